"""Coordination of agents over one interleaved event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.operators import coordination as co
from trajlens.operators import matching as ma
from trajlens.plans.registry import query
from trajlens.plans.sqltext import B1A
from trajlens.sources import bind

LAST = """SELECT a.step, a.agent_id AS me, b.agent_id AS other, a.resource, max(b.step) AS other_step
  FROM b1a a JOIN b1a b ON a.resource = b.resource AND b.step < a.step AND b.agent_id <> a.agent_id
  WHERE a.{mine} AND b.{theirs} {near} GROUP BY ALL"""
NEAR = "AND a.step - b.step <= 20"

SIGNALS = B1A + f""", wr AS ({LAST.format(mine='is_read', theirs='is_write', near=NEAR)}),
sig AS (SELECT other AS source_agent, me AS target_agent, resource, other_step AS source_step, step AS target_step, step - other_step AS latency_steps FROM wr)"""
FAILURES = B1A + f""", ww AS ({LAST.format(mine='is_write', theirs='is_write', near=NEAR)}),
rw AS ({LAST.format(mine='is_write', theirs='is_read', near=NEAR)}), sr AS ({LAST.format(mine='is_write', theirs='is_read', near='')}),
fail AS (SELECT 'race_condition' AS failure_type, me AS agent, other AS other_agent, resource, step, step - other_step AS gap FROM ww
  UNION ALL SELECT 'concurrent_modification', me, other, resource, step, step - other_step FROM rw
  UNION ALL SELECT 'stale_read', other, me, resource, step, step - other_step FROM sr WHERE step - other_step > 20)"""


@query("write_read_signals", f"WITH {SIGNALS} SELECT * FROM sig")
def write_read_signals(spark, sf_dir):
    return co.write_read_signals(bind.agent_events(spark, sf_dir))


@query("write_conflicts", f"WITH {FAILURES} SELECT * FROM fail WHERE failure_type <> 'stale_read'")
def write_conflicts(spark, sf_dir):
    return co.write_conflicts(bind.agent_events(spark, sf_dir))


@query("stale_reads", f"WITH {FAILURES} SELECT * FROM fail WHERE failure_type = 'stale_read'")
def stale_reads(spark, sf_dir):
    return co.stale_reads(bind.agent_events(spark, sf_dir))


@query("agent_dependencies", f"""WITH {SIGNALS} SELECT source_agent AS producer, target_agent AS consumer, count(*) AS signal_count,
  CASE WHEN count(*) >= 5 THEN 'strong' WHEN count(*) >= 2 THEN 'moderate' ELSE 'weak' END AS strength FROM sig GROUP BY ALL""")
def agent_dependencies(spark, sf_dir):
    return co.dependencies(co.write_read_signals(bind.agent_events(spark, sf_dir)))


@query("agent_pair_status", f"""WITH {FAILURES} SELECT least(agent, other_agent) AS agent_a, greatest(agent, other_agent) AS agent_b,
  count(*) FILTER (WHERE failure_type = 'race_condition') AS race_condition,
  count(*) FILTER (WHERE failure_type = 'concurrent_modification') AS concurrent_modification,
  count(*) FILTER (WHERE failure_type = 'stale_read') AS stale_read,
  CASE WHEN count(*) FILTER (WHERE failure_type <> 'concurrent_modification') > 0 THEN 'warning' ELSE 'normal' END AS status
FROM fail GROUP BY ALL""")
def agent_pair_status(spark, sf_dir):
    ev = bind.agent_events(spark, sf_dir)
    return co.pair_status(co.write_conflicts(ev).unionByName(co.stale_reads(ev)))


@query("agent_activity", f"""WITH {B1A} SELECT agent_id, count(*) AS events, count(DISTINCT CASE WHEN is_read THEN resource END) AS resources_read,
  count(DISTINCT CASE WHEN is_write THEN resource END) AS resources_written, max(step) FILTER (WHERE is_read) AS last_read,
  max(step) FILTER (WHERE is_write) AS last_write FROM b1a GROUP BY agent_id""")
def agent_activity(spark, sf_dir):
    return co.agent_activity(bind.agent_events(spark, sf_dir))


@query("last_access", f"""WITH {B1A} SELECT agent_id, resource, max(step) FILTER (WHERE is_read) AS last_read,
  max(step) FILTER (WHERE is_write) AS last_write, count(*) AS accesses FROM b1a GROUP BY ALL""")
def last_access(spark, sf_dir):
    ev = bind.agent_events(spark, sf_dir)
    return ev.df.groupBy("agent_id", "resource").agg(
        F.max(F.when(F.col("is_read"), F.col("step"))).alias("last_read"),
        F.max(F.when(F.col("is_write"), F.col("step"))).alias("last_write"), F.count("*").alias("accesses"))


# The queue of each two agents as a fold over the list of their actions.
MATCHED = B1A + """, ag AS (SELECT DISTINCT session_id, agent_id FROM b1a),
ps AS (SELECT b1a.session_id, least(b1a.agent_id, ag.agent_id) AS agent_a, greatest(b1a.agent_id, ag.agent_id) AS agent_b, CASE WHEN b1a.agent_id < ag.agent_id THEN 0 ELSE 1 END AS side, symbol, step
  FROM b1a JOIN ag ON ag.session_id = b1a.session_id AND ag.agent_id <> b1a.agent_id),
pl AS (SELECT session_id, agent_a, agent_b, list({'q': [{'side': side, 'symbol': symbol, 'step': step}], 'made': CAST([] AS STRUCT(pair_step BIGINT, symbol_a VARCHAR, step_a BIGINT, symbol_b VARCHAR, step_b BIGINT)[])} ORDER BY step) AS xs
  FROM ps GROUP BY ALL),
pf AS (SELECT session_id, agent_a, agent_b, list_reduce(xs, lambda acc, x: CASE
    WHEN len(acc.q) = 0 OR acc.q[1].side = x.q[1].side THEN {'q': list_concat(acc.q, x.q)[-50:], 'made': acc.made}
    WHEN x.q[1].step - acc.q[-1].step > 10 THEN {'q': x.q, 'made': acc.made}
    ELSE {'q': list_filter(acc.q, lambda e: x.q[1].step - e.step <= 10)[2:], 'made': list_append(acc.made, CASE WHEN x.q[1].side = 0
      THEN {'pair_step': x.q[1].step, 'symbol_a': x.q[1].symbol, 'step_a': x.q[1].step, 'symbol_b': list_filter(acc.q, lambda e: x.q[1].step - e.step <= 10)[1].symbol, 'step_b': list_filter(acc.q, lambda e: x.q[1].step - e.step <= 10)[1].step}
      ELSE {'pair_step': x.q[1].step, 'symbol_a': list_filter(acc.q, lambda e: x.q[1].step - e.step <= 10)[1].symbol, 'step_a': list_filter(acc.q, lambda e: x.q[1].step - e.step <= 10)[1].step, 'symbol_b': x.q[1].symbol, 'step_b': x.q[1].step} END)} END) AS f FROM pl),
mp AS (SELECT session_id, agent_a, agent_b, unnest(f.made, recursive := true) FROM pf),
mn AS (SELECT *, row_number() OVER (PARTITION BY session_id, agent_a, agent_b ORDER BY pair_step) AS pair_no FROM mp),
mi AS (SELECT *, round(greatest(entropy(symbol_a) OVER w + entropy(symbol_b) OVER w - entropy(symbol_a || '|' || symbol_b) OVER w, 0) + 1e-12, 4) AS information
  FROM mn WINDOW w AS (PARTITION BY session_id, agent_a, agent_b ORDER BY pair_step ROWS 99 PRECEDING))"""


@query("cross_agent_information", f"WITH {MATCHED} SELECT session_id, agent_a, agent_b, pair_no, pair_step, symbol_a, step_a, symbol_b, step_b, information FROM mi")
def cross_agent_information(spark, sf_dir):
    ev = bind.agent_events(spark, sf_dir)
    return ma.shared_information(ma.matched_pairs(ev), ["session_id"], chunk_rows=ev.chunk_rows).result()


@query("information_edges", f"""WITH {MATCHED} SELECT session_id, agent_a, agent_b, least(max(pair_no), 100) AS pairs, arg_max(information, pair_no) AS information FROM mi GROUP BY ALL""")
def information_edges(spark, sf_dir):
    ev = bind.agent_events(spark, sf_dir)
    return ma.information_edges(ma.shared_information(ma.matched_pairs(ev), ["session_id"], chunk_rows=ev.chunk_rows))
