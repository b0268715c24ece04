"""Stage-by-stage agent state, decision points, memory and contract adherence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trajlens.operators import cognition as cg
from trajlens.operators.phases import phase_machine
from trajlens.plans.registry import query
from trajlens.plans.sqltext import b1, b1t
from trajlens.sources import bind

T = b1t()
O = "(PARTITION BY session_id ORDER BY step)"


def trace(spark, sf_dir, *cols):
    ev = bind.trace_events(spark, sf_dir)
    return ev.select(*cols) if cols else ev


PERCEPTION = f"""pe0 AS (SELECT session_id, step, tool = 'read_file' AS rd, output_hash, row_number() OVER (PARTITION BY session_id, tool = 'read_file', output_hash ORDER BY step) AS nth FROM bt),
pe AS (SELECT session_id, step, least(count(*) FILTER (WHERE rd AND nth = 1) OVER {O} / 20.0, 1.0) AS perception_breadth,
  least(count(*) FILTER (WHERE rd) OVER {O} / 40.0, 1.0) AS perception_depth,
  round(greatest(0.0, 1 - (step - coalesce(max(CASE WHEN rd THEN step END) OVER {O}, 0)) / 20.0), 6) AS perception_recency FROM pe0)"""
ATTENTION = f"""at0 AS (SELECT session_id, step, output_hash, row_number() OVER {O} AS n, row_number() OVER (PARTITION BY session_id, output_hash ORDER BY step) AS nth FROM bt WHERE tool = 'read_file'),
at1 AS (SELECT session_id, step, least(n, 20) AS m, count(DISTINCT output_hash) OVER (PARTITION BY session_id ORDER BY step ROWS 19 PRECEDING) / least(n, 20) AS dv,
   sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER {O} AS known FROM at0),
at2 AS (SELECT session_id, step, round(dv, 6) AS d, round(1 - dv, 6) AS f, round(CASE WHEN known > 1 AND m > 1 THEN 1 - dv ELSE 0 END, 6) AS t FROM at1),
atn AS (SELECT b.session_id, b.step, coalesce(last_value(d IGNORE NULLS) OVER w, 0.0) AS attention_diversity, coalesce(last_value(f IGNORE NULLS) OVER w, 0.0) AS attention_focus,
   coalesce(last_value(t IGNORE NULLS) OVER w, 0.0) AS attention_tunnel_risk FROM bt b LEFT JOIN at2 USING (session_id, step) WINDOW w AS (PARTITION BY b.session_id ORDER BY b.step))"""
MEMORY = f"""me0 AS (SELECT *, row_number() OVER (PARTITION BY session_id, output_hash ORDER BY step) AS nth FROM bt),
me1 AS (SELECT session_id, step, least(sum(tokens_in + tokens_out) OVER {O} / 200000, 1.0) AS u, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER {O} AS items,
   count(DISTINCT output_hash) OVER (PARTITION BY session_id ORDER BY step ROWS 50 PRECEDING) AS act, count(DISTINCT output_hash) OVER (PARTITION BY session_id ORDER BY step ROWS 20 PRECEDING) AS fr FROM me0),
me AS (SELECT session_id, step, round(u, 6) AS memory_utilization, CAST(items - act AS BIGINT) AS memory_at_risk, round(fr / act, 6) AS memory_recency_bias FROM me1)"""
DECISION = f"""de0 AS (SELECT session_id, step, type = 'reasoning' AS th, max(CASE WHEN type <> 'reasoning' THEN step END) OVER {O} AS lastno FROM bt),
de1 AS (SELECT session_id, step, CASE WHEN th THEN least((step - coalesce(lastno, 0)) / 4.0, 1.0) ELSE 0.0 END AS decision_deliberation FROM de0),
dt0 AS (SELECT session_id, step, tool, row_number() OVER (PARTITION BY session_id, tool ORDER BY step) AS nth FROM bt WHERE tool IS NOT NULL),
dt1 AS (SELECT session_id, step, round(least(count(DISTINCT tool) OVER (PARTITION BY session_id ORDER BY step ROWS 9 PRECEDING) / sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER {O}, 1.0), 6) AS o FROM dt0),
dl0 AS (SELECT session_id, step, list(latency_ms) OVER (PARTITION BY session_id ORDER BY step ROWS 9 PRECEDING) AS l FROM bt WHERE latency_ms > 0),
dl1 AS (SELECT session_id, step, len(l) AS n, list_avg(l[1:len(l) // 2]) AS a, list_avg(l[len(l) // 2 + 1:]) AS b FROM dl0),
dl2 AS (SELECT session_id, step, round(CASE WHEN n >= 3 THEN least(greatest((b - a) / a, -1.0), 1.0) ELSE 0.0 END, 6) AS t FROM dl1),
den AS (SELECT b.session_id, b.step, decision_deliberation, coalesce(last_value(o IGNORE NULLS) OVER w, 0.0) AS decision_options, coalesce(last_value(t IGNORE NULLS) OVER w, 0.0) AS decision_latency_trend
  FROM bt b JOIN de1 USING (session_id, step) LEFT JOIN dt1 USING (session_id, step) LEFT JOIN dl2 USING (session_id, step) WINDOW w AS (PARTITION BY b.session_id ORDER BY b.step))"""
ACTION = f"""ac0 AS (SELECT session_id, step, tool, input_hash, success, CASE WHEN lag(tool || input_hash) OVER {O} = tool || input_hash THEN 0 ELSE 1 END AS chg, row_number() OVER {O} AS no FROM bt WHERE type = 'tool_call'),
ac1 AS (SELECT *, no - max(CASE WHEN chg = 1 THEN no END) OVER {O} + 1 AS same, count(DISTINCT tool) OVER (PARTITION BY session_id ORDER BY step ROWS 9 PRECEDING) AS nt,
   avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session_id ORDER BY step ROWS 9 PRECEDING) AS ok FROM ac0),
ac2 AS (SELECT b.session_id, b.step, coalesce(last_value(nt IGNORE NULLS) OVER w, 0) AS nt, round(coalesce(last_value(ok IGNORE NULLS) OVER w, 1.0), 6) AS action_success_rate,
   round(least(coalesce(last_value(same IGNORE NULLS) OVER w, 0) / 9.0, 1.0), 6) AS action_repetition_risk, b.tool FROM bt b LEFT JOIN ac1 USING (session_id, step) WINDOW w AS (PARTITION BY b.session_id ORDER BY b.step)),
ac3 AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool ORDER BY step) AS nth FROM ac2),
acn AS (SELECT session_id, step, action_success_rate, action_repetition_risk, round(least(nt / greatest(count(*) FILTER (WHERE tool IS NOT NULL AND nth = 1) OVER {O}, 1), 1.0), 6) AS action_diversity FROM ac3)"""
FEEDBACK = f"""fe0 AS (SELECT session_id, step, count(*) FILTER (WHERE phase_rank = 4) OVER (PARTITION BY session_id ORDER BY step ROWS 19 PRECEDING) AS v, count(*) FILTER (WHERE phase_rank = 3) OVER (PARTITION BY session_id ORDER BY step ROWS 19 PRECEDING) AS e,
   count(*) FILTER (WHERE phase_rank = 4 AND from_rank = 3) OVER {O} AS cl, count(*) FILTER (WHERE phase_rank = 3) OVER {O} AS ex FROM bm),
fc0 AS (SELECT session_id, step, tool, NOT lag(success) OVER {O} AS aft, lag(tool) OVER {O} <> tool AS mv FROM bt WHERE type = 'tool_call'),
fc1 AS (SELECT session_id, step, count(*) FILTER (WHERE aft) OVER {O} AS er, count(*) FILTER (WHERE aft AND mv) OVER {O} AS ch FROM fc0),
fen AS (SELECT f.session_id, f.step, round(CASE WHEN e > 0 THEN least(v / e, 1.0) ELSE 0.0 END, 6) AS feedback_verify_ratio, round(CASE WHEN ex > 0 THEN least(cl / ex, 1.0) ELSE 0.0 END, 6) AS feedback_loop_closed,
   round(coalesce(last_value(CASE WHEN er > 0 THEN ch / er WHEN er = 0 THEN 1.0 END IGNORE NULLS) OVER (PARTITION BY f.session_id ORDER BY f.step), 1.0), 6) AS feedback_error_response FROM fe0 f LEFT JOIN fc1 USING (session_id, step))"""


@query("cognition_perception", f"WITH {T}, {PERCEPTION} SELECT session_id, step, CAST(perception_breadth AS DOUBLE) AS perception_breadth, CAST(perception_depth AS DOUBLE) AS perception_depth, CAST(perception_recency AS DOUBLE) AS perception_recency FROM pe")
def cognition_perception(spark, sf_dir):
    return cg.perception(trace(spark, sf_dir, "tool", "output_hash")).df.select(
        "session_id", "step", "perception_breadth", "perception_depth", "perception_recency")


@query("cognition_attention", f"WITH {T}, {ATTENTION} SELECT * FROM atn")
def cognition_attention(spark, sf_dir):
    return cg.attention(trace(spark, sf_dir, "tool", "output_hash")).df.select(
        "session_id", "step", "attention_diversity", "attention_focus", "attention_tunnel_risk")


@query("cognition_memory", f"WITH {T}, {MEMORY} SELECT * FROM me")
def cognition_memory(spark, sf_dir):
    return cg.working_memory(trace(spark, sf_dir, "output_hash", "input_hash", "tokens_in", "tokens_out")).df.select(
        "session_id", "step", "memory_utilization", "memory_at_risk", "memory_recency_bias")


@query("cognition_decision", f"WITH {T}, {DECISION} SELECT session_id, step, CAST(decision_deliberation AS DOUBLE) AS decision_deliberation, decision_options, decision_latency_trend FROM den")
def cognition_decision(spark, sf_dir):
    return cg.decision(trace(spark, sf_dir, "type", "tool", "latency_ms")).df.select(
        "session_id", "step", "decision_deliberation", "decision_options", "decision_latency_trend")


@query("cognition_action", f"WITH {T}, {ACTION} SELECT session_id, step, action_diversity, action_success_rate, CAST(action_repetition_risk AS DOUBLE) AS action_repetition_risk FROM acn")
def cognition_action(spark, sf_dir):
    return cg.action(trace(spark, sf_dir, "type", "tool", "input_hash", "success")).df.select(
        "session_id", "step", "action_diversity", "action_success_rate", "action_repetition_risk")


@query("cognition_feedback", f"WITH {T}, {FEEDBACK} SELECT * FROM fen")
def cognition_feedback(spark, sf_dir):
    ev = phase_machine(trace(spark, sf_dir, "type", "tool", "success"))
    return cg.feedback(ev).df.select("session_id", "step", "feedback_verify_ratio", "feedback_loop_closed", "feedback_error_response")


LOADS = """ld AS (SELECT session_id, step, round(1 - (0.4 * perception_recency + 0.3 * perception_breadth + 0.3 * perception_depth) + 1e-9, 3) AS load_perception,
  round(0.6 * attention_tunnel_risk + 0.4 * (1 - attention_diversity) + 1e-9, 3) AS load_attention, round(memory_utilization + 1e-9, 3) AS load_working_memory,
  round(0.6 * decision_deliberation + 0.4 * greatest(decision_latency_trend, 0.0) + 1e-9, 3) AS load_decision_making,
  round(0.5 * (1 - action_success_rate) + 0.5 * action_repetition_risk + 1e-9, 3) AS load_action,
  round(0.5 * (1 - feedback_verify_ratio) + 0.5 * (1 - feedback_loop_closed) + 1e-9, 3) AS load_feedback,
  round(0.15 * (1 - perception_recency) + 0.15 * attention_tunnel_risk + 0.25 * memory_utilization + 0.15 * decision_deliberation + 0.15 * (1 - action_success_rate) + 0.15 * (1 - feedback_verify_ratio) + 1e-9, 3) AS overall_load
  FROM pe JOIN atn USING (session_id, step) JOIN me USING (session_id, step) JOIN den USING (session_id, step) JOIN acn USING (session_id, step) JOIN fen USING (session_id, step)),
mx AS (SELECT *, greatest(load_perception, load_attention, load_working_memory, load_decision_making, load_action, load_feedback) AS mxl FROM ld)"""


@query("cognition_load", f"""WITH {T}, {PERCEPTION}, {ATTENTION}, {MEMORY}, {DECISION}, {ACTION}, {FEEDBACK}, {LOADS}
SELECT session_id, step, CAST(overall_load AS DOUBLE) AS overall_load, CASE WHEN mxl <= 0.3 THEN '' WHEN load_perception = mxl THEN 'perception' WHEN load_attention = mxl THEN 'attention'
  WHEN load_working_memory = mxl THEN 'working_memory' WHEN load_decision_making = mxl THEN 'decision_making' WHEN load_action = mxl THEN 'action' ELSE 'feedback' END AS bottleneck FROM mx""")
def cognition_load(spark, sf_dir):
    ev = phase_machine(trace(spark, sf_dir, "type", "tool", "input_hash", "output_hash", "success", "latency_ms", "tokens_in", "tokens_out"))
    for stage in (cg.perception, cg.attention, cg.working_memory, cg.decision, cg.action, cg.feedback):
        ev = stage(ev)
    return cg.load(ev.df).select("session_id", "step", "overall_load", "bottleneck")


@query("memory_items", f"""WITH {T}, e AS (SELECT *, max(step) OVER (PARTITION BY session_id) AS fin FROM bt)
SELECT session_id, output_hash AS resource, min(step) AS first_step, max(step) AS last_step, count(*) AS accesses, max(tokens_in + tokens_out) AS tokens,
  round(least(0.6 * greatest(0.0, 1 - (any_value(fin) - max(step)) / 50.0) + 0.4 * least(count(*) / 5.0, 1.0), 1.0) + 1e-9, 3)::DOUBLE AS retention,
  CASE WHEN any_value(fin) - max(step) <= 50 THEN 'active' ELSE 'at_risk' END AS state FROM e GROUP BY ALL""")
def memory_items(spark, sf_dir):
    return cg.memory_items(trace(spark, sf_dir, "output_hash", "input_hash", "tokens_in", "tokens_out"))


DECISIONS = f"""dz AS (SELECT *, count(*) FILTER (WHERE type = 'reasoning') OVER {O} AS block, lag(output_hash) OVER {O} AS lh,
   sum(CASE WHEN type = 'reasoning' THEN latency_ms ELSE 0 END) OVER {O} AS th, max(CASE WHEN type = 'reasoning' THEN step END) OVER (PARTITION BY session_id) AS lt FROM bm),
dc AS (SELECT *, row_number() OVER (PARTITION BY session_id, block ORDER BY step) - 1 AS j, lag(th) OVER {O} AS tb FROM dz WHERE type = 'tool_call'),
dp AS (SELECT a.session_id, a.step AS action_step, a.tool AS action_tool, a.success AS action_success, round(CASE WHEN a.j = 0 THEN a.th - coalesce(a.tb, 0) ELSE 0.0 END, 1) AS deliberation_ms,
   count(b.step) AS outcome_steps, coalesce(bool_or(b.output_hash <> b.lh OR b.lh IS NULL) FILTER (WHERE b.step IS NOT NULL), false) AS changed_state,
   coalesce(bool_or(b.phase_rank = 4), false) AS verified, count(b.step) = 5 OR coalesce(any_value(a.lt) > a.step, false) AS closed
  FROM dc a LEFT JOIN dc b ON a.session_id = b.session_id AND a.block = b.block AND b.j BETWEEN a.j + 1 AND a.j + 5 WHERE a.j % 5 = 0
  GROUP BY a.session_id, a.step, a.tool, a.success, a.j, a.th, a.tb)"""


def points(spark, sf_dir):
    return cg.decision_points(phase_machine(trace(spark, sf_dir, "type", "tool", "output_hash", "success", "latency_ms")))


@query("decision_points", f"WITH {T}, {DECISIONS} SELECT * FROM dp")
def decision_points(spark, sf_dir):
    return points(spark, sf_dir)


@query("decision_quality", f"""WITH {T}, {DECISIONS} SELECT session_id, count(*) AS decisions, round(avg(action_success::INT), 3) AS action_success_rate,
  round(avg(deliberation_ms) + 1e-9, 1) AS mean_deliberation_ms, round(avg(verified::INT), 3) AS verified_rate, round(avg(changed_state::INT), 3) AS changed_state_rate
FROM dp WHERE closed GROUP BY session_id""")
def decision_quality(spark, sf_dir):
    return cg.decision_quality(points(spark, sf_dir), ["session_id"])


MIX = {"test": 0.0, "frontend": 0.5, "backend": 0.3, "config": 0.0, "other": 0.2}
CATS = ["frontend", "backend", "test", "config", "other"]


def _drift_sql():
    cat = "(['" + "', '".join(CATS) + "'])[k % 5 + 1]"
    terms = []
    for n, q in MIX.items():
        c = f"count(*) FILTER (WHERE cat = '{n}') OVER {O}"
        p = f"greatest(({c}) / (count(*) OVER {O}), 1e-6)"
        terms.append(f"CASE WHEN {q} > 0 OR ({c}) > 0 THEN {p} * log2({p} / {max(q, 1e-6)}::DOUBLE) ELSE 0 END")
    return f"""WITH {b1()}, c AS (SELECT session_id, step, k, {cat} AS cat FROM b1),
d AS (SELECT session_id, step, round(avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session_id ORDER BY step ROWS 29 PRECEDING) + 1e-9, 3) AS adherence,
  round(greatest({' + '.join(terms)}, 0.0) + 1e-9, 4) AS scope_drift FROM c)
SELECT *, CASE WHEN step >= 20 AND adherence < 0.3 THEN 'scope_deviation' WHEN step > 30 AND scope_drift > 2.0 THEN 'scope_drift' END AS anomaly FROM d"""


@query("contract_adherence", _drift_sql())
def contract_adherence(spark, sf_dir):
    cat = F.element_at(F.array(*[F.lit(c) for c in CATS]), (F.col("k") % 5 + 1).cast("int"))
    ev = bind.events(spark, sf_dir).select("k")
    return cg.contract(ev, F.col("k") % 3 == 0, cat, MIX).df.select("session_id", "step", "adherence", "scope_drift", "anomaly")
