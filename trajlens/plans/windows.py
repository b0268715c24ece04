"""Sliding-window measures over the event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.operators import metrics as m
from trajlens.plans.registry import query
from trajlens.plans.sqltext import b1, b1l
from trajlens.sources import bind

R4 = "round(({}) + 1e-12, 4)"

ENTROPY_SQL = f"""WITH {b1()} SELECT session_id, step,
  {R4.format("entropy(symbol) OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING)")} AS entropy
FROM b1"""


def mi_sql(source: str, name: str, out: str = "mi") -> str:
    w = "OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING)"
    h = "CASE WHEN count({0}) {1} > 0 THEN entropy({0}) {1} ELSE 0 END"
    return f"""SELECT session_id, step,
  {R4.format("greatest(" + h.format("prev", w) + " + " + h.format("cur", w) + " - " + h.format("pair", w) + ", 0.0)")} AS {out}
FROM (SELECT session_id, step, prev, CASE WHEN prev IS NOT NULL THEN {name} END AS cur,
             CASE WHEN prev IS NOT NULL THEN prev || '|' || {name} END AS pair
      FROM (SELECT session_id, step, {name}, lag({name}) OVER (PARTITION BY session_id ORDER BY step) AS prev
            FROM {source}))"""


# The baseline and the current window as rows per (event, symbol), summed over the symbols seen.
KL_SQL = f"""WITH {b1l()},
first_seen AS (SELECT session_id, symbol, min(step) AS first_step,
                      count(*) FILTER (WHERE step <= 100) AS base FROM b1 GROUP BY ALL),
cells AS (
  SELECT e.session_id, e.step, s.symbol, s.base,
         (SELECT NULL) AS unused
  FROM b1 e JOIN first_seen s ON s.session_id = e.session_id AND s.first_step <= e.step),
own AS (SELECT session_id, step, symbol,
               row_number() OVER (PARTITION BY session_id, symbol ORDER BY step) AS nth FROM b1 WHERE step > 100),
cum AS (
  SELECT c.session_id, c.step, c.symbol, c.base,
         (SELECT count(*) FROM own o WHERE o.session_id = c.session_id AND o.symbol = c.symbol
            AND o.step <= c.step AND o.step > c.step - 50) AS cur FROM cells c),
terms AS (
  SELECT session_id, step, base, cur, count(*) OVER w AS k, sum(cur) OVER w AS n
  FROM cum WINDOW w AS (PARTITION BY session_id, step))
SELECT session_id, step, CASE WHEN step > 100 THEN
  {R4.format("greatest(sum((cur + 1) / (n + k) * log2(((cur + 1) / (n + k)) / ((base + 1) / (100 + k)))), 0.0)")}
  ELSE 0.0 END AS kl FROM terms GROUP BY session_id, step"""

SURPRISAL_SQL = f"""WITH {b1()}, seen AS (
  SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step) AS known,
         count(*) OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING) AS n,
         count(*) OVER (PARTITION BY session_id, symbol ORDER BY step RANGE 49 PRECEDING) AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, symbol ORDER BY step) AS nth FROM b1))
SELECT session_id, step, {R4.format("-log2(c / (n + known))")} AS surprisal FROM seen"""


@query("sliding_entropy", ENTROPY_SQL)
def sliding_entropy(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol")
    return m.sliding_entropy(ev).df.select("session_id", "step", "entropy")


@query("sliding_mi", f"WITH {b1()} {mi_sql('b1', 'symbol')}")
def sliding_mi(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol")
    return m.sliding_mi(ev).df.select("session_id", "step", "mi")


@query("sliding_compression")
def sliding_compression(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol")
    return m.sliding_compression(ev).df.select("session_id", "step", "compression")


@query("sliding_surprisal", SURPRISAL_SQL)
def sliding_surprisal(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol")
    return m.surprisal(ev).df.select("session_id", "step", "surprisal")


@query("baseline_kl", KL_SQL)
def baseline_kl(spark, sf_dir):
    ev = bind.long_events(spark, sf_dir).select("symbol")
    return m.baseline_kl(ev).df.select("session_id", "step", "kl")


@query("running_distinct_symbols", f"""WITH {b1()} SELECT session_id, step,
  CAST(sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step) AS BIGINT) AS distinct_symbols
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, symbol ORDER BY step) AS nth FROM b1)""")
def running_distinct_symbols(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol")
    return ev.distinct_so_far("symbol", "distinct_symbols").df.select("session_id", "step", "distinct_symbols")


@query("substream_entropy", f"""WITH {b1()},
sub AS (SELECT session_id, step, {R4.format("entropy(symbol) OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING)")} AS e
        FROM b1 WHERE event_type IN ('click', 'purchase'))
SELECT b1.session_id, b1.step,
       coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY b1.session_id ORDER BY b1.step), 0.0) AS tool_entropy
FROM b1 LEFT JOIN sub USING (session_id, step)""")
def substream_entropy(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol", "event_type")
    out = m.carried_entropy(ev, F.col("event_type").isin("click", "purchase"), "tool_entropy")
    return out.df.select("session_id", "step", "tool_entropy")


STAGE = {"view": "perception", "signup": "decision_making", "click": "action",
         "purchase": "feedback", "error": "working_memory"}
STAGE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE.items()) + " END"


def _flow_sql() -> str:
    w = "OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING)"
    cols = []
    for a, b in m.ADJACENT_STAGES:
        j = f"count(*) FILTER (WHERE prev = '{a}' AND stage = '{b}') {w}"
        x = f"count(*) FILTER (WHERE prev = '{a}') {w}"
        y = f"count(*) FILTER (WHERE prev IS NOT NULL AND stage = '{b}') {w}"
        n = f"count(prev) {w}"
        cols.append(f"CASE WHEN {j} > 0 THEN {R4.format(f'greatest(({j}) / ({n}) * log2(({j}) * ({n}) / (({x}) * ({y}))), 0.0)')} ELSE 0.0 END AS {a}_to_{b}")
    return f"""WITH {b1()}, s AS (SELECT session_id, step, {STAGE_CASE} AS stage FROM b1),
p AS (SELECT *, lag(stage) OVER (PARTITION BY session_id ORDER BY step) AS prev FROM s)
SELECT session_id, step, {', '.join(cols)} FROM p"""


@query("stage_flow", _flow_sql())
def stage_flow(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select(bind.lookup(F.col("event_type"), STAGE).alias("stage"))
    return m.stage_flow(ev).df.select("session_id", "step", *[f"{a}_to_{b}" for a, b in m.ADJACENT_STAGES])


FEEDBACK_SQL = f"""WITH {b1()},
a AS (SELECT *, event_type = 'error' AS fb,
        count(*) FILTER (WHERE event_type <> 'error') OVER w AS acts,
        last_value(CASE WHEN event_type = 'error' THEN 'fb' || (k % 3) END IGNORE NULLS) OVER w AS fb_symbol
      FROM b1 WINDOW w AS (PARTITION BY session_id ORDER BY step)),
b AS (SELECT *, last_value(CASE WHEN fb THEN acts END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY step) AS at_fb FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step) AS pair_no
      FROM b WHERE NOT fb AND fb_symbol IS NOT NULL AND acts - at_fb <= 5),
m AS (SELECT session_id, step, CASE WHEN pair_no < 2 THEN 0.0 ELSE
        {R4.format("greatest(entropy(fb_symbol) OVER w + entropy(symbol) OVER w - entropy(fb_symbol || '|' || symbol) OVER w, 0.0)")} END AS mi
      FROM p WINDOW w AS (PARTITION BY session_id ORDER BY pair_no ROWS 99 PRECEDING))
SELECT b1.session_id, b1.step,
       coalesce(last_value(mi IGNORE NULLS) OVER (PARTITION BY b1.session_id ORDER BY b1.step), 0.0) AS feedback_action_mi
FROM b1 LEFT JOIN m USING (session_id, step)"""


@query("feedback_action_mi", FEEDBACK_SQL)
def feedback_action_mi(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol", "event_type", "k")
    out = m.feedback_action_mi(ev, F.col("event_type") == "error",
                               F.concat(F.lit("fb"), (F.col("k") % 3).cast("string")))
    return out.df.select("session_id", "step", "feedback_action_mi")


@query("memory_flow", f"""WITH {b1()},
x AS (SELECT *, event_type IN ('purchase', 'signup') AS wr, event_type = 'view' AS rd, k % 10 AS resource FROM b1),
y AS (SELECT *, min(CASE WHEN wr THEN step END) OVER (PARTITION BY session_id, resource) AS first_write FROM x),
c AS (SELECT session_id, step, count(*) FILTER (WHERE wr) OVER w AS nw,
        count(*) FILTER (WHERE rd AND first_write < step) OVER w AS nr,
        greatest(count(*) FILTER (WHERE wr OR rd) OVER w, 1) AS n
      FROM y WINDOW w AS (PARTITION BY session_id ORDER BY step))
SELECT session_id, step, {R4.format("least(nw, 30) / n")} AS consolidation_rate,
       {R4.format("least(nr, 30) / n")} AS retrieval_rate FROM c""")
def memory_flow(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("event_type", (F.col("k") % 10).alias("resource"))
    out = m.memory_flow(ev, F.col("event_type").isin("purchase", "signup"),
                        F.col("event_type") == "view", "resource")
    return out.df.select("session_id", "step", "consolidation_rate", "retrieval_rate")


@query("step_metrics")
def step_metrics(spark, sf_dir):
    ev = bind.long_events(spark, sf_dir).select("symbol")
    return m.step_metrics(ev).df.select(
        "session_id", "step", "action_entropy", "action_mi", "last_surprisal", "kl_divergence",
        "compression_ratio")
