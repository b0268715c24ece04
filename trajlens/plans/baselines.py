"""Phase baselines, self-calibrated anomalies, signatures and change points."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from trajlens.functions.events import phase_name
from trajlens.operators import baselines as bl
from trajlens.operators import metrics, phases
from trajlens.plans.phases import SEGMENTS_SQL, segment_table
from trajlens.plans.registry import query
from trajlens.plans.sqltext import b1, b1l, b1t
from trajlens.plans.windows import KL_SQL
from trajlens.sources import bind

CELLS = ("SELECT session_id, segment_id, phase, unnest(['" + "', '".join(bl.PHASE_METRICS) + "']) AS metric, unnest([" + ", ".join(
    f"CAST({m} AS DOUBLE)" for m in bl.PHASE_METRICS) + "]) AS value FROM ss")
DIST = f"""{b1t()}, {SEGMENTS_SQL}, cells AS ({CELLS}),
dist AS (SELECT phase, metric, count(*) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0.0), 4) AS std,
  round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.95), 4) AS p95 FROM cells GROUP BY ALL)"""


@query("phase_distributions", f"WITH {DIST} SELECT * FROM dist")
def phase_distributions(spark, sf_dir):
    return bl.phase_distributions(segment_table(spark, sf_dir))


@query("segment_scores", f"""WITH {DIST} SELECT session_id, segment_id, phase, metric, value, n >= 3 AND value > p95 AS is_anomalous
FROM cells JOIN dist USING (phase, metric)""")
def segment_scores(spark, sf_dir):
    seg = segment_table(spark, sf_dir)
    return bl.score_segments(seg, bl.phase_distributions(seg))


B1P = b1() + """, mv AS (SELECT session_id, lag(phase) OVER (PARTITION BY session_id ORDER BY step) AS from_phase, phase AS to_phase FROM b1)"""


@query("transition_model", f"""WITH {B1P}, c AS (SELECT from_phase, to_phase, count(*) AS n FROM mv WHERE from_phase <> to_phase GROUP BY ALL)
SELECT from_phase, to_phase, n, round(n / sum(n) OVER (PARTITION BY from_phase), 6) AS probability,
  n / sum(n) OVER (PARTITION BY from_phase) < 0.05 AS is_rare FROM c""")
def transition_model(spark, sf_dir):
    ev = bind.with_phase(bind.events(spark, sf_dir).select("event_type")).frame(
        1, 0, {"from_phase": lambda w: F.lag("phase").over(w)})
    moves = ev.df.where(F.col("from_phase") != F.col("phase")).withColumnRenamed("phase", "to_phase")
    return bl.transition_model(moves)


def phase_tools(spark, sf_dir):
    """(session, step, phase, tool) with the tool named by event type and value band."""
    ev = bind.with_phase(bind.events(spark, sf_dir))
    return ev.with_columns(tool=F.concat_ws("-", "event_type", (F.col("k") % 6).cast("string"))).select("phase", "tool")


PT = b1() + ", pt AS (SELECT *, event_type || '-' || (k % 6) AS tool FROM b1)"


@query("phase_tool_shares", f"""WITH {PT} SELECT phase, tool, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY phase), 6) AS share
FROM pt GROUP BY phase, tool""")
def phase_tool_shares(spark, sf_dir):
    out = bl.share_table(phase_tools(spark, sf_dir).df, ["phase"], "tool")
    return out.select("phase", "tool", "n", F.round("share", 6).alias("share"))


@query("phase_bigram_shares", f"""WITH {b1t()}, sg AS (SELECT *, (['idle','gathering','planning','executing','verifying','delivering'])[phase_rank + 1] AS ph,
  lag(phase_rank) OVER (PARTITION BY session_id ORDER BY step) AS pr, lag(tool) OVER (PARTITION BY session_id ORDER BY step) AS pt FROM bm),
bg AS (SELECT ph AS phase, pt || '>' || tool AS bigram FROM sg WHERE pr = phase_rank AND pt IS NOT NULL AND tool IS NOT NULL)
SELECT phase, bigram, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY phase), 6) AS share FROM bg GROUP BY phase, bigram""")
def phase_bigram_shares(spark, sf_dir):
    ev = phases.phase_machine(bind.trace_events(spark, sf_dir).select("type", "tool")).frame(1, 0, {
        "_pp": lambda w: F.lag("phase_rank").over(w), "_pt": lambda w: F.lag("tool").over(w)})
    grams = ev.df.where((F.col("_pp") == F.col("phase_rank")) & F.col("_pt").isNotNull() & F.col("tool").isNotNull()).select(
        phase_name(F.col("phase_rank")).alias("phase"), F.concat_ws(">", "_pt", "tool").alias("bigram"))
    out = bl.share_table(grams, ["phase"], "bigram")
    return out.select("phase", "bigram", "n", F.round("share", 6).alias("share"))


SPLIT = PT + """, ex AS (SELECT phase, tool, count(*) / sum(count(*)) OVER (PARTITION BY phase) AS q FROM pt WHERE session_id % 20 = 0 GROUP BY phase, tool),
ob AS (SELECT session_id, phase, tool, count(*) / sum(count(*)) OVER (PARTITION BY session_id, phase) AS p FROM pt WHERE session_id % 20 <> 0 GROUP BY session_id, phase, tool)"""


def split_shares(spark, sf_dir):
    df = phase_tools(spark, sf_dir).df
    fitted = bl.share_table(df.where("session_id % 20 = 0"), ["phase"], "tool")
    seen = bl.share_table(df.where("session_id % 20 <> 0"), ["session_id", "phase"], "tool")
    return seen, fitted


@query("tool_divergence", f"""WITH {SPLIT}, k AS (SELECT DISTINCT session_id, ob.phase FROM ob JOIN ex ON ob.phase = ex.phase),
f AS (SELECT k.session_id, k.phase, ex.tool, coalesce(p, 0) AS p, q FROM k JOIN ex ON ex.phase = k.phase
        LEFT JOIN ob ON ob.session_id = k.session_id AND ob.phase = k.phase AND ob.tool = ex.tool
      UNION ALL SELECT session_id, phase, tool, p, 0 FROM ob WHERE (phase, tool) NOT IN (SELECT (phase, tool) FROM ex) AND phase IN (SELECT phase FROM ex))
SELECT session_id, phase, round(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
   + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0.0), 6) AS divergence FROM f GROUP BY ALL""")
def tool_divergence(spark, sf_dir):
    return bl.tool_divergence(*split_shares(spark, sf_dir))


@query("novel_tools", f"""WITH {SPLIT} SELECT session_id, phase, count(*) AS tools, count(*) FILTER (WHERE ex.tool IS NULL) AS novel,
  round(count(*) FILTER (WHERE ex.tool IS NULL) / count(*), 6) AS novel_ratio FROM ob LEFT JOIN ex USING (phase, tool)
WHERE phase IN (SELECT phase FROM ex) GROUP BY ALL HAVING count(*) FILTER (WHERE ex.tool IS NULL) > 0""")
def novel_tools(spark, sf_dir):
    return bl.novel_tools(*split_shares(spark, sf_dir))


METRICS = ("action_entropy", "action_mi", "last_surprisal", "kl_divergence")
_W = "OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING)"
MET = KL_SQL.rsplit("SELECT session_id, step, CASE WHEN step > 100", 1)[0].rstrip() + f""",
klv AS (SELECT session_id, step, CASE WHEN step > 100{KL_SQL.rsplit("SELECT session_id, step, CASE WHEN step > 100", 1)[1]}),
lg AS (SELECT session_id, step, symbol, lag(symbol) OVER (PARTITION BY session_id ORDER BY step) AS prev,
   row_number() OVER (PARTITION BY session_id, symbol ORDER BY step) AS nth FROM b1),
m0 AS (SELECT session_id, step, round(entropy(symbol) {_W} + 1e-12, 4) AS action_entropy,
   CASE WHEN step = 1 THEN 0.0 ELSE round(greatest(entropy(prev) {_W} + entropy(CASE WHEN step > 1 THEN symbol END) {_W}
      - entropy(CASE WHEN step > 1 THEN prev || '|' || symbol END) {_W}, 0.0) + 1e-12, 4) END AS action_mi,
   round(-log2(count(*) OVER (PARTITION BY session_id, symbol ORDER BY step RANGE 49 PRECEDING)
      / (count(*) {_W} + sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step))) + 1e-12, 4) AS last_surprisal FROM lg),
met AS (SELECT m0.*, kl AS kl_divergence FROM m0 JOIN klv USING (session_id, step)),
st AS (SELECT session_id, {', '.join(f"avg({m}) FILTER (WHERE step <= 100) AS mean_{m}, stddev_samp({m}) FILTER (WHERE step <= 100) AS std_{m}" for m in METRICS)} FROM met GROUP BY session_id),
an AS (""" + " UNION ALL ".join(f"""SELECT session_id, step, '{m}' AS metric, {m} AS value, round(z, 2) AS z_score,
   CASE WHEN {m} > mean_{m} THEN 'high' ELSE 'low' END AS direction FROM (SELECT met.*, mean_{m}, CASE WHEN std_{m} < 1e-10
     THEN CASE WHEN abs({m} - mean_{m}) > 1e-6 THEN 3.0 END ELSE abs({m} - mean_{m}) / std_{m} END AS z
   FROM met JOIN st USING (session_id)) WHERE step > 100 AND z > 2.0""" for m in METRICS) + ")"


def numbered(spark, sf_dir, *more):
    """The steps with their symbol and ``more`` columns, numbered once: measures and baselines read them several times."""
    return bind.long_events(spark, sf_dir, columns=("symbol", *more)).kept()


def measured(spark, sf_dir, ev=None):
    """The step metrics of ``ev``, by default of all steps.

    They look back only, so those of the calibration come from the first steps alone.
    """
    ev = (numbered(spark, sf_dir) if ev is None else ev).select("symbol")
    whole = metrics.step_metrics(ev, compression=False)
    return replace(whole, early=metrics.step_metrics(ev.first(metrics.BASELINE), compression=False).df) if ev.split else whole


def scored(spark, sf_dir, ev=None):
    return bl.calibrated(measured(spark, sf_dir, ev), METRICS)


def signatures(scored):
    return scored.df.withColumn("signature", bl.signature(METRICS)).where(F.col("signature").isNotNull()).select(
        "session_id", "step", "signature")


@query("metric_anomalies", f"{MET} SELECT session_id, step, metric, value, z_score, direction FROM an")
def metric_anomalies(spark, sf_dir):
    return bl.anomalies(scored(spark, sf_dir), METRICS)


SIG = MET + """, wide AS (SELECT session_id, step, count(*) AS n, max(direction) FILTER (WHERE metric = 'action_entropy') AS h,
   max(direction) FILTER (WHERE metric = 'action_mi') AS mi, max(direction) FILTER (WHERE metric = 'last_surprisal') AS su,
   max(direction) FILTER (WHERE metric = 'kl_divergence') AS kd FROM an GROUP BY ALL HAVING count(*) >= 2),
sig AS (SELECT session_id, step, CASE WHEN h = 'low' AND mi = 'low' THEN 'mechanical_repetition' WHEN h = 'low' AND mi = 'high' THEN 'tight_iteration'
   WHEN kd = 'high' AND (su = 'high' OR h = 'high') THEN 'distributional_shift' WHEN kd = 'high' AND mi = 'high' THEN 'context_thrashing'
   WHEN kd = 'high' AND h = 'low' THEN 'distributional_anomaly' ELSE 'unclassified_anomaly' END AS signature FROM wide)"""


def signed(spark, sf_dir, ev=None):
    return signatures(scored(spark, sf_dir, ev))


@query("anomaly_signatures", f"{SIG} SELECT * FROM sig")
def anomaly_signatures(spark, sf_dir):
    return signed(spark, sf_dir)


@query("signature_timeline", f"{SIG} SELECT signature, count(*) AS n, count(DISTINCT session_id) AS sessions, min(step) AS first_step, max(step) AS last_step FROM sig GROUP BY signature")
def signature_timeline(spark, sf_dir):
    return signed(spark, sf_dir).groupBy("signature").agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"),
        F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("finite_observations", f"""WITH {b1()}, v AS (SELECT session_id, CASE WHEN k = 0 THEN NULL WHEN k % 7 = 0 THEN 'nan'::DOUBLE WHEN k % 11 = 0 THEN 'inf'::DOUBLE ELSE value END AS v FROM b1)
SELECT session_id, count(*) AS finite, round(avg(v), 4) AS mean_value FROM v WHERE v IS NOT NULL AND isfinite(v) GROUP BY session_id""")
def finite_observations(spark, sf_dir):
    v = (F.when(F.col("k") == 0, None).when(F.col("k") % 7 == 0, float("nan")).when(F.col("k") % 11 == 0, float("inf")).otherwise(F.col("value")))
    rows = bind.raw_events(spark, sf_dir).select(F.col("user_id").alias("session_id"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).groupBy("session_id").agg(
        F.count("*").alias("finite"), F.round(F.avg("v"), 4).alias("mean_value"))


def _decline_sql() -> str:
    w = "OVER (PARTITION BY session_id ORDER BY step ROWS 29 PRECEDING)"
    return f"""{MET}, d AS (SELECT session_id, step, action_mi AS v, CASE WHEN step > 100 THEN action_mi END AS y FROM met),
r AS (SELECT *, count(y) {w} AS n, regr_slope(y, step) {w} AS sl, regr_sxx(y, step) {w} AS sxx, regr_syy(y, step) {w} AS syy, regr_sxy(y, step) {w} AS sxy FROM d)
SELECT session_id, step, round(sl, 6) AS slope, round(v, 4) AS current FROM r JOIN st USING (session_id)
WHERE n = 30 AND std_action_mi >= 1e-10 AND sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / 28) / sqrt(sxx) >= 1e-12
  AND sl < -2 * sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / 28) / sqrt(sxx) AND v < mean_action_mi - 0.84 * std_action_mi"""


@query("gradual_decline", _decline_sql())
def gradual_decline(spark, sf_dir):
    return bl.gradual_decline(measured(spark, sf_dir), "action_mi")


def _cp(m: str) -> str:
    def o(f, lo, hi):
        return f"{f}({m}) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN {lo} AND {hi})"
    a = ("20 PRECEDING", "1 PRECEDING")
    b = ("CURRENT ROW", "19 FOLLOWING")
    return f"abs({o('avg', *b)} - {o('avg', *a)}) / (sqrt(({o('var_pop', *a)} + {o('var_pop', *b)}) / 2) + 1e-9)"


@query("change_points", f"""{MET}, c AS (SELECT session_id, step, count(*) OVER (PARTITION BY session_id) AS n,
  {_cp('action_entropy')} AS s1, {_cp('action_mi')} AS s2 FROM met)
SELECT session_id, min(step) AS first_step FROM c WHERE step > 20 AND step <= n - 20 AND (s1 >= 2.5 OR s2 >= 2.5) GROUP BY session_id""")
def change_points(spark, sf_dir):
    return bl.change_points(measured(spark, sf_dir), ("action_entropy", "action_mi"))


@query("leave_one_out_fire", f"""{MET}, t AS (SELECT session_id, {', '.join(f"count({m}) AS n_{m}, sum({m}) AS s_{m}, sum({m} * {m}) AS q_{m}" for m in METRICS)} FROM met GROUP BY session_id),
o AS (SELECT a.session_id, {', '.join(f"sum(b.s_{m}) / sum(b.n_{m}) AS mean_{m}, sqrt(greatest(sum(b.q_{m}) / sum(b.n_{m}) - (sum(b.s_{m}) / sum(b.n_{m})) ** 2, 0)) AS std_{m}" for m in METRICS)}
  FROM t a JOIN t b ON a.session_id <> b.session_id GROUP BY a.session_id)
SELECT session_id, min(step) AS first_step FROM met JOIN o USING (session_id) WHERE
  {' + '.join(f"CASE WHEN std_{m} > 1e-9 AND abs(({m} - mean_{m}) / std_{m}) >= 2 THEN 1 ELSE 0 END" for m in METRICS)} >= 2 GROUP BY session_id""")
def leave_one_out_fire(spark, sf_dir):
    return bl.leave_one_out(measured(spark, sf_dir).kept(), METRICS)
