"""Rule detectors over the trace-event binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.operators import detectors as dt
from trajlens.operators import firings as fr
from trajlens.operators.phases import phase_machine
from trajlens.plans.registry import query
from trajlens.plans.sqltext import b1, b1t
from trajlens.sources import bind

T = b1t()
SIZES = """, sz AS (SELECT session_id, count(*) AS n, max(step) AS last_step, arg_max(phase_rank, step) AS cur FROM bm GROUP BY session_id)"""


def ISLAND(src: str, value: str, order: str, name: str, cols: str = "") -> str:
    """CTEs ``name``: rows of src with run_id, and ``name_runs``: one row per run."""
    return f"""{name} AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY {order}) AS run_id FROM (
      SELECT *, CASE WHEN {value} IS NOT DISTINCT FROM lag({value}) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS chg
      FROM {src} WINDOW w AS (PARTITION BY session_id ORDER BY {order}))),
{name}_runs AS (SELECT session_id, run_id, any_value({value}) AS val, count(*) AS len, min({order}) AS run_start, max({order}) AS run_end{cols}
      FROM {name} GROUP BY session_id, run_id)"""


def LONGEST(name: str, where: str = "true") -> str:
    return f"""{name}_best AS (SELECT * FROM {name}_runs WHERE {where}
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY len DESC, run_start) = 1)"""


@query("longest_run", f"""WITH {b1()}, {ISLAND('b1', 'symbol', 'step', 'r')}, {LONGEST('r')}
SELECT session_id, val AS symbol, len AS run_length, run_start, run_end FROM r_best""")
def longest_run(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol")
    out = dt.longest_runs(ev.islands("symbol"), F.first("symbol").alias("symbol"))
    return out.select("session_id", "symbol", "run_length", "run_start", "run_end")


@query("first_run_reaching", f"""WITH {b1()}, {ISLAND('b1', 'symbol', 'step', 'r')},
 q AS (SELECT *, row_number() OVER (PARTITION BY session_id, run_id ORDER BY step) AS nth FROM r)
SELECT session_id, min(step) AS first_step FROM q WHERE nth = 3 GROUP BY session_id""")
def first_run_reaching(spark, sf_dir):
    runs = bind.events(spark, sf_dir).select("symbol").islands("symbol")
    return runs.df.where(F.col("step") - F.col("run_start") + 1 == 3).groupBy("session_id").agg(
        F.min("step").alias("first_step"))


@query("agent_blocks", f"""WITH {T}, q AS (SELECT *, count(*) FILTER (WHERE type = 'user_input') OVER
  (PARTITION BY session_id ORDER BY step) AS block FROM bt)
SELECT session_id, block, count(*) AS block_size, min(step) AS first_step, max(step) AS last_step
FROM q WHERE type <> 'user_input' GROUP BY session_id, block""")
def agent_blocks(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir).select("type").running(
        block=("count", F.when(F.col("type") == "user_input", 1)))
    return ev.df.where(F.col("type") != "user_input").groupBy("session_id", "block").agg(
        F.count("*").alias("block_size"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("repeated_triples", f"""WITH {b1()}, q AS (SELECT session_id, step, symbol AS a, lead(symbol, 1) OVER w AS b,
  lead(symbol, 2) OVER w AS c, lead(symbol, 3) OVER w AS d, lead(symbol, 4) OVER w AS e FROM b1
  WINDOW w AS (PARTITION BY session_id ORDER BY step))
SELECT session_id, step, a || '>' || b || '>' || c AS pattern FROM q WHERE a = c AND b = d AND c = e""")
def repeated_triples(spark, sf_dir):
    ev = bind.events(spark, sf_dir).select("symbol").frame(0, 4, {
        f"s{i}": (lambda w, i=i: F.lead("symbol", i).over(w)) for i in range(1, 5)})
    hit = (F.col("symbol") == F.col("s2")) & (F.col("s1") == F.col("s3")) & (F.col("s2") == F.col("s4"))
    return ev.df.where(hit).select("session_id", "step", F.concat_ws(">", "symbol", "s1", "s2").alias("pattern"))


@query("detect_step_repetition", f"""WITH {T}{SIZES}, tail AS (SELECT bt.* FROM bt JOIN sz USING (session_id) WHERE step > n - 9),
calls AS (SELECT *, tool || '|' || input_hash AS op FROM tail WHERE type = 'tool_call' AND tool IS NOT NULL),
{ISLAND('calls', 'op', 'step', 'r', ", any_value(tool) AS tool, any_value(input_hash) AS input_hash, count(DISTINCT output_hash) / count(*) AS div")}, {LONGEST('r')}
SELECT session_id, least(len / 6.0, 1.0) AS confidence, last_step AS at_step, tool AS repeated_operation, input_hash,
  len AS consecutive_count FROM r_best JOIN sz USING (session_id)
WHERE len >= 3 AND n >= 3 AND div <= 0.8 AND (cur <> 1 OR len >= 4)""")
def detect_step_repetition(spark, sf_dir):
    return dt.step_repetition(bind.trace_events(spark, sf_dir), 3, 4)


@query("detect_context_loss", f"""WITH {T}{SIZES}, w AS (SELECT *,
   count(*) FILTER (WHERE type = 'tool_call' AND tool <> 'read_file') OVER o AS work,
   count(*) FILTER (WHERE type = 'user_input') OVER o AS block FROM bt WINDOW o AS (PARTITION BY session_id ORDER BY step)),
rd AS (SELECT *, min(step) OVER (PARTITION BY session_id, output_hash) AS seen FROM w WHERE tool = 'read_file'),
pairs AS (SELECT a.session_id, a.output_hash, a.seen, a.step AS first_step, b.step AS reread_step, b.work - a.work AS gap
  FROM rd a JOIN rd b ON a.session_id = b.session_id AND a.output_hash = b.output_hash AND a.block = b.block AND a.step < b.step),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY gap DESC, seen, first_step, reread_step) = 1)
SELECT session_id, least(gap / 10.0, 1.0) AS confidence, reread_step AS at_step, output_hash AS resource_hash, first_step,
  gap AS intervening_operations FROM best JOIN sz USING (session_id)
WHERE n >= 6 AND gap >= greatest(5, floor(n * 0.08))""")
def detect_context_loss(spark, sf_dir):
    return dt.context_loss(bind.trace_events(spark, sf_dir))


VERIFIED = "regexp_matches(goal_text, '(?i)(tests? pass|looks? good)')"
FACTS = f""", f AS (SELECT session_id, count(*) AS n_events, max(step) AS last_step, arg_max(phase_rank, step) AS cur,
  count(*) FILTER (WHERE class_rank = 3) AS ex, count(*) FILTER (WHERE class_rank = 4) AS vf,
  count(*) FILTER (WHERE class_rank = 5) AS dl, coalesce(bool_or(phase_rank <> from_rank AND phase_rank = 4), false) AS reached,
  coalesce(bool_or(type = 'user_input' AND {VERIFIED}), false) AS delegated,
  coalesce(bool_or(tool = 'edit_file'), false) AS wrote FROM bm GROUP BY session_id)"""
# Edits read as commits and test runs as builds, so that work can end unverified.
SHIPPING = T.replace("WHEN 'purchase' THEN 'edit_file' WHEN 'error' THEN 'pytest'", "WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'npm'").replace(
    "WHEN tool = 'pytest' THEN 4 WHEN tool IN ('bash', 'edit_file') THEN 3", "WHEN tool = 'commit' THEN 5 WHEN tool IN ('bash', 'npm') THEN 3").replace(
    "tool IN ('bash', 'edit_file', 'pytest')", "tool IN ('bash', 'commit')")
# Half of the edits read as commits and all test runs as builds: nothing is verified, and every rule of a prefix finds cases.
MIXED = T.replace("WHEN 'purchase' THEN 'edit_file' WHEN 'error' THEN 'pytest'", "WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'commit' ELSE 'edit_file' END WHEN 'error' THEN 'npm'").replace(
    "WHEN tool = 'pytest' THEN 4 WHEN tool IN ('bash', 'edit_file') THEN 3", "WHEN tool = 'commit' THEN 5 WHEN tool IN ('bash', 'edit_file', 'npm') THEN 3").replace(
    "tool IN ('bash', 'edit_file', 'pytest')", "tool IN ('bash', 'edit_file', 'commit')")


def mixed_trace(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir)
    tool = F.when((F.col("tool") == "edit_file") & (F.col("k") % 2 == 0), "commit").when(F.col("tool") == "pytest", "npm").otherwise(F.col("tool"))
    return ev.on(ev.df.withColumn("tool", tool))


@query("detect_missing_verification", f"""WITH {MIXED}{FACTS}
SELECT session_id, least(ex / 15.0, 0.9) AS confidence, last_step AS at_step, ex AS execution_events, n_events AS total_events
FROM f WHERE ex >= 5 AND vf = 0 AND NOT delegated AND wrote AND cur NOT IN (1, 2)""")
def detect_missing_verification(spark, sf_dir):
    return dt.missing_verification(mixed_trace(spark, sf_dir), 5)


@query("detect_premature_termination", f"""WITH {SHIPPING}{FACTS}
SELECT session_id, 0.85::DOUBLE AS confidence, last_step AS at_step, ex AS execution_events, dl AS delivering_events
FROM f WHERE n_events >= 5 AND cur = 5 AND dl >= 3 AND ex >= 3 AND NOT reached AND NOT delegated""")
def detect_premature_termination(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir)
    tool = F.when(F.col("tool") == "edit_file", "commit").when(F.col("tool") == "pytest", "npm").otherwise(F.col("tool"))
    return dt.premature_termination(ev.on(ev.df.withColumn("tool", tool)))


@query("detect_reasoning_mismatch", f"""WITH {T}, q AS (SELECT *, lead(type) OVER w AS nt, lead(tool) OVER w AS nl, lead(step) OVER w AS ns
  FROM bt WINDOW w AS (PARTITION BY session_id ORDER BY step)),
h AS (SELECT *, CASE WHEN contains(goal_text, 'read') THEN 'read/review' WHEN contains(goal_text, 'test') THEN 'test/verify' END AS intent
  FROM q WHERE type = 'reasoning' AND nt = 'tool_call' AND nl = 'edit_file')
SELECT session_id, CASE WHEN intent = 'read/review' THEN 0.7 ELSE 0.65 END::DOUBLE AS confidence, ns AS at_step, step AS reasoning_step,
  intent AS planned_intent, nl AS actual_tool FROM h WHERE intent IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY step) = 1""")
def detect_reasoning_mismatch(spark, sf_dir):
    return dt.reasoning_action_mismatch(bind.trace_events(spark, sf_dir))


@query("detect_goal_drift", f"""WITH {T}, l AS (SELECT *, max(CASE WHEN type = 'user_input' THEN step END) OVER
    (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lu,
    count(*) FILTER (WHERE type = 'user_input') OVER (PARTITION BY session_id ORDER BY step) AS raw FROM bm),
back AS (SELECT session_id, count(*) AS n, max(step) AS last_step,
  count(*) FILTER (WHERE phase_rank < from_rank AND (lu IS NULL OR lu < step - 3)) AS reg FROM l GROUP BY session_id),
blk AS (SELECT session_id, raw, count(*) AS size, row_number() OVER (PARTITION BY session_id ORDER BY raw) AS no
  FROM l WHERE type <> 'user_input' GROUP BY session_id, raw),
tl AS (SELECT DISTINCT l.session_id, no, size, tool FROM l JOIN blk USING (session_id, raw) WHERE type <> 'user_input' AND tool IS NOT NULL),
kn AS (SELECT *, min(no) OVER (PARTITION BY session_id, tool) AS first_no FROM tl),
nv AS (SELECT session_id, no, any_value(size) AS size, count(*) FILTER (WHERE first_no > 2) / count(*) AS novelty FROM kn WHERE no > 2 GROUP BY session_id, no),
dr AS (SELECT session_id, count(*) AS d FROM nv WHERE novelty > 0.5 AND size >= 3 GROUP BY session_id),
tb AS (SELECT session_id, max(no) AS total_blocks FROM blk GROUP BY session_id)
SELECT session_id, round(least(d / 5.0, 0.85), 3) AS confidence, last_step AS at_step, d AS drift_blocks, total_blocks, reg AS unprompted_regressions
FROM back JOIN tb USING (session_id) JOIN dr USING (session_id) WHERE n >= 20 AND total_blocks >= 3 AND d >= 1 AND reg >= 1""")
def detect_goal_drift(spark, sf_dir):
    return dt.goal_drift(bind.trace_events(spark, sf_dir), drift_blocks=1, regressions=1)


@query("detect_tool_thrashing", f"""WITH {T}{SIZES}, calls AS (SELECT *, tool = 'read_file' AS ro FROM bt WHERE type = 'tool_call' AND tool IS NOT NULL),
{ISLAND('calls', 'ro', 'step', 'r')}, m AS (SELECT session_id, max(len) AS c FROM r_runs WHERE val GROUP BY session_id),
q AS (SELECT *, CASE WHEN cur = 3 THEN 3 ELSE 4 END AS threshold FROM m JOIN sz USING (session_id))
SELECT session_id, least(c / (threshold * 2.0), 0.85) AS confidence, last_step AS at_step, c AS consecutive_read_only, threshold
FROM q WHERE n >= 3 AND c >= threshold""")
def detect_tool_thrashing(spark, sf_dir):
    return dt.tool_thrashing(bind.trace_events(spark, sf_dir), 3, 4)


@query("detect_tool_misuse", f"""WITH {T}, calls AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step) AS no FROM bt WHERE type = 'tool_call'),
f AS (SELECT *, CASE WHEN lag(tool) OVER w IS DISTINCT FROM tool THEN 1 ELSE 0 END AS sw,
   CASE WHEN lag(output_hash) OVER w IS DISTINCT FROM output_hash THEN 1 ELSE 0 END AS ch, lag(step, 4) OVER w AS first_step
  FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY no)),
s AS (SELECT *, sum(sw) OVER w / 4.0 * (1 - sum(ch) OVER w / 4.0) AS score FROM f
  WINDOW w AS (PARTITION BY session_id ORDER BY no ROWS 3 PRECEDING)),
b AS (SELECT * FROM s WHERE no >= 5 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, no) = 1)
SELECT session_id, round(least(score, 0.85), 3) AS confidence, step AS at_step, round(score, 3) AS switch_rate, first_step AS window_start_step
FROM b WHERE score >= 0.4""")
def detect_tool_misuse(spark, sf_dir):
    return dt.tool_misuse(bind.trace_events(spark, sf_dir))


@query("detect_stall", f"""WITH {T}, a AS (SELECT * FROM bt WHERE latency_ms <= 120000),
q AS (SELECT session_id, count(*) AS n, quantile_cont(latency_ms, 0.25) AS q25, quantile_cont(latency_ms, 0.5) AS med,
        quantile_cont(latency_ms, 0.75) AS q75 FROM a GROUP BY session_id),
f AS (SELECT *, greatest(q75 + 1.5 * (q75 - q25), 20000.0) AS thr FROM q WHERE n >= 10 AND med >= 50),
s AS (SELECT a.*, med, thr FROM a JOIN f USING (session_id) WHERE latency_ms > thr),
g AS (SELECT session_id, count(*) AS stall_count, max(latency_ms) AS mx, any_value(thr) AS thr, any_value(med) AS med,
  arg_min(step, (-latency_ms, step)) AS at_step, max(step) AS last_stall FROM s GROUP BY session_id)
SELECT session_id, round(least(0.5 + (mx - thr) / thr * 0.3, 1.0), 3) AS confidence, at_step, stall_count, round(mx, 1) AS max_latency_ms,
  round(med, 1) AS median_latency_ms, round(thr, 1) AS threshold_ms FROM g WHERE stall_count >= 2 AND last_stall > 6""")
def detect_stall(spark, sf_dir):
    return dt.stall(bind.trace_events(spark, sf_dir), floor_ms=20000.0)


@query("detect_error_cascade", f"""WITH {T}{SIZES}, {ISLAND('bt', 'success', 'step', 'r')}, {LONGEST('r', 'NOT val')},
t AS (SELECT session_id, count(*) FILTER (WHERE len >= 3) AS total_chains, CAST(sum(len) AS BIGINT) AS total_errors FROM r_runs WHERE NOT val GROUP BY session_id)
SELECT session_id, round(least(len / 10.0, 1.0), 3) AS confidence, run_end AS at_step, len AS longest_chain, run_start AS chain_start_step,
  total_chains, total_errors FROM r_best JOIN t USING (session_id) JOIN sz USING (session_id) WHERE n >= 3 AND len >= 3""")
def detect_error_cascade(spark, sf_dir):
    return dt.error_cascade(bind.trace_events(spark, sf_dir))


@query("detect_token_explosion", f"""WITH {T}, n AS (SELECT session_id, count(*) AS n FROM bt GROUP BY session_id),
e AS (SELECT session_id, step - (n + 1) / 2.0 AS x, CAST(tokens_in + tokens_out AS DOUBLE) AS y, step, n, greatest(floor(n / 4), 1) AS q
  FROM bt JOIN n USING (session_id)),
s AS (SELECT session_id, n, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x * y) AS sx2y, sum(x * x) AS sx2, sum(x * x * x * x) AS sx4,
  avg(y) FILTER (WHERE step <= q) AS f, avg(y) FILTER (WHERE step > n - q) AS l FROM e GROUP BY session_id, n),
c AS (SELECT *, l / greatest(f, 1.0) AS ratio, (n * sx2y - sx2 * sy) / (n * sx4 - sx2 * sx2) AS accel FROM s WHERE n >= 50 AND f >= 50),
d AS (SELECT *, CASE WHEN ratio > 1.1 THEN least((ratio - 1.1) / 5.0, 0.5) ELSE 0 END
   + CASE WHEN accel > 0 THEN least(accel / greatest(sy / n, 1.0) * 10, 0.5) ELSE 0 END AS score FROM c)
SELECT session_id, round(least(score, 0.9), 3) AS confidence, n AS at_step, round(ratio, 2) AS growth_ratio,
  round(sxy / sx2, 2) AS slope, round(accel, 4) AS acceleration FROM d WHERE score >= 0.02""")
def detect_token_explosion(spark, sf_dir):
    return dt.token_explosion(bind.trace_events(spark, sf_dir), growth=1.1, min_score=0.02)


@query("detect_analysis_paralysis", f"""WITH {T}, e AS (SELECT *, type = 'reasoning' AS th FROM bt),
{ISLAND('e', 'th', 'step', 'r')}, {LONGEST('r', 'val')}
SELECT session_id, round(least(len / 9.0, 0.85), 3) AS confidence, run_end AS at_step, len AS consecutive_reasoning, run_start AS start_step
FROM r_best WHERE len >= 3""")
def detect_analysis_paralysis(spark, sf_dir):
    return dt.analysis_paralysis(bind.trace_events(spark, sf_dir), 3)


@query("detect_recovery_failure", f"""WITH {T}, e AS (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER
    (PARTITION BY session_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS aft,
    lead(tool) OVER w AS nt, lead(input_hash) OVER w AS ni FROM bt WINDOW w AS (PARTITION BY session_id ORDER BY step)),
p AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE NOT success) AS total_errors,
   count(*) FILTER (WHERE NOT success AND aft IS NOT NULL) AS attempts, count(*) FILTER (WHERE NOT success AND aft > 0) AS bad,
   max(step) FILTER (WHERE NOT success AND aft > 0) AS last_bad,
   arg_min(step, (-aft, step)) FILTER (WHERE NOT success AND aft > 0) AS at_step,
   CAST(max(aft) FILTER (WHERE NOT success) AS BIGINT) AS worst,
   count(*) FILTER (WHERE NOT success AND nt IS NOT DISTINCT FROM tool AND ni = input_hash) AS stuck,
   count(*) FILTER (WHERE NOT success AND nt = tool) AS same_tool,
   count(*) FILTER (WHERE type = 'tool_call') AS calls, count(*) FILTER (WHERE type = 'tool_call' AND success) AS good
  FROM e GROUP BY session_id),
u AS (SELECT session_id, count(DISTINCT output_hash) AS uniq FROM bt JOIN p USING (session_id)
  WHERE success AND type = 'tool_call' AND step > last_bad GROUP BY session_id)
SELECT session_id, round(least(bad / attempts, 1.0), 3) AS confidence, at_step, total_errors, bad AS failed_recoveries,
  same_tool AS same_tool_retries, stuck AS stuck_retries, worst AS worst_failures_after
FROM p LEFT JOIN u USING (session_id) WHERE n >= 4 AND total_errors >= 3 AND bad / attempts >= 0.3 AND coalesce(uniq, 0) < 5
  AND NOT (calls >= 50 AND good / calls >= 0.8 AND stuck = 0)""")
def detect_recovery_failure(spark, sf_dir):
    return dt.recovery_failure(bind.trace_events(spark, sf_dir), rate=0.3)


FIRING = f"""{MIXED}, f AS (SELECT *, NOT success AS err, type = 'tool_call' AS is_call, row_number() OVER o AS n,
    count(*) FILTER (WHERE NOT success) OVER o AS errors, count(*) FILTER (WHERE type = 'tool_call') OVER o AS calls,
    count(*) FILTER (WHERE type = 'tool_call' AND success) OVER o AS goods, count(*) FILTER (WHERE class_rank = 3) OVER o AS ex,
    count(*) FILTER (WHERE class_rank = 4) OVER o AS vf, count(*) FILTER (WHERE class_rank = 5) OVER o AS dl,
    coalesce(bool_or(phase_rank <> from_rank AND phase_rank = 4) OVER o, false) AS reached, coalesce(bool_or(tool = 'edit_file') OVER o, false) AS wrote,
    coalesce(bool_or(type = 'user_input' AND {VERIFIED}) OVER o, false) AS delegated,
    count(*) FILTER (WHERE type = 'tool_call' AND tool <> 'read_file') OVER o AS work, count(*) FILTER (WHERE type = 'user_input') OVER o AS block,
    step - coalesce(max(CASE WHEN success THEN step END) OVER o, 0) AS chain, step - coalesce(max(CASE WHEN type <> 'reasoning' THEN step END) OVER o, 0) AS thinking,
    lag(type) OVER o AS was_type, lag(goal_text) OVER o AS was_text, lag(tool) OVER o AS was_tool, lag(input_hash) OVER o AS was_input, lag(success) OVER o AS was_ok,
    count(*) FILTER (WHERE tool = 'read_file') OVER o AS looks
  FROM bm WINDOW o AS (PARTITION BY session_id ORDER BY step)),
g AS (SELECT *, count(*) FILTER (WHERE NOT was_ok AND was_tool IS NOT DISTINCT FROM tool AND was_input = input_hash) OVER o AS stuck,
    max(CASE WHEN err THEN chain END) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest,
    looks - coalesce(max(CASE WHEN is_call AND tool <> 'read_file' THEN looks END) OVER o, 0) AS look
  FROM f WINDOW o AS (PARTITION BY session_id ORDER BY step)),
rk AS (SELECT k.session_id, k.step, i.step AS i, count(z.step) AS aft FROM f k JOIN f i ON i.session_id = k.session_id AND i.err AND i.step < k.step
    LEFT JOIN f z ON z.session_id = k.session_id AND z.err AND z.step > i.step AND z.step <= least(i.step + 3, k.step) GROUP BY ALL),
rs AS (SELECT session_id, step, count(*) AS attempts, count(*) FILTER (WHERE aft > 0) AS bads, max(i) FILTER (WHERE aft > 0) AS last_bad,
    arg_min(i, (-aft, i)) FILTER (WHERE aft > 0) AS worst FROM rk GROUP BY session_id, step),
ru AS (SELECT rs.session_id, rs.step, count(DISTINCT z.output_hash) AS fresh FROM rs JOIN bm z ON z.session_id = rs.session_id AND z.success AND z.type = 'tool_call'
    AND z.step > rs.last_bad AND z.step <= rs.step GROUP BY ALL),
a AS (SELECT session_id, step, latency_ms FROM bm WHERE latency_ms <= 120000),
q AS (SELECT *, count(*) OVER o AS n, quantile_cont(latency_ms, 0.25) OVER o AS q25, quantile_cont(latency_ms, 0.5) OVER o AS med, quantile_cont(latency_ms, 0.75) OVER o AS q75
  FROM a WINDOW o AS (PARTITION BY session_id ORDER BY step)),
s0 AS (SELECT session_id, step, greatest(q75 + 1.5 * (q75 - q25), 20000.0) AS thr FROM q WHERE n >= 10 AND med >= 50),
s1 AS (SELECT s0.session_id, s0.step, any_value(thr) AS thr, count(*) AS c, max(a.latency_ms) AS mx, arg_min(a.step, (-a.latency_ms, a.step)) AS at_step, max(a.step) AS late
  FROM s0 JOIN a ON a.session_id = s0.session_id AND a.step <= s0.step AND a.latency_ms > thr GROUP BY s0.session_id, s0.step),
s2 AS (SELECT *, lag(at_step) OVER (PARTITION BY session_id ORDER BY step) AS told FROM s1 WHERE c >= 2 AND late > 6),
all_of AS (
  SELECT session_id, 'context_loss' AS failure, step, step AS at_step, least((work - w0) / 10.0, 1.0) AS confidence FROM (SELECT *, first_value(work) OVER (PARTITION BY session_id, output_hash, block ORDER BY step) AS w0
    FROM g WHERE tool = 'read_file') WHERE n >= 6 AND work - w0 >= greatest(5, floor(n * 0.08))
  UNION ALL SELECT session_id, 'premature_termination', step, step, 0.85 FROM g WHERE n >= 5 AND phase_rank = 5 AND dl >= 3 AND ex >= 3 AND NOT reached AND NOT delegated
  UNION ALL SELECT session_id, 'analysis_paralysis', step, step, round(least(thinking / 9.0, 0.85), 3) FROM g WHERE type = 'reasoning' AND thinking >= 3
  UNION ALL SELECT session_id, 'recovery_failure', step, worst, round(bads / attempts, 3) FROM g JOIN rs USING (session_id, step) LEFT JOIN ru USING (session_id, step)
    WHERE n >= 4 AND errors >= 3 AND bads / attempts >= 0.3 AND coalesce(fresh, 0) < 5 AND NOT (calls >= 50 AND goods / calls >= 0.8 AND stuck = 0)
  UNION ALL SELECT session_id, 'missing_verification', step, step, least(ex / 15.0, 0.9) FROM g WHERE ex >= 5 AND vf = 0 AND NOT delegated AND wrote AND phase_rank NOT IN (1, 2)
  UNION ALL SELECT session_id, 'reasoning_action_mismatch', step, step, CASE WHEN contains(was_text, 'read') THEN 0.7 ELSE 0.65 END FROM g
    WHERE was_type = 'reasoning' AND is_call AND tool = 'edit_file' AND (contains(was_text, 'read') OR contains(was_text, 'test'))
  UNION ALL SELECT session_id, 'tool_thrashing', step, step, least(most / (cap * 2.0), 0.85) FROM (SELECT *, max(CASE WHEN tool = 'read_file' THEN look END) OVER (PARTITION BY session_id ORDER BY step) AS most,
    CASE WHEN phase_rank = 3 THEN 3 ELSE 4 END AS cap FROM g) WHERE n >= 3 AND most >= cap),
fired AS (SELECT session_id, failure, step, at_step, confidence FROM all_of QUALIFY row_number() OVER (PARTITION BY session_id, failure ORDER BY step) = 1
  UNION ALL SELECT session_id, 'error_cascade', step, step, round(least(chain / 10.0, 1.0), 3) FROM g WHERE err AND n >= 3 AND chain >= 3 AND chain > coalesce(longest, 0)
  UNION ALL SELECT session_id, 'stall', step, at_step, round(least(0.5 + (mx - thr) / thr * 0.3, 1.0), 3) FROM s2 WHERE told IS DISTINCT FROM at_step)"""
LOOSE = {"analysis": 3, "rate": 0.3, "executing": 5, "look": (3, 4), "stall": {"floor_ms": 20000.0}}


@query("first_firings", f"WITH {FIRING} SELECT session_id, failure, step, at_step, confidence::DOUBLE AS confidence FROM fired")
def first_firings(spark, sf_dir):
    return fr.first_firings(mixed_trace(spark, sf_dir), **LOOSE)


@query("settled_firings", f"""WITH {FIRING},
lp AS (SELECT session_id, max(step) AS step FROM bm GROUP BY session_id),
fs AS (SELECT session_id, round(least(0.5 + (mx - thr) / thr * 0.3, 1.0), 3) AS whole FROM s1 JOIN (SELECT session_id, max(step) AS step FROM a GROUP BY session_id) USING (session_id, step) WHERE c >= 2 AND late > 6),
rf AS (SELECT session_id FROM g JOIN rs USING (session_id, step) JOIN lp USING (session_id, step) LEFT JOIN ru USING (session_id, step)
  WHERE n >= 4 AND errors >= 3 AND bads / attempts >= 0.3 AND coalesce(fresh, 0) < 5 AND NOT (calls >= 50 AND goods / calls >= 0.8 AND stuck = 0))
SELECT session_id, failure, step, at_step, greatest(confidence, CASE WHEN failure = 'stall' THEN whole END)::DOUBLE AS confidence FROM fired LEFT JOIN fs USING (session_id)
WHERE failure <> 'recovery_failure' OR session_id IN (SELECT session_id FROM rf)""")
def settled_firings(spark, sf_dir):
    ev = mixed_trace(spark, sf_dir)
    return fr.settled_firings(fr.first_firings(ev, **LOOSE), dt.stall(ev, floor_ms=20000.0), dt.recovery_failure(ev, rate=0.3))


@query("failed_gates", f"""WITH {T}{SIZES}, {ISLAND('bt', 'success', 'step', 'r')}, {LONGEST('r', 'NOT val')},
a AS (SELECT * FROM bt WHERE latency_ms <= 120000),
q AS (SELECT session_id, count(*) AS m, quantile_cont(latency_ms, 0.25) AS q25, quantile_cont(latency_ms, 0.5) AS med, quantile_cont(latency_ms, 0.75) AS q75 FROM a GROUP BY session_id),
h AS (SELECT *, greatest(q75 + 1.5 * (q75 - q25), 20000.0) AS thr FROM q),
b AS (SELECT session_id, count(*) AS c, max(latency_ms) AS mx, max(step) AS late FROM a JOIN h USING (session_id) WHERE latency_ms > thr GROUP BY session_id),
w AS (SELECT *, count(*) FILTER (WHERE type = 'tool_call' AND tool <> 'read_file') OVER o AS work, count(*) FILTER (WHERE type = 'user_input') OVER o AS block FROM bt WINDOW o AS (PARTITION BY session_id ORDER BY step)),
cl AS (SELECT session_id, max(gap) AS gap FROM (SELECT session_id, max(work) - min(work) AS gap FROM w WHERE tool = 'read_file' GROUP BY session_id, output_hash, block) GROUP BY session_id),
o AS (SELECT session_id, 'stall' AS failure, CASE WHEN n < 10 THEN 'min_events' WHEN coalesce(m, 0) < 10 THEN 'min_active_events' WHEN med < 50 THEN 'low_median' WHEN c IS NULL THEN 'no_outliers'
    WHEN c < 2 THEN 'min_stall_count' WHEN late <= 6 THEN 'cold_start' END AS gate_failed, round(least(0.5 + (mx - thr) / thr * 0.3, 1.0), 3) AS sure
  FROM sz LEFT JOIN h USING (session_id) LEFT JOIN b USING (session_id)
  UNION ALL SELECT session_id, 'error_cascade', CASE WHEN n < 3 THEN 'min_events' WHEN coalesce(len, 0) < 3 THEN 'no_chains_above_min' END, round(least(len / 10.0, 1.0), 3) FROM sz LEFT JOIN r_best USING (session_id)
  UNION ALL SELECT session_id, 'context_loss', CASE WHEN n < 6 THEN 'min_events' WHEN coalesce(gap, 0) < greatest(5, floor(n * 0.08)) THEN 'no_reread_candidates' END, least(gap / 10.0, 1.0) FROM sz LEFT JOIN cl USING (session_id))
SELECT session_id, failure, gate_failed IS NULL AS fired, CASE WHEN gate_failed IS NULL THEN sure ELSE 0.0 END::DOUBLE AS confidence, gate_failed FROM o""")
def failed_gates(spark, sf_dir):
    return fr.failed_gates(bind.trace_events(spark, sf_dir), stall={"floor_ms": 20000.0})


def evaluated(ev):
    """The trace with runs of an evaluation among its shell calls."""
    return ev.on(ev.df.withColumns({
        "error_message": F.lit(None).cast("string"),
        "goal_text": F.when((F.col("tool") == "bash") & (F.col("k") % 2 == 0), "pytest accuracy: 0.5").otherwise(F.col("goal_text"))}))


# In this trace every evaluation reports 0.5, no edit and no read names a path, and an edit's target is its input.
@query("detect_strategic_myopia", f"""WITH {T}, e AS (SELECT *, coalesce(tool = 'bash' AND k % 2 = 0, false) AS ev, coalesce(tool = 'edit_file', false) AS ed FROM bm),
s AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE ev) AS evals, max(step) FILTER (WHERE ev) AS at_step, count(*) FILTER (WHERE ed) AS edits,
  count(*) FILTER (WHERE tool = 'read_file') AS reads FROM e GROUP BY session_id),
l AS (SELECT session_id, count(*) AS late, count(*) FILTER (WHERE class_rank IN (1, 2)) AS exploring FROM e JOIN s USING (session_id) WHERE step > floor(n / 4) GROUP BY session_id),
c AS (SELECT session_id, input_hash, count(*) AS c FROM e WHERE ed GROUP BY session_id, input_hash),
t AS (SELECT session_id, sum(c) AS top FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY c DESC, input_hash) <= 3) GROUP BY session_id),
g AS (SELECT *, CAST(evals >= 3 AS INTEGER) + CAST(reads >= 10 AS INTEGER) + CAST(exploring / late < 0.05 AS INTEGER) AS signals FROM s JOIN l USING (session_id) JOIN t USING (session_id))
SELECT session_id, round(least(0.4 + signals * 0.15, 0.85), 3)::DOUBLE AS confidence, at_step, evals - 1 AS eval_cycles, round(top / edits, 3)::DOUBLE AS edit_concentration,
  edits AS total_edits, signals AS optional_signals FROM g WHERE n >= 40 AND evals - 1 >= 4 AND edits >= 4 AND top / edits >= 0.8 AND signals >= 2""")
def detect_strategic_myopia(spark, sf_dir):
    return dt.strategic_myopia(evaluated(bind.trace_events(spark, sf_dir)), min_edits=4)


@query("detections")
def detections(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir)
    on_trace = tuple(n for n in dt.DETECTORS if n != "strategic_myopia")
    return dt.run_detectors(ev, on_trace, step_repetition={"threshold": 3, "gathering_threshold": 4},
                            analysis_paralysis={"threshold": 3}, stall={"floor_ms": 20000.0}).unionByName(
        dt.run_detectors(evaluated(ev), ("strategic_myopia",), strategic_myopia={"min_edits": 4}))


@query("session_overview", f"""WITH {b1()}, en AS (SELECT session_id, step, round(entropy(symbol) OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING) + 1e-12, 4) AS h FROM b1),
{ISLAND('b1', 'symbol', 'step', 'r')}, {ISLAND('b1', 'success', 'step', 'f')},
e AS (SELECT session_id, max(step) AS events, arg_max(h, step) AS final_entropy FROM en GROUP BY session_id),
l AS (SELECT session_id, max(len) AS longest FROM r_runs GROUP BY session_id),
c AS (SELECT session_id, max(len) AS cascade FROM f_runs WHERE NOT val GROUP BY session_id),
s AS (SELECT *, CASE WHEN coalesce(cascade, 0) >= 3 THEN 'failing' WHEN longest >= 4 THEN 'repeating'
   WHEN final_entropy >= 2.2 THEN 'exploring' ELSE 'steady' END AS state FROM e JOIN l USING (session_id) LEFT JOIN c USING (session_id))
SELECT state, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, round(avg(final_entropy), 4) AS mean_entropy,
  max(longest) AS longest_run, max(coalesce(cascade, 0)) AS longest_cascade FROM s GROUP BY state""")
def session_overview(spark, sf_dir):
    """Per session entropy, longest run and error cascade; then sessions per behavioural state."""
    from trajlens.operators.metrics import sliding_entropy
    ev = bind.events(spark, sf_dir).select("symbol", "success")
    both = sliding_entropy(ev).islands("symbol", run="r", start="r_start").islands("success", run="f", start="f_start")
    per = both.df.groupBy("session_id").agg(
        F.max("step").alias("events"), F.max_by("entropy", "step").alias("final_entropy"),
        F.max(F.col("step") - F.col("r_start") + 1).alias("longest"),
        F.coalesce(F.max(F.when(~F.col("success"), F.col("step") - F.col("f_start") + 1)), F.lit(0)).alias("cascade"))
    state = (F.when(F.col("cascade") >= 3, "failing").when(F.col("longest") >= 4, "repeating")
             .when(F.col("final_entropy") >= 2.2, "exploring").otherwise("steady"))
    return per.groupBy(state.alias("state")).agg(
        F.count("*").alias("sessions"), F.sum("events").alias("events"),
        F.round(F.avg("final_entropy"), 4).alias("mean_entropy"), F.max("longest").alias("longest_run"),
        F.max("cascade").alias("longest_cascade"))
