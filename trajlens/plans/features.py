"""Trajectory features over the chat-turn binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions import text as tx
from trajlens.operators import trajectories as tj
from trajlens.plans.registry import query
from trajlens.plans.sqltext import B2, B3, b1
from trajlens.sources import bind

ACTS = B2 + """,
al AS (SELECT *, regexp_extract_all(text, '```[a-zA-Z0-9_]*\\n?(.*?)```', 1, 's')[-1] AS body FROM b2 WHERE role IN ('ai', 'assistant')),
ac AS (SELECT session_id, turn, text, split_part(trim(body, chr(10) || ' '), ' ', 1) AS tool_name,
         split_part(trim(body, chr(10) || ' '), ' ', 2) AS args FROM al WHERE body IS NOT NULL),
act AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS step, args AS target_path,
   CASE WHEN tool_name IN ('open', 'search_dir') THEN 'file_read' WHEN tool_name IN ('edit', 'create') THEN 'file_write'
        WHEN tool_name = 'submit' THEN 'tool_call' ELSE 'shell_command' END AS event_type FROM ac),
sy AS (SELECT *, CASE event_type WHEN 'file_read' THEN 'read:' || target_path WHEN 'file_write' THEN 'write:' || target_path
   WHEN 'shell_command' THEN 'shell:' || tool_name ELSE 'tool:' || tool_name END AS symbol FROM act)"""
TRIM = "regexp_replace(regexp_replace(text, '```[a-zA-Z0-9_]*\\n?(.*?)```', '', 'gs'), '^\\s+|\\s+$', '', 'g')"


@query("parsed_actions", f"WITH {ACTS} SELECT session_id, turn, step, tool_name, target_path, event_type, symbol FROM sy")
def parsed_actions(spark, sf_dir):
    return tj.actions(bind.turns(spark, sf_dir)).df.select(
        "session_id", "turn", "step", "tool_name", "target_path", "event_type", "symbol")


def _info_sql() -> str:
    w = "OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING)"
    m = """m AS (SELECT session_id, step, round(entropy(symbol) {w} + 1e-12, 4) AS action_entropy,
      CASE WHEN step = 1 THEN 0.0 ELSE round(greatest(entropy(prev) {w} + entropy(CASE WHEN step > 1 THEN symbol END) {w}
        - entropy(CASE WHEN step > 1 THEN prev || '|' || symbol END) {w}, 0.0) + 1e-12, 4) END AS action_mi, 0.0 AS kl_divergence,
      symbol, event_type FROM (SELECT *, lag(symbol) OVER (PARTITION BY session_id ORDER BY step) AS prev FROM sy)),
t AS (SELECT session_id, step, round(entropy(symbol) {w} + 1e-12, 4) AS e FROM sy WHERE event_type IN ('tool_call', 'shell_command')),
a AS (SELECT m.*, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY m.session_id ORDER BY m.step), 0.0) AS tool_entropy
      FROM m LEFT JOIN t USING (session_id, step))""".replace("{w}", w)
    cols = ", ".join(f"round(avg({x}), 6) AS {x}_mean, round(arg_max({x}, step), 6) AS {x}_final, round(max({x}), 6) AS {x}_max, "
                     f"round(coalesce(regr_slope({x}, step), 0), 6) AS {x}_slope"
                     for x in ("action_mi", "action_entropy", "tool_entropy", "kl_divergence"))
    return f"WITH {ACTS}, {m} SELECT session_id, {cols} FROM a GROUP BY session_id"


@query("information_features", _info_sql())
def information_features(spark, sf_dir):
    return tj.information(tj.actions(bind.turns(spark, sf_dir)), compression=False)


@query("information_features_full")
def information_features_full(spark, sf_dir):
    return tj.information(tj.actions(bind.turns(spark, sf_dir)))


WORKLOAD = """, w AS (SELECT session_id, turn, turn - 1 AS pos, role IN ('ai', 'assistant') AS agent, length(text) AS len,
    CASE WHEN role IN ('ai', 'assistant') THEN length({trim}) END AS think, contains(text, '```') AS acts,
    role NOT IN ('ai', 'assistant') AND turn > 2 AND regexp_matches(text, '(?i)error|traceback|no such file|command not found|not found|exception') AS err
  FROM {src}),
c AS (SELECT *, sum(len) OVER (PARTITION BY session_id ORDER BY turn) AS cum,
    count(*) FILTER (WHERE agent) OVER (PARTITION BY session_id ORDER BY turn) AS nth FROM w),
ep AS (SELECT session_id, nth, min(pos) AS pos FROM c WHERE err GROUP BY session_id, nth),
la AS (SELECT ep.session_id, a.pos - ep.pos AS latency FROM ep LEFT JOIN c a ON a.session_id = ep.session_id AND a.agent AND a.nth = ep.nth + 1),
es AS (SELECT session_id, count(*) AS n, avg(latency) AS lat FROM la GROUP BY session_id),
g AS (SELECT session_id, avg(think) AS rm, max(think) AS rx, sum(think) AS rt, regr_slope(think, nth) FILTER (WHERE agent) AS rs,
   max(cum) AS cf, regr_slope(cum, pos) AS cs, count(*) FILTER (WHERE agent AND acts) AS na FROM c GROUP BY session_id)
SELECT session_id, round(coalesce(rm, 0.0), 6) AS reasoning_mean, CAST(coalesce(rx, 0) AS BIGINT) AS reasoning_max,
  CAST(coalesce(rt, 0) AS BIGINT) AS reasoning_total, round(coalesce(CASE WHEN isnan(rs) THEN 0 ELSE rs END, 0.0), 6) AS reasoning_slope,
  CAST(cf AS BIGINT) AS context_final, round(coalesce(cs, 0.0), 6) AS context_slope,
  round(CASE WHEN na > 0 THEN coalesce(rt, 0) / na ELSE 0.0 END, 6) AS reasoning_density,
  coalesce(n, 0) AS error_episodes, round(coalesce(lat, 0.0), 6) AS recovery_latency FROM g LEFT JOIN es USING (session_id)"""


@query("workload_features", "WITH " + B2 + WORKLOAD.format(trim=TRIM, src="b2"))
def workload_features(spark, sf_dir):
    return tj.workload(bind.turns(spark, sf_dir))


@query("workload_conversations", "WITH " + B3 + WORKLOAD.format(trim=TRIM, src="b3"))
def workload_conversations(spark, sf_dir):
    return tj.workload(bind.conversation_turns(spark, sf_dir))


@query("awareness_features", f"""WITH {ACTS},
x AS (SELECT *, tool_name = 'open' AS sees, tool_name IN ('open', 'search_dir') AS looks, tool_name IN ('edit', 'create') AS mut,
   tool_name IN ('python', 'search_dir') AS ver FROM act),
y AS (SELECT *, min(CASE WHEN sees THEN step END) OVER (PARTITION BY session_id, target_path) AS seen,
   max(CASE WHEN mut THEN step END) OVER (PARTITION BY session_id, target_path) AS lm FROM x),
g AS (SELECT session_id, count(*) AS n, count(DISTINCT CASE WHEN mut THEN target_path END) AS dm,
   count(DISTINCT CASE WHEN mut AND seen < lm THEN target_path END) AS cov, count(*) FILTER (WHERE looks) AS nl,
   count(*) FILTER (WHERE ver) AS nv, min(step) FILTER (WHERE mut) AS fm, max(step) FILTER (WHERE mut) AS lmut,
   count(*) FILTER (WHERE mut AND (seen IS NULL OR seen > step)) AS blind, max(step) FILTER (WHERE ver) AS lv FROM y GROUP BY session_id)
SELECT session_id, round(CASE WHEN dm > 0 THEN cov / dm ELSE 0.0 END, 6) AS coverage, round(nl / n, 6) AS explore_ratio,
  round(coalesce((fm - 1) / n, 1.0), 6) AS read_before_first_edit, round(blind / n, 6) AS blind_edit_rate,
  CAST(coalesce(lv > lmut, false) AS INT) AS verify_before_submit, round(nv / n, 6) AS verify_rate FROM g""")
def awareness_features(spark, sf_dir):
    return tj.awareness(tj.actions(bind.turns(spark, sf_dir)))


@query("error_recovery_features", f"""WITH {ACTS},
s AS (SELECT b.session_id, row_number() OVER (PARTITION BY b.session_id ORDER BY b.turn) AS seq, a.tool_name || '|' || a.args AS act,
    role = 'user' AS obs, role = 'user' AND regexp_matches(b.text, '(?i)error|traceback') AS err
  FROM b2 b LEFT JOIN ac a USING (session_id, turn) WHERE a.turn IS NOT NULL OR (b.role = 'user' AND b.turn > 2)),
l AS (SELECT *, lag(err) OVER w AS pe, last_value(act IGNORE NULLS) OVER w AS fail FROM s WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
e AS (SELECT session_id, seq, fail FROM l WHERE err AND NOT coalesce(pe, false)),
r AS (SELECT e.*, (SELECT arg_min(act, seq) FROM s WHERE s.session_id = e.session_id AND s.seq > e.seq AND act IS NOT NULL) AS resp,
   (SELECT min(seq) FROM s WHERE s.session_id = e.session_id AND s.seq > e.seq AND obs AND NOT err) AS ok,
   row_number() OVER (PARTITION BY session_id, fail ORDER BY seq) AS nth FROM e),
g AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE fail IS NOT NULL AND nth > 1) AS again,
   count(*) FILTER (WHERE resp <> fail) AS chg, count(*) FILTER (WHERE ok - seq <= 3) AS rec, avg(ok - seq) AS lat FROM r GROUP BY session_id),
t AS (SELECT session_id, arg_max(err, seq) FILTER (WHERE obs) AS op FROM s GROUP BY session_id)
SELECT session_id, coalesce(n, 0) AS episodes, round(coalesce(again / n, 0.0), 6) AS recurrence_rate,
  round(coalesce(chg / n, 0.0), 6) AS strategy_change_rate, round(coalesce(rec / n, 0.0), 6) AS recovery_rate,
  round(coalesce(lat, 0.0), 6) AS mean_latency, CAST(coalesce(op, false) AS INT) AS terminal_unresolved
FROM t LEFT JOIN g USING (session_id)""")
def error_recovery_features(spark, sf_dir):
    return tj.error_recovery(bind.turns(spark, sf_dir))


COHERENCE = f"""{ACTS}, lx AS (SELECT *, CASE tool_name WHEN 'open' THEN ['look','read','open','view','inspect','check','see','examine']
   WHEN 'search_dir' THEN ['search','find','locate','grep','where']
   WHEN 'python' THEN ['run','execute','test','verify','confirm','check']
   ELSE ['edit','change','modify','fix','add','create','write','update','replace','implement'] END AS lex,
   lower({TRIM}) AS th, lower(regexp_extract(args, '([A-Za-z_][A-Za-z0-9_]+)', 1)) AS tg FROM act),
sc AS (SELECT *, CASE WHEN list_has_any(regexp_extract_all(th, '([a-z_]+)', 1), lex) THEN 1 ELSE 0 END AS va,
   CASE WHEN contains(th, tg) THEN 1 ELSE 0 END AS tm FROM lx)"""


@query("coherence_features", f"""WITH {COHERENCE}
SELECT session_id, round(avg(0.5 * va + 0.5 * tm), 6) AS mean, round(min(CAST(0.5 * va + 0.5 * tm AS DOUBLE)), 6) AS min,
  round(arg_max(CAST(0.5 * va + 0.5 * tm AS DOUBLE), step), 6) AS final, round(coalesce(regr_slope(0.5 * va + 0.5 * tm, step), 0), 6) AS slope,
  round(avg(va), 6) AS verb_align_rate, round(avg(tm), 6) AS target_match_rate FROM sc GROUP BY session_id""")
def coherence_features(spark, sf_dir):
    return tj.coherence(bind.turns(spark, sf_dir))


@query("trivial_features", f"""WITH {ACTS}, rn AS (SELECT user_id AS session_id, max(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS k FROM events WHERE user_id % 5 <> 0 GROUP BY user_id),
n AS (SELECT session_id, count(*) AS n_turns, count(a.turn) AS n_parsed_actions FROM b2 LEFT JOIN ac a USING (session_id, turn) GROUP BY session_id)
SELECT session_id, n_turns, n_parsed_actions, CASE WHEN k IS NULL THEN 0 ELSE CAST(k % 40 AS INT) END AS patch_len,
  CASE k % 3 WHEN 0 THEN 'submitted' WHEN 1 THEN 'early_exit' ELSE 'unknown' END AS exit_status, CASE WHEN k % 2 = 0 THEN 'm' || (k % 4) ELSE 'unknown' END AS model_name
FROM n LEFT JOIN rn USING (session_id)""")
def trivial_features(spark, sf_dir):
    per = bind.raw_events(spark, sf_dir).where("user_id % 5 <> 0").groupBy(F.col("user_id").alias("session_id")).agg(F.max("k").alias("k"))
    k = F.col("k")
    runs = per.select("session_id", F.repeat(F.lit("+"), (k % 40).cast("int")).alias("patch"),
                      F.when(k % 3 == 0, "submitted").when(k % 3 == 1, "early_exit").otherwise("").alias("exit_status"),
                      F.when(k % 2 == 0, F.concat(F.lit("m"), (k % 4).cast("string"))).alias("model"))
    return tj.trivial(bind.turns(spark, sf_dir), runs)


@query("tool_count_matrix", f"""WITH {ACTS} SELECT session_id, count(*) FILTER (WHERE tool_name = 'create') AS "create",
  count(*) FILTER (WHERE tool_name = 'edit') AS edit, count(*) FILTER (WHERE tool_name = 'open') AS open,
  count(*) FILTER (WHERE tool_name = 'python') AS python, count(*) FILTER (WHERE tool_name = 'search_dir') AS search_dir
FROM act GROUP BY session_id""")
def tool_count_matrix(spark, sf_dir):
    counts = tj.tool_counts(tj.actions(bind.turns(spark, sf_dir)))
    return counts.groupBy("session_id").pivot("tool_name", ["create", "edit", "open", "python", "search_dir"]).agg(
        F.sum("n")).na.fill(0)


@query("spaced_pairs", f"""WITH {ACTS}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM act)
SELECT session_id, step, tool_name, target_path FROM n
WHERE n <= 6 OR list_contains(list_transform(range(6), lambda i: CAST(floor(i * (n - 1) / 5.0) AS BIGINT) + 1), step)""")
def spaced_pairs(spark, sf_dir):
    return tj.spaced_pairs(tj.actions(bind.turns(spark, sf_dir)))


@query("graded_outcome", f"""WITH {b1()}, g AS (SELECT session_id, count(*) FILTER (WHERE event_type = 'purchase') AS p,
   count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'signup' AND k % 5 = 0) AS e FROM b1 GROUP BY session_id)
SELECT session_id, CASE WHEN session_id % 7 = 0 THEN NULL WHEN session_id % 5 = 0 THEN CASE WHEN p > 0 THEN 1.0 END
  WHEN p + f + e > 0 THEN round(p / (p + f + e), 6) END AS g FROM g""")
def graded_outcome(spark, sf_dir):
    ev = bind.events(spark, sf_dir)
    def n(c):
        return F.count(F.when(c, 1)).cast("string")
    kind = F.col("event_type")
    logs = ev.df.groupBy("session_id").agg(
        n(kind == "purchase").alias("p"), n(kind == "error").alias("f"),
        n((kind == "signup") & (F.col("k") % 5 == 0)).alias("e"))
    text = (F.when(F.col("session_id") % 7 == 0, "no tests ran")
            .when(F.col("session_id") % 5 == 0, F.concat("p", F.lit(" passed")))
            .otherwise(F.concat(F.lit("== "), "p", F.lit(" passed, "), "f", F.lit(" failed, "), "e", F.lit(" error =="))))
    return logs.select("session_id", F.round(tx.passed_share(text), 6).alias("g"))
