"""Session summaries, user signals and corpus reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions import text as tx
from trajlens.operators import sessions as ss
from trajlens.plans.evaluation import DET, found
from trajlens.plans.registry import query
from trajlens.plans.sqltext import B1A, B3, b1, b1t
from trajlens.sources import bind
from trajlens.sequence import number_rows

T = b1t()


@query("trace_features", f"""WITH {T}, l AS (SELECT *, lag(tool) OVER w = tool AS same, lag(output_hash) OVER w <> output_hash AS mv FROM bt WINDOW w AS (PARTITION BY session_id ORDER BY step))
SELECT session_id, count(*) AS events, round(count(*) / greatest(max(timestamp) - min(timestamp), 1e-9), 6) AS event_rate,
  round(count(DISTINCT tool) / greatest(count(tool), 1), 6) AS tool_diversity, round(count(*) FILTER (WHERE same) / count(*), 6) AS repetition_rate,
  round(regr_slope(latency_ms, step), 4) AS latency_slope, round(regr_slope(tokens_in + tokens_out, step), 4) AS token_slope,
  round(count(*) FILTER (WHERE NOT success) / count(*), 6) AS error_rate, round(count(*) FILTER (WHERE mv) / count(*), 6) AS state_change_rate,
  count(*) FILTER (WHERE type = 'reasoning') AS plan_depth, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, round(sum(latency_ms), 2) AS total_latency_ms FROM l GROUP BY session_id""")
def trace_features(spark, sf_dir):
    return ss.trace_features(bind.with_seconds(bind.trace_events(spark, sf_dir)))


@query("session_digest", f"""WITH {T} SELECT session_id, count(*) AS lines, count(*) FILTER (WHERE type = 'user_input') AS user_messages, count(*) FILTER (WHERE type = 'tool_call') AS tool_calls,
  count(*) FILTER (WHERE type = 'tool_call' AND NOT success) AS errors, round(count(*) FILTER (WHERE type = 'tool_call' AND NOT success) / greatest(count(*) FILTER (WHERE type = 'tool_call'), 1), 6) AS error_rate,
  round(max(timestamp) - min(timestamp), 3) AS duration_sec, arg_min(goal_text, step) FILTER (WHERE type = 'user_input') AS first_message,
  arg_max(goal_text, step) FILTER (WHERE type = 'user_input') AS last_message, count(DISTINCT CASE WHEN type = 'tool_call' THEN tool END) AS unique_tools FROM bt GROUP BY session_id""")
def session_digest(spark, sf_dir):
    return ss.digest(bind.with_seconds(bind.trace_events(spark, sf_dir)))


@query("sampled_messages", f"""WITH {T}, u AS (SELECT session_id, step, goal_text, row_number() OVER (PARTITION BY session_id ORDER BY step) - 1 AS at_, count(*) OVER (PARTITION BY session_id) AS m FROM bt WHERE type = 'user_input'),
g AS (SELECT *, greatest(1, floor(m / 3)) AS gap FROM u) SELECT session_id, step, goal_text FROM g WHERE m > 2 AND at_ % gap = 0 AND at_ >= gap AND at_ < m - 1 AND at_ / gap <= 2""")
def sampled_messages(spark, sf_dir):
    return ss.sampled_messages(bind.trace_events(spark, sf_dir), 2)


@query("top_tools", f"""WITH {T}, c AS (SELECT session_id, tool, count(*) AS n FROM bt WHERE tool IS NOT NULL GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY n DESC, tool) AS INT) AS rank FROM c QUALIFY rank <= 2""")
def top_tools(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir)
    return ss.top_counts(ev.df.where(F.col("tool").isNotNull()), ["session_id"], "tool", 2)


SIGNALS = f"""{T}, cl AS (SELECT session_id, step, success, tool || ':' || input_hash AS op, row_number() OVER (PARTITION BY session_id ORDER BY step) AS no FROM bt WHERE type = 'tool_call'),
cg AS (SELECT *, CASE WHEN lag(op) OVER w = op THEN 0 ELSE 1 END AS chg, lag(op) OVER w = op AND NOT lag(success) OVER w AS retry FROM cl WINDOW w AS (PARTITION BY session_id ORDER BY no)),
cr AS (SELECT *, no - max(CASE WHEN chg = 1 THEN no END) OVER (PARTITION BY session_id ORDER BY no) + 1 AS run FROM cg),
pc AS (SELECT session_id, count(*) AS tool_calls, count(*) FILTER (WHERE NOT success) AS errors, max(run) AS literal_loop_max, count(*) FILTER (WHERE retry) AS error_retry_cycles FROM cr GROUP BY session_id),
pu AS (SELECT session_id, count(*) AS user_messages, arg_max(goal_text, step) AS fin FROM bt WHERE type = 'user_input' GROUP BY session_id),
sg AS (SELECT session_id, coalesce(tool_calls, 0) AS tool_calls, coalesce(errors, 0) AS errors, coalesce(literal_loop_max, 0) AS literal_loop_max, coalesce(error_retry_cycles, 0) AS error_retry_cycles,
  coalesce(user_messages, 0) AS user_messages, 0::BIGINT AS frustration_hits, 0::BIGINT AS correction_hits,
  CASE WHEN contains(fin, 'looks good') THEN 'positive' ELSE 'none' END AS resolution, coalesce(errors, 0) > 0 AND fin IS NULL AS abandoned FROM pc FULL JOIN pu USING (session_id))"""


@query("session_signals", f"WITH {SIGNALS} SELECT * FROM sg")
def session_signals(spark, sf_dir):
    out = ss.signals(bind.trace_events(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("long") for c in ("frustration_hits", "correction_hits")})


@query("signal_ratings", f"""WITH {SIGNALS} SELECT session_id, unnest(['stuck_in_loop', 'user_satisfied', 'goal_drifted', 'coherent_progress', 'overall_health']) AS dimension,
  unnest([CASE WHEN literal_loop_max < 3 THEN 1 WHEN literal_loop_max < 5 THEN 2 WHEN literal_loop_max < 8 THEN 3 WHEN literal_loop_max < 15 THEN 4 ELSE 5 END,
   CASE resolution WHEN 'positive' THEN 5 WHEN 'negative' THEN 1 END, NULL, NULL, NULL]) AS value FROM sg""")
def signal_ratings(spark, sf_dir):
    return ss.signal_ratings(ss.signals(bind.trace_events(spark, sf_dir)))


WORDS = "list_distinct(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1))"


@query("reprompts", f"""WITH {B3}, w AS (SELECT session_id, turn, {WORDS} AS s FROM b3 WHERE role = 'user')
SELECT DISTINCT b.session_id, b.turn FROM w a JOIN w b ON a.session_id = b.session_id AND a.turn < b.turn
WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.1""")
def reprompts(spark, sf_dir):
    said = bind.conversation_turns(spark, sf_dir).df.where("role = 'user'")
    return ss.reprompts(said, "turn", 0.1)


@query("turn_similarity", f"""WITH {B3}, w AS (SELECT session_id, turn, {WORDS} AS s FROM b3), l AS (SELECT *, lag(s) OVER (PARTITION BY session_id ORDER BY turn) AS p FROM w)
SELECT session_id, turn, round(CASE WHEN len(s) > 0 AND len(p) > 0 THEN len(list_intersect(s, p)) / (len(s) + len(p) - len(list_intersect(s, p))) ELSE 0.0 END, 6) AS similarity FROM l WHERE turn > 1""")
def turn_similarity(spark, sf_dir):
    ev = bind.conversation_turns(spark, sf_dir).with_columns(_w=tx.word_set(F.col("text")))
    framed = ev.select("_w").frame(1, 0, {"_p": lambda w: F.lag("_w").over(w)})
    return framed.df.where("turn > 1").select("session_id", "turn", F.round(tx.jaccard(F.col("_w"), F.col("_p")), 6).alias("similarity"))


@query("prose_flags", f"""WITH {B3}, t AS (SELECT session_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM b3),
s AS (SELECT *, length(regexp_replace(t, '[^\\p{{L}}\\s]', '', 'g')) / greatest(length(t), 1) AS share FROM t)
SELECT session_id, turn, t <> '' AND NOT starts_with(t, '<') AND NOT contains(t, '====') AND NOT contains(t, '$ ') AND NOT contains(t, '>>>') AND share > 0.65 AS prose,
  t <> '' AND length(t) <= 160 AND NOT contains(t, chr(10)) AND NOT contains(t, '$ ') AND NOT contains(t, '>>>') AND share > 0.7 AS reaction FROM s""")
def prose_flags(spark, sf_dir):
    ev = bind.conversation_turns(spark, sf_dir)
    return ev.df.select("session_id", "turn", tx.is_prose(F.col("text")).alias("prose"), tx.is_reaction(F.col("text")).alias("reaction"))


@query("corpus_report", f"""WITH {DET}, d AS (SELECT *, CASE WHEN confidence >= 0.4 THEN 'critical' ELSE 'warning' END AS severity FROM det)
SELECT failure, severity, count(*) AS fired, count(DISTINCT session_id) AS sessions, round(avg(confidence), 4) AS mean_confidence,
  round(count(DISTINCT session_id) / (SELECT count(DISTINCT session_id) FROM b1), 4) AS firing_rate FROM d GROUP BY CUBE (failure, severity)""")
def corpus_report(spark, sf_dir):
    d = found(spark, sf_dir).withColumn("severity", F.when(F.col("confidence") >= 0.4, "critical").otherwise("warning"))
    return ss.corpus_report(d, bind.table(spark, sf_dir, "events").select("user_id").distinct())


@query("session_manifest", f"""WITH {b1()} SELECT session_id, count(*) AS lines, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*) FILTER (WHERE NOT success) AS errors,
  min(ts) AS first_ts, max(ts) AS last_ts FROM b1 GROUP BY session_id""")
def session_manifest(spark, sf_dir):
    return bind.raw_events(spark, sf_dir).groupBy(F.col("user_id").alias("session_id")).agg(
        F.count("*").alias("lines"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("discover_sessions", f"""WITH {b1()} SELECT session_id, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts FROM b1 GROUP BY session_id HAVING count(*) >= 60""")
def discover_sessions(spark, sf_dir):
    from trajlens.sources.sessions import discover
    lines = bind.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts")
    return discover(lines, "session_id", "ts", 60)


@query("archive_changes", f"""WITH {b1()}, s AS (SELECT session_id AS name, count(*) AS bytes FROM b1 WHERE session_id % 5 <> 0 GROUP BY 1), d AS (SELECT session_id AS name, count(*) FILTER (WHERE event_id % 3 <> 0 OR session_id % 2 = 0) AS bytes FROM b1 WHERE session_id % 7 <> 0 GROUP BY 1),
j AS (SELECT coalesce(s.bytes, 0) AS a, d.bytes AS b, s.bytes IS NULL AS gone FROM s FULL JOIN d USING (name))
SELECT CASE WHEN gone THEN 'kept' WHEN b IS NULL THEN 'new' WHEN a > b THEN 'grew' ELSE 'unchanged' END AS action, count(*) AS files, CAST(sum(greatest(a, coalesce(b, 0))) AS BIGINT) AS bytes FROM j GROUP BY 1""")
def archive_changes(spark, sf_dir):
    from trajlens.sources.sessions import archive_actions
    ev = bind.table(spark, sf_dir, "events")
    def sizes(cond, keep):
        return ev.where(keep).groupBy(F.col("user_id").alias("name")).agg(F.count(F.when(cond, 1)).alias("bytes"))
    source = sizes(F.lit(True), F.col("user_id") % 5 != 0)
    kept = sizes((F.col("event_id") % 3 != 0) | (F.col("user_id") % 2 == 0), F.col("user_id") % 7 != 0)
    return archive_actions(source, kept).groupBy("action").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("merged_streams", f"""WITH {b1()}, m AS (SELECT 'a' AS source, session_id, ts, event_id, symbol FROM b1 WHERE event_id % 2 = 0 UNION ALL SELECT 'b', session_id, ts, event_id, symbol FROM b1 WHERE event_id % 2 = 1)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, source, event_id) AS step, source, symbol FROM m""")
def merged_streams(spark, sf_dir):
    """Two sources merged by time and numbered afresh."""
    ev = bind.raw_events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts", "event_id", F.col("event_type").alias("symbol"))
    a = ev.where("event_id % 2 = 0").withColumn("source", F.lit("a"))
    b = ev.where("event_id % 2 = 1").withColumn("source", F.lit("b"))
    return number_rows(a.unionByName(b), ["session_id"], ["ts", "source", "event_id"]).df.select("session_id", "step", "source", "symbol")


@query("sub_agents", f"""WITH {B1A} SELECT coalesce(CAST(nullif(agent_id, 0) AS VARCHAR), 'main') AS agent, count(*) AS events, count(DISTINCT resource) AS resources, count(*) FILTER (WHERE symbol = 'error') AS errors FROM b1a GROUP BY 1""")
def sub_agents(spark, sf_dir):
    ev = bind.agent_events(spark, sf_dir)
    agent = F.coalesce(F.when(F.col("agent_id") != 0, F.col("agent_id").cast("string")), F.lit("main"))
    return ev.df.groupBy(agent.alias("agent")).agg(F.count("*").alias("events"), F.count_distinct("resource").alias("resources"),
                                                    F.count(F.when(F.col("symbol") == "error", 1)).alias("errors"))


@query("similar_cases", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS c FROM embeddings, q)
SELECT vec_id, label, round(c, 6) AS similarity FROM s ORDER BY round(c, 9) DESC, vec_id LIMIT 10""")
def similar_cases(spark, sf_dir):
    """The ten cases nearest to a given case by cosine; one vector is the query, the table is scanned once."""
    from trajlens.operators.cases import nearest
    vectors = bind.table(spark, sf_dir, "embeddings")
    given = vectors.orderBy("vec_id").select("embedding").first()[0]
    return nearest(vectors, "embedding", [float(x) for x in given], "vec_id", 10).select("vec_id", "label", "similarity")
