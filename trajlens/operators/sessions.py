"""Whole-session summaries: trace features, digests, reports, user signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions import text as tx
from trajlens.operators.trajectories import slope
from trajlens.sequence import Ordered


def trace_features(ev: Ordered) -> DataFrame:
    """Rates, slopes and totals of one session."""
    framed = ev.frame(1, 0, {
        "_same": lambda w: F.lag("tool").over(w) == F.col("tool"),
        "_moved": lambda w: F.lag("output_hash").over(w) != F.col("output_hash")})
    n = F.count("*")
    tokens = F.col("tokens_in") + F.col("tokens_out")
    per = framed.df.groupBy(*ev.keys).agg(
        n.alias("events"), (F.max("timestamp") - F.min("timestamp")).alias("_span"),
        F.count_distinct("tool").alias("_tools"), F.count("tool").alias("_calls"),
        F.count(F.when(F.col("_same"), 1)).alias("_same"), slope(F.col("latency_ms"), F.col(ev.order)).alias("latency_slope"),
        slope(tokens, F.col(ev.order)).alias("token_slope"), F.count(F.when(~F.col("success"), 1)).alias("_errors"),
        F.count(F.when(F.col("_moved"), 1)).alias("_moves"),
        F.count(F.when(F.col("type").isin("reasoning", "planning"), 1)).alias("plan_depth"),
        F.sum(tokens).alias("total_tokens"), F.sum("latency_ms").alias("total_latency_ms"))
    e = F.col("events")
    return per.select(
        *ev.keys, "events", F.round(e / F.greatest("_span", F.lit(1e-9)), 6).alias("event_rate"),
        F.round(F.col("_tools") / F.greatest("_calls", F.lit(1)), 6).alias("tool_diversity"),
        F.round(F.col("_same") / e, 6).alias("repetition_rate"), F.round("latency_slope", 4).alias("latency_slope"),
        F.round("token_slope", 4).alias("token_slope"), F.round(F.col("_errors") / e, 6).alias("error_rate"),
        F.round(F.col("_moves") / e, 6).alias("state_change_rate"), "plan_depth", "total_tokens",
        F.round("total_latency_ms", 2).alias("total_latency_ms"))


def digest(ev: Ordered) -> DataFrame:
    """Counts, error rate, duration and the first and last user message of one session."""
    user = F.col("type") == "user_input"
    call = F.col("type") == "tool_call"
    step = F.col(ev.order)
    return ev.df.groupBy(*ev.keys).agg(
        F.count("*").alias("lines"), F.count(F.when(user, 1)).alias("user_messages"), F.count(F.when(call, 1)).alias("tool_calls"),
        F.count(F.when(call & ~F.col("success"), 1)).alias("errors"),
        F.round(F.count(F.when(call & ~F.col("success"), 1)) / F.greatest(F.count(F.when(call, 1)), F.lit(1)), 6).alias("error_rate"),
        F.round(F.max("timestamp") - F.min("timestamp"), 3).alias("duration_sec"),
        F.min_by("goal_text", F.when(user, step)).alias("first_message"), F.max_by("goal_text", F.when(user, step)).alias("last_message"),
        F.count_distinct(F.when(call, F.col("tool"))).alias("unique_tools"))


def sampled_messages(ev: Ordered, n: int = 5) -> DataFrame:
    """Up to ``n`` user messages at even distances, leaving out the first and the last."""
    said = ev.select("type", "goal_text").substream(F.col("type") == "user_input", "nth").totals(_m=F.max("nth"))
    at, m = F.col("nth") - 1, F.col("_m")
    gap = F.greatest(F.lit(1), F.floor(m / (n + 1)))
    return said.df.where((m > 2) & (at % gap == 0) & (at >= gap) & (at < m - 1) & (at / gap <= n)).select(
        *ev.keys, F.col(ev.order), "goal_text")


def reprompts(messages: DataFrame, order: str, minimum: float = 0.6) -> DataFrame:
    """User messages at least ``minimum`` Jaccard-similar to an earlier one of the session.

    Messages with the same words collapse into one set first. Two sets that similar
    must share one of their rarest words: of n words ordered from the session's
    rarest, one of the first n - ceil(minimum n) + 1. Only sets meeting in such a
    word are compared, and then exactly.
    """
    worded = messages.withColumn("_set", F.array_sort(tx.word_set(F.col("text")))).where(F.size("_set") > 0)
    sets = worded.groupBy("session_id", "_set").agg(F.min(order).alias("_first")).withColumn("_n", F.size("_set"))
    words = sets.select("session_id", "_first", "_n", F.explode("_set").alias("_word"))
    rarity = words.groupBy("session_id", "_word").agg(F.count("*").alias("_df"))
    ordered = words.join(rarity, ["session_id", "_word"]).groupBy("session_id", "_first", "_n").agg(
        F.array_sort(F.collect_list(F.struct("_df", "_word"))).alias("_ranked"))
    keep = F.col("_n") - F.ceil(F.col("_n") * minimum - 1e-9) + 1
    prefix = ordered.select("session_id", "_first", "_n", F.explode(F.slice("_ranked", F.lit(1), keep.cast("int"))).alias("_e"))
    left = prefix.select("session_id", F.col("_e._word").alias("_word"), F.col("_first").alias("_a"), F.col("_n").alias("_na"))
    right = prefix.select("session_id", F.col("_e._word").alias("_word"), F.col("_first").alias("_b"), F.col("_n").alias("_nb"))
    close = (F.col("_a") < F.col("_b")) & (F.col("_na") >= F.col("_nb") * minimum - 1e-9) & (F.col("_nb") >= F.col("_na") * minimum - 1e-9)
    pairs = left.join(right, ["session_id", "_word"]).where(close).select("session_id", "_a", "_b").distinct()
    body = sets.select("session_id", "_first", "_set")
    checked = (pairs.join(body.withColumnsRenamed({"_first": "_a", "_set": "_sa"}), ["session_id", "_a"])
               .join(body.withColumnsRenamed({"_first": "_b", "_set": "_sb"}), ["session_id", "_b"])
               .where(tx.jaccard(F.col("_sa"), F.col("_sb")) >= minimum).select("session_id", F.col("_b").alias("_hit")).distinct())
    repeats = worded.join(sets.select("session_id", "_set", "_first"), ["session_id", "_set"]).where(
        F.col(order) > F.col("_first")).select("session_id", order)
    return repeats.unionByName(checked.select("session_id", F.col("_hit").alias(order)))


def signals(ev: Ordered) -> DataFrame:
    """Literal loops, error retries and resolution of a session of calls and user messages."""
    call = F.col("type") == "tool_call"
    calls = ev.select("type", "tool", "input_hash", "success").substream(call, "call_no").with_columns(
        _op=F.concat_ws(":", "tool", "input_hash")).islands("_op", run="_run", start="_start").frame(1, 0, {
            "_retry": lambda w: (F.lag("_op").over(w) == F.col("_op")) & ~F.lag("success").over(w)})
    per_call = calls.df.groupBy(*ev.keys).agg(
        F.count("*").alias("tool_calls"), F.count(F.when(~F.col("success"), 1)).alias("errors"),
        F.max(F.col("call_no") - F.col("_start") + 1).alias("literal_loop_max"),
        F.count(F.when(F.col("_retry"), 1)).alias("error_retry_cycles"))
    said = ev.df.where(F.col("type") == "user_input")
    text = F.col("goal_text")
    per_user = said.groupBy(*ev.keys).agg(
        F.count("*").alias("user_messages"), F.count(F.when(text.rlike(tx.FRUSTRATION), 1)).alias("frustration_hits"),
        F.count(F.when(text.rlike(tx.CORRECTION), 1)).alias("correction_hits"),
        F.max_by(text, F.when(tx.is_prose(text), F.col(ev.order))).alias("_final"))
    final = F.col("_final")
    resolution = (F.when(final.rlike(tx.FRUSTRATION) | final.rlike(tx.NEGATIVE_CLOSE), "negative")
                  .when(final.rlike(tx.POSITIVE_CLOSE), "positive").otherwise("none"))
    joined = per_call.join(per_user, list(ev.keys), "full_outer").withColumn("resolution", resolution)
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in (
        "tool_calls", "errors", "literal_loop_max", "error_retry_cycles", "user_messages", "frustration_hits", "correction_hits")}
    return joined.select(*ev.keys, *[c.alias(n) for n, c in counts.items()], "resolution",
                         ((counts["errors"] > 0) & final.isNull()).alias("abandoned"))


def call_signals(calls: DataFrame) -> DataFrame:
    """Per session: tasks created and completed, undone work and results of its tool calls.

    ``calls`` has ``session_id, tool, input`` (JSON) and ``has_result``.
    """
    done = F.lower(F.get_json_object("input", "$.status")) == "completed"
    command = F.coalesce(F.get_json_object("input", "$.command"), F.lit(""))

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return calls.groupBy("session_id").agg(
        F.count("*").alias("tool_calls"), n(F.col("has_result")).alias("tool_results"), n(F.col("tool") == "TaskCreate").alias("tasks_created"),
        n((F.col("tool") == "TaskUpdate") & done).alias("tasks_completed"),
        n((F.col("tool") == "Bash") & command.rlike(tx.GIT_UNDO)).alias("git_undo"))


def signal_ratings(found: DataFrame) -> DataFrame:
    """Signals as ratings; what a trace cannot show stays without a value."""
    loop = F.col("literal_loop_max")
    stuck = F.when(loop < 3, 1).when(loop < 5, 2).when(loop < 8, 3).when(loop < 15, 4).otherwise(5)
    satisfied = F.when(F.col("resolution") == "positive", 5).when(F.col("resolution") == "negative", 1)
    def row(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("dimension"), value.cast("int").alias("value"))
    return found.select("session_id", F.inline(F.array(
        row("stuck_in_loop", stuck), row("user_satisfied", satisfied), row("goal_drifted", F.lit(None)),
        row("coherent_progress", F.lit(None)), row("overall_health", F.lit(None)))))


def top_counts(df: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """The k most frequent items per key; Spark keeps k per key before it shuffles the counts."""
    from pyspark.sql import Window
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def corpus_report(detections: DataFrame, sessions: DataFrame) -> DataFrame:
    """Firing counts per failure and severity, with subtotals, over all sessions."""
    total = sessions.count()
    return detections.cube("failure", "severity").agg(
        F.count("*").alias("fired"), F.count_distinct("session_id").alias("sessions"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence")).withColumn(
        "firing_rate", F.round(F.col("sessions") / float(total), 4))
