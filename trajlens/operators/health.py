"""Health, status and context of sessions built on phases, detections and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions import infotheory as it
from trajlens.functions.events import any_of
from trajlens.functions.taxonomy import signature_colour
from trajlens.operators import detectors as dt
from trajlens.operators.metrics import window_sums
from trajlens.sequence import Ordered

# Points per phase reached, trust lost per finding.
PENALTY = {"info": 0.02, "warning": 0.08, "critical": 0.20}


def memory_operations(ev: Ordered, window: int = 50, least: int = 10) -> Ordered:
    """Namespace entropy and escalation rate of the last memory operations, from the tenth on.

    Needs ``event_type, namespace``; values are carried over the other events.
    """
    from trajlens.operators.cognition import carried
    ops = ev.select("event_type", "namespace").substream(F.startswith("event_type", F.lit("memory_")), "op_no").with_columns(
        _ns=F.coalesce("namespace", F.lit("unknown")), _esc=(F.col("event_type") == "memory_tier_escalation").cast("int"))
    summed = window_sums(ops, window, {"_s": "_ns"}).frame(window - 1, 0, {
        "_e": lambda w: F.sum("_esc").over(w.rowsBetween(1 - window, 0))})
    n = F.least(F.col("op_no"), F.lit(window))
    ready = F.col("op_no") >= least
    return carried(ev, summed, {
        "namespace_entropy": F.when(ready, it.stored(it.entropy_of_sum(F.col("_s"), n))),
        "escalation_rate": F.when(ready, it.stored(F.col("_e") / n))})


def status(ev: Ordered, lookback: int = 30) -> Ordered:
    """Status colour of every step from the latest anomaly; ``signature`` is null elsewhere."""
    step = F.col(ev.order)
    seen = ev.running(_at=("last", F.when(F.col("signature").isNotNull(), step)), _name=("last", F.col("signature")))
    since = step - F.col("_at")
    recent = F.coalesce(since <= lookback, F.lit(False))
    return seen.on(seen.df.withColumns({
        "colour": F.when(recent, signature_colour(F.col("_name"))).otherwise("green"),
        "recovered": F.coalesce(since == lookback, F.lit(False))}).drop("_at", "_name"))


def plan_deviation(ev: Ordered, expected: dict[str, tuple[float, float]], limit: float = 2.5) -> DataFrame:
    """Steps whose entropy is far from what the phase's plan expects."""
    mean, std = F, F
    for phase, (m, s) in expected.items():
        mean, std = mean.when(F.col("phase") == phase, m), std.when(F.col("phase") == phase, s)
    z = F.abs(F.col("action_entropy") - mean) / F.greatest(std, F.lit(0.01))
    return ev.df.where((F.col("action_entropy") != 0) & (z > limit)).select(
        *ev.keys, F.col(ev.order), "phase", F.round("action_entropy", 3).alias("entropy"), F.round(z + 1e-9, 2).alias("z_score"))


def evaluation_learning(grades: DataFrame, found: DataFrame, failing: float = 0.7, bucket: int = 256) -> DataFrame:
    """Graded step ranges with the anomalies inside: learned signatures or a detection gap."""
    poor = grades.where(F.col("score") < failing)
    # Ranges and anomalies meet in buckets of steps, so a session with many of both is spread over its buckets.
    spread = poor.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("from_step") / bucket), F.floor(F.greatest("from_step", "to_step") / bucket))))
    inside = spread.join(found.withColumn("_bucket", F.floor(F.col("step") / bucket)), ["session_id", "_bucket"]).where(
        F.col("step").between(F.col("from_step"), F.col("to_step")))
    learned = inside.groupBy("signature").agg(F.count("*").alias("patterns"), F.count_distinct("session_id", "sprint").alias("sprints"))
    hits = inside.groupBy("session_id", "sprint").agg(F.count("*").alias("_n"))
    gaps = poor.join(hits, ["session_id", "sprint"], "left_anti").agg(F.count("*").alias("patterns"), F.count_distinct("session_id", "sprint").alias("sprints"))
    return learned.select("signature", "patterns", "sprints", (F.col("patterns") * -0.5).alias("threshold_change")).unionByName(
        gaps.select(F.lit("none").alias("signature"), "patterns", "sprints", F.lit(0.0).alias("threshold_change")))


def session_health(progress: DataFrame, detections: DataFrame) -> DataFrame:
    """Completion, failure density, trust and health of each session."""
    level = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    loss = F
    for k, v in PENALTY.items():
        loss = loss.when(F.col("severity") == k, v)
    per = detections.groupBy("session_id").agg(F.count("*").alias("diagnoses"), F.max(level).alias("_worst"), F.sum(loss).alias("_loss"))
    joined = progress.join(per, "session_id", "left")
    points = F
    for name, p in (("gathering", 20), ("planning", 40), ("executing", 60), ("verifying", 80), ("delivering", 100)):
        points = points.when(F.col("max_phase") == name, p)
    done = F.greatest(F.lit(0), points.otherwise(0) - F.col("regressions") * 5)
    health = (F.when(F.col("_worst") == 2, "failing").when(F.col("_worst") == 1, "degraded").when(done < 30, "degraded").otherwise("healthy"))
    return joined.select(
        "session_id", done.cast("long").alias("completion"), F.coalesce("diagnoses", F.lit(0)).alias("diagnoses"),
        F.round(F.coalesce("diagnoses", F.lit(0)) / F.col("total_events") * 100, 2).alias("failure_density"),
        F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("_loss", F.lit(0.0))), 2).alias("trust"), health.alias("health"))


def triage(ev: Ordered, progress: DataFrame, detections: DataFrame) -> DataFrame:
    """Whether a session's phases are plausible, and a first verdict on its findings."""
    writes = any_of(F.lower("tool"), ("write", "edit", "write_file", "edit_file", "create"))
    facts = ev.df.groupBy(*ev.keys).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("type") == "tool_call", 1)).alias("calls"),
        F.coalesce(F.bool_or((F.col("type") == "tool_call") & writes), F.lit(False)).alias("wrote"))
    fired = detections.groupBy("session_id").agg(
        F.count_distinct("failure").alias("_kinds"), F.min("failure").alias("_one"), F.bool_or(F.col("severity") == "critical").alias("_critical"))
    joined = facts.join(progress.select("session_id", "current_phase", "progress"), "session_id").join(fired, "session_id", "left")
    odd = (F.col("wrote") & (F.col("current_phase") == "gathering") & (F.col("calls") > 5)) | ((F.col("progress") == 0) & (F.col("n") > 20))
    verdict = (F.when(odd, "parser_issue").when(F.col("_kinds").isNull(), "clean")
               .when((F.col("_kinds") == 1) & (F.col("_one") == "goal_drift") & (F.col("n") < 30), "false_alarm")
               .when((F.col("_kinds") == 1) & (F.col("_one") == "step_repetition"), "ambiguous")
               .when((F.col("_kinds") > 1) | F.col("_critical"), "real").otherwise("ambiguous"))
    return joined.select("session_id", (~odd).alias("plausible"), verdict.alias("verdict"))


def calibrated_repetition(ev: Ordered, fitted: DataFrame, min_run: int = 4) -> DataFrame:
    """Repetition among the last 30 events beyond the phase's own 95th percentile; needs ``phase``."""
    sized = ev.select("type", "tool", "phase").totals(_n=F.max(ev.order))
    phase = ev.df.groupBy(*ev.keys).agg(F.max_by("phase", ev.order).alias("phase"), F.max(ev.order).alias("at_step"))
    tail = sized.on(sized.df.where(F.col(ev.order) > F.col("_n") - 30)).with_columns(_op=F.coalesce("tool", "type"))
    calls = tail.substream(F.col("type") == "tool_call", "call_no")
    runs = dt.longest_runs(calls.islands("_op"), F.first("_op").alias("tool"))
    counts = calls.frame(1, 0, {"_same": lambda w: F.lag("_op").over(w) == F.col("_op")}).df.groupBy(*ev.keys).agg(
        F.count("*").alias("_calls"), F.count(F.when(F.col("_same"), 1)).alias("_same"))
    limits = fitted.where(F.col("metric") == "repetition_rate").select("phase", F.col("n").alias("_fit"), "p95")
    rate = F.col("_same") / F.col("_calls")
    joined = counts.join(runs, list(ev.keys)).join(phase, list(ev.keys)).join(limits, "phase")
    return joined.where((F.col("at_step") >= 30) & (F.col("_calls") >= 5) & (F.col("_fit") >= 3) & (rate > F.col("p95"))
                        & (F.col("run_length") >= min_run)).select(
        *ev.keys, F.round(F.least(rate / F.greatest(F.col("p95") * 2, F.lit(0.01)), F.lit(1.0)), 4).alias("confidence"), "at_step",
        F.round(rate, 4).alias("repetition_rate"), "phase", "tool", "run_length")


def calibrated_drift(moves: DataFrame, model: DataFrame, divergence: DataFrame, novel: DataFrame, least: float = 0.5) -> DataFrame:
    """Weighted drift score from rare transitions, tool divergence, new tools and regressions."""
    known = model.select("from_phase").distinct()
    rare = moves.join(model.select("from_phase", "to_phase", "is_rare"), ["from_phase", "to_phase"], "left").join(
        known.withColumn("_k", F.lit(True)), "from_phase", "left")
    odd = F.col("_k") & F.coalesce("is_rare", F.lit(True))
    per = rare.groupBy("session_id").agg(F.count(F.when(odd, 1)).alias("anomalous_transitions"),
                                         F.count(F.when(F.col("is_regression"), 1)).alias("regressions"))
    joined = per.join(divergence.groupBy("session_id").agg(F.max("divergence").alias("divergence")), "session_id", "left").join(
        novel.groupBy("session_id").agg(F.max("novel_ratio").alias("novel_ratio")), "session_id", "left")
    a, d = F.col("anomalous_transitions"), F.coalesce("divergence", F.lit(0.0))
    score = (F.when(a >= 3, 0.4).when(a >= 1, 0.2).otherwise(0.0) + F.when(d > 1.0, 0.3).when(d > 0.5, 0.15).otherwise(0.0)
             + F.when(F.coalesce("novel_ratio", F.lit(0.0)) > 0.3, 0.2).otherwise(0.0) + F.when(F.col("regressions") > 8, 0.2).otherwise(0.0))
    return joined.withColumn("confidence", F.round(score, 3)).where(F.col("confidence") >= least).select(
        "session_id", "confidence", "anomalous_transitions", "regressions", F.round(d, 4).alias("divergence"))


def calibrated_missing_verification(ev: Ordered, fitted: DataFrame, least: int = 10, floor: float = 50.0) -> DataFrame:
    """Execution beyond three times the phase's 95th percentile with no verification at all."""
    facts = dt._phase_facts(ev).where((F.col("execution_events") >= least) & (F.col("verification_events") == 0) & F.col("wrote"))
    limit = fitted.where((F.col("metric") == "step_count") & (F.col("phase") == "executing") & (F.col("n") >= 3)).select("p95").first()
    if limit is not None:
        facts = facts.where(F.col("execution_events") > max(limit[0] * 3, floor))
    return facts.select(*ev.keys, F.least(F.col("execution_events") / 100.0, F.lit(0.9)).alias("confidence"),
                        F.col("last_step").alias("at_step"), "execution_events")


def calibrated_context_loss(ev: Ordered, common: dict[str, float]) -> DataFrame:
    """Re-reads with three other calls between first and last read, or five where reading is common; needs ``phase``."""
    other = dt.is_call() & F.col("tool").isNotNull() & ~dt.is_read()
    counted = ev.select("type", "tool", "output_hash").running(_work=("count", F.when(other, 1)))
    reads = counted.df.where(dt.is_read()).withColumn("resource", F.coalesce("output_hash", "tool"))
    per = reads.groupBy(*ev.keys, "resource").agg(
        F.min(ev.order).alias("first_step"), F.max(ev.order).alias("at_step"), F.count("*").alias("read_count"),
        (F.max("_work") - F.min("_work")).alias("gap"))
    phase = ev.df.groupBy(*ev.keys).agg(F.max_by("phase", ev.order).alias("phase"), F.count("*").alias("_n"))
    usual = F
    for name, share in common.items():
        usual = usual.when(F.col("phase") == name, share)
    need = F.when(F.coalesce(usual.otherwise(0.0), F.lit(0.0)) < 0.3, 3).otherwise(5)
    hits = per.join(phase, list(ev.keys)).where((F.col("_n") >= 6) & (F.col("read_count") >= 2) & (F.col("gap") >= need))
    first = hits.groupBy(*ev.keys).agg(F.min_by(F.struct("resource", "at_step", "read_count", "gap"), "first_step").alias("_f")).select(*ev.keys, "_f.*")
    return first.select(*ev.keys, F.least(F.col("read_count") / 4.0, F.lit(1.0)).alias("confidence"), "at_step", "resource", "read_count",
                        F.col("gap").alias("intervening_operations"))


def stall_context(ev: Ordered, stalls: DataFrame) -> DataFrame:
    """What surrounds the stalls of a session: user input near them, adjacency, progress after the last.

    ``stalls`` has one row per stalled step.
    """
    marked = ev.on(ev.df.join(stalls.select(*ev.keys, F.col(ev.order), F.lit(1).alias("_stall")), [*ev.keys, ev.order], "left"))
    framed = marked.frame(2, 2, {"_near": lambda w: F.max((F.col("type") == "user_input").cast("int")).over(w.rowsBetween(-2, 2))})
    runs = framed.with_columns(_is=F.col("_stall").isNotNull()).islands("_is", run="_run", start="_start").totals(
        _last=F.max(F.when(F.col("_stall").isNotNull(), F.col(ev.order))))
    after = (F.col(ev.order) > F.col("_last")) & (F.col("type") == "tool_call")
    return runs.df.where(F.col("_last").isNotNull()).groupBy(*ev.keys).agg(
        F.count("_stall").alias("stalls"), F.max(F.when(F.col("_is") & (F.col("_near") == 1) & (F.col("type") != "user_input"), 1).otherwise(0)).alias("user_near"),
        F.max(F.when(F.col("_is"), F.col(ev.order) - F.col("_start") + 1)).alias("max_consecutive"),
        F.count(F.when(after, 1)).alias("calls_after"),
        F.count_distinct(F.when(after & F.col("success"), F.concat_ws("|", "tool", "output_hash"))).alias("unique_after"))


def onset_context(ev: Ordered, onsets: DataFrame, window: int = 15, head: int = 5, tail: int = 10) -> DataFrame:
    """The events around one onset step per session, and the session's first and last events."""
    sized = ev.totals(_n=F.max(ev.order)).df.join(onsets.select(*ev.keys, "onset_step"), list(ev.keys))
    step, onset = F.col(ev.order), F.col("onset_step")
    part = F.filter(F.array(
        F.when((step >= F.greatest(F.lit(1), onset - window)) & (step <= onset + window * 2 // 3), F.when(step == onset, "onset").when(
            step < onset, "before").otherwise("after")),
        F.when(step <= head, "head"), F.when(step > F.col("_n") - tail, "tail")), lambda p: p.isNotNull())
    text = F.concat_ws(" ", F.concat(F.lit("#"), step.cast("string")), "type", "tool", F.when(~F.col("success"), "FAILED"))
    return sized.select(*ev.keys, step, text.alias("line"), F.explode(part).alias("part"))


def audit_state(events: Column, anomalies: Column, mi: Column, kl: Column, compression: Column | None = None) -> Column:
    """Descriptive state of a session from its final measures and its anomaly rate."""
    looping = mi < 0.4
    if compression is not None:
        looping = looping | (compression < 0.7)
    return (F.when(events == 0, "unknown").when(looping, "looping").when((kl > 0.45) | (anomalies / events > 0.15), "phase_shifting")
            .otherwise("steady"))


def session_profile(ev: Ordered) -> DataFrame:
    """Mean latency, error rate, tools, re-read resources and the longest streak of one tool."""
    tool = F.coalesce("tool", F.lit(""))
    runs = ev.select("tool", "latency_ms", "success", "output_hash").with_columns(_tool=tool).islands("_tool")
    per = runs.df.groupBy(*ev.keys).agg(
        F.round(F.avg("latency_ms") + 1e-9, 1).alias("avg_latency_ms"), F.round(F.avg((~F.col("success")).cast("int")), 3).alias("error_rate"),
        F.count_distinct("tool").alias("unique_tools"), F.max(F.col(ev.order) - F.col("run_start") + 1).alias("longest_streak"))
    read = F.lower("tool").isin("read", "read_file", "cat", "head", "grep", "glob")
    again = ev.df.where(read & F.col("output_hash").isNotNull()).groupBy(*ev.keys, "output_hash").agg(F.count("*").alias("_n")).where(
        "_n > 1").groupBy(*ev.keys).agg(F.count("*").alias("reread_count"))
    return per.join(again, list(ev.keys), "left").withColumn("reread_count", F.coalesce("reread_count", F.lit(0)))
