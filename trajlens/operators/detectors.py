"""Rule detectors over whole sessions.

Every detector takes an ordered trace-event table and returns one row per firing
session: ``session_id, confidence, at_step`` and its evidence columns.
``as_detections`` brings them to one common schema. Thresholds are parameters with
the usual values as defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions.events import any_of, output_hash
from trajlens.operators.phases import phase_machine
from trajlens.operators.stats import quantiles
from trajlens.sequence import Ordered, number_rows

# Word lists and patterns of the rules.
READ_WORDS = ("read_file", "read", "cat", "head", "search_docs", "fetch")
READ_ONLY_TOOLS = ("read_file", "read", "cat", "head", "tail", "grep", "glob", "find", "list_files", "ls", "search",
                   "fetch", "get", "describe", "search_docs", "web_search", "search_codebase")
WRITE_WORDS = ("write_file", "edit_file", "edit", "write", "create_file")
META_TOOLS = ("task", "exitplanmode", "enterplanmode", "askuserquestion", "todowrite", "taskcreate", "taskupdate",
              "taskget", "tasklist")
SLOW_TOOLS = ("Task", "TaskOutput", "Bash")
READ_INTENT = ("read", "look at", "examine", "check", "review", "inspect")
TEST_INTENT = ("test", "run", "verify", "check", "validate")
TEST_PHRASES = ("tests pass", "all tests", "test output", "verified", "confirmed working", "tests are passing",
                "test suite", "tests succeeded")
VERIFICATION = (
    r"(?i)(?:it works|tests? pass|looks? good|here(?:'|&apos;)?s the (?:output|error|result)|"
    r"(?:got|getting|see(?:ing)?|hit(?:ting)?) (?:this|an?|the) error|traceback|stack ?trace|exception|error:|failed|"
    r"output (?:is|was|shows|from)|ran (?:it|the|this)|results? (?:from|of|show)|successfully|completed|"
    r"CUDA|OOM|segfault|\.py\b.*(?:line|error)|(?:sbatch|srun|qsub|slurm))")
CONTINUATION = (
    r"(?i)(?:context (?:was |)(?:compressed|compacted|truncated|continued|lost)|previous conversation|"
    r"ran out of context|continue (?:from )?where|pick(?:ing)? up where|summary (?:of|below|above|covers)|"
    r"earlier portion|</?summary>|this session is being continued)")
TEST_COMMAND = (r"(?i)(?:pytest|python -m pytest|npm test|jest|cargo test|go test|make test|rspec|phpunit|"
                r"python.*test|bash.*test|\.\/test)")
TEST_TASK = r"(?i)(?:run.*tests?|test.*(?:pass|fail|results?)|verify|validate|check.*(?:output|results?))"
EVAL_RUN = (r"(?i)(?:pytest|python\s+scripts/|run_ablation|npm\s+test|make\s+test|python\s+-m\s+pytest|jest|mocha|"
            r"cargo\s+test|go\s+test)")
METRIC = (r"(?i)(?:F1|accuracy|precision|recall|score|AUC|loss|error)[\s:=]*(\d+\.?\d*)\s*%?"
          r"|(\d+\.?\d*)\s*%\s*(?:precision|recall|accuracy|F1)")
EVAL_PATHS = ("annotation", "test", "fixture", "ground_truth", "expected", "golden", "splits")
BROAD_READS = ("docs/", "readme", "architecture", "claude.md", "design", "doc/", "contributing")

TAXONOMY = {  # failure -> (code, category)
    "step_repetition": ("2.2", "memory"), "context_loss": ("2.1", "memory"), "goal_drift": ("2.4", "memory"),
    "tool_thrashing": ("3.1", "execution"), "analysis_paralysis": ("3.4", "execution"),
    "strategic_myopia": ("3.5", "decision_making"), "tool_misuse": ("4.1", "resource"),
    "error_cascade": ("4.2", "resource"), "recovery_failure": ("4.3", "resource"), "stall": ("4.4", "resource"),
    "token_explosion": ("4.4", "resource"), "missing_verification": ("5.3", "plan_structure"),
    "premature_termination": ("5.4", "plan_structure"), "reasoning_action_mismatch": ("6.4", "coordination")}
REFIREABLE = ("stall", "error_cascade")


def is_call() -> Column:
    return F.col("type") == "tool_call"


def is_read() -> Column:
    return F.coalesce(any_of(F.lower("tool"), READ_WORDS), F.lit(False))


def session_sizes(ev: Ordered) -> DataFrame:
    return ev.df.groupBy(*ev.keys).agg(F.count("*").alias("n_events"), F.max(ev.order).alias("last_step"))


def longest_runs(runs: Ordered, *keep: Column) -> DataFrame:
    """Per session the longest run, the earliest on ties: length, start, end and kept columns."""
    per_run = runs.df.groupBy(*runs.keys, "run_id", "run_start").agg(
        F.count("*").alias("run_length"), F.max(runs.order).alias("run_end"), *keep)
    rest = [c for c in per_run.columns if c not in runs.keys]
    return per_run.groupBy(*runs.keys).agg(F.max_by(
        F.struct(*rest), F.struct("run_length", -F.col("run_start"))).alias("_r")).select(*runs.keys, "_r.*")


def step_repetition(ev: Ordered, threshold: int = 9, gathering_threshold: int = 10) -> DataFrame:
    """Identical (tool, input) calls in a row within the last 3 x threshold events."""
    phase = phase_machine(ev.select("type", "tool")).df.groupBy(*ev.keys).agg(
        F.max_by("phase_rank", ev.order).alias("current_rank"))
    sized = ev.select("type", "tool", "input_hash", "output_hash").totals(_n=F.max(ev.order))
    tail = sized.on(sized.df.where(F.col(ev.order) > F.col("_n") - 3 * threshold))
    calls = tail.substream(is_call() & F.col("tool").isNotNull(), "call_no").with_columns(
        _op=F.concat_ws("\u0001", "tool", F.coalesce("input_hash", F.lit("_no_hash"))))
    worst = longest_runs(
        calls.islands("_op"), F.first("tool").alias("tool"), F.first("input_hash").alias("input_hash"),
        F.count("output_hash").alias("_outputs"), F.count_distinct("output_hash").alias("_distinct"))
    fired = worst.join(session_sizes(ev), list(ev.keys)).join(phase, list(ev.keys)).where(
        (F.col("n_events") >= threshold) & (F.col("run_length") >= threshold)
        & ((F.col("_outputs") == 0) | (F.col("_distinct") / F.col("_outputs") <= 0.8))
        & ((F.col("current_rank") != 1) | (F.col("run_length") >= max(threshold, gathering_threshold)))
        & ~F.lower("tool").isin(*META_TOOLS))
    return fired.select(
        *ev.keys, F.least(F.col("run_length") / (2.0 * threshold), F.lit(1.0)).alias("confidence"),
        F.col("last_step").alias("at_step"), F.col("tool").alias("repeated_operation"), "input_hash",
        F.col("run_length").alias("consecutive_count"))


def context_loss(ev: Ordered, min_intervening: int = 5, staleness: float = 0.08) -> DataFrame:
    """Re-reads of the same content with much other work and no user message between.

    Of all read pairs of one resource in one stretch without user messages, the one
    with most work between is the first read and the latest read with the highest
    work count, so pairs need not be formed: one aggregate per resource and stretch.
    """
    other = is_call() & F.col("tool").isNotNull() & ~is_read()
    counted = ev.select("type", "tool", "output_hash").running(
        _work=("count", F.when(other, 1)), _block=("count", F.when(F.col("type") == "user_input", 1)))
    reads = counted.df.where(is_read() & F.col("output_hash").isNotNull() & (F.col("output_hash") != F.col("tool")))
    first_seen = reads.groupBy(*ev.keys, "output_hash").agg(F.min(ev.order).alias("_seen"))
    spans = reads.groupBy(*ev.keys, "output_hash", "_block").agg(
        F.min(ev.order).alias("first_step"),
        F.min_by(F.col(ev.order), F.struct(-F.col("_work"), F.col(ev.order))).alias("reread_step"),
        (F.max("_work") - F.min("_work")).alias("gap"))
    best = spans.join(first_seen, [*ev.keys, "output_hash"]).groupBy(*ev.keys).agg(F.max_by(
        F.struct("output_hash", "first_step", "reread_step", "gap"),
        F.struct("gap", -F.col("_seen"), -F.col("first_step"))).alias("_b")).select(*ev.keys, "_b.*")
    need = F.greatest(F.lit(min_intervening), F.floor(F.col("n_events") * staleness))
    fired = best.join(session_sizes(ev), list(ev.keys)).where((F.col("n_events") >= 6) & (F.col("gap") >= need))
    return fired.select(
        *ev.keys, F.least(F.col("gap") / 10.0, F.lit(1.0)).alias("confidence"), F.col("reread_step").alias("at_step"),
        F.col("output_hash").alias("resource_hash"), "first_step", F.col("gap").alias("intervening_operations"))


def _phase_facts(ev: Ordered) -> DataFrame:
    delegated = (F.col("type") == "user_input") & F.col("goal_text").rlike(VERIFICATION)
    tested = (
        (any_of(F.lower("tool"), ("bash",)) & F.col("goal_text").rlike(TEST_COMMAND))
        | ((F.lower("tool") == "task") & F.col("goal_text").rlike(TEST_TASK))
        | (F.col("type").isin("reasoning", "planning") & any_of(F.lower("goal_text"), TEST_PHRASES)))
    machine = phase_machine(ev.select("type", "tool", "goal_text"))
    return machine.df.groupBy(*ev.keys).agg(
        F.count("*").alias("n_events"), F.max(ev.order).alias("last_step"),
        F.max_by("phase_rank", ev.order).alias("current_rank"),
        F.count(F.when(F.col("class_rank") == 3, 1)).alias("execution_events"),
        F.count(F.when(F.col("class_rank") == 4, 1)).alias("verification_events"),
        F.count(F.when(F.col("class_rank") == 5, 1)).alias("delivering_events"),
        F.coalesce(F.bool_or(F.col("is_transition") & (F.col("phase_rank") == 4)), F.lit(False)).alias("reached_verifying"),
        F.coalesce(F.bool_or(delegated), F.lit(False)).alias("delegated"),
        F.coalesce(F.bool_or(tested), F.lit(False)).alias("tested"),
        F.coalesce(F.bool_or(any_of(F.lower("tool"), WRITE_WORDS)), F.lit(False)).alias("wrote"))


def premature_termination(ev: Ordered, min_execute: int = 3, min_delivering: int = 3) -> DataFrame:
    """Delivering after execution without ever having verified."""
    fired = _phase_facts(ev).where(
        (F.col("n_events") >= 5) & (F.col("current_rank") == 5) & (F.col("delivering_events") >= min_delivering)
        & (F.col("execution_events") >= min_execute) & ~F.col("reached_verifying") & ~F.col("delegated"))
    return fired.select(*ev.keys, F.lit(0.85).alias("confidence"), F.col("last_step").alias("at_step"),
                        "execution_events", "delivering_events")


def missing_verification(ev: Ordered, threshold: int = 25) -> DataFrame:
    """Much execution with file writes and no sign of verification in any of five forms."""
    fired = _phase_facts(ev).where(
        (F.col("execution_events") >= threshold) & (F.col("verification_events") == 0) & ~F.col("delegated")
        & ~F.col("tested") & F.col("wrote") & ~F.col("current_rank").isin(1, 2))
    return fired.select(*ev.keys, F.least(F.col("execution_events") / (threshold * 3.0), F.lit(0.9)).alias("confidence"),
                        F.col("last_step").alias("at_step"), "execution_events",
                        F.col("n_events").alias("total_events"))


def reasoning_action_mismatch(ev: Ordered) -> DataFrame:
    """A stated intent to read or test followed at once by a write."""
    text = F.lower("goal_text")
    reads, tests = any_of(text, READ_INTENT), any_of(text, TEST_INTENT)
    framed = ev.select("type", "tool", "goal_text").frame(0, 1, {
        "_next_type": lambda w: F.lead("type").over(w), "_next_tool": lambda w: F.lead("tool").over(w),
        "_next_step": lambda w: F.lead(ev.order).over(w)})
    low = F.lower("_next_tool")
    kind = (F.when(reads & any_of(low, ("write", "edit", "create", "delete")), "read/review")
            .when(tests & any_of(low, ("write", "edit", "create")), "test/verify"))
    hits = framed.df.where(F.col("type").isin("reasoning", "planning") & (F.col("_next_type") == "tool_call")
                           & (F.col("_next_tool") != "") & (F.col("goal_text") != "")).withColumn(
        "planned_intent", kind).where(F.col("planned_intent").isNotNull())
    first = hits.groupBy(*ev.keys).agg(F.min_by(
        F.struct(F.col(ev.order).alias("reasoning_step"), F.col("_next_step").alias("at_step"), "planned_intent",
                 F.col("_next_tool").alias("actual_tool")), ev.order).alias("_f")).select(*ev.keys, "_f.*")
    return first.select(*ev.keys, F.when(F.col("planned_intent") == "read/review", 0.7).otherwise(0.65).alias("confidence"),
                        "at_step", "reasoning_step", "planned_intent", "actual_tool")


def goal_drift(ev: Ordered, min_events: int = 20, drift_blocks: int = 3, regressions: int = 3,
               few_blocks: int = 2, many_regressions: int = 5) -> DataFrame:
    """Stretches between user messages full of new tools, with unprompted phase regressions."""
    machine = phase_machine(ev.select("type", "tool"))
    user = F.col("type") == "user_input"
    lined = machine.running(exclusive=True, _last_user=("last", F.when(user, F.col(ev.order))))
    lined = lined.running(_raw=("count", F.when(user, 1)))
    unprompted = F.col("is_regression") & (
        F.col("_last_user").isNull() | (F.col("_last_user") < F.col(ev.order) - 3))
    back = lined.df.groupBy(*ev.keys).agg(
        F.count("*").alias("n_events"), F.max(ev.order).alias("last_step"),
        F.count(F.when(unprompted, 1)).alias("unprompted_regressions"))
    # Stretches holding no agent event do not exist, so they get no number.
    agent = lined.on(lined.df.where(~user))
    tools = agent.df.groupBy(*ev.keys, "_raw", "tool").agg(F.count("*").alias("_n"))
    blocks = tools.groupBy(*ev.keys, "_raw").agg(F.sum("_n").alias("block_size"))
    numbered = number_rows(blocks, ev.keys, ["_raw"], "block_no", ev.chunk_rows).result()
    placed = tools.where(F.col("tool").isNotNull()).join(numbered, [*ev.keys, "_raw"])
    known = placed.groupBy(*ev.keys, "tool").agg(F.min("block_no").alias("_first"))
    novelty = placed.join(known, [*ev.keys, "tool"]).where("block_no > 2").groupBy(*ev.keys, "block_no").agg(
        F.count("*").alias("_tools"), F.count(F.when(F.col("_first") > 2, 1)).alias("_novel"),
        F.max("block_size").alias("_size"))
    drifted = novelty.where((F.col("_novel") / F.col("_tools") > 0.5) & (F.col("_size") >= 3)).groupBy(*ev.keys).agg(
        F.count("*").alias("drift_blocks"))
    total = numbered.groupBy(*ev.keys).agg(F.max("block_no").cast("long").alias("total_blocks"))
    joined = back.join(total, list(ev.keys)).join(drifted, list(ev.keys))
    d, r = F.col("drift_blocks"), F.col("unprompted_regressions")
    conf = (F.when((d >= drift_blocks) & (r >= regressions), F.least(d / 5.0, F.lit(0.85)))
            .when((d >= few_blocks) & (r >= many_regressions), F.least(d / 4.0, F.lit(0.85))))
    return joined.where((F.col("n_events") >= min_events) & (F.col("total_blocks") >= 3) & conf.isNotNull()).select(
        *ev.keys, F.round(conf, 3).alias("confidence"), F.col("last_step").alias("at_step"),
        "drift_blocks", "total_blocks", "unprompted_regressions")


def tool_thrashing(ev: Ordered, executing_threshold: int = 15, other_threshold: int = 25) -> DataFrame:
    """Long runs of read-only calls."""
    phase = phase_machine(ev.select("type", "tool")).df.groupBy(*ev.keys).agg(
        F.max_by("phase_rank", ev.order).alias("current_rank"))
    calls = ev.select("type", "tool").substream(is_call() & F.col("tool").isNotNull(), "call_no").with_columns(
        _read_only=F.lower("tool").isin(*READ_ONLY_TOOLS))
    runs = calls.islands("_read_only")
    longest = runs.df.where("_read_only").groupBy(*ev.keys, "run_id").agg(F.count("*").alias("_n")).groupBy(
        *ev.keys).agg(F.max("_n").alias("consecutive_read_only"))
    limit = F.when(F.col("current_rank") == 3, executing_threshold).otherwise(other_threshold)
    fired = longest.join(session_sizes(ev), list(ev.keys)).join(phase, list(ev.keys)).where(
        (F.col("n_events") >= executing_threshold) & (F.col("consecutive_read_only") >= limit))
    return fired.select(*ev.keys, F.least(F.col("consecutive_read_only") / (limit * 2.0), F.lit(0.85)).alias("confidence"),
                        F.col("last_step").alias("at_step"), "consecutive_read_only", limit.alias("threshold"))


def tool_misuse(ev: Ordered, window: int = 5, minimum: float = 0.4) -> DataFrame:
    """Rapid tool switching with little change of state in a short window."""
    hashed = ev.select("type", "tool", "output_hash", "tokens_out", "success").with_columns(
        _hash=output_hash(F.col("output_hash"), F.col("tool"), F.col("tokens_out"), F.col("success")))
    calls = hashed.substream(is_call(), "call_no")
    reach = window - 2

    def changes(c: str):
        return lambda w: F.sum(c).over(w.rowsBetween(-reach, 0))

    framed = calls.frame(
        window, 0,
        {"_switch": lambda w: (~F.lag("tool").over(w).eqNullSafe(F.col("tool"))).cast("int"),
         "_change": lambda w: (~F.lag("_hash").over(w).eqNullSafe(F.col("_hash"))).cast("int"),
         "_first": lambda w: F.lag(ev.order, window - 1).over(w)},
        {"_switches": changes("_switch"), "_changes": changes("_change")})
    score = F.col("_switches") / (window - 1.0) * (1 - F.col("_changes") / (window - 1.0))
    scored = framed.df.where(F.col("call_no") >= window).withColumn("_score", score)
    worst = scored.groupBy(*ev.keys).agg(F.max_by(
        F.struct("_score", F.col("_first").alias("window_start_step"), F.col(ev.order).alias("at_step")),
        F.struct("_score", -F.col("call_no"))).alias("_w")).select(*ev.keys, "_w.*")
    return worst.where(F.col("_score") >= minimum).select(
        *ev.keys, F.round(F.least("_score", F.lit(0.85)), 3).alias("confidence"), "at_step",
        F.round("_score", 3).alias("switch_rate"), "window_start_step")


def stall(ev: Ordered, min_events: int = 10, multiplier: float = 1.5, floor_ms: float = 30_000.0,
          idle_ms: float = 120_000.0, min_count: int = 2, min_median_ms: float = 50.0) -> DataFrame:
    """Latency outliers of active work, beyond the quartile fence and an absolute floor."""
    base = ev.select("type", "tool", "latency_ms")
    active = base.df.where(F.col("latency_ms") <= idle_ms)
    fence = quantiles(active, ev.keys, "latency_ms", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ev.chunk_rows)
    fence = fence.withColumn("threshold_ms", F.greatest(
        F.col("q75") + multiplier * (F.col("q75") - F.col("q25")), F.lit(floor_ms))).where(
        (F.col("n") >= min_events) & (F.col("median") >= min_median_ms))
    stalls = active.join(fence, list(ev.keys)).where(F.col("latency_ms") > F.col("threshold_ms"))
    named = F.coalesce("tool", "type")
    found = stalls.groupBy(*ev.keys).agg(
        F.count("*").alias("stall_count"), F.max("latency_ms").alias("max_latency_ms"),
        F.first("threshold_ms").alias("threshold_ms"), F.first("median").alias("median_latency_ms"),
        F.min_by(F.col(ev.order), F.struct(-F.col("latency_ms"), F.col(ev.order))).alias("at_step"),
        F.bool_and(named.isin(*SLOW_TOOLS)).alias("_slow_only"), F.max(ev.order).alias("_last"))
    conf = F.least(0.5 + (F.col("max_latency_ms") - F.col("threshold_ms")) / F.col("threshold_ms") * 0.3, F.lit(1.0))
    return found.where((F.col("stall_count") >= min_count) & ~F.col("_slow_only") & (F.col("_last") > 6)).select(
        *ev.keys, F.round(conf, 3).alias("confidence"), "at_step", "stall_count",
        F.round("max_latency_ms", 1).alias("max_latency_ms"), F.round("median_latency_ms", 1).alias("median_latency_ms"),
        F.round("threshold_ms", 1).alias("threshold_ms"))


def error_cascade(ev: Ordered, min_chain: int = 3, min_confidence: float = 0.3) -> DataFrame:
    """Chains of failures in a row; the longest, the earliest on ties."""
    runs = ev.select("success").islands("success")
    chains = runs.df.where(~F.col("success")).groupBy(*ev.keys, "run_id", "run_start").agg(
        F.count("*").alias("run_length"), F.max(ev.order).alias("run_end"))
    per = chains.groupBy(*ev.keys).agg(
        F.max_by(F.struct("run_length", "run_start", "run_end"),
                 F.struct("run_length", -F.col("run_start"))).alias("_l"),
        F.count(F.when(F.col("run_length") >= min_chain, 1)).alias("total_chains"),
        F.sum("run_length").alias("total_errors"))
    conf = F.least(F.col("_l.run_length") / 10.0, F.lit(1.0))
    return per.join(session_sizes(ev), list(ev.keys)).where(
        (F.col("n_events") >= 3) & (F.col("_l.run_length") >= min_chain) & (conf >= min_confidence)).select(
        *ev.keys, F.round(conf, 3).alias("confidence"), F.col("_l.run_end").alias("at_step"),
        F.col("_l.run_length").alias("longest_chain"), F.col("_l.run_start").alias("chain_start_step"),
        "total_chains", "total_errors")


def token_explosion(ev: Ordered, growth: float = 3.0, min_score: float = 0.5, min_events: int = 50,
                    min_first: float = 50.0) -> DataFrame:
    """Token use per step growing by quarters and accelerating.

    The quadratic fit comes from power sums around the middle of the session, in
    which the normal equations separate into two small ones.
    """
    sized = ev.select((F.col("tokens_in") + F.col("tokens_out")).cast("double").alias("y")).totals(
        _n=F.max(ev.order))
    n = F.col("_n")
    q = F.greatest(F.floor(n / 4), F.lit(1))
    x = F.col(ev.order) - (n + 1) / 2.0
    y = F.col("y")
    sums = sized.df.groupBy(*ev.keys, "_n").agg(
        F.sum("y").alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x * y).alias("sx2y"),
        F.sum(x * x).alias("sx2"), F.sum(x * x * x * x).alias("sx4"),
        F.sum(F.when(F.col(ev.order) <= q, y)).alias("sf"), F.sum(F.when(F.col(ev.order) > n - q, y)).alias("sl"))
    accel = (n * F.col("sx2y") - F.col("sx2") * F.col("sy")) / (n * F.col("sx4") - F.col("sx2") * F.col("sx2"))
    first, last = F.col("sf") / q, F.col("sl") / q
    ratio = last / F.greatest(first, F.lit(1.0))
    score = (F.when(ratio > growth, F.least((ratio - growth) / 5.0, F.lit(0.5))).otherwise(0.0)
             + F.when(accel > 0, F.least(accel / F.greatest(F.col("sy") / n, F.lit(1.0)) * 10, F.lit(0.5))).otherwise(0.0))
    return sums.where((n >= min_events) & (F.col("sy") != 0)).withColumns(
        {"_score": score, "_ratio": ratio, "_first": first, "_last": last, "_slope": F.col("sxy") / F.col("sx2"),
         "_accel": accel}).where((F.col("_first") >= min_first) & (F.col("_score") >= min_score)).select(
        *ev.keys, F.round(F.least("_score", F.lit(0.9)), 3).alias("confidence"), n.alias("at_step"),
        F.round("_ratio", 2).alias("growth_ratio"), F.round("_slope", 2).alias("slope"),
        F.round("_accel", 4).alias("acceleration"))


def analysis_paralysis(ev: Ordered, threshold: int = 4) -> DataFrame:
    """Reasoning or planning events in a row without any action."""
    thinking = ev.select("type").with_columns(_thinks=F.col("type").isin("reasoning", "planning"))
    runs = thinking.islands("_thinks")
    worst = longest_runs(runs.on(runs.df.where("_thinks")))
    return worst.where(F.col("run_length") >= threshold).select(
        *ev.keys, F.round(F.least(F.col("run_length") / (threshold * 3.0), F.lit(0.85)), 3).alias("confidence"),
        F.col("run_end").alias("at_step"), F.col("run_length").alias("consecutive_reasoning"),
        F.col("run_start").alias("start_step"))


def recovery_failure(ev: Ordered, recovery: int = 3, rate: float = 0.4, progress: int = 5,
                     productive_events: int = 50, productive_rate: float = 0.8) -> DataFrame:
    """Errors followed by more failures, without later progress.

    The progress test counts different outputs of successful calls after the last
    failed recovery. Since that point lies in each session's own past, it is joined
    back once per session.
    """
    failed = (~F.col("success")).cast("int")
    framed = ev.select("type", "tool", "input_hash", "output_hash", "success").with_columns(_fail=failed).frame(
        0, recovery,
        {"_after": lambda w: F.sum("_fail").over(w.rowsBetween(1, recovery)),
         "_next_tool": lambda w: F.lead("tool").over(w), "_next_input": lambda w: F.lead("input_hash").over(w)})
    error = ~F.col("success")
    attempt = error & F.col("_after").isNotNull()
    bad = attempt & (F.col("_after") > 0)
    stuck = error & F.col("_next_tool").eqNullSafe(F.col("tool")) & (F.col("_next_input") == F.col("input_hash"))
    per = framed.df.groupBy(*ev.keys).agg(
        F.count("*").alias("n_events"), F.count(F.when(error, 1)).alias("total_errors"),
        F.count(F.when(attempt, 1)).alias("attempts"), F.count(F.when(bad, 1)).alias("failed_recoveries"),
        F.max(F.when(bad, F.col(ev.order))).alias("_last_bad"),
        F.min_by(F.when(bad, F.col(ev.order)), F.when(bad, F.struct(-F.col("_after"), F.col(ev.order)))).alias("at_step"),
        F.max(F.when(bad, F.col("_after"))).alias("worst_failures_after"),
        F.count(F.when(stuck, 1)).alias("stuck_retries"),
        F.count(F.when(error & (F.col("_next_tool") == F.col("tool")), 1)).alias("same_tool_retries"),
        F.count(F.when(is_call(), 1)).alias("_calls"),
        F.count(F.when(is_call() & F.col("success"), 1)).alias("_good_calls"))
    done = is_call() & F.col("success")
    latest = framed.df.where(done).groupBy(*ev.keys, "output_hash").agg(
        F.max(ev.order).alias("_latest"))
    with_hash = per.select(*ev.keys, "_last_bad").join(latest, list(ev.keys)).where(
        F.col("_latest") > F.col("_last_bad")).groupBy(*ev.keys).agg(
        F.count("output_hash").alias("_unique"))
    after = framed.df.where(done).join(per.select(*ev.keys, "_last_bad"), list(ev.keys)).where(
        F.col(ev.order) > F.col("_last_bad")).groupBy(*ev.keys).agg(F.count("*").alias("_plain"))
    joined = per.join(with_hash, list(ev.keys), "left").join(after, list(ev.keys), "left")
    failure_rate = F.col("failed_recoveries") / F.col("attempts")
    recovered = F.when(F.coalesce("_unique", F.lit(0)) > 0, F.col("_unique") >= progress).otherwise(
        F.coalesce("_plain", F.lit(0)) >= progress + 3)
    productive = ((F.col("_calls") >= productive_events) & (F.col("_good_calls") / F.col("_calls") >= productive_rate)
                  & (F.col("stuck_retries") == 0))
    return joined.where(
        (F.col("n_events") >= 4) & (F.col("total_errors") >= 3) & (F.col("attempts") > 0) & (failure_rate >= rate)
        & ~recovered & ~productive).select(
        *ev.keys, F.round(F.least(failure_rate, F.lit(1.0)), 3).alias("confidence"), "at_step", "total_errors",
        "failed_recoveries", "same_tool_retries", "stuck_retries", "worst_failures_after")


def strategic_myopia(ev: Ordered, min_cycles: int = 4, min_edits: int = 8, concentration: float = 0.8,
                     min_events: int = 40, max_delta: float = 0.10, exploration: float = 0.05) -> DataFrame:
    """Evaluation loops with edits kept to few targets and little looking around."""
    text = F.concat(F.coalesce("goal_text", F.lit("")), F.coalesce("input_hash", F.lit("")))
    runs_eval = is_call() & F.col("tool").isin("Bash", "bash") & text.rlike(EVAL_RUN)
    edits = is_call() & F.col("tool").isin("Edit", "Write", "edit", "write", "edit_file", "write_file")
    target = F.coalesce(F.when(F.col("goal_text") != "", F.col("goal_text")),
                        F.when(F.col("input_hash") != "", F.col("input_hash")), F.col("tool"))
    reads = is_call() & F.col("tool").isin("Read", "read", "read_file")
    broad = reads & any_of(F.lower(text), BROAD_READS)
    report = F.concat(F.coalesce("goal_text", F.lit("")), F.coalesce("error_message", F.lit("")))
    seen = F.concat(F.regexp_extract(report, METRIC, 1), F.regexp_extract(report, METRIC, 2))
    machine = phase_machine(ev.select("type", "tool", "goal_text", "input_hash", "error_message").totals(
        _n=F.max(ev.order)))
    rows = machine.with_columns(_eval=runs_eval, _edit=edits, _target=F.when(edits, target),
                                _metric=F.when(seen != "", seen.cast("double")))
    framed = rows.frame(0, 3, {"_found": lambda w: F.first("_metric", ignorenulls=True).over(w.rowsBetween(0, 3))})
    late = F.col(ev.order) > F.floor(F.col("_n") / 4)
    per = framed.df.groupBy(*ev.keys).agg(
        F.count("*").alias("n_events"), F.count(F.when(F.col("_eval"), 1)).alias("_evals"),
        F.max(F.when(F.col("_eval"), F.col(ev.order))).alias("at_step"),
        F.count(F.when(F.col("_edit"), 1)).alias("total_edits"),
        F.count(F.when(F.col("_edit") & any_of(F.lower("_target"), EVAL_PATHS), 1)).alias("_eval_edits"),
        F.count(F.when(reads, 1)).alias("_reads"), F.count(F.when(broad, 1)).alias("_broad"),
        F.count(F.when(F.col("_eval"), F.col("_found"))).alias("_metrics"),
        F.max(F.when(F.col("_eval"), F.col("_found"))).alias("_best"),
        F.min(F.when(F.col("_eval"), F.col("_found"))).alias("_worst"),
        F.count(F.when(late, 1)).alias("_late"),
        F.count(F.when(late & F.col("class_rank").isin(1, 2), 1)).alias("_exploring"))
    counts = framed.df.where("_edit").groupBy(*ev.keys, "_target").agg(F.count("*").alias("_c"))
    # Spark prunes row_number() <= 3 to three rows per session before it shuffles the counts.
    top = counts.withColumn("_r", F.row_number().over(
        Window.partitionBy(*ev.keys).orderBy(F.desc("_c"), "_target"))).where(
        "_r <= 3").groupBy(*ev.keys).agg(F.sum("_c").alias("_top3"))
    delta = F.when(F.col("_best") > 0, (F.col("_best") - F.col("_worst")) / F.col("_best")).otherwise(0.0)
    flags = [(F.col("_metrics") >= 3) & (delta < max_delta), F.col("_eval_edits") >= 2,
             (F.col("_reads") >= 10) & (F.col("_broad") == 0),
             F.col("_exploring") / F.col("_late") < exploration]
    signals = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])
    return per.join(top, list(ev.keys)).withColumn("optional_signals", signals).where(
        (F.col("n_events") >= min_events) & (F.col("_evals") - 1 >= min_cycles) & (F.col("total_edits") >= min_edits)
        & (F.col("_top3") / F.col("total_edits") >= concentration) & (F.col("optional_signals") >= 2)).select(
        *ev.keys, F.round(F.least(0.4 + F.col("optional_signals") * 0.15, F.lit(0.85)), 3).alias("confidence"),
        "at_step", (F.col("_evals") - 1).alias("eval_cycles"),
        F.round(F.col("_top3") / F.col("total_edits"), 3).alias("edit_concentration"), "total_edits", "optional_signals")


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "context_loss": context_loss, "premature_termination": premature_termination, "stall": stall,
    "error_cascade": error_cascade, "analysis_paralysis": analysis_paralysis, "recovery_failure": recovery_failure,
    "step_repetition": step_repetition, "goal_drift": goal_drift, "tool_thrashing": tool_thrashing,
    "tool_misuse": tool_misuse, "token_explosion": token_explosion, "missing_verification": missing_verification,
    "reasoning_action_mismatch": reasoning_action_mismatch, "strategic_myopia": strategic_myopia}
DEFAULT_DETECTORS = ("context_loss", "premature_termination", "stall", "error_cascade", "analysis_paralysis",
                     "recovery_failure")


def as_detections(found: DataFrame, failure: str) -> DataFrame:
    """The common detection row: code, category, severity, confidence, step, evidence."""
    code, category = TAXONOMY[failure]
    evidence = [c for c in found.columns if c not in ("session_id", "confidence", "at_step")]
    critical = {"premature_termination": F.lit(True), "context_loss": F.lit(False),
                "missing_verification": F.lit(False), "reasoning_action_mismatch": F.lit(False),
                "strategic_myopia": F.lit(False)}.get(failure, F.col("confidence") >= 0.7)
    if failure == "step_repetition":
        critical = F.col("consecutive_count") >= 10
    if failure == "tool_thrashing":
        critical = F.col("consecutive_read_only") >= 20
    return found.select(
        "session_id", F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(failure).alias("failure"),
        F.when(critical, "critical").otherwise("warning").alias("severity"), F.round("confidence", 4).alias("confidence"),
        "at_step", F.to_json(F.struct(*evidence)).alias("evidence"))


def run_detectors(ev: Ordered, names: tuple[str, ...] = DEFAULT_DETECTORS, **params: dict) -> DataFrame:
    """Union of the named detectors; ``params`` maps a detector to its arguments."""
    parts = [as_detections(DETECTORS[n](ev, **params.get(n, {})), n) for n in names]
    return reduce(DataFrame.unionByName, parts)
