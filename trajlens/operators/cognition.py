"""Per-step state of the agent's information processing, and decision points.

Input: ordered trace events. "The last n reads" or calls are windows over the
sub-stream of those events; their values are joined back by step and carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions.events import GATHERING_WORDS, any_of
from trajlens.operators.metrics import window_sums
from trajlens.sequence import Ordered

CONTEXT_TOKENS = 200_000


def _one(count: Column) -> Column:
    return (count == 1).cast("long")


def sliding_distinct(ev: Ordered, value: str, window: int, out: str) -> Ordered:
    """Number of different values among the last ``window`` rows."""
    summed = window_sums(ev, window, {out: value}, _one)
    return summed.on(summed.df.drop(f"{out}_step"))


def carried(ev: Ordered, sub: Ordered, cols: dict[str, Column], default: dict[str, object] | None = None) -> Ordered:
    """Columns of a sub-stream joined back to all events, the last value carried forward."""
    values = sub.df.select(*ev.keys, F.col(ev.order), *[c.alias(f"_j_{n}") for n, c in cols.items()])
    joined = ev.on(ev.df.join(values, [*ev.keys, ev.order], "left"))
    last = joined.running(**{n: ("last", F.col(f"_j_{n}")) for n in cols})
    out = last.df.drop(*[f"_j_{n}" for n in cols])
    if default:
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in default.items()})
    return last.on(out)


def is_gathering() -> Column:
    low = F.replace(F.replace(F.lower("tool"), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.coalesce(any_of(low, GATHERING_WORDS), F.lit(False))


def perception(ev: Ordered) -> Ordered:
    """Breadth (targets read), depth (reads) and recency of reading."""
    step = F.col(ev.order)
    marked = ev.with_columns(_read=is_gathering()).with_columns(_target=F.when(F.col("_read"), F.col("output_hash")))
    known = marked.distinct_so_far("_target", "_targets").running(
        _reads=("count", F.when(F.col("_read"), 1)), _last=("last", F.when(F.col("_read"), step)))
    recency = F.greatest(F.lit(0.0), 1 - (step - F.coalesce("_last", F.lit(0))) / 20.0)
    return known.on(known.df.withColumns({
        "perception_breadth": F.least(F.col("_targets") / 20.0, F.lit(1.0)),
        "perception_depth": F.least(F.col("_reads") / 40.0, F.lit(1.0)),
        "perception_recency": F.round(recency, 6)}).drop("_read", "_target", "_targets", "_reads", "_last"))


def attention(ev: Ordered, window: int = 20) -> Ordered:
    """Diversity of the recent reads, and the risk of looking at the same few."""
    reads = ev.select("tool", "output_hash").substream(is_gathering() & F.col("output_hash").isNotNull(), "read_no")
    counted = sliding_distinct(reads.distinct_so_far("output_hash", "_known"), "output_hash", window, "_d")
    n = F.least(F.col("read_no"), F.lit(window))
    diversity = F.col("_d") / n
    tunnel = F.when((F.col("_known") > 1) & (n > 1), 1 - diversity).otherwise(0.0)
    return carried(ev, counted, {"attention_diversity": F.round(diversity, 6), "attention_focus": F.round(1 - diversity, 6),
                                 "attention_tunnel_risk": F.round(tunnel, 6)},
                   {"attention_diversity": 0.0, "attention_focus": 0.0, "attention_tunnel_risk": 0.0})


def working_memory(ev: Ordered, decay: int = 50, recent: int = 20) -> Ordered:
    """Context use, items not touched for ``decay`` steps, and how recent the rest are.

    Items at risk are all items so far less those in the last ``decay + 1`` steps.
    """
    res = ev.with_columns(_res=F.coalesce("output_hash", "input_hash"), _tok=F.col("tokens_in") + F.col("tokens_out"))
    known = res.distinct_so_far("_res", "_items").running(_tokens=("sum", F.col("_tok")))
    active = sliding_distinct(sliding_distinct(known, "_res", decay + 1, "_active"), "_res", recent + 1, "_fresh")
    return active.on(active.df.withColumns({
        "memory_utilization": F.round(F.least(F.col("_tokens") / CONTEXT_TOKENS, F.lit(1.0)), 6),
        "memory_at_risk": F.col("_items") - F.col("_active"),
        "memory_recency_bias": F.round(F.when(F.col("_active") > 0, F.col("_fresh") / F.col("_active")).otherwise(0.0), 6),
    }).drop("_res", "_tok", "_items", "_tokens", "_active", "_fresh"))


def decision(ev: Ordered, window: int = 10, deliberation: int = 4) -> Ordered:
    """Reasoning streak, options explored, latency trend."""
    thinking = ev.with_columns(_thinks=F.col("type").isin("reasoning", "planning", "thinking")).islands(
        "_thinks", run="_run", start="_start")
    streak = F.when(F.col("_thinks"), F.col(ev.order) - F.col("_start") + 1).otherwise(0)
    base = thinking.on(thinking.df.withColumn(
        "decision_deliberation", F.least(streak / float(deliberation), F.lit(1.0))).drop("_thinks", "_run", "_start"))
    tools = ev.select("tool").substream(F.col("tool").isNotNull() & (F.col("tool") != ""), "tool_no")
    explored = sliding_distinct(tools.distinct_so_far("tool", "_all"), "tool", window, "_d")
    base = carried(base, explored, {"decision_options": F.round(F.least(F.col("_d") / F.col("_all"), F.lit(1.0)), 6)},
                   {"decision_options": 0.0})
    slow = ev.select("latency_ms").substream(F.col("latency_ms") > 0, "lat_no").frame(window - 1, 0, {
        "_l": lambda w: F.collect_list("latency_ms").over(w.rowsBetween(1 - window, 0))})
    half = F.floor(F.size("_l") / 2).cast("int")

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    first, second = mean(F.slice("_l", 1, half)), mean(F.slice("_l", half + 1, F.size("_l") - half))
    trend = F.when(F.size("_l") >= 3, F.least(F.greatest((second - first) / first, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    return carried(base, slow, {"decision_latency_trend": F.round(trend, 6)}, {"decision_latency_trend": 0.0})


def action(ev: Ordered, window: int = 10, repetition: int = 9) -> Ordered:
    """Diversity, success and repetition of the recent calls."""
    known = ev.select("type", "tool", "input_hash", "success").distinct_so_far("tool", "_all")
    calls = known.substream(F.col("type") == "tool_call", "call_no").with_columns(
        _tool=F.coalesce("tool", F.lit("")), _op=F.concat_ws("\u0001", F.coalesce("tool", F.lit("")), F.coalesce("input_hash", F.lit(""))))
    runs = sliding_distinct(calls.islands("_op", run="_run", start="_start"), "_tool", window, "_d").frame(window - 1, 0, {
        "_ok": lambda w: F.avg(F.col("success").cast("double")).over(w.rowsBetween(1 - window, 0))})
    same = F.when(F.col("_tool") != "", F.col("call_no") - F.col("_start") + 1).otherwise(1)
    out = carried(ev, runs, {
        "_n_tools": F.col("_d"), "action_success_rate": F.round("_ok", 6),
        "action_repetition_risk": F.round(F.least(same / float(repetition), F.lit(1.0)), 6)},
        {"_n_tools": 0, "action_success_rate": 1.0, "action_repetition_risk": 0.0})
    total = out.distinct_so_far("tool", "_all")
    return total.on(total.df.withColumn("action_diversity", F.round(F.least(
        F.col("_n_tools") / F.greatest("_all", F.lit(1)), F.lit(1.0)), 6)).drop("_n_tools", "_all"))


def feedback(ev: Ordered, window: int = 20) -> Ordered:
    """Verification against execution, change after errors, closed loops; needs ``phase_rank``."""
    rank = F.col("phase_rank")

    def count(c: Column):
        return lambda w: F.count(F.when(c, 1)).over(w.rowsBetween(1 - window, 0))

    framed = ev.frame(window - 1, 0, {
        "_v": count(rank == 4), "_e": count(rank == 3), "_was_exec": lambda w: F.lag("phase_rank").over(w) == 3})
    counted = framed.running(_closed=("count", F.when((rank == 4) & F.col("_was_exec"), 1)),
                             _exec=("count", F.when(rank == 3, 1)))
    base = counted.on(counted.df.withColumns({
        "feedback_verify_ratio": F.round(F.when(F.col("_e") > 0, F.least(F.col("_v") / F.col("_e"), F.lit(1.0))).otherwise(0.0), 6),
        "feedback_loop_closed": F.round(F.when(F.col("_exec") > 0, F.least(F.col("_closed") / F.col("_exec"), F.lit(1.0))).otherwise(0.0), 6),
    }).drop("_v", "_e", "_was_exec", "_closed", "_exec"))
    calls = ev.select("type", "tool", "success").substream(F.col("type") == "tool_call", "call_no").frame(1, 0, {
        "_after": lambda w: ~F.lag("success").over(w),
        "_moved": lambda w: ~F.coalesce(F.lag("tool").over(w), F.lit("")).eqNullSafe(F.coalesce("tool", F.lit("")))}).running(
        _errors=("count", F.when(F.col("_after"), 1)), _changes=("count", F.when(F.col("_after") & F.col("_moved"), 1)))
    response = F.when(F.col("_errors") > 0, F.col("_changes") / F.col("_errors")).otherwise(1.0)
    return carried(base, calls, {"feedback_error_response": F.round(response, 6)}, {"feedback_error_response": 1.0})


def load(state: DataFrame) -> DataFrame:
    """Load of each stage, overall load and the stage carrying most, from the state columns."""
    c = F.col
    stages = {
        "perception": 1 - (0.4 * c("perception_recency") + 0.3 * c("perception_breadth") + 0.3 * c("perception_depth")),
        "attention": 0.6 * c("attention_tunnel_risk") + 0.4 * (1 - c("attention_diversity")),
        "working_memory": c("memory_utilization"),
        "decision_making": 0.6 * c("decision_deliberation") + 0.4 * F.greatest("decision_latency_trend", F.lit(0.0)),
        "action": 0.5 * (1 - c("action_success_rate")) + 0.5 * c("action_repetition_risk"),
        "feedback": 0.5 * (1 - c("feedback_verify_ratio")) + 0.5 * (1 - c("feedback_loop_closed"))}
    loads = {f"load_{n}": F.round(e + 1e-9, 3) for n, e in stages.items()}
    overall = (0.15 * (1 - c("perception_recency")) + 0.15 * c("attention_tunnel_risk") + 0.25 * c("memory_utilization")
               + 0.15 * c("decision_deliberation") + 0.15 * (1 - c("action_success_rate")) + 0.15 * (1 - c("feedback_verify_ratio")))
    with_loads = state.withColumns({**loads, "overall_load": F.round(overall + 1e-9, 3)})
    # The earliest stage wins a tie, as its position counts down.
    ranked = F.array(*[F.struct(c(f"load_{n}").alias("load"), F.lit(-i).alias("order"), F.lit(n).alias("stage"))
                       for i, n in enumerate(stages)])
    worst = F.array_max(ranked)
    return with_loads.withColumn("bottleneck", F.when(worst["load"] > 0.3, worst["stage"]).otherwise(""))


def decision_points(ev: Ordered, reach: int = 5) -> DataFrame:
    """Decisions with their deliberation and outcome; needs ``phase_rank``.

    Between two reasoning events every fifth call starts a decision, whose outcome is
    the next five calls; so the position of a call since the last reasoning event
    settles which decisions it belongs to.
    """
    step = F.col(ev.order)
    thinks = F.col("type").isin("reasoning", "planning", "thinking")
    call = F.col("type") == "tool_call"
    base = ev.with_columns(_thinks=thinks, _call=call)
    prior = base.running(exclusive=True, _last_hash=("last", F.col("output_hash")))
    counted = prior.running(_block=("count", F.when(F.col("_thinks"), 1)), _calls=("count", F.when(F.col("_call"), 1)),
                            _thought=("sum", F.when(F.col("_thinks"), F.col("latency_ms"))))
    marked = counted.running(_calls_before=("last", F.when(F.col("_thinks"), F.col("_calls"))))
    calls = marked.substream(F.col("_call"), "call_no").frame(1, 0, {"_thought_before": lambda w: F.lag("_thought").over(w)})
    j = F.col("_calls") - F.coalesce("_calls_before", F.lit(0)) - 1
    roles = F.filter(F.array(
        F.when(j % reach == 0, F.struct(F.expr("0 = 0").alias("starts"), (j / reach).cast("long").alias("nth"))),
        F.when(j >= 1, F.struct(F.expr("0 = 1").alias("starts"), F.floor((j - 1) / reach).alias("nth")))), lambda r: r.isNotNull())
    rows = calls.df.withColumns({"_j": j, "_r": F.explode(roles)}).withColumn("_starts", F.col("_r.starts"))
    begin, after = F.col("_starts"), ~F.col("_starts")
    changed = F.col("output_hash").isNotNull() & ~F.col("output_hash").eqNullSafe(F.col("_last_hash"))
    points = rows.groupBy(*ev.keys, "_block", F.col("_r.nth").alias("_nth")).agg(
        F.max(F.when(begin, step)).alias("action_step"), F.max(F.when(begin, F.coalesce("tool", "type"))).alias("action_tool"),
        F.bool_or(F.when(begin, F.col("success"))).alias("action_success"),
        F.max(F.when(begin & (F.col("_j") == 0), F.col("_thought") - F.coalesce("_thought_before", F.lit(0.0)))).alias("_deliberation"),
        F.count(F.when(after, 1)).alias("outcome_steps"),
        F.coalesce(F.bool_or(after & changed), F.lit(False)).alias("changed_state"),
        F.coalesce(F.bool_or(after & (F.col("phase_rank") == 4)), F.lit(False)).alias("verified"))
    last = ev.df.groupBy(*ev.keys).agg(F.max(F.when(thinks, step)).alias("_last_thought"))
    closed = points.where(F.col("action_step").isNotNull()).join(last, list(ev.keys)).withColumn(
        "closed", (F.col("outcome_steps") == reach) | F.coalesce(F.col("_last_thought") > F.col("action_step"), F.lit(False)))
    return closed.select(*ev.keys, "action_step", "action_tool", "action_success",
                         F.round(F.coalesce("_deliberation", F.lit(0.0)), 1).alias("deliberation_ms"),
                         "outcome_steps", "changed_state", "verified", "closed")


def decision_quality(points: DataFrame, keys: list[str]) -> DataFrame:
    done = points.where("closed")
    def share(c: str) -> Column:
        return F.round(F.avg(F.col(c).cast("int")), 3).alias(f"{c}_rate")
    return done.groupBy(*keys).agg(
        F.count("*").alias("decisions"), share("action_success"), F.round(F.avg("deliberation_ms") + 1e-9, 1).alias("mean_deliberation_ms"),
        share("verified"), share("changed_state"))


def memory_items(ev: Ordered, decay: float = 50.0) -> DataFrame:
    """Resources touched by a session with their retention at its end."""
    sized = ev.totals(_end=F.max(ev.order)).with_columns(
        resource=F.coalesce("output_hash", "input_hash"), _tok=F.col("tokens_in") + F.col("tokens_out"))
    per = sized.df.where(F.col("resource").isNotNull()).groupBy(*ev.keys, "resource").agg(
        F.min(ev.order).alias("first_step"), F.max(ev.order).alias("last_step"), F.count("*").alias("accesses"),
        F.max("_tok").alias("tokens"), F.max("_end").alias("_end"))
    recency = F.greatest(F.lit(0.0), 1 - (F.col("_end") - F.col("last_step")) / decay)
    kept = F.least(0.6 * recency + 0.4 * F.least(F.col("accesses") / 5.0, F.lit(1.0)), F.lit(1.0))
    return per.select(*ev.keys, "resource", "first_step", "last_step", "accesses", "tokens", F.round(kept + 1e-9, 3).alias("retention"),
                      F.when(F.col("_end") - F.col("last_step") <= decay, "active").otherwise("at_risk").alias("state"))


def contract(ev: Ordered, on_contract: Column, category: Column, expected: dict[str, float], window: int = 30) -> Ordered:
    """Share of recent actions on the agreed files, and drift of all files so far from the agreed mix."""
    eps = 1e-6
    marked = ev.with_columns(_on=on_contract, _cat=category).frame(window - 1, 0, {
        "adherence": lambda w: F.avg(F.col("_on").cast("double")).over(w.rowsBetween(1 - window, 0))})
    names = list(expected)
    counted = marked.running(_all=("count", F.col("_cat")), **{
        f"_c_{n}": ("count", F.when(F.col("_cat") == n, 1)) for n in names})
    drift = F.lit(0.0)
    for n in names:
        q = max(expected[n], eps)
        p = F.greatest(F.col(f"_c_{n}") / F.greatest("_all", F.lit(1)), F.lit(eps))
        seen = F.lit(True) if expected[n] > 0 else F.col(f"_c_{n}") > 0
        drift = drift + F.when(seen, p * F.log2(p / q)).otherwise(0.0)
    step = F.col(ev.order)
    adherence, kl = F.round(F.col("adherence") + 1e-9, 3), F.round(F.greatest(drift, F.lit(0.0)) + 1e-9, 4)
    return counted.on(counted.df.withColumns({"adherence": adherence, "scope_drift": kl}).withColumn(
        "anomaly", F.when((step >= 20) & (F.col("adherence") < 0.3), "scope_deviation")
        .when((step > 30) & (F.col("scope_drift") > 2.0), "scope_drift")).drop("_on", "_cat", "_all", *[f"_c_{n}" for n in names]))
