"""Feature families of chat trajectories; one row per trajectory.

The input is an ordered turn table ``(session_id, turn, role, text)``. "The next
such turn" is a running value taken backwards, so each family is one pass over its
turns and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions import infotheory as it
from trajlens.functions import text as tx
from trajlens.functions.events import verb_class
from trajlens.operators import metrics
from trajlens.sequence import Ordered

AGENT_ROLES = ("ai", "assistant")
IT_METRICS = ("action_mi", "action_entropy", "tool_entropy", "compression_ratio", "kl_divergence")


def is_agent() -> Column:
    return F.col("role").isin(*AGENT_ROLES)


def slope(y: Column, x: Column) -> Column:
    fitted = F.regr_slope(y, x)
    return F.coalesce(F.when(F.isnan(fitted), 0.0).otherwise(fitted), F.lit(0.0))


def actions(turns: Ordered) -> Ordered:
    """One row per agent turn holding an action: command, arguments, target, event type, symbol."""
    lined = turns.with_columns(_line=F.when(is_agent(), tx.action_line(F.col("text"))))
    acted = lined.substream(F.col("_line").isNotNull(), "step")
    acted = acted.with_columns(tool_name=tx.command_of(F.col("_line")), args=tx.arguments_of(F.col("_line")))
    acted = acted.with_columns(target_path=tx.first_path(F.col("args")), event_type=verb_class(F.col("tool_name")))
    prefix = (F.when(F.col("event_type") == "file_read", "read:").when(F.col("event_type") == "file_write", "write:"))
    symbol = (F.when(prefix.isNotNull(), F.concat(prefix, F.coalesce("target_path", F.lit("unknown"))))
              .when(F.col("event_type") == "shell_command", F.concat(F.lit("shell:"), F.col("tool_name")))
              .otherwise(F.concat(F.lit("tool:"), F.col("tool_name"))))
    return acted.on(acted.df.withColumn("symbol", symbol).drop("_line"))


def information(acted: Ordered, compression: bool = True) -> DataFrame:
    """Mean, final, maximum and slope of each information measure over the actions."""
    stream = acted.select("symbol", "event_type")
    measured = metrics.step_metrics(stream, compression=compression)
    measured = metrics.carried_entropy(
        measured, F.col("event_type").isin("tool_call", "shell_command"), "tool_entropy")
    names = [m for m in IT_METRICS if compression or m != "compression_ratio"]
    aggs = []
    for m in names:
        y = F.col(m)
        aggs += [F.avg(y).alias(f"{m}_mean"), F.max_by(y, acted.order).alias(f"{m}_final"),
                 F.max(y).alias(f"{m}_max"), slope(y, F.col(acted.order)).alias(f"{m}_slope")]
    per = measured.df.groupBy(*acted.keys).agg(*aggs)
    return per.select(*acted.keys, *[F.round(c, 6).alias(c) for c in per.columns if c not in acted.keys])


def workload(turns: Ordered) -> DataFrame:
    """Reasoning length, context growth and error episodes."""
    text = F.coalesce("text", F.lit(""))
    at = F.col(turns.order) - 1
    error = ~is_agent() & (at > 1) & text.rlike(tx.WORKLOAD_ERROR)
    base = turns.with_columns(_at=at, _len=F.length(text).cast("long"), _err=error, _agent=is_agent(),
                              _think=F.when(is_agent(), F.length(tx.thought_of(F.col("text"))).cast("long")),
                              _acts=(is_agent() & text.rlike(tx.FENCE)).cast("int"))
    base = base.on(base.df.drop("text"))
    summed = base.running(_cum=("sum", F.col("_len")), _nth=("count", F.when(F.col("_agent"), 1)))
    before = summed.running(exclusive=True, _last_err=("last", F.when(F.col("_err"), F.col("_at"))),
                            _last_agent=("last", F.when(F.col("_agent"), F.col("_at"))))
    opens = F.col("_err") & (F.col("_last_err").isNull() | (F.col("_last_err") < F.col("_last_agent")))
    opened = before.with_columns(_opens=opens).running(
        exclusive=True, _open_at=("last", F.when(F.col("_opens"), F.col("_at"))))
    closes = F.col("_agent") & (F.col("_open_at") > F.coalesce("_last_agent", F.lit(-1)))
    per = opened.df.groupBy(*turns.keys).agg(
        F.avg("_think").alias("reasoning_mean"), F.max("_think").alias("reasoning_max"),
        F.sum("_think").alias("reasoning_total"), slope(F.col("_think"), F.col("_nth")).alias("reasoning_slope"),
        F.max("_cum").alias("context_final"), slope(F.col("_cum"), F.col("_at")).alias("context_slope"),
        F.sum("_acts").alias("_actions"), F.count(F.when(F.col("_opens"), 1)).alias("error_episodes"),
        F.avg(F.when(closes, F.col("_at") - F.col("_open_at"))).alias("recovery_latency"))
    return per.select(
        *turns.keys, F.round(F.coalesce("reasoning_mean", F.lit(0.0)), 6).alias("reasoning_mean"),
        F.coalesce("reasoning_max", F.lit(0)).cast("long").alias("reasoning_max"),
        F.coalesce("reasoning_total", F.lit(0)).cast("long").alias("reasoning_total"),
        F.round("reasoning_slope", 6).alias("reasoning_slope"), F.col("context_final"),
        F.round("context_slope", 6).alias("context_slope"),
        F.round(F.when(F.col("_actions") > 0, F.coalesce("reasoning_total", F.lit(0)) / F.col("_actions")).otherwise(0.0), 6)
        .alias("reasoning_density"), "error_episodes",
        F.round(F.coalesce("recovery_latency", F.lit(0.0)), 6).alias("recovery_latency"))


def awareness(acted: Ordered) -> DataFrame:
    """Looking before changing, and verifying before submitting."""
    low = F.lower("tool_name")
    at = F.col(acted.order)
    base = acted.select("tool_name", "target_path").with_columns(
        _target=F.nullif(tx.base_name(F.col("target_path")), F.lit("")), _sees=low.isin(*tx.OBSERVE_VERBS),
        _looks=low.isin(*tx.OBSERVE_VERBS, *tx.SEARCH_VERBS), _mutates=low.isin(*tx.MUTATE_VERBS),
        _verifies=low.isin(*tx.VERIFY_VERBS), _submits=low == "submit")
    base = base.on(base.df.drop("tool_name", "target_path"))
    mutated = F.when(F.col("_mutates"), at)
    known = base.per_value("_target", _seen=F.min(F.when(F.col("_sees"), at)), _first_mut=F.min(mutated), _last_mut=F.max(mutated))
    # Each changed target is counted once, on its first change.
    first = F.col("_target").isNotNull() & (F.col("_first_mut") == at)
    blind = F.col("_mutates") & F.col("_target").isNotNull() & (F.col("_seen").isNull() | (F.col("_seen") > at))
    verified = known.running(_verified=("last", F.when(F.col("_verifies"), at)), _n_submits=("count", F.when(F.col("_submits"), 1)))
    per = verified.df.groupBy(*acted.keys).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("_looks"), 1)).alias("_n_looks"),
        F.count(F.when(F.col("_verifies"), 1)).alias("_n_verifies"), F.min(F.when(F.col("_mutates"), at)).alias("_first_mutate"),
        F.max(F.when(F.col("_mutates"), at)).alias("_last_mutate"), F.count(F.when(blind, 1)).alias("_blind"),
        F.count(F.when(first, 1)).alias("_distinct"), F.count(F.when(first & (F.col("_seen") < F.col("_last_mut")), 1)).alias("_covered"),
        F.max(F.when((F.col("_n_submits") == 0) & F.col("_verifies"), at)).alias("_last_verify"))
    n = F.col("n")
    return per.select(
        *acted.keys, F.round(F.when(F.col("_distinct") > 0, F.col("_covered") / F.col("_distinct")).otherwise(0.0), 6).alias("coverage"),
        F.round(F.col("_n_looks") / n, 6).alias("explore_ratio"),
        F.round(F.coalesce((F.col("_first_mutate") - 1) / n, F.lit(1.0)), 6).alias("read_before_first_edit"),
        F.round(F.col("_blind") / n, 6).alias("blind_edit_rate"),
        F.coalesce((F.col("_last_verify") > F.col("_last_mutate")).cast("int"), F.lit(0)).alias("verify_before_submit"),
        F.round(F.col("_n_verifies") / n, 6).alias("verify_rate"))


def error_recovery(turns: Ordered, within: int = 3) -> DataFrame:
    """Error episodes: recurrence, change of strategy, recovery, open end."""
    line = F.when(is_agent(), tx.action_line(F.col("text")))
    observes = F.col("role").isin("user", "tool") & (F.col(turns.order) > 2)
    marked = turns.with_columns(_line=line, _obs=observes).substream(
        F.col("_line").isNotNull() | F.col("_obs"), "seq")
    args = tx.arguments_of(F.col("_line"))
    quoted = F.regexp_extract(args, tx.QUOTED, 1)
    target = tx.base_name(F.when(quoted != "", quoted).otherwise(F.regexp_extract(args, r"^\s*(\S+)", 1)))
    act = F.when(F.col("_line").isNotNull(), F.concat_ws("\u0001", F.lower(tx.command_of(F.col("_line"))), target))
    seq = marked.with_columns(_act=act, _err=F.coalesce(F.col("_obs") & F.col("text").rlike(tx.EPISODE_ERROR), F.lit(False)))
    seq = seq.on(seq.df.drop("text", "_line", "role"))
    seq = seq.with_columns(_ok=F.col("_obs") & ~F.col("_err"))
    lagged = seq.frame(1, 0, {"_prev_err": lambda w: F.coalesce(F.lag("_err").over(w), F.lit(False))})
    at = F.col("seq")
    told = lagged.running(_fail=("last", F.col("_act"))).running(
        exclusive=True, reverse=True, _resp=("last", F.col("_act")), _ok_at=("last", F.when(F.col("_ok"), at)))
    episode = F.col("_err") & ~F.col("_prev_err")

    def episodes_with(cond: Column) -> Column:
        return F.count(F.when(episode & cond, 1))

    submits = F.startswith("_act", F.lit("submit\u0001")) | (F.col("_act") == "submit")
    wait = F.when(episode, F.col("_ok_at") - at)
    per_fail = told.df.groupBy(*turns.keys, F.when(episode, F.coalesce("_fail", F.lit(""))).alias("_key")).agg(
        episodes_with(F.lit(True)).alias("_n"), episodes_with(F.col("_resp") != F.col("_fail")).alias("_changed"),
        episodes_with(F.col("_ok_at") - at <= within).alias("_recovered"), F.sum(wait).alias("_latency"), F.count(wait).alias("_ended"),
        F.max(F.when(F.col("_obs"), F.struct(at.alias("at"), F.col("_err").alias("err")))).alias("_last_obs"),
        F.max(F.when(submits, at)).alias("_submit"))
    every = per_fail.groupBy(*turns.keys).agg(
        F.sum("_n").alias("episodes"), F.coalesce(F.sum(F.when(F.col("_key") != "", F.col("_n") - 1)), F.lit(0)).alias("_again"),
        F.sum("_changed").alias("_changed"), F.sum("_recovered").alias("_recovered"), F.sum("_latency").alias("_latency"),
        F.sum("_ended").alias("_ended"), F.max("_last_obs").alias("_last_obs"), F.max("_submit").alias("_submit"))
    n = F.col("episodes")

    def share(c: str) -> Column:
        return F.round(F.when(n > 0, F.col(c) / n).otherwise(0.0), 6)

    open_end = F.col("_last_obs.err") & (F.col("_submit").isNull() | (F.col("_submit") < F.col("_last_obs.at")))
    return every.select(
        *turns.keys, F.coalesce("episodes", F.lit(0)).alias("episodes"), share("_again").alias("recurrence_rate"),
        share("_changed").alias("strategy_change_rate"), share("_recovered").alias("recovery_rate"),
        F.round(F.coalesce(F.col("_latency") / F.when(F.col("_ended") > 0, F.col("_ended")), F.lit(0.0)), 6).alias("mean_latency"),
        F.coalesce(open_end.cast("int"), F.lit(0)).alias("terminal_unresolved"))


def coherence(turns: Ordered) -> DataFrame:
    """Agreement of what an agent says with what it does, per action turn."""
    acted = turns.with_columns(_line=F.when(is_agent(), tx.action_line(F.col("text")))).substream(
        F.col("_line").isNotNull(), "step")
    verb = F.lower(tx.command_of(F.col("_line")))
    told = acted.with_columns(_cat=tx.verb_category(verb), _thought=F.lower(tx.thought_of(F.col("text"))),
                              _target=tx.target_token(tx.arguments_of(F.col("_line"))))
    told = told.with_columns(_verb=tx.verb_aligned(F.col("_cat"), F.col("_thought")))
    named = F.col("_target") != ""
    said = F.contains("_thought", F.col("_target")).cast("int")
    score = 0.5 * F.col("_verb") + 0.5 * F.when(named, said).otherwise(F.col("_verb"))
    scored = told.with_columns(_score=score, _match=F.when(named, said))
    per = scored.df.groupBy(*turns.keys).agg(
        F.avg("_score").alias("mean"), F.min("_score").alias("min"), F.max_by("_score", "step").alias("final"),
        slope(F.col("_score"), F.col("step")).alias("slope"), F.avg("_verb").alias("verb_align_rate"),
        F.coalesce(F.avg("_match"), F.lit(0.0)).alias("target_match_rate"))
    return per.select(*turns.keys, *[F.round(c, 6).alias(c) for c in per.columns if c not in turns.keys])


def trivial(turns: Ordered, runs: DataFrame | None = None) -> DataFrame:
    """Turn and action counts; with ``runs`` (keys, ``patch, exit_status, model``) also patch length, exit status and model.

    A trajectory without a run, and empty fields, count as no patch and "unknown".
    """
    has = F.when(is_agent() & tx.action_line(F.col("text")).isNotNull(), 1)
    counts = turns.df.groupBy(*turns.keys).agg(F.count("*").alias("n_turns"), F.count(has).alias("n_parsed_actions"))
    if runs is None:
        return counts
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    return counts.join(runs, list(turns.keys), "left").select(
        *turns.keys, "n_turns", "n_parsed_actions", F.coalesce(F.length("patch"), F.lit(0)).alias("patch_len"),
        known("exit_status").alias("exit_status"), known("model").alias("model_name"))


def tool_counts(acted: Ordered) -> DataFrame:
    return acted.df.groupBy(*acted.keys, "tool_name").agg(F.count("*").alias("n"))


def action_symbols_entropy(acted: Ordered) -> DataFrame:
    counts = acted.df.groupBy(*acted.keys, "symbol").agg(F.count("*").alias("n"))
    n = F.sum("n").cast("double")
    c = F.col("n").cast("double")
    return counts.groupBy(*acted.keys).agg(
        it.stored(F.greatest(F.log2(n) - F.sum(c * F.log2(c)) / n, F.lit(0.0))).alias("entropy"))


def spaced_pairs(acted: Ordered, k: int = 6) -> DataFrame:
    """Up to ``k`` evenly spaced action turns per trajectory."""
    sized = acted.totals(_n=F.max(acted.order))
    n = F.col("_n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                         lambda i: F.floor(i * (n - 1) / (k - 1.0)) + 1)
    keep = (n <= k) | F.array_contains(wanted, F.col(acted.order))
    return sized.df.where(keep).select(*acted.keys, F.col(acted.order), "tool_name", "target_path")
