"""When each detector first fires: the rules of ``detectors`` as conditions on every prefix of a session.

A monitor that checks its rules after each event reports a failure at the first
event that makes the rule hold, and not again; a few may report again at another
place. Here one table of running values holds what nine rules need of a prefix,
so every rule is a condition on a row, and all of them are read off in one pass.
Only the latency rule needs quartiles of every prefix: sessions that can stall
at all go through a sorted list.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions.events import any_of
from trajlens.operators import detectors as dt
from trajlens.operators.phases import phase_machine
from trajlens.operators.stats import quantiles
from trajlens.sequence import Ordered
from trajlens.session import durable

#: The rules that are conditions on a row of running values.
PREFIX_RULES = ("context_loss", "premature_termination", "error_cascade", "analysis_paralysis", "recovery_failure",
                "missing_verification", "reasoning_action_mismatch", "tool_thrashing")
RULES = (*PREFIX_RULES, "stall")
_NONE = "\u0001none"
_SHIFT = 1 << 40


def _written(rows: Ordered) -> Ordered:
    """Where sessions are split, running values read their input twice; written between them, it stays two readings."""
    return rows.on(durable(rows.df)) if rows.split else rows


def prefix_facts(ev: Ordered) -> Ordered:
    """Running values of every prefix, one row per event."""
    step, user = F.col(ev.order), F.col("type") == "user_input"
    call, read = dt.is_call(), dt.is_read()
    err = ~F.col("success")
    text = F.lower("goal_text")
    tested = ((any_of(F.lower("tool"), ("bash",)) & F.col("goal_text").rlike(dt.TEST_COMMAND))
              | ((F.lower("tool") == "task") & F.col("goal_text").rlike(dt.TEST_TASK))
              | (F.col("type").isin("reasoning", "planning") & any_of(text, dt.TEST_PHRASES)))
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = _written(phase_machine(ev.select("type", "tool", "input_hash", "output_hash", "success", "goal_text"))).with_columns(
        _err=err, _good=call & F.col("success"), _call=call, _thinks=F.col("type").isin("reasoning", "planning"),
        _read=read & F.col("output_hash").isNotNull() & (F.col("output_hash") != F.col("tool")),
        _looks=call & F.col("tool").isNotNull() & F.lower("tool").isin(*dt.READ_ONLY_TOOLS),
        _acts=call & F.col("tool").isNotNull() & ~F.lower("tool").isin(*dt.READ_ONLY_TOOLS))
    back = lambda c, n, default=None: lambda w: F.lag(c, n, default).over(w)
    rows = rows.frame(3, 0, {
        "_e1": back("_err", 1, False), "_e2": back("_err", 2, False), "_e3": back("_err", 3, False),
        "_g1": back(F.when(F.col("_good"), F.col("output_hash")), 1), "_g2": back(F.when(F.col("_good"), F.col("output_hash")), 2),
        "_was_type": back("type", 1), "_was_tool": back("tool", 1), "_was_input": back("input_hash", 1), "_was_text": back("goal_text", 1)})
    e1, e2, e3 = (F.col(f"_e{n}") for n in (1, 2, 3))
    after = F.when(e3, e1.cast("long") + e2.cast("long") + 1).when(e2, e1.cast("long") + 1).when(e1, F.lit(1).cast("long"))
    near = F.when(e1, 1).when(e2, 2).when(e3, 3)
    far = F.when(e3, 3).when(e2, 2).when(e1, 1)
    again = e1 & F.col("_was_tool").eqNullSafe(F.col("tool")) & (F.col("_was_input") == F.col("input_hash"))
    # A failure makes the failures up to three events before it failed recoveries; the nearest of them had none until now.
    rows = rows.with_columns(_bad=F.col("_err") & (e1 | e2 | e3), _bad_at=step - near, _worst=F.when(F.col("_err"), after * _SHIFT - (step - far)))
    one = lambda c: ("count", F.when(c, 1))
    ever = lambda c: ("max", flag(c).cast("int"))
    rows = _written(rows).running(
        errors=one(F.col("_err")), bads=one(F.col("_bad")), worst=("max", F.col("_worst")), calls=one(call), goods=one(F.col("_good")), stuck=one(again),
        executing=one(F.col("class_rank") == 3), verifying=one(F.col("class_rank") == 4), delivering=one(F.col("class_rank") == 5),
        reached=ever(F.col("is_transition") & (F.col("phase_rank") == 4)), delegated=ever(user & F.col("goal_text").rlike(dt.VERIFICATION)),
        tested=ever(tested), wrote=ever(any_of(F.lower("tool"), dt.WRITE_WORDS)), work=one(call & F.col("tool").isNotNull() & ~read), block=one(user),
        looks=one(F.col("_looks")), last_bad=("last", F.when(F.col("_bad"), F.col("_bad_at"))), last_ok=("last", F.when(F.col("success"), step)),
        last_act=("last", F.when(~F.col("_thinks"), step)))
    rows = _written(rows).running(looks_before=("last", F.when(F.col("_acts"), F.col("looks"))))
    rows = rows.with_columns(chain=F.when(F.col("_err"), step - F.coalesce("last_ok", F.lit(0))), thinking=step - F.coalesce("last_act", F.lit(0)),
                             looking=F.when(F.col("_looks"), F.col("looks") - F.coalesce("looks_before", F.lit(0))))
    rows = _written(rows).running(longest_look=("max", F.col("looking")))
    rows = _written(rows).running(exclusive=True, longest_before=("max", F.col("chain")), goods_at_error=("last", F.when(F.col("_err"), F.col("goods"))))
    # Different results since the last failed recovery: those between it and the failure that told, and new ones from there on.
    first, second = F.when(~e1, F.col("_g1")), F.when(~e1 & ~e2, F.col("_g2"))
    between = F.when(first.isNotNull(), 1).otherwise(0) + F.when(second.isNotNull() & ~second.eqNullSafe(first), 1).otherwise(0)
    told = lambda c: ("last", F.when(F.col("_bad"), c))
    rows = _written(rows).running(goods_before=told(F.col("goods_at_error")), seen1=told(F.coalesce(first, F.lit(_NONE))), seen2=told(F.coalesce(second, F.lit(_NONE))), between=told(between))
    hashed = F.col("_good") & F.col("output_hash").isNotNull() & F.col("last_bad").isNotNull()
    rows = rows.with_columns(_since=F.when(hashed, F.struct("output_hash", "last_bad"))).per_value("_since", _since_at=F.min(ev.order))
    fresh = hashed & (F.col("_since_at") == step) & (F.col("output_hash") != F.col("seen1")) & (F.col("output_hash") != F.col("seen2"))
    rows = _written(rows).running(fresh=one(fresh))
    rows = _written(rows).running(fresh_before=told(F.col("fresh")))
    rows = rows.with_columns(_stretch=F.when(F.col("_read"), F.struct("output_hash", "block"))).per_value("_stretch", first_work=F.min("work"), first_read=F.min(ev.order))
    return rows.with_columns(n=step, new_results=F.col("between") + F.col("fresh") - F.col("fresh_before"), successes=F.col("goods") - F.col("goods_before"))


def _conditions(order: str, analysis: int, rate: float, executing: int, look: tuple[int, int], min_intervening: int, staleness: float) -> dict[str, tuple[Column, Column, Column]]:
    """Of each rule whether it reports at this row, where, and how sure."""
    n, c = F.col("n"), F.col
    gap = c("work") - c("first_work")
    chain = F.least(c("chain") / 10.0, F.lit(1.0))
    failed = c("bads") / (c("errors") - c("_err").cast("int"))
    recovered = F.when(F.coalesce("new_results", F.lit(0)) > 0, c("new_results") >= 5).otherwise(F.coalesce("successes", F.lit(0)) >= 8)
    productive = (c("calls") >= 50) & (c("goods") / c("calls") >= 0.8) & (c("stuck") == 0)
    text, tool = F.lower("_was_text"), F.lower("tool")
    reads = any_of(text, dt.READ_INTENT) & any_of(tool, ("write", "edit", "create", "delete"))
    tests = any_of(text, dt.TEST_INTENT) & any_of(tool, ("write", "edit", "create"))
    stated = c("_was_type").isin("reasoning", "planning") & c("_call") & (c("tool") != "") & (c("_was_text") != "")
    limit = F.when(c("phase_rank") == 3, look[0]).otherwise(look[1])
    quiet = (c("delegated") == 0)
    return {
        "context_loss": (c("_read") & (n >= 6) & (gap >= F.greatest(F.lit(min_intervening), F.floor(n * staleness))), n, F.least(gap / 10.0, F.lit(1.0))),
        "premature_termination": ((n >= 5) & (c("phase_rank") == 5) & (c("delivering") >= 3) & (c("executing") >= 3) & (c("reached") == 0) & quiet, n, F.lit(0.85)),
        "error_cascade": ((n >= 3) & (c("chain") >= 3) & (c("chain") > F.coalesce("longest_before", F.lit(0))), n, F.round(chain, 3)),
        "analysis_paralysis": (c("_thinks") & (c("thinking") >= analysis), n, F.round(F.least(c("thinking") / (analysis * 3.0), F.lit(0.85)), 3)),
        "recovery_failure": ((n >= 4) & (c("errors") >= 3) & (failed >= rate) & ~recovered & ~productive, F.pmod(-c("worst"), F.lit(_SHIFT)), F.round(F.least(failed, F.lit(1.0)), 3)),
        "missing_verification": ((c("executing") >= executing) & (c("verifying") == 0) & quiet & (c("tested") == 0) & (c("wrote") == 1) & ~c("phase_rank").isin(1, 2),
                                 n, F.least(c("executing") / (executing * 3.0), F.lit(0.9))),
        "reasoning_action_mismatch": (stated & (reads | tests), n, F.when(reads, 0.7).otherwise(0.65)),
        "tool_thrashing": ((n >= look[0]) & (c("longest_look") >= limit), n, F.least(c("longest_look") / (limit * 2.0), F.lit(0.85)))}


class _Ranks:
    """Sorted values in runs, so that an insertion moves few of them."""

    RUN = 2000

    def __init__(self):
        self.runs: list[list[float]] = [[]]
        self.n = 0

    def add(self, x: float) -> None:
        at = min(bisect_left(self.runs, x, key=lambda r: r[-1] if r else x), len(self.runs) - 1)
        run = self.runs[at]
        insort(run, x)
        self.n += 1
        if len(run) > self.RUN:
            self.runs[at:at + 1] = [run[:self.RUN // 2], run[self.RUN // 2:]]

    def at(self, rank: int) -> float:
        for run in self.runs:
            if rank < len(run):
                return run[rank]
            rank -= len(run)
        raise IndexError(rank)

    def quantile(self, p: float) -> float:
        place = (self.n - 1) * p
        low = int(place)
        a = self.at(low)
        return a if low == place else a + (place - low) * (self.at(low + 1) - a)


_STALL = "step long, at_step long, confidence double"


def stall_firings(ev: Ordered, min_events: int = 10, multiplier: float = 1.5, floor_ms: float = 30_000.0, idle_ms: float = 120_000.0,
                  min_count: int = 2, min_median_ms: float = 50.0) -> DataFrame:
    """Every step at which the latency rule reports: its quartiles are those of the prefix.

    Only sessions with ``min_count`` latencies beyond the floor can report; their
    active rows go by session, in order, through one sorted list, which holds 8 bytes
    for each of them.
    """
    keys = list(ev.keys)
    slow = F.coalesce("tool", "type").isin(*dt.SLOW_TOOLS)
    active = ev.df.where(F.col("latency_ms") <= idle_ms).select(*keys, F.col(ev.order).alias("step"), F.col("latency_ms").cast("double").alias("latency"), slow.alias("slow"))
    able = active.where(F.col("latency") > floor_ms).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count).select(*keys)
    dealt = active.join(able, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "step")
    fields = [f for f in dealt.schema.fields if f.name in keys]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), _STALL])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = None
        for batch in batches:
            key = [batch.column(k).to_pylist() for k in range(len(keys))]
            out: list[tuple[int, int, int, float]] = []
            for row, (step, x, is_slow) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(keys), len(keys) + 3)))):
                own = tuple(k[row] for k in key)
                if own != session:
                    session, ranks, big = own, _Ranks(), []
                    top, top_at, top_other, top_late, told = 0.0, 0, 0.0, 0.0, None
                ranks.add(x)
                if x > floor_ms:
                    insort(big, x)
                if x > top:
                    top, top_at = x, step
                if not is_slow:
                    top_other = max(top_other, x)
                if step > 6:
                    top_late = max(top_late, x)
                if ranks.n < min_events or len(big) < min_count:
                    continue
                q25, median, q75 = (ranks.quantile(p) for p in (0.25, 0.5, 0.75))
                limit = max(q75 + multiplier * (q75 - q25), floor_ms)
                beyond = len(big) - bisect_right(big, limit)
                if median >= min_median_ms and beyond >= min_count and top_other > limit and top_late > limit:
                    if told != top_at:
                        out.append((row, step, top_at, round(min(0.5 + (top - limit) / limit * 0.3, 1.0), 3)))
                    told = top_at
            if out:
                rows, steps, places, sure = zip(*out)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in range(len(keys))), pa.array(steps, pa.int64()),
                                                  pa.array(places, pa.int64()), pa.array(sure, pa.float64())], [*keys, "step", "at_step", "confidence"])

    return dealt.mapInArrow(fold, ddl).select(*keys, F.lit("stall").alias("failure"), "step", "at_step", "confidence")


def first_firings(ev: Ordered, rules: tuple[str, ...] = RULES, analysis: int = 4, rate: float = 0.4, executing: int = 25, look: tuple[int, int] = (15, 25),
                  min_intervening: int = 5, staleness: float = 0.08, stall: dict | None = None) -> DataFrame:
    """``session_id, failure, step, at_step, confidence``: what a monitor that checks ``rules`` after every event reports.

    ``step`` is the event after which a rule first holds and ``at_step`` the place
    it names. ``error_cascade`` and ``stall`` report again whenever they name
    another place than the time before; all others report once a session.
    """
    keys = list(ev.keys)
    on_rows = [r for r in rules if r in PREFIX_RULES]
    parts = []
    if on_rows:
        found = _conditions(ev.order, analysis, rate, executing, look, min_intervening, staleness)
        reports = F.array(*[F.when(F.coalesce(found[r][0], F.lit(False)), F.struct(
            F.lit(r).alias("failure"), found[r][1].cast("long").alias("at_step"), found[r][2].cast("double").alias("confidence"))) for r in on_rows])
        rows = prefix_facts(ev).df.select(*keys, F.col(ev.order).cast("long").alias("step"), F.explode(F.filter(reports, lambda r: r.isNotNull())).alias("_r"))
        once = F.when(~F.col("_r.failure").isin(*dt.REFIREABLE), F.lit(0)).otherwise(F.col("step"))
        parts.append(rows.groupBy(*keys, F.col("_r.failure").alias("failure"), once.alias("_once")).agg(
            F.min_by(F.struct("step", "_r.at_step", "_r.confidence"), "step").alias("_f")).select(*keys, "failure", "_f.*"))
    if "stall" in rules:
        parts.append(stall_firings(ev, **(stall or {})))
    return reduce(DataFrame.unionByName, parts)


def settled_firings(firings: DataFrame, final_stall: DataFrame, final_recovery: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Firings after a look at the whole session.

    ``recovery_failure`` is taken back where the whole session does not show it; a
    stall takes the confidence of the whole session where that is at least its own.
    """
    ends = final_recovery.select(*keys, F.lit("recovery_failure").alias("failure"), F.lit(None).cast("double").alias("whole")).unionByName(
        final_stall.select(*keys, F.lit("stall").alias("failure"), F.col("confidence").alias("whole")))
    joined = firings.join(ends.withColumn("_held", F.lit(True)), [*keys, "failure"], "left")
    kept = joined.where((F.col("failure") != "recovery_failure") | F.col("_held"))
    return kept.withColumn("confidence", F.greatest("confidence", "whole")).drop("whole", "_held")


def failed_gates(ev: Ordered, min_chain: int = 3, stall: dict | None = None, **reread: float) -> DataFrame:
    """``session_id, failure, fired, confidence, gate_failed`` at the end of each session, of the rules whose gates have names."""
    keys, limits = list(ev.keys), {"min_events": 10, "multiplier": 1.5, "floor_ms": 30_000.0, "idle_ms": 120_000.0, "min_count": 2, "min_median_ms": 50.0} | (stall or {})
    sizes = dt.session_sizes(ev)
    active = ev.df.where(F.col("latency_ms") <= limits["idle_ms"])
    fence = quantiles(active, keys, "latency_ms", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ev.chunk_rows).withColumn(
        "_limit", F.greatest(F.col("q75") + limits["multiplier"] * (F.col("q75") - F.col("q25")), F.lit(limits["floor_ms"])))
    beyond = active.join(fence.select(*keys, "_limit"), keys).where(F.col("latency_ms") > F.col("_limit")).groupBy(*keys).agg(
        F.count("*").alias("_stalls"), F.bool_and(F.coalesce("tool", "type").isin(*dt.SLOW_TOOLS)).alias("_slow"), F.max(ev.order).alias("_last"))
    facts = sizes.join(fence.select(*keys, F.col("n").alias("_active"), "median"), keys, "left").join(beyond, keys, "left")
    stalls, many = F.coalesce("_stalls", F.lit(0)), F.col("n_events")
    gates = {
        "stall": F.when(many < limits["min_events"], "min_events").when(F.coalesce("_active", F.lit(0)) < limits["min_events"], "min_active_events")
        .when(F.col("median") < limits["min_median_ms"], "low_median").when(stalls == 0, "no_outliers").when(stalls < limits["min_count"], "min_stall_count")
        .when(F.col("_slow"), "slow_tools_only").when(F.col("_last") <= 6, "cold_start"),
        "error_cascade": F.when(many < 3, "min_events").otherwise("no_chains_above_min"),
        "context_loss": F.when(many < 6, "min_events").otherwise("no_reread_candidates")}
    final = {"stall": dt.stall(ev, **(stall or {})), "error_cascade": dt.error_cascade(ev, min_chain), "context_loss": dt.context_loss(ev, **reread)}
    shots = facts.select(*keys, F.explode(F.array(*[F.struct(F.lit(r).alias("failure"), g.alias("gate_failed")) for r, g in gates.items()])).alias("_g")).select(*keys, "_g.*")
    results = reduce(DataFrame.unionByName, [d.select(*keys, F.lit(r).alias("failure"), F.round("confidence", 4).alias("confidence")) for r, d in final.items()])
    both = shots.join(results, [*keys, "failure"], "left")
    fired = F.col("confidence").isNotNull()
    return both.select(*keys, "failure", fired.alias("fired"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(~fired, F.col("gate_failed")).alias("gate_failed"))
