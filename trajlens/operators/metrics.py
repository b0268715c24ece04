"""Sliding information measures of symbol streams."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import zip_longest

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from trajlens.functions import infotheory as it
from trajlens.sequence import Framed, Ordered

WINDOW = 50
LZ_WINDOW = 150
BASELINE = 100

ADJACENT_STAGES = (("perception", "attention"), ("attention", "working_memory"),
                   ("working_memory", "decision_making"), ("decision_making", "action"),
                   ("action", "feedback"))


def _nth_gain(count: Column, symbol: Column, gain) -> Column:
    return F.when(symbol.isNotNull(), gain(count)).otherwise(F.lit(0).cast("long"))


def window_sums(ev: Ordered, window: int, sums: dict[str, str], gain=it.entropy_gain,
                before: dict[str, Framed] | None = None) -> Ordered:
    """For each ``out: symbol`` the fixed-point sum(c log2 c) of the last ``window`` symbols.

    A row adds the gain of its own symbol's count in the window and takes off the
    gain of the symbol that just left; both counts are range counts over (session,
    symbol), so a row costs the occurrences of its own symbol and nothing else.
    The change itself is kept as ``out_step``.
    """
    back, stages, helpers = _sum_stages(window, sums, gain, before)
    framed = ev.frame(back, 0, *stages)
    return framed.on(framed.df.drop(*helpers))


def _sum_stages(window: int, sums: dict[str, str], gain=it.entropy_gain, before: dict[str, Framed] | None = None,
                only: Column | None = None) -> tuple[int, list[dict[str, Framed]], list[str]]:
    """The reach, the stages and the helper columns of ``window_sums``; with ``only``, of the rows that fulfil it.

    Gains of a symbol's counts add up to a function of its count, so changes summed
    from any row that lies before the window give the sum of the window itself: the
    rows a frame copies suffice, and nothing is carried over from earlier ones.
    """
    one = F.lit(1) if only is None else F.when(only, 1)
    counts, changes, running = {}, {}, {}
    for out, symbol in sums.items():
        counts[f"_in_{out}"] = ((symbol,), lambda w: F.count(one).over(w.rangeBetween(1 - window, 0)))
        counts[f"_out_{out}"] = ((symbol,), lambda w: F.count(one).over(w.rangeBetween(0, window - 1)))
    counted = {out: F.col(symbol) if only is None else F.when(only, F.col(symbol)) for out, symbol in sums.items()}
    terms = {f"_gain_{out}": _nth_gain(F.col(f"_in_{out}"), symbol, gain) for out, symbol in counted.items()}
    losses = {f"_loss_{out}": _nth_gain(F.col(f"_out_{out}"), symbol, gain) for out, symbol in counted.items()}
    stages = [before] if before else []
    stages.append(counts)
    stages.append({n: (lambda w, c=c: c) for n, c in (terms | losses).items()})
    for out in sums:
        changes[f"{out}_step"] = lambda w, out=out: (
            F.col(f"_gain_{out}") - F.coalesce(F.lag(f"_loss_{out}", window).over(w), F.lit(0)))
        running[out] = lambda w, out=out: F.coalesce(
            F.sum(f"{out}_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    stages += [changes, running]
    helpers = [f"_{p}_{out}" for out in sums for p in ("in", "out", "gain", "loss")]
    return window + (1 if before else 0), stages, helpers


def sliding_entropy(ev: Ordered, symbol: str = "symbol", window: int = WINDOW,
                    out: str = "entropy") -> Ordered:
    """Entropy of the last ``window`` symbols."""
    summed = window_sums(ev, window, {"_s": symbol})
    n = F.least(F.col(ev.order), F.lit(window))
    return summed.on(summed.df.withColumn(
        out, it.stored(it.entropy_of_sum(F.col("_s"), n))).drop("_s", "_s_step"))


def _pair_stage(symbol: str) -> dict[str, Framed]:
    return {"_pair": lambda w: F.when(
        F.lag(symbol).over(w).isNotNull(), F.concat_ws("\u0001", F.lag(symbol).over(w), symbol))}


def _pair_stages(symbol: str, window: int) -> tuple[int, list[dict[str, Framed]], list[str]]:
    """The reach, the stages and the helper columns of the sums of symbols (``_s``) and pairs (``_p``).

    ``_heads`` counts the session's first symbol; it is read as long as that is in the window,
    so it counts from the start and needs no frame of the window's width.
    """
    back, stages, helpers = _sum_stages(window, {"_s": symbol, "_p": "_pair"}, before=_pair_stage(symbol))
    heads = ({"_head": lambda w: F.first(symbol).over(w.rowsBetween(Window.unboundedPreceding, 0))},
             {"_is_head": lambda w: (F.col("_head") == F.col(symbol)).cast("int")},
             {"_heads": lambda w: F.sum("_is_head").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return back, _side_by_side(stages, heads), [*helpers, "_head", "_is_head"]


def _side_by_side(stages: Sequence[dict[str, Framed]], others: Sequence[dict[str, Framed]]) -> list[dict[str, Framed]]:
    """Both lists of stages as one, so that they share a frame."""
    return [a | b for a, b in zip_longest(stages, others, fillvalue={})]


def _right_margin(ev: Ordered, window: int) -> Column:
    """The sum of the right symbols of the pairs of a window.

    The left margin of the pairs ending at a row is the symbol window of the row
    before. The right margin is the row's own symbol window, less the session's
    first symbol as long as that is still in the window, since it ends no pair.
    """
    return F.col("_s") - F.when(F.col(ev.order) <= window, it.entropy_gain(F.col("_heads"))).otherwise(0)


def _pair_information(ev: Ordered, window: int) -> Column:
    n = F.least(F.col(ev.order) - 1, F.lit(window))
    return it.stored(it.information_of_sums(
        F.col("_s") - F.col("_s_step"), _right_margin(ev, window), F.col("_p"), n))


def sliding_mi(ev: Ordered, symbol: str = "symbol", window: int = WINDOW, out: str = "mi") -> Ordered:
    """Mutual information of the last ``window`` adjacent pairs."""
    back, stages, helpers = _pair_stages(symbol, window)
    paired = ev.frame(back, 0, *stages)
    return paired.on(paired.df.withColumn(out, _pair_information(ev, window)).drop(
        *helpers, "_s", "_s_step", "_p", "_p_step", "_heads", "_pair"))


def sliding_compression(ev: Ordered, symbol: str = "symbol", window: int = LZ_WINDOW,
                        out: str = "compression") -> Ordered:
    """Phrase-count compression ratio of the last ``window`` symbols."""
    framed = ev.frame(window - 1, 0, {
        "_w": lambda w: F.collect_list(symbol).over(w.rowsBetween(1 - window, 0))})
    return framed.on(framed.df.withColumn(
        out, it.stored(it.lz_ratio(it.packed(F.col("_w"))))).drop("_w"))


def surprisal(ev: Ordered, symbol: str = "symbol", window: int = WINDOW,
              out: str = "surprisal") -> Ordered:
    """-log2 of the symbol's share of the window, smoothed by the vocabulary so far."""
    known = ev.distinct_so_far(symbol, "_k")
    framed = known.frame(window - 1, 0, {"_c": (
        (symbol,), lambda w: F.count(F.lit(1)).over(w.rangeBetween(1 - window, 0)))})
    n = F.least(F.col(ev.order), F.lit(window))
    return framed.on(framed.df.withColumn(
        out, it.stored(-F.log2(F.col("_c") / (n + F.col("_k"))))).drop("_c", "_k"))


def baseline_kl(ev: Ordered, symbol: str = "symbol", window: int = WINDOW,
                baseline: int = BASELINE, out: str = "kl") -> Ordered:
    """KL of the latest symbols after calibration against the first ``baseline`` symbols.

    Both distributions are smoothed by one over the vocabulary so far. With c and b
    the two counts of a symbol, the sum over the vocabulary splits into
    sum((c + 1) log2 (c + 1)), a windowed sum of log2(b + 1) over the current
    symbols, and a constant of the session.
    """
    framed = _vocabulary(ev, symbol, baseline)
    back, stages, helpers = _kl_stages(ev, symbol, window, baseline)
    framed = framed.frame(back, 0, *stages)
    return framed.on(framed.df.withColumn(out, _kl_value(ev, window, baseline)).drop(*helpers, *_KL_COLUMNS))


_KL_COLUMNS = ("_k", "_b", "_at", "_log_b", "_const", "_t", "_t_step", "_u", "_u_step")


def _vocabulary(ev: Ordered, symbol: str, baseline: int) -> Ordered:
    """The vocabulary so far (``_k``) and what the baseline says about each symbol and the session."""
    step = F.col(ev.order)
    counted = ev.per_value(symbol, _b=F.count(F.when(step <= baseline, 1)), _at=F.min(ev.order))
    log_b = F.log2(F.coalesce("_b", F.lit(0)) + 1.0)
    new = F.col("_at") == step
    return counted.with_columns(_log_b=log_b).running(
        _k=("count", F.when(F.col(symbol).isNotNull() & new, 1)),
        _const=("sum", F.when(new & (F.col("_b") > 0), F.col("_log_b"))))


def _kl_stages(ev: Ordered, symbol: str, window: int, baseline: int) -> tuple[int, list[dict[str, Framed]], list[str]]:
    """The reach, the stages and the helper columns of both windowed sums of the symbols after calibration.

    A symbol's count after calibration shares the window of its count, and the sum
    of logarithms changes by one term in and one out, in fixed point.
    """
    late = F.col(ev.order) > baseline
    back, stages, helpers = _sum_stages(window, {"_t": symbol}, it.smoothed_gain, only=late)
    log_b = F.when(late & F.col(symbol).isNotNull(), F.round(F.col("_log_b") * it.SCALE).cast("long")).otherwise(F.lit(0).cast("long"))
    recent = ({"_lb": lambda w: log_b},
              {"_u_step": lambda w: F.col("_lb") - F.coalesce(F.lag("_lb", window).over(w), F.lit(0))},
              {"_u": lambda w: F.sum("_u_step").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return back, _side_by_side(stages, recent), [*helpers, "_lb"]


def _kl_value(ev: Ordered, window: int, baseline: int) -> Column:
    step = F.col(ev.order)
    n = F.least(step - baseline, F.lit(window)) + F.col("_k")
    kl = (((F.col("_t") - F.col("_u")) / it.SCALE - F.col("_const")) / n
          + F.log2((F.col("_k") + baseline) / n))
    return F.when(step > baseline, it.stored(F.greatest(kl, F.lit(0.0)))).otherwise(0.0)


def carried_entropy(ev: Ordered, keep: Column, out: str, symbol: str = "symbol",
                    window: int = WINDOW) -> Ordered:
    """Entropy of the sub-stream ``keep``, carried forward over the other events.

    The sub-stream is measured on its own positions and joined back on the
    session and step, so both sides stay spread over the cluster.
    """
    sub = ev.substream(keep)
    measured = sliding_entropy(sub, symbol, window, "_e").df.select(
        *ev.keys, F.col(ev.order), "_e")
    joined = ev.on(ev.df.join(measured, [*ev.keys, ev.order], "left"))
    carried = joined.running(**{"_last": ("last", F.col("_e"))})
    return carried.on(carried.df.withColumn(
        out, F.coalesce("_last", F.lit(0.0))).drop("_last", "_e"))


def step_metrics(ev: Ordered, symbol: str = "symbol", compression: bool = True,
                 baseline: int = BASELINE) -> Ordered:
    """Entropy, pair information, surprisal, KL and compression of the action stream.

    All but compression share the vocabulary so far and one frame; a symbol's count in
    the window serves both its entropy and its surprisal.
    """
    back, pairs, pair_helpers = _pair_stages(symbol, WINDOW)
    reach, late, kl_helpers = _kl_stages(ev, symbol, WINDOW, baseline)
    framed = _vocabulary(ev, symbol, baseline).frame(max(back, reach), 0, *_side_by_side(pairs, late))
    n = F.least(F.col(ev.order), F.lit(WINDOW))
    out = framed.on(framed.df.withColumns({
        "action_entropy": it.stored(it.entropy_of_sum(F.col("_s"), n)),
        "action_mi": _pair_information(ev, WINDOW),
        "last_surprisal": it.stored(-F.log2(F.col("_in__s") / (n + F.col("_k")))),
        "kl_divergence": _kl_value(ev, WINDOW, baseline),
    }).drop(*pair_helpers, *kl_helpers, *_KL_COLUMNS, "_s", "_s_step", "_p", "_p_step", "_heads", "_pair"))
    return sliding_compression(out, symbol, out="compression_ratio") if compression else out


def stage_flow(ev: Ordered, stage: str = "stage", window: int = WINDOW) -> Ordered:
    """Pointwise information between adjacent processing stages over the last pairs."""
    framed = ev.frame(
        window, 0,
        {"_prev": lambda w: F.lag(stage).over(w)},
        {"_n": lambda w: F.count("_prev").over(w.rowsBetween(1 - window, 0))}
        | {f"_j{i}": _count_if((F.col("_prev") == a) & (F.col(stage) == b), window)
           for i, (a, b) in enumerate(ADJACENT_STAGES)}
        | {f"_a{i}": _count_if(F.col("_prev") == a, window) for i, (a, _) in enumerate(ADJACENT_STAGES)}
        | {f"_b{i}": _count_if(F.col("_prev").isNotNull() & (F.col(stage) == b), window)
           for i, (_, b) in enumerate(ADJACENT_STAGES)})
    cols = {}
    for i, (a, b) in enumerate(ADJACENT_STAGES):
        p = F.col(f"_j{i}") / F.col("_n")
        value = p * F.log2(F.col(f"_j{i}") * F.col("_n") / (F.col(f"_a{i}") * F.col(f"_b{i}")))
        cols[f"{a}_to_{b}"] = F.when(
            F.col(f"_j{i}") > 0, it.stored(F.greatest(value, F.lit(0.0)))).otherwise(0.0)
    helpers = [f"_{p}{i}" for p in "jab" for i in range(len(ADJACENT_STAGES))]
    return framed.on(framed.df.withColumns(cols).drop("_prev", "_n", *helpers))


def _count_if(cond: Column, window: int):
    return lambda w: F.count(F.when(cond, 1)).over(w.rowsBetween(1 - window, 0))


def feedback_action_mi(ev: Ordered, feedback: Column, feedback_symbol: Column, symbol: str = "symbol",
                       response: int = 5, window: int = 100, out: str = "feedback_action_mi") -> Ordered:
    """MI between feedback and the up to ``response`` actions that follow each one.

    A newer feedback event replaces the pending one. The value after the latest
    pair is carried forward; one pair alone gives 0.
    """
    action = F.when(~F.col("_fb"), 1)
    marked = ev.with_columns(_fb=feedback).running(
        _acts=("count", action),
        _fb_symbol=("last", F.when(feedback, feedback_symbol)))
    since = marked.running(_acts_at_fb=("last", F.when(F.col("_fb"), F.col("_acts"))))
    order_in_response = F.col("_acts") - F.col("_acts_at_fb")
    paired = ~F.col("_fb") & F.col("_fb_symbol").isNotNull() & (order_in_response <= response)
    base = since.on(since.df.withColumn("_pair", paired))
    pairs = window_sums(
        base.substream(F.col("_pair"), "_pair_no").with_columns(
            _joint=F.concat_ws("\u0001", "_fb_symbol", symbol)),
        window, {"_x": "_fb_symbol", "_y": symbol, "_xy": "_joint"})
    mi = it.stored(it.information_of_sums(
        F.col("_x"), F.col("_y"), F.col("_xy"), F.least(F.col("_pair_no"), F.lit(window))))
    values = pairs.df.select(*ev.keys, F.col(ev.order),
                             F.when(F.col("_pair_no") < 2, 0.0).otherwise(mi).alias("_mi"))
    joined = base.on(base.df.join(values, [*ev.keys, ev.order], "left")).running(
        _last=("last", F.col("_mi")))
    return joined.on(joined.df.withColumn(out, F.coalesce("_last", F.lit(0.0))).drop(
        "_fb", "_acts", "_fb_symbol", "_acts_at_fb", "_pair", "_mi", "_last"))


def memory_flow(ev: Ordered, is_write: Column, is_read: Column, resource: str, cap: int = 30) -> Ordered:
    """Consolidation and retrieval counts, capped, over all memory events so far.

    A read is a retrieval when the same resource was written earlier; that needs
    the first write per resource only, which is a small aggregate joined back.
    """
    base = ev.with_columns(_wr=is_write, _rd=is_read)
    first_write = base.df.where("_wr").groupBy(*ev.keys, resource).agg(F.min(ev.order).alias("_first"))
    known = base.on(base.df.join(first_write, [*ev.keys, resource], "left"))
    counted = known.running(
        _w=("count", F.when(F.col("_wr"), 1)),
        _r=("count", F.when(F.col("_rd") & (F.col("_first") < F.col(ev.order)), 1)),
        _n=("count", F.when(F.col("_wr") | F.col("_rd"), 1)))
    n = F.greatest(F.col("_n"), F.lit(1))
    return counted.on(counted.df.withColumns({
        "consolidation_rate": it.stored(F.least(F.col("_w"), F.lit(cap)) / n),
        "retrieval_rate": it.stored(F.least(F.col("_r"), F.lit(cap)) / n),
    }).drop("_wr", "_rd", "_first", "_w", "_r", "_n"))
