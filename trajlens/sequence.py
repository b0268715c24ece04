"""Ordered per-session computation that stays bounded per task.

An event table carries a dense 1-based position ``step`` within each session.
Sessions of ordinary length are handled with plain window functions, one session
per window partition. When the longest session is known to exceed
``chunk_rows``, the same operations run per (session, chunk of ``chunk_rows``
steps): bounded frames copy the few boundary rows they need into the neighbouring
chunk, and running aggregates add a carry taken from a per-chunk summary. No task
ever holds more than one chunk of one session. Summaries are written out before they
are joined back, so a chain of operations reads its table once per operation; a
summary left in the plan would double the plan with each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajlens.session import durable

CHUNK_ROWS = 200_000
CHUNK_SETTING = "spark.trajlens.chunkRows"
LONGEST_SETTING = "spark.trajlens.longestSession"

# A column over the session window, or (extra partition columns, column over that window).
Framed = Callable[[WindowSpec], Column] | tuple[tuple[str, ...], Callable[[WindowSpec], Column]]


def chunk_limit(df: DataFrame, given: int | None = None) -> int:
    """Rows of one session a task may hold: the argument, the session setting or the default."""
    return given or int(df.sparkSession.conf.get(CHUNK_SETTING, str(CHUNK_ROWS)))


def stated_longest(df: DataFrame) -> int | None:
    """The longest session a caller or a catalogue states, so that nothing has to be counted."""
    value = df.sparkSession.conf.get(LONGEST_SETTING, None)
    return int(value) if value else None


def longest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in the largest group and in total.

    Where ``spark.trajlens.longestSession`` states a bound, that is taken and no job
    runs. Else it is one aggregate with map-side combine, remembered for the session
    by plan and keys; the numbers choose how rows are dealt out and never change a result.
    """
    stated = stated_longest(df)
    if stated is not None:
        return stated, stated
    known = df.sparkSession.__dict__.setdefault("_trajlens_sizes", {})
    key = (df.semanticHash(), *keys)
    if key not in known:
        row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
        known[key] = int(row[0] or 0), int(row[1] or 0)
    return known[key]


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "step",
    chunk_rows: int | None = None,
) -> "Ordered":
    """Add the dense 1-based position of each row within its group.

    ``order`` must be a total order within a group. Groups are dealt to as many tasks
    as keep them at about ``chunk_rows`` rows each. Groups beyond ``chunk_rows``
    are numbered by a range sort over (keys, order): each range is counted, and
    a row's position is its rank in the range plus the rows in earlier ranges.
    The range assignment is written out first, so a lost executor cannot move a
    row to another range between the two passes.
    """
    chunk_rows = chunk_limit(df, chunk_rows)
    longest, total = longest_group(df, keys)
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if longest <= chunk_rows:
        if total > shuffle * chunk_rows:
            # More tasks, not larger ones; what follows per session keeps this layout.
            df = df.repartition(-(-total // chunk_rows), *keys)
        w = Window.partitionBy(*keys).orderBy(*order)
        return Ordered(df.withColumn(out, F.row_number().over(w).cast("long")),
                       tuple(keys), out, longest, chunk_rows)
    ranges = max(shuffle, -(-total // chunk_rows))
    placed = durable(
        df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
        .select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    numbered = (
        placed.withColumn("_rank", F.row_number().over(within))
        .join(offsets, [*keys, "_range"])
        .withColumn(out, (F.col("_rank") + F.col("_offset")).cast("long"))
        .drop("_rank", "_offset", "_range")
    )
    return Ordered(numbered, tuple(keys), out, longest, chunk_rows)


@dataclass(frozen=True)
class Ordered:
    """An event table, its session keys, its position column and the longest session."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str
    longest: int
    chunk_rows: int = CHUNK_ROWS
    # The same columns for the first steps of every session alone, where they were computed apart.
    early: DataFrame | None = None

    @staticmethod
    def of(df: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "step",
           chunk_rows: int | None = None) -> "Ordered":
        """Wrap a table whose ``order`` is already dense and 1-based; reads its maximum unless a bound is stated."""
        longest = stated_longest(df)
        if longest is None:
            longest = int(df.agg(F.max(order)).first()[0] or 0)
        return Ordered(df, tuple(keys), order, longest, chunk_limit(df, chunk_rows))

    @property
    def split(self) -> bool:
        return self.longest > self.chunk_rows

    def on(self, df: DataFrame) -> "Ordered":
        return replace(self, df=df, early=None)

    def first(self, steps: int) -> "Ordered":
        """The first ``steps`` steps of every session, as a table of sessions that short."""
        head = self.df.where(F.col(self.order) <= steps).drop("_chunk")
        return replace(self, df=head, longest=min(self.longest, steps), early=None)

    def with_columns(self, **cols: Column) -> "Ordered":
        return self.on(self.df.withColumns(cols))

    def select(self, *cols: str | Column) -> "Ordered":
        kept = [*self.keys, self.order]
        if "_chunk" in self.df.columns:
            kept.append("_chunk")
        extra = [c for c in cols if not (isinstance(c, str) and c in kept)]
        return self.on(self.df.select(*kept, *extra))

    def result(self) -> DataFrame:
        return self.df.drop("_chunk")

    def _home(self) -> Column:
        return F.expr(f"({self.order} - 1) div {self.chunk_rows}")

    def chunked(self) -> DataFrame:
        """The table with its ``_chunk`` number (a single chunk when nothing is split)."""
        if "_chunk" in self.df.columns:
            return self.df
        return self.df.withColumn("_chunk", self._home())

    def frame(self, back: int, ahead: int, *stages: dict[str, Framed]) -> "Ordered":
        """Columns over frames reaching at most ``back`` rows back and ``ahead`` forward.

        Each stage may use the columns of the stages before it; ``back`` and
        ``ahead`` must cover the sum of what the stages reach.
        """
        def apply(df: DataFrame, keys: Sequence[str]) -> DataFrame:
            for stage in stages:
                cols = {}
                for name, make in stage.items():
                    extra, fn = make if isinstance(make, tuple) else ((), make)
                    cols[name] = fn(Window.partitionBy(*keys, *extra).orderBy(self.order))
                df = df.withColumns(cols)
            return df

        if not self.split:
            return self.on(apply(self.df, self.keys))
        size = self.chunk_rows
        pos = F.expr(f"({self.order} - 1) % {size}")
        home = F.col("_home")
        targets = [home]
        for i in range(1, -(-back // size) + 1):
            targets.append(F.when(pos >= i * size - back, home + i))
        for i in range(1, -(-ahead // size) + 1):
            targets.append(F.when((pos < ahead - (i - 1) * size) & (home >= i), home - i))
        copies = F.filter(F.array(*targets), lambda c: c.isNotNull())
        df = (
            self.df.drop("_chunk").withColumn("_home", self._home())
            .withColumn("_chunk", F.explode(copies))
        )
        df = apply(df, [*self.keys, "_chunk"])
        return self.on(df.where(F.col("_chunk") == F.col("_home")).drop("_home"))

    def running(self, exclusive: bool = False, reverse: bool = False, **specs: tuple[str, Column]) -> "Ordered":
        """Running aggregates from the first row of the session, or back from the last one.

        Each spec is ``(kind, column)``; kinds are ``sum``, ``count`` (of non-null
        values), ``max``, ``min`` and ``last`` (non-null). ``exclusive`` leaves out the
        current row.
        In reverse, ``last`` is the next value that follows.
        """
        end = -1 if exclusive else 0

        def along(column: str) -> Column:
            return F.desc(column) if reverse else F.asc(column)

        if not self.split:
            w = (Window.partitionBy(*self.keys).orderBy(along(self.order))
                 .rowsBetween(Window.unboundedPreceding, end))
            return self.on(self.df.withColumns(
                {name: _windowed(kind, col, w) for name, (kind, col) in specs.items()}))
        df = self.chunked().withColumns({f"_v_{n}": c for n, (_, c) in specs.items()})
        w = (Window.partitionBy(*self.keys, "_chunk").orderBy(along(self.order))
             .rowsBetween(Window.unboundedPreceding, end))
        local = df.withColumns(
            {f"_l_{n}": _windowed(k, F.col(f"_v_{n}"), w) for n, (k, _) in specs.items()})
        sums = df.groupBy(*self.keys, "_chunk").agg(
            *[_grouped(k, F.col(f"_v_{n}"), -F.col(self.order) if reverse else F.col(self.order)).alias(f"_s_{n}")
              for n, (k, _) in specs.items()])
        earlier = (Window.partitionBy(*self.keys).orderBy(along("_chunk"))
                   .rowsBetween(Window.unboundedPreceding, -1))
        carry = durable(sums).select(*self.keys, "_chunk", *[
            _carried(k, F.col(f"_s_{n}"), earlier).alias(f"_c_{n}")
            for n, (k, _) in specs.items()])
        joined = local.join(carry, [*self.keys, "_chunk"], "left")
        out = joined.withColumns({
            n: _combined(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in specs.items()})
        drop = [f"_{p}_{n}" for n in specs for p in "vlc"]
        return self.on(out.drop(*drop))

    def kept(self) -> "Ordered":
        """A split table written out, for callers that read it more than once."""
        return self.on(durable(self.df)) if self.split else self

    def totals(self, *, upto: int | None = None, **aggs: Column) -> "Ordered":
        """Session-wide aggregates repeated on every row of the session.

        A split table gets them from a two-level aggregation joined per chunk, so
        that the join keys stay balanced. Where the aggregates use the first ``upto``
        steps only, they are taken from ``early`` or, without that, from the chunks
        that hold these steps.
        """
        if not self.split:
            w = Window.partitionBy(*self.keys)
            return self.on(self.df.withColumns({n: a.over(w) for n, a in aggs.items()}))
        df = self.chunked()
        if upto is None:
            used = df
        elif self.early is not None:
            used = self.early
        else:
            used = df.where(F.col("_chunk") <= (upto - 1) // self.chunk_rows)
        per_session = used.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])
        chunks = df.select(*self.keys, "_chunk").distinct()
        per_chunk = durable(chunks.join(per_session, list(self.keys)))
        return self.on(df.join(per_chunk, [*self.keys, "_chunk"]))

    def substream(self, keep: Column, rank: str = "sub_step") -> "Ordered":
        """The rows matching ``keep`` with a dense position of their own."""
        kept = self.running(**{rank: ("count", F.when(keep, 1))})
        df = kept.df.where(keep).drop("_chunk")
        return replace(self, df=df, order=rank, early=None)

    def islands(self, *values: str, run: str = "run_id", start: str = "run_start") -> "Ordered":
        """Number the runs of identical ``values`` and note the step each run starts at."""
        def changed(w: WindowSpec) -> Column:
            same = F.lit(True)
            for v in values:
                same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
            return F.when((F.col(self.order) > 1) & same, 0).otherwise(1)

        marked = self.frame(1, 0, {"_changed": changed})
        numbered = marked.running(**{
            run: ("sum", F.col("_changed")),
            start: ("max", F.when(F.col("_changed") == 1, F.col(self.order))),
        })
        return numbered.on(numbered.df.drop("_changed"))

    def per_value(self, value: str, **aggs: Column) -> "Ordered":
        """Aggregates over all rows of the session that share ``value``.

        A split table takes them from a two-level aggregation joined back on
        (session, value), which adaptive skew handling can divide further.
        """
        if not self.split:
            w = Window.partitionBy(*self.keys, value)
            return self.on(self.df.withColumns({n: a.over(w) for n, a in aggs.items()}))
        grouped = (self.df.where(F.col(value).isNotNull()).groupBy(*self.keys, value)
                   .agg(*[a.alias(n) for n, a in aggs.items()]))
        return self.on(self.df.join(durable(grouped), [*self.keys, value], "left"))

    def distinct_so_far(self, value: str, out: str) -> "Ordered":
        """Number of different ``value``s seen up to and including each row."""
        known = self.per_value(value, _first=F.min(self.order))
        new = F.col(value).isNotNull() & (F.col("_first") == F.col(self.order))
        counted = known.running(**{out: ("count", F.when(new, 1))})
        return counted.on(counted.df.drop("_first"))


def _windowed(kind: str, col: Column, w: WindowSpec) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(col).over(w), F.lit(0))
    if kind == "last":
        return F.last(col, ignorenulls=True).over(w)
    return {"count": F.count, "max": F.max, "min": F.min}[kind](col).over(w)


def _grouped(kind: str, col: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(col, F.when(col.isNotNull(), order))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](col)


def _carried(kind: str, col: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(w)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind](col).over(w)


def _combined(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carry, F.lit(0)) + local
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)
