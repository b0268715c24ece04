"""Events of several sources in the order they happened, however they arrive.

An event is held until the watermark has passed its time; nothing earlier can
then come any more, so it leaves with its final place in the session. Sessions
are dealt into a fixed number of buckets, and a state key is a bucket: what a
micro-batch costs besides its rows does not grow with the number of sessions. A
bucket holds what its sessions receive within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State keys of a stream; part of its state, so a stream that goes on needs the number it began with.
BUCKETS = 4096


class _InOrder(StatefulProcessor):
    """Holds rows ``(key, at_micros, ...)`` of a bucket and lets them go by ``(at_micros, order)`` once the watermark is past them.

    The rows of a call are one Arrow value of the state, and a bucket has one
    timer, at its earliest row.
    """

    def __init__(self, held: T.StructType, key: str, order: list[str]):
        self.schema = to_arrow_schema(held, timestamp_utc=False)
        self.counts = pa.schema([self.schema.field(key), pa.field("step", pa.int64())])
        self.key = key
        self.sorting = [(c, "ascending") for c in (key, "at_micros", *order)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = T.StructType([T.StructField("rows", T.BinaryType())])
        self.handle = handle
        self.held = handle.getListState("held", one)
        self.last = handle.getValueState("last", one)
        self.wake = handle.getValueState("wake", T.StructType([T.StructField("ms", T.LongType())]))

    def _wake(self, rows: pa.Table) -> None:
        at = int(rows["at_micros"].to_numpy().min()) // 1000 + 1
        known = self.wake.get()[0] if self.wake.exists() else None
        if known is not None and known <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(pdf[self.schema.names], schema=self.schema, preserve_index=False, safe=False) for pdf in rows if len(pdf)]
        if new:
            whole = pa.concat_tables(new)
            self.held.appendList([(_packed(whole),)])
            self._wake(whole)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        held = [_unpacked(r[0]) for r in self.held.get()] if self.held.exists() else []
        if not held:
            return iter([])
        whole = pa.concat_tables(held)
        gone = whole["at_micros"].to_numpy() < passed
        later = whole.filter(pa.array(~gone))
        if len(later):
            self.held.put([(_packed(later),)])
            self._wake(later)
        else:
            self.held.clear()
        ready = whole.filter(pa.array(gone))
        if not len(ready):
            return iter([])
        ready = ready.take(pa.compute.sort_indices(ready, sort_keys=self.sorting, null_placement="at_start"))
        return iter([ready.append_column("step", pa.array(self._placed(ready[self.key]))).to_pandas(integer_object_nulls=True)])

    def _placed(self, keys: pa.ChunkedArray) -> np.ndarray:
        """The step of each row of sorted keys, counted on from the last ones, which it stores."""
        coded = keys.combine_chunks().dictionary_encode()
        sessions = coded.dictionary.to_pylist()
        known = _unpacked(self.last.get()[0]) if self.last.exists() else self.counts.empty_table()
        steps = dict(zip(known[self.key].to_pylist(), known["step"].to_pylist()))
        code = coded.indices.to_numpy()
        sizes = np.bincount(code, minlength=len(sessions))
        before = np.array([steps.get(s, 0) for s in sessions], np.int64)
        steps.update(zip(sessions, (before + sizes).tolist()))
        self.last.update((_packed(pa.table([list(steps), list(steps.values())], schema=self.counts)),))
        return (np.arange(len(code)) - (np.cumsum(sizes) - sizes)[code] + before[code] + 1).astype(np.int64)

    def close(self) -> None:
        pass


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def in_order(*sources: DataFrame, key: str = "session_id", time: str = "ts", order: tuple[str, ...] = ("event_id",), delay: str = "10 minutes",
             buckets: int = BUCKETS) -> DataFrame:
    """The sources' rows as one stream with ``step``: the place of each in its key by time, then ``order``.

    Rows leave when the watermark, ``delay`` behind the latest time seen, has
    passed them. Rows that arrive later than that are dropped, as Spark does for
    every stateful step. Rows without a key or a time have no place and are
    dropped. A stream that stops leaves its last ``delay`` in the state until it
    goes on. All sources need the same columns. Sessions share ``buckets`` state
    keys, so a task holds the late rows of one bucket at a time.
    """
    merged = sources[0]
    for s in sources[1:]:
        merged = merged.unionByName(s)
    spark = merged.sparkSession
    spark.conf.set(STORE, ROCKS)
    own = [f for f in merged.schema.fields if f.name not in (key, time)]
    stamped = merged.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    rows = stamped.withColumns({"at_micros": F.unix_micros(time), "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets))})
    held = T.StructType([merged.schema[key], T.StructField("at_micros", T.LongType()), *(T.StructField(f.name, f.dataType) for f in own)])
    out = T.StructType([*held.fields, T.StructField("step", T.LongType())])
    placed = rows.groupBy("_bucket").transformWithStateInPandas(_InOrder(held, key, list(order)), out, "append", "EventTime")
    return placed.withColumn(time, F.timestamp_micros("at_micros")).select(key, time, *[f.name for f in own], "step")
