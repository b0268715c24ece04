"""Pairs of two agents' actions, matched first come first served, and the information they share.

The actions of two agents wait in two queues. A new action drops what the other
agent did more than ``gap`` steps ago, is paired with the oldest action left,
or waits itself. After each action one queue is empty, so the state of a stream
is one bounded queue.

A long stream is cut into chunks that are matched at the same time. Each begins
with the queue that the chunk before it left; as long as that changes, the chunk
is matched again. Streams forget within a few steps, so that is seldom, and what
a task holds is a chunk and a queue.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.functions import infotheory as it
from trajlens.operators.metrics import window_sums
from trajlens.sequence import Ordered, number_rows
from trajlens.session import durable

_QUEUE = "array<struct<side: int, symbol: string, step: bigint>>"
_QUEUE_TYPE = pa.list_(pa.struct([("side", pa.int32()), ("symbol", pa.string()), ("step", pa.int64())]))
_PAIR = [("pair_step", pa.int64()), ("symbol_a", pa.string()), ("step_a", pa.int64()), ("symbol_b", pa.string()), ("step_b", pa.int64())]


def match(events: list[tuple[int, str, int]], queue: list[tuple[int, str, int]], gap: int, pending: int):
    """Pairs ``(step, symbol a, step a, symbol b, step b)`` of events ``(side, symbol, step)`` in order, and the queue that is left."""
    queue, pairs = list(queue), []
    for event in events:
        side, symbol, step = event
        if queue and queue[0][0] != side:
            fresh = next((k for k, e in enumerate(queue) if step - e[2] <= gap), len(queue))
            queue = queue[fresh:]
            if queue:
                other = queue.pop(0)
                a, b = (event, other) if side == 0 else (other, event)
                pairs.append((step, a[1], a[2], b[1], b[2]))
                continue
        queue.append(event)
        del queue[:-pending]
    return pairs, queue


def pair_streams(ev: Ordered, agent: str = "agent_id", symbol: str = "symbol") -> Ordered:
    """Each pair of a session's agents with the actions of both, numbered: ``agent_a, agent_b, side, symbol, step, place``."""
    keys = list(ev.keys)
    ev = ev.select(agent, symbol).kept()
    actions = ev.df.select(*keys, F.col(agent).alias("_agent"), F.col(symbol).cast("string").alias("symbol"), F.col(ev.order).cast("long").alias("step"))
    agents = actions.where("_agent IS NOT NULL").select(*keys, F.col("_agent").alias("_other")).distinct()
    both = actions.join(agents, keys).where(F.col("_agent") != F.col("_other")).select(
        *keys, F.least("_agent", "_other").alias("agent_a"), F.greatest("_agent", "_other").alias("agent_b"),
        F.when(F.col("_agent") < F.col("_other"), 0).otherwise(1).alias("side"), "symbol", "step")
    return number_rows(both, [*keys, "agent_a", "agent_b"], ["step", "side", "symbol"], "place", ev.chunk_rows)


def matched_pairs(ev: Ordered, gap: int = 10, pending: int = 50, agent: str = "agent_id", symbol: str = "symbol") -> DataFrame:
    """``keys, agent_a, agent_b, pair_step, symbol_a, step_a, symbol_b, step_b``: one row per pair of actions at most ``gap`` steps apart.

    ``pair_step`` is the step of the later action, at which the pair is made. An
    agent's oldest waiting action is dropped when ``pending`` others wait. All
    agents of a session are known from its start; actions without an agent take
    no part.
    """
    streams = pair_streams(ev, agent, symbol)
    keys = list(streams.keys)
    fields = [f for f in streams.df.schema.fields if f.name in keys]
    of_keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    rows = streams.chunked().select(*keys, "_chunk", "place", "side", "symbol", "step", F.lit(None).cast(_QUEUE).alias("queue"))

    def run(rows: pa.Table):
        rows = rows.sort_by("place")
        queue, events = [], []
        for side, name, step, waiting in zip(*(rows.column(c).to_pylist() for c in ("side", "symbol", "step", "queue"))):
            if waiting is None:
                events.append((side, name, step))
            else:
                queue = [(w["side"], w["symbol"], w["step"]) for w in waiting]
        return match(events, queue, gap, pending)

    def own(rows: pa.Table, n: int) -> list[pa.Array]:
        return [pa.repeat(rows.column(k)[0], n) for k in keys]

    def pairs(rows: pa.Table) -> pa.Table:
        found, _ = run(rows)
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*found) if found else [[]] * 5, _PAIR)]
        return pa.table([*own(rows, len(found)), *columns], names=[*keys, *(n for n, _ in _PAIR)])

    def left(rows: pa.Table) -> pa.Table:
        _, queue = run(rows)
        waiting = pa.array([[dict(zip(("side", "symbol", "step"), e)) for e in queue]], _QUEUE_TYPE)
        return pa.table([*own(rows, 1), rows.column("_chunk")[:1].combine_chunks(), waiting], names=[*keys, "_chunk", "queue"])

    pair_ddl = f"{of_keys}, pair_step long, symbol_a string, step_a long, symbol_b string, step_b long"
    if not streams.split:
        return rows.groupBy(*keys).applyInArrow(pairs, pair_ddl)
    rows = durable(rows)
    by = [*keys, "_chunk"]

    def begin(queues: DataFrame) -> DataFrame:
        """A row before each chunk with the queue it begins with."""
        return queues.select(*by, F.lit(0).cast("long").alias("place"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("string").alias("symbol"),
                             F.lit(None).cast("long").alias("step"), "queue")

    before = Window.partitionBy(*keys).orderBy("_chunk")
    empty = F.array().cast(_QUEUE)
    known = rows.select(*by).distinct().withColumn("queue", empty)
    ends = durable(rows.groupBy(*by).applyInArrow(left, f"{of_keys}, _chunk long, queue {_QUEUE}"))
    while True:
        begins = durable(ends.withColumn("queue", F.coalesce(F.lag("queue").over(before), empty)))
        changed = begins.alias("b").join(known.alias("k"), by).where(F.to_json("b.queue") != F.to_json("k.queue")).select(*by, F.col("b.queue").alias("queue"))
        changed = durable(changed)
        known = begins
        if changed.isEmpty():
            break
        again = rows.join(changed.select(*by), by, "left_semi").unionByName(begin(changed))
        ended = again.groupBy(*by).applyInArrow(left, f"{of_keys}, _chunk long, queue {_QUEUE}")
        ends = durable(ends.join(changed.select(*by), by, "left_anti").unionByName(ended))
    # Written out: numbering the pairs reads them several times, and should not match them again.
    return durable(rows.unionByName(begin(known)).groupBy(*by).applyInArrow(pairs, pair_ddl))


def shared_information(pairs: DataFrame, keys: list[str], window: int = 100, chunk_rows: int | None = None) -> Ordered:
    """The pairs in order (``pair_no``) with ``information``: that of the last ``window`` pairs of the two agents."""
    numbered = number_rows(pairs, [*keys, "agent_a", "agent_b"], ["pair_step"], "pair_no", chunk_rows)
    summed = window_sums(numbered.with_columns(_both=F.concat_ws("\u0001", "symbol_a", "symbol_b")), window, {"_a": "symbol_a", "_b": "symbol_b", "_p": "_both"})
    n = F.least(F.col("pair_no"), F.lit(window))
    value = it.stored(it.information_of_sums(F.col("_a"), F.col("_b"), F.col("_p"), n))
    return summed.on(summed.df.withColumn("information", value).drop("_a", "_b", "_p", "_a_step", "_b_step", "_p_step", "_both"))


def information_edges(history: Ordered, window: int = 100) -> DataFrame:
    """``agent_a, agent_b, pairs, information`` of each two agents at the end: the pairs in the window and what they share."""
    return history.df.groupBy(*history.keys).agg(F.least(F.max("pair_no"), F.lit(window)).cast("long").alias("pairs"),
                                                 F.max_by("information", "pair_no").alias("information"))
