"""Per-session monitoring as a keyed stateful stream.

The state of a session is its windows and counters; it is removed at the session's
end marker or after a quiet time. Rows of one micro-batch are taken in time order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = ("session_id long, step long, symbol string, entropy double, mi double, surprisal double, phase long, "
          "z_entropy double, detection string, anomalies long, health string, ended boolean")
STATE = ("step long, symbols array<string>, vocabulary array<string>, n long, mean double, m2 double, phase long, "
         "last_class long, failures long, thinking long, fired array<string>, anomalies long")
EMPTY = (0, [], [], 0, 0.0, 0.0, 0, 0, 0, 0, [], 0)


def _entropy(values: list) -> float:
    n = len(values)
    return math.log2(n) - sum(c * math.log2(c) for c in Counter(values).values()) / n if n else 0.0


def _stored(x: float) -> float:
    return math.floor((max(x, 0.0) + 1e-12) * 1e4 + 0.5) / 1e4


def monitor(events: DataFrame, window: int = 50, calibration: int = 30, sensitivity: float = 2.0,
            cascade: int = 3, paralysis: int = 4, quiet: str | None = None) -> DataFrame:
    """Metrics, phase, z-score, first-time detections and health of each event.

    ``events`` has ``session_id, ts, event_id, symbol, class_rank, strong, success,
    thinks, ends``. Detections fire once per session, a cascade again at each new run.
    """
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (step, symbols, vocab, n, mean, m2, phase, last_class, failures, thinking, fired, anomalies) = (
            state.get if state.exists else EMPTY)
        symbols, known, fired = list(symbols), set(vocab), set(fired)
        pdf = pd.concat(batches).sort_values(["ts", "event_id"])
        out, ended = [], False
        for e in pdf.itertuples():
            step += 1
            known.add(e.symbol)
            symbols = [*symbols, e.symbol][-(window + 1):]
            recent = symbols[-window:]
            pairs = list(zip(symbols, symbols[1:]))
            entropy = _stored(_entropy(recent))
            mi = _stored(_entropy(symbols[:-1]) + _entropy(symbols[1:]) - _entropy(pairs)) if pairs else 0.0
            surprisal = _stored(-math.log2(recent.count(e.symbol) / (len(recent) + len(known))))
            if step == 1 or e.strong or e.class_rank == last_class:
                phase = e.class_rank
            last_class = e.class_rank
            z = None
            if n < calibration:
                n += 1
                gap = entropy - mean
                mean += gap / n
                m2 += gap * (entropy - mean)
            else:
                sd = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
                z = round(abs(entropy - mean) / sd, 2) if sd > 1e-10 else None
                anomalies += int(z is not None and z > sensitivity)
            failures = 0 if e.success else failures + 1
            thinking = thinking + 1 if e.thinks else 0
            found = None
            if failures == cascade:
                found = "error_cascade"
            elif thinking == paralysis and "analysis_paralysis" not in fired:
                found = "analysis_paralysis"
            if found:
                fired.add(found)
            rate = anomalies / step
            health = "green" if step < 10 or rate <= 0.05 else "yellow" if rate <= 0.15 else "red"
            ended = ended or bool(e.ends)
            out.append((key[0], step, e.symbol, entropy, mi, surprisal, phase, z, found, anomalies, health, bool(e.ends)))
        if ended:
            state.remove()
        else:
            state.update((step, symbols, sorted(known), n, mean, m2, int(phase), int(last_class), failures, thinking,
                          sorted(fired), anomalies))
            if quiet:
                state.setTimeoutDuration(quiet)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("session_id").applyInPandasWithState(
        advance, OUTPUT, STATE, "append", "ProcessingTimeTimeout" if quiet else "NoTimeout")


def monitor_input(events: DataFrame) -> DataFrame:
    """The columns ``monitor`` takes, from raw events of the given tables."""
    kind = F.col("event_type")
    rank = (F.when(kind == "view", 1).when(kind == "signup", 2).when(kind == "click", 3).when(kind == "error", 4).otherwise(5))
    return events.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", kind.alias("symbol"), rank.cast("long").alias("class_rank"),
        kind.isin("click", "error", "purchase").alias("strong"), (kind != "error").alias("success"),
        (kind == "signup").alias("thinks"), F.lit(False).alias("ends"))


def session_profile(events: DataFrame) -> DataFrame:
    """Running profile of each session; the same aggregate for tables and streams."""
    kind = F.col("event_type")
    return events.groupBy(F.col("user_id").alias("session_id")).agg(
        F.count("*").alias("events"), F.count(F.when(kind == "error", 1)).alias("errors"),
        F.size(F.collect_set("event_type")).cast("long").alias("types"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_sources(*streams: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Several event sources as one stream; events later than ``delay`` are dropped by what follows."""
    merged = streams[0]
    for s in streams[1:]:
        merged = merged.unionByName(s)
    return merged.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


COORDINATION = "resource long, kind string, agent long, other_agent long, step long, other_step long"


def coordinate(events: DataFrame, window: int = 20) -> DataFrame:
    """Signals and failures between agents, keyed by resource.

    ``events`` has ``resource, step, agent_id, is_read, is_write`` with a global step.
    The state is each agent's last read and write of the resource.
    """
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reads, writes = ({}, {})
        if state.exists:
            agents, r, w = state.get
            reads = {a: s for a, s in zip(agents, r) if s > 0}
            writes = {a: s for a, s in zip(agents, w) if s > 0}
        out = []
        for e in pd.concat(batches).sort_values("step").itertuples():
            others = lambda seen: [(a, s) for a, s in seen.items() if a != e.agent_id]
            if e.is_write:
                writes[e.agent_id] = e.step
                out += [(key[0], "race_condition", e.agent_id, a, e.step, s) for a, s in others(writes) if e.step - s <= window]
                out += [(key[0], "concurrent_modification" if e.step - s <= window else "stale_read", e.agent_id, a, e.step, s)
                        for a, s in others(reads)]
            elif e.is_read:
                reads[e.agent_id] = e.step
                out += [(key[0], "write_read", e.agent_id, a, e.step, s) for a, s in others(writes) if e.step - s <= window]
        agents = sorted(set(reads) | set(writes))
        state.update((agents, [reads.get(a, 0) for a in agents], [writes.get(a, 0) for a in agents]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COORDINATION.split(", ")])

    return events.groupBy("resource").applyInPandasWithState(
        advance, COORDINATION, "agents array<long>, reads array<long>, writes array<long>", "append", "NoTimeout")
