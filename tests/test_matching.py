"""Pairs of two agents' actions against two literal queues."""

import math
import random
from collections import Counter, deque

import pytest

from trajlens.operators import matching as ma
from trajlens.sequence import Ordered


def _two_queues(events, gap, size):
    """The rule with both queues spelled out, and the information of the last 100 pairs after each."""
    waiting, pairs, last = (deque(maxlen=size), deque(maxlen=size)), [], deque(maxlen=100)
    for side, symbol, step in events:
        waiting[side].append((symbol, step))
        while waiting[0] and waiting[1]:
            (a, at_a), (b, at_b) = waiting[0][0], waiting[1][0]
            if abs(at_a - at_b) <= gap:
                waiting[0].popleft(), waiting[1].popleft()
                last.append((a, b))
                n = len(last)
                h = lambda xs: -sum(c / n * math.log2(c / n) for c in Counter(xs).values())
                mi = h([x for x, _ in last]) + h([y for _, y in last]) - h(last)
                pairs.append((a, at_a, b, at_b, max(mi, 0.0)))
            else:
                waiting[0 if at_a < at_b else 1].popleft()
    return pairs


@pytest.mark.parametrize("chunk_rows", [None, 7])
def test_pairs_and_information_equal_two_queues(spark, chunk_rows):
    rnd = random.Random(5)
    rows, step = [], 0
    for session in ("x", "y"):
        step = 0
        for _ in range(500):
            step += rnd.choice([1, 1, 1, 1, 2, 9, 30])
            # Long stretches of one agent, so that queues fill.
            agent = rnd.choice(["a", "b", "c"]) if step % 300 > 90 else "a"
            rows.append((session, step, agent if rnd.random() < 0.98 else None, f"s{rnd.randint(0, 3)}"))
    frame = spark.createDataFrame(rows, "session_id string, step long, agent_id string, symbol string").repartition(3)
    ev = Ordered.of(frame, chunk_rows=chunk_rows)
    pairs = ma.matched_pairs(ev, gap=12, pending=5)
    got = {}
    for r in ma.shared_information(pairs, ["session_id"], chunk_rows=chunk_rows).result().collect():
        got.setdefault((r.session_id, r.agent_a, r.agent_b), {})[r.pair_no] = (r.symbol_a, r.step_a, r.symbol_b, r.step_b, r.information)
    for session in ("x", "y"):
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            events = [(0 if g == a else 1, s, at) for name, at, g, s in rows if name == session and g in (a, b)]
            want = _two_queues(sorted(events, key=lambda e: e[2]), 12, 5)
            mine = got[session, a, b]
            assert len(mine) == len(want) > 50
            for k, w in enumerate(want):
                assert mine[k + 1][:4] == w[:4] and abs(mine[k + 1][4] - w[4]) <= 6e-5


def test_one_agent_makes_no_pair(spark):
    ev = Ordered.of(spark.createDataFrame([("s", k, "a", "x") for k in range(1, 9)], "session_id string, step long, agent_id string, symbol string"))
    assert ma.matched_pairs(ev).collect() == [] and ma.matched_pairs(ev.on(ev.df.where("false"))).collect() == []
