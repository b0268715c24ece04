"""Known answers of single operators on small hand-made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trajlens.functions import infotheory as it
from trajlens.functions import text as tx
from trajlens.operators import agreement as ag
from trajlens.operators import detectors as dt
from trajlens.operators import evaluation as ev
from trajlens.operators import phases as ph
from trajlens.operators import sessions as ss
from trajlens.operators import trajectories as tj
from trajlens.sequence import Ordered


def one(df, *cols):
    row = df.collect()[0]
    return tuple(row[c] for c in cols)


@pytest.mark.parametrize("log,want", [("8 passed, 2 failed", 0.8), ("3 passed", 1.0), ("5 failed", 0.0),
                                      ("2 passed, 1 failed, 1 error", 0.5), ("none", None), ("", None), ("0 passed", None)])
def test_passed_share(spark, log, want):
    got = spark.range(1).select(tx.passed_share(F.lit(log)).alias("g")).first()["g"]
    assert got == want


def brute_lz(seq):
    n, i, phrases = len(seq), 0, 0
    if n < 20:
        return 1.0
    while i < n:
        size = 1
        while i + size <= n and any(seq[j:j + size] == seq[i:i + size] for j in range(i) if j + size <= i):
            size += 1
        phrases, i = phrases + 1, i + max(size - 1, 1)
    k = len(set(seq))
    return 0.0 if k < 2 else min(phrases / max(n / math.log2(k), 1.0), 1.0)


def test_compression_against_brute_force(spark):
    rng = random.Random(1)
    seqs = [[rng.choice(["x", "yy", "z"][: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 150))] for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s array<string>")
    got = {r["i"]: r["v"] for r in df.select("i", it.lz_ratio(it.packed(F.col("s"))).alias("v")).collect()}
    for i, s in enumerate(seqs):
        assert got[i] == pytest.approx(brute_lz(s))


def test_entropy(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (list("abcd"),)], "s array<string>")
    assert [round(r[0], 6) for r in df.select(it.entropy(F.col("s"))).collect()] == [0.0, 0.0, 1.0, 2.0]


def phases_of(spark, events):
    rows = [(1, i, t, tool) for i, (t, tool) in enumerate(events, 1)]
    ordered = Ordered.of(spark.createDataFrame(rows, "session_id long, step long, type string, tool string"))
    return [r["phase_rank"] for r in ph.phase_machine(ordered).df.orderBy("step").collect()]


def step_by_step(classes):
    """The machine event by event: pending phase, two in a row, strong events."""
    current, pending, count, out = 0, None, 0, []
    for n, (c, strong) in enumerate(classes, 1):
        if c != current:
            if strong:
                current, pending, count = c, None, 0
            elif c == pending:
                count += 1
                if count >= 2:
                    current, pending, count = c, None, 0
            else:
                pending, count = c, 1
        else:
            pending, count = None, 0
        if current == 0 and n == 1:
            current = c
        out.append(current)
    return out


def test_phase_machine_against_fold(spark):
    rng = random.Random(3)
    kinds = {"read_file": (1, False), "pytest": (4, True), "edit_file": (3, True), "run_code": (3, False), "summarize": (5, False), "lint": (4, False)}
    tools = [rng.choice(list(kinds)) for _ in range(200)]
    assert phases_of(spark, [("tool_call", t) for t in tools]) == step_by_step([kinds[t] for t in tools])


def test_phase_machine_words(spark):
    assert phases_of(spark, [("reasoning", None), ("tool_call", "widget"), ("tool_call", "latest")]) == [2, 2, 2]


def turns(spark, texts):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(texts, 1)]
    return Ordered.of(spark.createDataFrame(rows, "session_id long, turn long, role string, text string"), order="turn")


def act(line, said="ok"):
    return ("ai", f"{said}\n```\n{line}\n```")


def test_awareness(spark):
    seen = tj.awareness(tj.actions(turns(spark, [act("open a.py"), act("create a.py"), act("pytest x"), act("submit")])))
    assert one(seen, "coverage", "blind_edit_rate", "verify_before_submit") == (1.0, 0.0, 1)
    blind = tj.awareness(tj.actions(turns(spark, [act("create a.py"), act("submit")])))
    assert one(blind, "coverage", "blind_edit_rate", "verify_before_submit") == (0.0, 0.5, 0)


def test_error_recovery(spark):
    start = [("user", "issue"), act("open a.py")]
    fixed = tj.error_recovery(turns(spark, start + [("user", "Traceback: bad"), act("edit a.py"), ("user", "fine")]))
    assert one(fixed, "episodes", "strategy_change_rate", "recovery_rate", "terminal_unresolved") == (1, 1.0, 1.0, 0)
    again = tj.error_recovery(turns(spark, start + [("user", "error"), act("open a.py"), ("user", "error")]))
    assert one(again, "episodes", "recurrence_rate", "strategy_change_rate", "terminal_unresolved") == (2, 0.5, 0.0, 1)


def test_coherence(spark):
    out = tj.coherence(turns(spark, [act("open foo.py", "I will read foo"), act("edit bar.py", "let us rest")]))
    assert one(out, "mean", "min", "final", "verb_align_rate", "target_match_rate") == (0.5, 0.0, 0.0, 0.5, 0.5)


def test_actions_take_the_last_block(spark):
    got = tj.actions(turns(spark, [("ai", "```\nls\n```\nthen\n```python\nopen 'a b.py' 3\n```"), ("ai", "no block"), ("user", "x")])).df.collect()
    assert [(r["tool_name"], r["target_path"], r["event_type"]) for r in got] == [("open", "a b.py", "file_read")]


def test_kappa_and_alpha(spark):
    pairs = [(a, b) for a, b in [(1, 1), (2, 2), (3, 3), (1, 2), (3, 2), (2, 2)]]
    df = spark.createDataFrame(pairs, "a int, b int")
    po = sum(a == b for a, b in pairs) / 6
    pe = sum((sum(a == v for a, _ in pairs) / 6) * (sum(b == v for _, b in pairs) / 6) for v in (1, 2, 3))
    assert one(ag.cohens_kappa(df, [], "a", "b"), "kappa")[0] == pytest.approx((po - pe) / (1 - pe), abs=1e-6)
    num = sum(abs(a - b) for a, b in pairs) / 6
    den = sum(abs(a - b) for a, _ in pairs for _, b in pairs) / 36
    assert one(ag.cohens_kappa(df, [], "a", "b", linear=True), "kappa")[0] == pytest.approx(1 - num / den, abs=1e-6)
    same = spark.createDataFrame([("x", 1, v) for v in (1, 1)] + [("x", 2, v) for v in (2, 2)], "g string, item int, value int")
    assert one(ag.krippendorff_alpha(same, ["g"], "item", "value"), "alpha")[0] == 1.0


@pytest.mark.parametrize("y,want", [([1, 8, 27, 64], 1.0), ([4, 3, 2, 1], -1.0)])
def test_spearman(spark, y, want):
    df = spark.createDataFrame([(i, float(i), float(v)) for i, v in enumerate(y)], "id int, x double, y double")
    assert one(ag.spearman(df, [], "x", "y", "id"), "rho")[0] == pytest.approx(want)


def test_matching(spark):
    det = spark.createDataFrame([("s1", "stall", 0.9, 10), ("s1", "stall", 0.5, 3), ("s2", "stall", 0.8, 40), ("s3", "loop", 0.7, 5)],
                                "session_id string, failure string, confidence double, step long")
    tru = spark.createDataFrame([("s1", "stall", 12, False), ("s2", "stall", 5, False), ("s4", "stall", 0, False), ("s5", "loop", 1, True)],
                                "session_id string, failure string, onset_step long, is_latent boolean")
    got = {(r["session_id"], r["failure"]): (r["match_type"], r["tp_weight"]) for r in ev.match(det, tru).collect()}
    assert got == {("s1", "stall"): ("full", 1.0), ("s2", "stall"): ("partial", 0.5), ("s3", "loop"): ("fp", 0.0), ("s4", "stall"): ("fn", 0.0)}


def trace(spark, rows):
    cols = "session_id long, step long, type string, tool string, input_hash string, output_hash string, success boolean, goal_text string, latency_ms double, tokens_in long, tokens_out long"
    return Ordered.of(spark.createDataFrame([(1, i, *r, 100.0, 1, 1) for i, r in enumerate(rows, 1)], cols))


def test_error_cascade_and_context_loss(spark):
    bad = [("tool_call", "bash", "i", f"o{i}", i not in (3, 4, 5), None) for i in range(10)]
    assert one(dt.error_cascade(trace(spark, bad)), "longest_chain", "chain_start_step", "at_step") == (3, 4, 6)
    read = ("tool_call", "read_file", "i", "same", True, None)
    work = [("tool_call", "bash", "i", f"o{i}", True, None) for i in range(6)]
    assert one(dt.context_loss(trace(spark, [read, *work, read])), "intervening_operations", "at_step") == (6, 8)
    asked = [read, *work[:3], ("user_input", None, None, None, True, "go on"), *work[3:], read]
    assert dt.context_loss(trace(spark, asked)).count() == 0


def test_session_signals(spark):
    call = lambda h, ok=True: ("tool_call", "Bash", h, "o", ok, None)
    rows = [("user_input", None, None, None, True, "please start"), call("a"), call("a"), call("a", False), call("a"),
            ("user_input", None, None, None, True, "thanks, looks good")]
    got = one(ss.signals(trace(spark, rows)), "literal_loop_max", "error_retry_cycles", "user_messages", "resolution", "abandoned")
    assert got == (4, 1, 2, "positive", False)


def test_reprompts_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    msgs = [(s, t, " ".join(rng.sample(vocab, rng.randrange(2, 7)))) for s in range(4) for t in range(25)]
    def sim(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b)
    want = {(s, t) for s, t, m in msgs if any(s2 == s and t2 < t and sim(m, m2) >= 0.6 for s2, t2, m2 in msgs)}
    df = spark.createDataFrame(msgs, "session_id int, turn int, text string")
    assert {(r["session_id"], r["turn"]) for r in ss.reprompts(df, "turn").collect()} == want
