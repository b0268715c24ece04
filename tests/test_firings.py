"""First firings against the rules run on every prefix, as if each were a session of its own."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trajlens.operators import detectors as dt
from trajlens.operators import firings as fr
from trajlens.sequence import Ordered

EVENT = "session_id string, step long, type string, tool string, input_hash string, output_hash string, success boolean, goal_text string, latency_ms double, tokens_out long"
LOOSE = {"analysis": 2, "rate": 0.4, "executing": 4, "look": (3, 4), "min_intervening": 2, "stall": {"floor_ms": 300.0}}


def _session(rnd, name):
    rows, tools = [], rnd.choice([["read_file", "bash", "edit_file", "commit", "grep", "pytest"], ["bash", "commit", "commit", "edit_file"],
                                 ["read_file", "read_file", "bash", "edit_file"]])
    for step in range(1, rnd.randint(12, 34)):
        kind = rnd.choices(["tool_call", "reasoning", "user_input", "planning"], [12, 4, 1, 1])[0]
        tool = rnd.choice(tools) if kind == "tool_call" else None
        text = rnd.choice(["I will read it", "let me test it", "write now", "", None]) if kind in ("reasoning", "planning") else (
            rnd.choice(["next please", "it works", None]) if kind == "user_input" else None)
        latency = rnd.choice([60.0, 80.0, 100.0, 120.0, 150.0, 900.0 + rnd.randint(0, 3) * 100.0, 200_000.0])
        rows.append((name, step, kind, tool, f"i{rnd.randint(0, 1)}", rnd.choice([f"o{rnd.randint(0, 1 if tool == 'read_file' else 7)}", None]), rnd.random() < 0.6, text, latency, 1))
    return rows


@pytest.fixture(scope="module")
def sessions():
    rnd = random.Random(11)
    return {f"s{k}": _session(rnd, f"s{k}") for k in range(48)}


def test_first_firings_equal_the_rules_on_every_prefix(spark, sessions):
    prefixes = [(f"{name}|{k}", *r[1:]) for name, rows in sessions.items() for k in range(1, len(rows) + 1) for r in rows[:k]]
    ev = Ordered.of(spark.createDataFrame(prefixes, EVENT).repartition(4, "session_id"))
    final = {"context_loss": dt.context_loss(ev, 2), "premature_termination": dt.premature_termination(ev), "error_cascade": dt.error_cascade(ev),
             "analysis_paralysis": dt.analysis_paralysis(ev, 2), "recovery_failure": dt.recovery_failure(ev), "missing_verification": dt.missing_verification(ev, 4),
             "reasoning_action_mismatch": dt.reasoning_action_mismatch(ev), "tool_thrashing": dt.tool_thrashing(ev, 3, 4), "stall": dt.stall(ev, floor_ms=300.0)}
    holds = defaultdict(list)
    for rule, found in final.items():
        for r in found.select("session_id", "at_step", "confidence").collect():
            name, k = r.session_id.split("|")
            holds[name, rule].append((int(k), r.at_step, round(r.confidence, 6)))
    want = set()
    for (name, rule), at in holds.items():
        told = None
        for k, place, sure in sorted(at):
            if told is None or (rule in dt.REFIREABLE and place != told):
                want.add((name, rule, k, place, sure))
            told = place
    whole = Ordered.of(spark.createDataFrame([r for rows in sessions.values() for r in rows], EVENT).repartition(4, "session_id"))
    got = {(r.session_id, r.failure, r.step, r.at_step, round(r.confidence, 6)) for r in fr.first_firings(whole, **LOOSE).collect()}
    assert sorted(got ^ want) == []
    assert {w[1] for w in want} == set(fr.RULES)
    again = [w for w in want if w[1] in dt.REFIREABLE]
    assert len(again) > len({w[:2] for w in again})
    few = fr.first_firings(whole, ("stall", "error_cascade"), **LOOSE)
    assert {r.failure for r in few.collect()} == {"stall", "error_cascade"}
    settled = fr.settled_firings(few.unionByName(fr.first_firings(whole, ("recovery_failure",), **LOOSE)), dt.stall(whole, floor_ms=300.0), dt.recovery_failure(whole)).collect()
    still = {r.session_id for r in dt.recovery_failure(whole).collect()}
    assert {r.session_id for r in settled if r.failure == "recovery_failure"} == still
    ends = {r.session_id: r.confidence for r in dt.stall(whole, floor_ms=300.0).collect()}
    assert all(r.confidence >= ends.get(r.session_id, 0) for r in settled if r.failure == "stall")


def test_a_session_without_events_to_judge_fires_nothing(spark):
    ev = Ordered.of(spark.createDataFrame([("a", 1, "tool_call", None, None, None, True, None, None, 1)], EVENT))
    assert fr.first_firings(ev).collect() == []
    assert {r.gate_failed for r in fr.failed_gates(ev).collect()} == {"min_events"}
    none = ev.on(ev.df.where(F.lit(False)))
    assert fr.first_firings(none).collect() == [] and fr.failed_gates(none).collect() == []


def test_sorted_runs_give_the_quantiles_of_a_list():
    rnd = random.Random(2)
    ranks, seen = fr._Ranks(), []
    for n in range(9000):
        x = float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1e5]))
        ranks.add(x)
        seen.append(x)
        if n % 500 == 0:
            seen.sort()
            for p in (0.25, 0.5, 0.75):
                place = n * p
                low = int(place)
                want = seen[low] + (place - low) * (seen[min(low + 1, n)] - seen[low])
                assert abs(ranks.quantile(p) - want) < 1e-9
