"""Trace formats to events."""

import json

import pytest

from trajlens.sources import adapters as ad


def records(spark, *sessions):
    rows = [(name, i, json.dumps(m)) for name, items in sessions for i, m in enumerate(items, 1)]
    return spark.createDataFrame(rows, "session_id string, line long, raw string")


BLOCKS = ("b", [{"role": "user", "content": [{"type": "text", "text": "hi"}]},
                {"role": "assistant", "content": [{"type": "thinking", "thinking": "let me see"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": "a b"}}]},
                {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "no such file", "is_error": True}]},
                {"role": "assistant", "content": "all done now"}])
CALLS = ("c", [{"role": "system", "content": "be good"}, {"role": "assistant", "content": "thinking out loud"},
               {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "grep", "arguments": "{\"a\": 1}"}}, {"id": "2", "function": {"name": "ls", "arguments": ""}}]},
               {"role": "tool", "tool_call_id": "1", "content": "three words here"}])
RUNS = ("r", [{"run_type": "tool", "name": "search", "inputs": {"q": "x"}, "outputs": "two words", "latency_ms": 5.0},
              {"run_type": "llm", "name": "m", "inputs": "a", "outputs": "b", "error": "boom"}, {"run_type": "chain", "name": "plan", "inputs": "a", "outputs": ""}])
NATIVE = ("n", [{"step": 1, "type": "tool_call", "tool": "bash", "extra": 9, "success": False}, {"step": 2, "type": "output"}])
SESSION = ("s", [{"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "fix it"}},
                 {"type": "assistant", "timestamp": "2024-01-01T00:00:02Z", "message": {"role": "assistant", "usage": {"input_tokens": 7, "output_tokens": 3},
                  "content": [{"type": "text", "text": "  "}, {"type": "tool_use", "id": "u1", "name": "Read", "input": {"file_path": "/x/pkg/main.py"}}]}},
                 {"type": "progress"},
                 {"type": "user", "timestamp": "2024-01-01T00:00:03.5Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u1", "is_error": True, "content": [{"type": "text", "text": "denied"}]}]}}])


def rows(ordered):
    return ordered.df.orderBy("step").collect()


def test_block_messages(spark):
    got = rows(ad.block_messages(records(spark, BLOCKS)))
    assert [(r["type"], r["tool"], r["success"]) for r in got] == [
        ("planning", None, True), ("tool_call", "Read", True), ("tool_call", "t1", False), ("reasoning", None, True)]
    assert got[2]["error_message"] == "no such file" and got[3]["tokens_out"] == 3


def test_call_messages(spark):
    got = rows(ad.call_messages(records(spark, CALLS)))
    assert [(r["type"], r["tool"]) for r in got] == [("reasoning", None), ("tool_call", "grep"), ("tool_call", "ls"), ("tool_call", "1")]
    assert [r["tokens_in"] for r in got] == [0, 2, 0, 0] and got[3]["tokens_out"] == 3


def test_callback_runs(spark):
    got = rows(ad.callback_runs(records(spark, RUNS)))
    assert [(r["type"], r["tool"], r["success"], r["latency_ms"]) for r in got] == [
        ("tool_call", "search", True, 5.0), ("reasoning", None, False, 0.0), ("planning", "plan", True, 0.0)]


def test_native_events_drop_unknown_keys(spark):
    got = rows(ad.native(records(spark, NATIVE)))
    assert [(r["type"], r["tool"], r["success"]) for r in got] == [("tool_call", "bash", False), ("output", None, True)]


def test_session_records(spark):
    got = rows(ad.session_records(records(spark, SESSION)))
    assert [(r["type"], r["tool"], r["success"]) for r in got] == [("user_input", None, True), ("tool_call", "Read", False)]
    call = got[1]
    assert (call["latency_ms"], call["timestamp"], call["tokens_in"], call["goal_text"], call["error_message"]) == (1500.0, 2.0, 7, "pkg/main.py", "denied")


def test_auto_takes_each_session_by_its_format(spark):
    every = records(spark, BLOCKS, CALLS, RUNS, NATIVE, SESSION)
    kinds = {r["session_id"]: r["format"] for r in ad.formats(every).collect()}
    assert kinds == {"b": "blocks", "c": "calls", "r": "runs", "n": "native", "s": "session"}
    counts = {r["session_id"]: r["count"] for r in ad.auto(every).groupBy("session_id").count().collect()}
    assert counts == {"b": 4, "c": 4, "r": 3, "n": 2, "s": 2}


def test_files(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text("\n".join(json.dumps(m) for m in NATIVE[1]) + "\n")
    got = ad.read_records(spark, str(tmp_path / "lines")).orderBy("line").collect()
    assert [json.loads(r["raw"])["type"] for r in got] == ["tool_call", "output"]
    (tmp_path / "arrays").mkdir()
    (tmp_path / "arrays" / "b.json").write_text(json.dumps(RUNS[1]))
    assert ad.callback_runs(ad.read_arrays(spark, str(tmp_path / "arrays"))).df.count() == 3


def test_ledger_drops_bad_lines(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    path.write_text('{"session_id": "a", "value": 3}\nnot json\n{"session_id": "b", "value": 1}\n')
    assert ad.read_ledger(spark, str(path), "session_id string, value int").count() == 2
    assert [r["line"] for r in ad.bad_ledger_lines(spark, str(path), "session_id string, value int").collect()] == ["not json"]


def test_annotation_replies(spark):
    codes = spark.createDataFrame([("4.2",)], "code string")
    reply = '```json\n[{"session_id": "a", "has_failure": true, "code": "4.2", "severity": 3, "confidence": 4}, {"session_id": "b", "has_failure": true, "code": "9.9", "severity": 9, "confidence": 4}]\n```'
    got = {r["session_id"]: (r["code"], list(r["issues"])) for r in ad.annotation_replies(spark.createDataFrame([(reply,)], "reply string"), codes).collect()}
    assert got == {"a": ("4.2", []), "b": (None, ["unknown code", "severity out of range"])}


@pytest.mark.parametrize("text,want", [("Read the config file. Then go.", "Read the config file."), ("short", None), ("x" * 300, "x" * 300)])
def test_goal_of_thought(spark, text, want):
    from pyspark.sql import functions as F
    assert spark.range(1).select(ad.goal_of_thought(F.lit(text))).first()[0] == want


@pytest.mark.parametrize("chunk", [4, 1000])
def test_results_without_ids_take_the_oldest_call(spark, chunk):
    import random
    from collections import deque

    from pyspark.sql import functions as F
    from trajlens.sequence import number_rows

    rnd = random.Random(4)
    kinds = [rnd.choice("urx") for _ in range(60)]
    pending, want = deque(), []
    for i, k in enumerate(kinds, 1):
        if k == "u":
            pending.append(i)
        elif k == "r":
            want.append((i, pending.popleft() if pending else None))
    ev = number_rows(spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "session_id long, at long, kind string"), ["session_id"], ["at"], chunk_rows=chunk)
    got = ad.first_in_first_out(ev, F.col("kind") == "u", F.col("kind") == "r").orderBy("step").collect()
    assert [(r["step"], r["use_step"]) for r in got] == want
