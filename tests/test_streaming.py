"""The monitor over session files that arrive as a stream."""

import json
import random

from pyspark.sql import functions as F

from trajlens.streaming import run
from trajlens.streaming.monitor import monitor
from trajlens.streaming.reorder import in_order

SCHEMA = "session_id long, ts timestamp, event_id long, symbol string, success boolean, ends boolean"


def test_files_to_detections(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source = tmp_path / "sessions"
        source.mkdir()
        ok = [True, False, False, False, True, True, False, False, False, True]
        for part, steps in enumerate((range(0, 5), range(5, 10))):
            lines = [json.dumps({"session_id": 1, "ts": f"2024-01-01T00:00:{i:02d}Z", "event_id": i, "symbol": "ab"[i % 2],
                                 "success": ok[i], "ends": i == 9}) for i in steps]
            (source / f"{part}.json").write_text("\n".join(lines))
        events = run.read_json(spark, str(source), SCHEMA, files_per_batch=2).withColumns({
            "class_rank": F.when(F.col("symbol") == "a", 1).otherwise(3).cast("long"), "strong": F.lit(False), "thinks": F.lit(False)})
        out = run.to_table(monitor(events, calibration=3)).orderBy("step").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["step"] for r in out] == list(range(1, 11))
    assert [r["step"] for r in out if r["detection"] == "error_cascade"] == [4, 9]
    assert [r["ended"] for r in out] == [False] * 9 + [True]
    # Phases alternate and none is strong, so the first one stays committed.
    assert {r["phase"] for r in out} == {1}
    assert out[9]["entropy"] == 1.0 and out[0]["entropy"] == 0.0


def test_events_of_two_sources_leave_in_order(spark, tmp_path):
    """Three shuffled micro-batches of two sources give the steps of the whole; ties go by event id; a row without a key or time has no place."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rnd = random.Random(4)
    rows = [(rnd.randint(1, 5), 86400 + minute * 60, k, rnd.choice("abc")) for k, minute in enumerate(rnd.choices(range(300), k=400))]
    schema = "session_id long, at long, event_id long, symbol string"
    table = lambda some: spark.createDataFrame(some, schema).select("session_id", F.timestamp_seconds("at").alias("ts"), "event_id", "symbol")
    try:
        by_time = sorted(rows, key=lambda r: r[1] + rnd.randint(0, 6000))
        for batch in range(3):
            part = by_time[batch * 134:(batch + 1) * 134]
            for source in (0, 1):
                table([r for r in part if r[2] % 2 == source] + [(None, 86400, 900, "x"), (1, None, 901, "x")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{source}")
        table([(9, 10 ** 6, -1, "end")]).write.mode("append").parquet(f"{tmp_path}/0")
        streams = [run.read_parts(spark, f"{tmp_path}/{s}", 1) for s in (0, 1)]
        out = run.to_table(in_order(*streams, delay="2 hours")).where("session_id <> 9").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for session in range(1, 6):
        for step, r in enumerate(sorted((r for r in rows if r[0] == session), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = (session, step, r[3])
    assert {r.event_id: (r.session_id, r.step, r.symbol) for r in out} == want and len(out) == len(rows)
    assert [r[2] for r in by_time] != [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_sessions_that_share_a_bucket_keep_their_own_steps(spark, tmp_path):
    """Two state keys hold forty sessions; nulls in other columns stay."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    big = 2 ** 40 + 1
    rows = [(f"s{k % 40}", 86400 + (k * 7919 % 500) * 60, k, None if k % 3 else big + k) for k in range(400)]
    schema = "session_id string, at long, event_id long, size long"
    table = lambda some: spark.createDataFrame(some, schema).select("session_id", F.timestamp_seconds("at").alias("ts"), "event_id", "size")
    try:
        for part in (rows[:200], rows[200:], [("end", 10 ** 7, -1, None)]):
            table(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = run.to_table(in_order(run.read_parts(spark, f"{tmp_path}/in", 1), delay="10 hours", buckets=2)).where("session_id <> 'end'").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = set()
    for session in {r[0] for r in rows}:
        for step, r in enumerate(sorted((r for r in rows if r[0] == session), key=lambda r: (r[1], r[2])), 1):
            want.add((session, r[2], r[3], step))
    assert {(r.session_id, r.event_id, r.size, r.step) for r in out} == want and len(out) == len(rows)
