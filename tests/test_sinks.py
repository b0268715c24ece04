"""What is written reads back the same."""

import pytest

from trajlens.operators import baselines as bl
from trajlens.sources import sinks


def test_ledger_keeps_every_row_and_reads_the_newest(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "session_id string, rater string, value int, at long"
    sinks.append_ledger(spark.createDataFrame([("a", "x", 1, 1), ("b", "x", 2, 2)], schema), path)
    sinks.append_ledger(spark.createDataFrame([("a", "x", 5, 3)], schema), path)
    assert spark.read.schema(schema).json(path).count() == 3
    got = {r["session_id"]: r["value"] for r in sinks.read_latest(spark, path, schema, ["session_id", "rater"], "at").collect()}
    assert got == {"a": 5, "b": 2}


def test_profile(spark, tmp_path):
    moves = spark.createDataFrame([("gathering", "executing")] * 30 + [("gathering", "planning")], "from_phase string, to_phase string")
    sinks.save_profile(str(tmp_path), transition_model=bl.transition_model(moves))
    back = sinks.load_profile(spark, str(tmp_path), "transition_model")["transition_model"]
    assert {r["to_phase"]: r["is_rare"] for r in back.collect()} == {"executing": False, "planning": True}
    with pytest.raises(ValueError):
        sinks.save_profile(str(tmp_path), other=moves)


def test_features_are_partitioned(spark, tmp_path):
    df = spark.createDataFrame([(1, "dev", 0.5), (2, "test", 0.7)], "id long, split string, v double")
    sinks.write_features(df, str(tmp_path / "f"), "split")
    assert (tmp_path / "f" / "split=dev").exists()
    assert spark.read.parquet(str(tmp_path / "f")).where("split = 'test'").first()["v"] == 0.7
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "m")).count() == 2
