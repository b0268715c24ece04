"""Nothing is lost to prefixes, caps or the shape of a folder."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import ROOT, difference, duck
from trajlens.functions import text as tx
from trajlens.operators import evaluation as ev
from trajlens.operators import labels as lb
from trajlens.operators import models as md
from trajlens.plans import ORACLES, QUERIES
from trajlens.sources import adapters as ad
from trajlens.streaming import run

RECORD = ("session_id string, annotator_type string, label_status string, has_failure boolean, code string, onset_step int, "
          "is_latent boolean, seq long")


def test_streamed_tables_may_be_folders_or_files(spark, tmp_path):
    rows = spark.range(30)
    rows.repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "single.parquet")
    for name in ("parts", "single"):
        assert run.to_table(run.read_table(spark, str(tmp_path), name)).count() == 30


def test_ids_that_begin_alike_stay_apart(spark):
    rows = [("12345678-aaaa", "human", "human_reviewed", True, "4.2", 3, False, 1), ("12345678-bbbb", "human", "human_reviewed", False, "", 0, False, 2),
            ("12345678", "auto", "auto_labeled", True, "2.1", 5, False, 3), ("87654321", "human", "human_reviewed", True, "2.2", 1, False, 4),
            ("87654321-full", "auto", "auto_labeled", True, "2.1", 7, False, 5)]
    records = spark.createDataFrame(rows, RECORD)
    truth = {(r.session_id, r.code) for r in lb.ground_truth(records).collect()}
    assert truth == {("12345678-aaaa", "4.2"), ("12345678", "2.1"), ("87654321-full", "2.2"), ("87654321-full", "2.1")}
    ids = {r.canonical_id: (r.ids, r.ambiguous) for r in lb.canonical_ids(records).collect()}
    assert ids == {"12345678-aaaa": (1, False), "12345678-bbbb": (1, False), "12345678": (1, True), "87654321-full": (2, False)}


def test_results_that_differ_late_have_different_hashes(spark):
    def session(name, result):
        items = [{"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "assistant", "content": [
                    {"type": "tool_use", "id": "u", "name": "Read", "input": {"file_path": "/a"}}]}},
                 {"type": "user", "timestamp": "2024-01-01T00:00:01Z", "message": {"role": "user", "content": [
                     {"type": "tool_result", "tool_use_id": "u", "is_error": True, "content": result}]}}]
        return [(name, i, json.dumps(m)) for i, m in enumerate(items)]

    records = spark.createDataFrame(session("a", "x" * 2500 + "1") + session("b", "x" * 2500 + "2"), "session_id string, line long, raw string")
    got = ad.session_records(records).df.where("tool IS NOT NULL").collect()
    assert len({r["output_hash"] for r in got}) == 2 and {len(r["error_message"]) for r in got} == {2501}


def test_long_paths_commands_and_errors_are_read_whole(spark):
    path = "a/" * 150
    row = spark.range(1).select(
        tx.first_path(F.lit(path + "x.py")).alias("path"), tx.normal_command(F.lit("run " + "y" * 200 + " && z")).alias("command"),
        tx.is_error_result(F.lit(False), F.lit("ok " * 200 + "Traceback")).alias("error")).first()
    assert row.path == path + "x.py" and row.command == "run " + "y" * 200 and row.error


def test_any_number_of_modes(spark):
    found = spark.createDataFrame([(f"m{i}", "s1", "stall", 0.9, 10) for i in range(80)], "mode string, session_id string, failure string, confidence double, step long")
    truth = spark.createDataFrame([("s1", "stall", 10, False), ("s2", "loop", 1, False)], "session_id string, failure string, onset_step long, is_latent boolean")
    kinds = [r.match_type for r in ev.match(found, truth, keys=("mode",)).collect()]
    assert sorted(kinds) == ["fn"] * 80 + ["full"] * 80


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=300)
    y = (x + rnd.normal(size=300) > 0.4).astype(int)
    return spark.createDataFrame([(i, float(a), int(b), 2.0) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, y int, flat double")


def test_null_labels_are_permutations(spark, rows):
    scores = md.logistic_cv(md.with_folds(rows, "id"), "id", ["a"], "y", 12)
    positives = {r.replicate: r.n for r in scores.groupBy("replicate").agg(F.sum("y").alias("n")).collect()}
    assert len(positives) == 13 and len(set(positives.values())) == 1
    drawn = {r.replicate: tuple(sorted(r.ids)) for r in scores.where("y = 1").groupBy("replicate").agg(F.collect_list("id_hash").alias("ids")).collect()}
    assert len(set(drawn.values())) == 13


def test_a_fit_that_has_not_settled_raises(rows):
    with pytest.raises(RuntimeError):
        md.logistic_cv(md.with_folds(rows, "id"), "id", ["a"], "y", iterations=1)


def test_a_constant_feature_has_no_score(rows):
    assert md.ridge_cv(md.with_folds(rows, "id"), ["a"], ["flat"])["flat"] is None


def test_scores_that_differ_little_are_not_tied(spark):
    def scored(values):
        return spark.createDataFrame([(i, v, float(i % 2)) for i, v in enumerate(values)], "id_hash long, score double, y double")

    base, full = scored([0.5] * 20), scored([0.5 + (i % 2) * 1e-6 for i in range(20)])
    got = md.bootstrap_auc_gain(base, full, 20).first()
    assert got.auc_base == 0.5 and got.auc_full == 1.0


def test_drift_scores_take_all_four_terms(spark):
    sf = f"{ROOT}/sf0.01"
    got = QUERIES["calibrated_drift"](spark, sf)
    assert difference(got, duck(sf), ORACLES["calibrated_drift"]) is None
    assert got.where("confidence > 0.8").count() > 0      # beyond what transitions and regressions can give


def test_detections_run_every_detector(spark):
    sf = f"{ROOT}/sf0.001"
    wanted = {r.session_id for r in QUERIES["detect_strategic_myopia"](spark, sf).collect()}
    got = QUERIES["detections"](spark, sf).where("failure = 'strategic_myopia'").collect()
    assert {r.session_id for r in got} == wanted and wanted
