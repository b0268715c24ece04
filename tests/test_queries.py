"""Every registered query with a SQL twin gives the same rows on the smallest tables."""

import pytest

from tests.compare import ROOT, difference, duck
from trajlens.plans import ORACLES, QUERIES
from trajlens.sequence import CHUNK_SETTING

SF = f"{ROOT}/sf0.001"
# One query per kind of ordered operation, run again with sessions split into chunks.
SPLIT = ["sliding_mi", "baseline_kl", "feedback_action_mi", "phase_segment_stats", "detect_context_loss", "detect_stall",
         "error_recovery_features", "awareness_features", "stale_reads", "change_points", "cognition_memory",
         "decision_points", "merged_streams", "spearman_average", "first_firings", "cross_agent_information"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", SPLIT)
def test_same_rows_when_sessions_are_split(spark, con, name):
    spark.conf.set(CHUNK_SETTING, "37")
    try:
        assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None
    finally:
        spark.conf.unset(CHUNK_SETTING)


@pytest.mark.parametrize("name", ["balanced_sample_keyed", "bootstrap_detector_scores", "binomial_hit_test", "detect_strategic_myopia"])
def test_queries_without_sql_run(spark, name):
    assert len(QUERIES[name](spark, SF).collect()) >= 0
