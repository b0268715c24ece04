"""Plans and figures that must not grow faster than the tables."""

import pytest
from pyspark.sql import functions as F

from tests.compare import ROOT, difference, duck
from trajlens.operators import matching as ma
from trajlens.operators import metrics
from trajlens.plans import ORACLES, QUERIES
from trajlens.plans.baselines import METRICS, measured
from trajlens.plans.evaluation import sweep
from trajlens.sequence import CHUNK_SETTING, Ordered, number_rows
from trajlens.sources import bind

SF = f"{ROOT}/sf0.001"


def leaves(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


@pytest.fixture
def split(spark):
    spark.conf.set(CHUNK_SETTING, "37")
    yield spark
    spark.conf.unset(CHUNK_SETTING)


def stream(spark, rows):
    return Ordered.of(spark.range(rows).select((F.col("id") % 2).alias("session_id"), (F.expr("id div 2") + 1).alias("step"),
                                               F.concat(F.lit("s"), (F.col("id") * 7 % 11 % 5).cast("string")).alias("symbol")), chunk_rows=37)


def test_a_chain_of_running_values_reads_its_table_once(spark):
    ev = stream(spark, 400)
    for i in range(5):
        ev = ev.running(**{f"r{i}": ("count", F.col("symbol"))}).totals(**{f"t{i}": F.max("step")}).per_value("symbol", **{f"v{i}": F.count("*")})
    assert leaves(ev.df) <= 1 + 15
    assert {(r.session_id, r.n, r.t) for r in ev.df.groupBy("session_id").agg(F.max("r4").alias("n"), F.max("t4").alias("t")).collect()} == {(0, 200, 200), (1, 200, 200)}


def test_step_metrics_of_split_sessions(spark):
    """Same values as whole sessions, from a plan of few tables."""
    parts = metrics.step_metrics(stream(spark, 500), compression=False)
    assert parts.split and leaves(parts.df) <= 4
    columns = ["session_id", "step", "action_entropy", "action_mi", "last_surprisal", "kl_divergence"]
    whole = metrics.step_metrics(Ordered.of(stream(spark, 500).df, chunk_rows=10_000), compression=False)
    assert sorted(parts.df.select(columns).collect()) == sorted(whole.df.select(columns).collect())


@pytest.mark.parametrize("name", ["metric_anomalies", "best_threshold", "information_edges"])
def test_same_rows_as_sql_when_split(split, name):
    assert difference(QUERIES[name](split, SF), duck(SF), ORACLES[name]) is None


def test_long_sessions_are_measured_once_per_query(split):
    assert leaves(QUERIES["metric_anomalies"](split, SF)) <= 6


def test_short_sessions_are_dealt_to_more_tasks(spark):
    df = spark.range(4000).select((F.col("id") % 500).alias("session_id"), "id")
    assert number_rows(df, ["session_id"], ["id"], chunk_rows=100).df.rdd.getNumPartitions() >= 40


def test_pairs_are_matched_once(split):
    rows = [("s", i % 2, f"x{i % 3}", i + 1) for i in range(120)]
    ev = Ordered.of(split.createDataFrame(rows, "session_id string, agent_id long, symbol string, step long"))
    plan = ma.matched_pairs(ev)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_long_events_are_numbered_once_and_narrow(split, monkeypatch):
    """Queries that read the steps twice number them once and carry only the columns they use."""
    seen = []

    def recorded(df, *args, **kwargs):
        seen.append(df.columns)
        return number_rows(df, *args, **kwargs)

    monkeypatch.setattr(bind, "number_rows", recorded)
    for name, columns in (("lead_lag", {"symbol"}), ("mark_confusion", {"symbol", "event_type"})):
        seen.clear()
        assert difference(QUERIES[name](split, SF), duck(SF), ORACLES[name]) is None
        assert [set(c) for c in seen] == [{"session_id", "ts", "event_id"} | columns]


def test_calibration_is_measured_on_the_first_steps(split):
    """Where sessions are split, their first steps are measured apart and have the values of the whole."""
    ev = stream(split, 500)
    columns = ["session_id", "step", *METRICS]
    early = metrics.step_metrics(ev.first(metrics.BASELINE), compression=False).df.select(columns)
    whole = metrics.step_metrics(ev, compression=False)
    first = sorted(early.collect())
    assert len(first) == 2 * metrics.BASELINE
    assert first == sorted(whole.df.where(F.col("step") <= metrics.BASELINE).select(columns).collect())
    m = measured(split, SF)
    assert m.early is not None and m.with_columns(x=F.lit(1)).early is None


@pytest.mark.parametrize("measure", [metrics.sliding_mi, metrics.baseline_kl, lambda ev: metrics.step_metrics(ev, compression=False)])
def test_sums_over_a_window_change_by_one_term(spark, measure):
    """No frame of rows is summed anew for each row."""
    plan = measure(Ordered.of(stream(spark, 300).df, chunk_rows=10_000)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "RowFrame, -49" not in plan


def test_level_of_a_step_is_one_expression_of_its_scores(spark):
    """The scores of a step are sorted once, not once for each threshold."""
    assert sweep(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1
