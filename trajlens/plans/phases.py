"""Phase machine, transitions and phase segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions.events import phase_name
from trajlens.operators import phases as ph
from trajlens.plans.registry import query
from trajlens.plans.sqltext import b1t
from trajlens.sources import bind

NAME = "(['idle','gathering','planning','executing','verifying','delivering'])[{} + 1]"


def phased(spark, sf_dir):
    return ph.phase_machine(bind.trace_events(spark, sf_dir).select("type", "tool"))


@query("phase_machine", f"""WITH {b1t()} SELECT session_id, step, {NAME.format('class_rank')} AS classified,
  {NAME.format('phase_rank')} AS phase, phase_rank <> from_rank AS is_transition,
  phase_rank < from_rank AS is_regression FROM bm""")
def phase_machine(spark, sf_dir):
    return phased(spark, sf_dir).df.select(
        "session_id", "step", phase_name(F.col("class_rank")).alias("classified"),
        phase_name(F.col("phase_rank")).alias("phase"), "is_transition", "is_regression")


@query("phase_transitions", f"""WITH {b1t()} SELECT session_id, step AS at_step, {NAME.format('from_rank')} AS from_phase,
  {NAME.format('phase_rank')} AS to_phase, phase_rank < from_rank AS is_regression FROM bm WHERE phase_rank <> from_rank""")
def phase_transitions(spark, sf_dir):
    return ph.transitions(phased(spark, sf_dir))


SEGMENTS_SQL = """sg AS (SELECT *, ([ 'idle','gathering','planning','executing','verifying','delivering'])[phase_rank + 1] AS ph,
  sum(CASE WHEN phase_rank <> from_rank THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step) AS segment_id FROM bm),
tl AS (SELECT *, CASE WHEN type = 'tool_call' THEN coalesce(tool, 'unknown') END AS tl FROM sg),
pv AS (SELECT session_id, segment_id, step, lag(tl) OVER (PARTITION BY session_id, segment_id ORDER BY step) = tl AS rep
       FROM tl WHERE tl IS NOT NULL),
ss AS (SELECT session_id, CAST(segment_id AS BIGINT) AS segment_id, ph AS phase, count(*) AS step_count, count(tl) AS tool_calls,
    count(DISTINCT tl) AS unique_tools, round(count(DISTINCT tl) / greatest(count(tl), 1), 4) AS tool_diversity,
    round(count(*) FILTER (WHERE rep) / greatest(count(tl), 1), 4) AS repetition_rate,
    count(*) FILTER (WHERE type IN ('planning', 'reasoning')) AS planning_events,
    count(*) FILTER (WHERE NOT success) AS error_count, round(count(*) FILTER (WHERE NOT success) / count(*), 4) AS error_rate,
    CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens,
    round(coalesce(sum(latency_ms) FILTER (WHERE latency_ms > 0), 0.0) / greatest(count(*) FILTER (WHERE latency_ms > 0), 1) + 1e-9, 1) AS avg_latency_ms,
    round(max(timestamp) - min(timestamp), 2) AS duration_sec,
    CASE WHEN count(tl) > 0 THEN round(entropy(tl) + 1e-12, 4) ELSE 0.0 END AS action_entropy
  FROM tl LEFT JOIN pv USING (session_id, segment_id, step) GROUP BY session_id, segment_id, ph)"""


def segment_table(spark, sf_dir):
    ev = bind.with_seconds(bind.trace_events(spark, sf_dir)).select(
        "type", "tool", "success", "tokens_in", "tokens_out", "latency_ms", "timestamp")
    machine = ph.phase_machine(ev)
    named = machine.with_columns(phase=phase_name(F.col("phase_rank")))
    return ph.segment_stats(ph.segments(named))


@query("phase_segment_stats", f"WITH {b1t()}, {SEGMENTS_SQL} SELECT * FROM ss")
def phase_segment_stats(spark, sf_dir):
    return segment_table(spark, sf_dir)


@query("session_progress", f"""WITH {b1t()}, c AS (
  SELECT session_id, arg_max(phase_rank, step) AS r, max(phase_rank) AS m,
    count(*) FILTER (WHERE phase_rank < from_rank) AS regressions, count(*) FILTER (WHERE phase_rank <> from_rank) AS transitions,
    count(*) AS total_events, count(*) FILTER (WHERE class_rank = 1) AS gathering_events,
    count(*) FILTER (WHERE class_rank = 2) AS planning_events, count(*) FILTER (WHERE class_rank = 3) AS executing_events,
    count(*) FILTER (WHERE class_rank = 4) AS verifying_events, count(*) FILTER (WHERE class_rank = 5) AS delivering_events
  FROM bm GROUP BY session_id),
d AS (SELECT *, ([0.0, 0.2, 0.35, 0.75, 0.95, 1.0])[r + 1] AS here, ([0.0, 0.0, 0.2, 0.35, 0.75, 0.95])[r + 1] AS below,
    least(([0, gathering_events, planning_events, executing_events, verifying_events, delivering_events])[r + 1] / 10.0, 1.0) AS share FROM c)
SELECT session_id, {NAME.format('r')} AS current_phase, {NAME.format('m')} AS max_phase, regressions, transitions, total_events,
  gathering_events, planning_events, executing_events, verifying_events, delivering_events,
  round(CAST(below AS DOUBLE) + (CAST(here AS DOUBLE) - CAST(below AS DOUBLE)) * share, 4) AS progress FROM d""")
def session_progress(spark, sf_dir):
    return ph.progress(phased(spark, sf_dir))
