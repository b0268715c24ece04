"""Streaming jobs run over the given tables until they are drained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trajlens.plans.registry import query
from trajlens.plans.sqltext import B1A, b1
from trajlens.plans.windows import mi_sql
from trajlens.sources import bind
from trajlens.streaming import monitor as mo
from trajlens.streaming import reorder, run
from trajlens.streaming.windows import tumbling


@query("stream_monitor", f"""WITH {b1()}, h AS (SELECT session_id, step, round(entropy(symbol) OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING) + 1e-12, 4) AS entropy FROM b1),
m AS ({mi_sql('b1', 'symbol')}), k AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS c FROM b1),
p AS (SELECT session_id, step, symbol, last_value(CASE WHEN step = 1 OR event_type IN ('click', 'error', 'purchase') OR c = lag_c THEN c END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY step) AS phase
  FROM (SELECT *, lag(c) OVER (PARTITION BY session_id ORDER BY step) AS lag_c FROM k))
SELECT session_id, step, symbol, entropy, mi, CAST(phase AS BIGINT) AS phase FROM h JOIN m USING (session_id, step) JOIN p USING (session_id, step)""")
def stream_monitor(spark, sf_dir):
    events = run.read_table(spark, sf_dir, "events")
    out = run.to_table(mo.monitor(mo.monitor_input(events)))
    return out.select("session_id", "step", "symbol", "entropy", "mi", "phase")


@query("stream_profile", """SELECT user_id AS session_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type) AS types,
  min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id""")
def stream_profile(spark, sf_dir):
    return run.to_latest(mo.session_profile(run.read_table(spark, sf_dir, "events")))


@query("stream_windows", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    events = run.read_table(spark, sf_dir, "events")
    out = run.to_latest(tumbling(mo.merge_sources(events), "6 hours", "event_type"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


LAST = """SELECT a.resource, a.agent_id AS agent, b.agent_id AS other_agent, a.step, max(b.step) AS other_step FROM b1a a JOIN b1a b
  ON a.resource = b.resource AND b.step < a.step AND b.agent_id <> a.agent_id WHERE a.{mine} AND b.{theirs} GROUP BY ALL"""


@query("stream_coordination", f"""WITH {B1A} SELECT 'write_read' AS kind, * FROM ({LAST.format(mine='is_read', theirs='is_write')}) WHERE step - other_step <= 20
UNION ALL SELECT 'race_condition', * FROM ({LAST.format(mine='is_write', theirs='is_write')}) WHERE step - other_step <= 20
UNION ALL SELECT CASE WHEN step - other_step <= 20 THEN 'concurrent_modification' ELSE 'stale_read' END, * FROM ({LAST.format(mine='is_write', theirs='is_read')})""")
def stream_coordination(spark, sf_dir):
    """The agent stream is numbered as a table first, since a global step needs a global order."""
    folder = f"{run.shared_folder(spark)}/agents"
    bind.agent_events(spark, sf_dir).df.select("resource", "step", "agent_id", "is_read", "is_write").write.parquet(folder)
    return run.to_table(mo.coordinate(run.read_parts(spark, folder)))


@query("stream_in_order", """SELECT user_id AS session_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events""")
def stream_in_order(spark, sf_dir):
    """Two sources whose events arrive up to six days late; a row of no session ends the stream.

    Events leave a source by a time that lies a few days behind their own, so
    every micro-batch holds rows that belong before rows of the last ones. The table is
    dealt into the four parts of its time in one pass; a part is then sent as one file a source.
    """
    folder = run.shared_folder(spark)
    events = bind.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    sent = (F.unix_micros("ts") / 1e6 / 86400 + F.pmod(F.xxhash64("event_id"), F.lit(6))).alias("sent")
    whole = events.select("*", sent)
    first, last = whole.agg(F.min("sent"), F.max("sent")).first()
    end = spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.timestamp_micros(F.lit(int((last + 30) * 86400e6))).alias("ts"),
                                F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"))
    part = reduce(lambda a, b: a + b, [(F.col("sent") >= first + (last - first) * i / 4).cast("int") for i in (1, 2, 3)])
    dealt = whole.where(F.col("sent").isNotNull() & F.col("event_id").isNotNull()).select(
        *events.columns, part.alias("part"), F.pmod(F.col("event_id"), F.lit(2)).alias("source"))
    dealt.write.partitionBy("part", "source").parquet(f"{folder}/dealt")
    parts = spark.read.schema(dealt.schema).parquet(f"{folder}/dealt")
    for i in range(4):
        for source, even in (("a", 0), ("b", 1)):
            rows = parts.where((F.col("part") == i) & (F.col("source") == even)).select(*events.columns)
            rows.coalesce(1).write.mode("append").parquet(f"{folder}/{source}")
    end.write.mode("append").parquet(f"{folder}/a")
    streams = [run.read_parts(spark, f"{folder}/{s}", 1) for s in ("a", "b")]
    out = run.to_table(reorder.in_order(*streams, delay="20 days"))
    return out.where("session_id <> -1").select("session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "step")
