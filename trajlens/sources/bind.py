"""Bindings of the given tables to the canonical event, turn and ledger tables.

Each function is a projection plus a per-session position; nothing is sampled or
cut off. The same projections are written as SQL in ``trajlens.plans.sqltext``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.sequence import Ordered, number_rows

PHASE_OF_EVENT = {"view": "gathering", "signup": "planning", "click": "executing",
                  "error": "verifying", "purchase": "delivering"}
VERB_OF_EVENT = {"view": "open", "click": "search_dir", "signup": "edit",
                 "purchase": "python", "error": "create"}


def lookup(key: Column, table: dict) -> Column:
    """``table[key]`` as a CASE expression."""
    chain = None
    for k, v in table.items():
        chain = F.when(key == k, F.lit(v)) if chain is None else chain.when(key == k, F.lit(v))
    return chain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the integer of ``props`` as ``k``."""
    return table(spark, sf_dir, "events").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))


def events(spark: SparkSession, sf_dir: str, session: Column | None = None,
           chunk_rows: int | None = None, columns: tuple[str, ...] | None = None) -> Ordered:
    """Trace events: one session per user unless ``session`` says otherwise.

    With ``columns`` only these are carried through the numbering, which writes
    out what it numbers where sessions are long.
    """
    session = F.col("user_id") if session is None else session
    ev = raw_events(spark, sf_dir).select(
        session.alias("session_id"), "event_id", "ts", "user_id", "event_type", "value", "k",
        F.col("event_type").alias("symbol"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("value") * 100).alias("latency_ms"),
    )
    keys, order = ["session_id"], ["ts", "event_id"]
    if columns is None:
        return number_rows(ev, keys, order, chunk_rows=chunk_rows)
    narrow = ev.select(*dict.fromkeys([*keys, *order, *columns]))
    return number_rows(narrow, keys, order, chunk_rows=chunk_rows).select(*columns)


def long_events(spark: SparkSession, sf_dir: str, chunk_rows: int | None = None,
                columns: tuple[str, ...] | None = None) -> Ordered:
    """Fifteen long sessions, so that calibration windows of 100 events close."""
    return events(spark, sf_dir, F.col("user_id") % 15, chunk_rows, columns)


def agent_events(spark: SparkSession, sf_dir: str, chunk_rows: int | None = None) -> Ordered:
    """One global stream of interleaved agents touching shared resources."""
    ev = raw_events(spark, sf_dir).select(
        F.lit("all").alias("session_id"), "event_id", "ts",
        (F.col("user_id") % 3).alias("agent_id"), (F.col("k") % 20).alias("resource"),
        F.col("event_type").alias("symbol"),
        F.col("event_type").isin("view", "click").alias("is_read"),
        F.col("event_type").isin("purchase", "signup").alias("is_write"),
    )
    return number_rows(ev, ["session_id"], ["ts", "event_id"], chunk_rows=chunk_rows)


def with_phase(ev: Ordered) -> Ordered:
    return ev.with_columns(phase=lookup(F.col("event_type"), PHASE_OF_EVENT))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session time zone."""
    return F.expr(f"(datediff({ts}, date'1970-01-01') * 86400L + hour({ts}) * 3600 + minute({ts}) * 60) * 1000000L"
                  f" + cast(extract(second from {ts}) * 1000000 as bigint)")


def with_seconds(ev: Ordered) -> Ordered:
    """Adds ``timestamp``: seconds since the first event of the session."""
    started = ev.with_columns(_at=micros("ts")).running(_start=("min", F.col("_at")))
    return started.on(started.df.withColumn(
        "timestamp", (F.col("_at") - F.col("_start")) / 1e6).drop("_start", "_at"))


def turns(spark: SparkSession, sf_dir: str, chunk_rows: int | None = None) -> Ordered:
    """Two chat turns per event: an action turn with a fenced block, then its outcome."""
    ev = events(spark, sf_dir, chunk_rows=chunk_rows)
    verb = lookup(F.col("event_type"), VERB_OF_EVENT)
    k = F.col("k").cast("string")
    action = F.concat(
        F.lit("I will "), F.col("event_type"), F.lit(" f"), (F.col("k") % 7).cast("string"),
        F.lit("\n```\n"), verb, F.lit(" f"), (F.col("k") % 10).cast("string"), F.lit(".py\n```"))
    outcome = F.when(F.col("event_type") == "error", "Traceback: error").otherwise("ok")
    pair = F.array(
        F.struct((F.col("step") * 2 - 1).alias("turn"), F.lit("ai").alias("role"), action.alias("text")),
        F.struct((F.col("step") * 2).alias("turn"), F.lit("user").alias("role"), outcome.alias("text")))
    df = ev.df.select("session_id", F.inline(pair))
    return Ordered(df, ("session_id",), "turn", ev.longest * 2, ev.chunk_rows)


def trace_events(spark: SparkSession, sf_dir: str, session: Column | None = None,
                 chunk_rows: int | None = None) -> Ordered:
    """Events in the full trace form the detectors read."""
    ev = events(spark, sf_dir, session, chunk_rows)
    kind = (F.when(F.col("k") % 25 == 0, "user_input").when(F.col("event_type") == "signup", "reasoning")
            .otherwise("tool_call"))
    intent = F.when(F.col("k") % 3 == 0, "read").when(F.col("k") % 3 == 1, "test").otherwise("write")
    said = F.when(F.col("k") % 50 == 0, "tests pass, looks good").otherwise("next please")
    tools = {"view": "read_file", "click": "bash", "purchase": "edit_file", "error": "pytest"}
    df = ev.df.withColumn("type", kind).withColumns({
        "tool": F.when(F.col("type") == "tool_call", lookup(F.col("event_type"), tools)),
        "input_hash": F.concat(F.lit("i"), (F.col("k") % 2).cast("string")),
        "output_hash": F.concat(F.lit("o"), (F.col("k") % 6).cast("string")),
        "goal_text": F.when(F.col("type") == "reasoning", F.concat(
            F.lit("I will "), intent, F.lit(" f"), (F.col("k") % 7).cast("string")))
        .when(F.col("type") == "user_input", said),
        "tokens_in": F.col("k"), "tokens_out": F.floor("value"),
    })
    return ev.on(df)


def conversation_turns(spark: SparkSession, sf_dir: str, chunk_rows: int | None = None) -> Ordered:
    conv = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), "role", "text")
    return number_rows(conv, ["session_id"], ["at"], out="turn", chunk_rows=chunk_rows)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating ledger rows: session, rater, dimension, value, confidence, time."""
    return raw_events(spark, sf_dir).select(
        (F.col("user_id") % 40).alias("session_id"), F.col("event_type").alias("rater"),
        (F.col("k") % 5).alias("dimension"), (1 + F.col("k") % 5).alias("value"),
        (F.col("k") % 4).alias("confidence"), "ts", "event_id")


CODES = ("2.1", "2.2", "4.2", "4.4", "5.4", "")


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label ledger in four layers; one id in three is a bare prefix."""
    ev = raw_events(spark, sf_dir)
    short = F.lpad(F.col("user_id").cast("string"), 8, "0")
    layer = (F.when(F.col("event_type") == "click", "auto").when(F.col("event_type") == "signup", "human")
             .when((F.col("event_type") == "purchase") & (F.col("k") % 10 == 0), "adjudicated")
             .when(F.col("event_type") == "purchase", "human").otherwise("detector"))
    status = {"detector": "unlabeled", "auto": "auto_labeled", "human": "human_reviewed", "adjudicated": "adjudicated"}
    return ev.select(
        F.when(F.col("k") % 3 == 0, short).otherwise(F.concat(short, F.lit("-full"))).alias("session_id"),
        layer.alias("annotator_type"), F.concat(F.lit("a"), (F.col("k") % 4).cast("string")).alias("annotator_id"),
        lookup(layer, status).alias("label_status"), (F.col("k") % 4 != 0).alias("has_failure"),
        F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("k") % 6 + 1).cast("int")).alias("code"),
        F.col("k").alias("onset_step"), (F.col("k") % 6).alias("severity"),
        (F.floor(F.col("k") / 2) % 6).alias("confidence"), (F.col("k") % 5 == 0).alias("is_latent"),
        F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"), "user_id")
