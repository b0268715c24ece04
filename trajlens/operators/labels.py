"""Label ledgers: latest rows, trust order, ground truth, queues, splits.

A label record has ``session_id, annotator_type, annotator_id, label_status,
has_failure, code, onset_step, severity, confidence, is_latent, updated_at, seq``;
``seq`` is its position in the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.operators.stats import first_by
from trajlens.sequence import number_rows

# Statuses, layers and how far each is trusted.
AUTHORITY = {"adjudicated": 4, "human_reviewed": 3, "auto_labeled": 2, "unlabeled": 1}
TRUST = {"adjudicated": 4, "human": 3, "auto": 2, "detector": 1}
TRUSTED = ("human_reviewed", "adjudicated")
STATUSES = ("unlabeled", "auto_labeled", "human_reviewed", "adjudicated", "held_out_test")
LAYERS = ("detector", "auto", "human", "adjudicated")
SYMPTOM, CAUSES = "premature_termination", ("stall", "error_cascade")


def rank_of(value: Column, table: dict[str, int]) -> Column:
    chain = F
    for k, v in table.items():
        chain = chain.when(value == k, v)
    return chain.otherwise(0)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def with_canonical(records: DataFrame, prefix: int = 8) -> DataFrame:
    """The records with ``canonical_id`` and whether the id is an ambiguous short form.

    Full ids stay apart, whatever they begin with. A bare id of ``prefix``
    characters stands for the one full id that begins with it; where several do,
    it is ``ambiguous`` and stays itself.
    """
    full = records.select("session_id").distinct().where(F.length("session_id") > prefix)
    named = full.groupBy(F.substring("session_id", 1, prefix).alias("_short")).agg(F.count("*").alias("_full"), F.max("session_id").alias("_only"))
    joined = records.join(named, F.col("session_id") == F.col("_short"), "left")
    return joined.withColumns({
        "canonical_id": F.when(F.col("_full") == 1, F.col("_only")).otherwise(F.col("session_id")),
        "ambiguous": F.coalesce(F.col("_full") > 1, F.lit(False))}).drop("_short", "_full", "_only")


def canonical_ids(df: DataFrame, prefix: int = 8) -> DataFrame:
    """Each session's canonical id, how many written forms it has and whether it is an ambiguous short form."""
    return with_canonical(df.select("session_id"), prefix).groupBy("canonical_id").agg(
        F.count_distinct("session_id").alias("ids"), F.bool_or("ambiguous").alias("ambiguous"))


def ground_truth(records: DataFrame, prefix: int = 8) -> DataFrame:
    """Failures that may serve as truth, one per session and failure.

    A session whose most trusted record is a human or adjudicated "clean" has none.
    Unlabeled detector output never counts. Everything is picked by aggregation per
    session, so one session with very many records needs no sort.
    """
    keyed = with_canonical(records, prefix).withColumn("_auth", rank_of(F.col("label_status"), AUTHORITY))
    best = first_by(keyed.select("canonical_id", "_auth", "seq", "label_status", "annotator_type", "has_failure"),
                    ["canonical_id"], [-F.col("_auth"), F.col("seq")])
    clean = best.where(F.col("label_status").isin(*TRUSTED) & F.col("annotator_type").isin("human", "adjudicated")
                       & ~F.col("has_failure")).select("canonical_id")
    usable = keyed.where(
        F.col("has_failure") & F.col("label_status").isin(*TRUSTED, "auto_labeled") & (F.coalesce("code", F.lit("")) != ""))
    kept = usable.join(clean, "canonical_id", "left_anti")
    one = first_by(kept.select("canonical_id", "code", "_auth", "seq", "onset_step", "is_latent", "label_status"),
                   ["canonical_id", "code"], [-F.col("_auth"), F.col("seq")])
    return one.select(F.col("canonical_id").alias("session_id"), "code", "onset_step", "is_latent",
                      (F.col("label_status") == "auto_labeled").alias("is_draft"))


def best_labels(records: DataFrame) -> DataFrame:
    """The most trusted record per session, the first of the ledger among equals."""
    ranked = records.withColumn("_trust", rank_of(F.col("annotator_type"), TRUST))
    best = first_by(ranked, ["session_id"], [-F.col("_trust"), F.col("seq")])
    return best.drop("_trust")


def layers(records: DataFrame) -> DataFrame:
    """One row per session with each layer's newest record side by side."""
    newest = latest(records.select("session_id", "annotator_type", "has_failure", "code", "onset_step", "severity",
                                   "updated_at", "seq"), ["session_id", "annotator_type"], "updated_at", "seq")
    cell = F.struct("has_failure", "code", "onset_step", "severity")
    return newest.groupBy("session_id").pivot("annotator_type", list(LAYERS)).agg(F.first(cell))


def disagreements(side: DataFrame) -> DataFrame:
    """Where layers differ on failure or code, and by how much on onset and severity."""
    def differs(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        unlike = (F.col(f"{a}.has_failure") != F.col(f"{b}.has_failure")) | (F.col(f"{a}.code") != F.col(f"{b}.code"))
        return F.when(both, unlike)

    pairs = {"detector_auto": ("detector", "auto"), "auto_human": ("auto", "human"),
             "human_adjudicated": ("human", "adjudicated"), "detector_human": ("detector", "human")}
    flags = {n: differs(*p) for n, p in pairs.items()}
    total = F.lit(0)
    for c in flags.values():
        total = total + F.coalesce(c.cast("int"), F.lit(0))
    a, h = F.col("auto.onset_step"), F.col("human.onset_step")
    return side.select(
        "session_id", *[c.alias(n) for n, c in flags.items()], total.alias("total_disagreements"),
        F.when(a.isNotNull() & h.isNotNull(), F.when((a != 0) & (h != 0), F.abs(a - h)).otherwise(0)).alias("onset_delta"),
        F.abs(F.col("auto.severity") - F.col("human.severity")).alias("severity_delta"))


def priority_queue(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions by how urgently they need a label."""
    failed = F.col("has_failure")
    named = records.where(failed & (F.coalesce("code", F.lit("")) != ""))
    per_code = named.groupBy("code").agg(F.count("*").alias("n"))
    novelty = named.select("session_id", "code").distinct().join(per_code, "code").groupBy("session_id").agg(
        F.max(F.when(F.col("n") <= 2, 5.0).when(F.col("n") <= 5, 2.0).otherwise(0.0)).alias("novelty"))
    per = records.groupBy("session_id").agg(
        F.bool_or(F.col("label_status") == "adjudicated").alias("_done"),
        F.coalesce(F.max(F.when(failed, F.col("severity"))), F.lit(0)).alias("_severity"),
        F.min(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("_confidence"),
        F.bool_or(F.col("annotator_type").isin("human", "adjudicated")).alias("_human"))
    scored = per.join(disagreements(layers(records)).select("session_id", "total_disagreements"), "session_id").join(
        novelty, "session_id", "left").select(
        "session_id", "_done", (F.col("_severity") * 2.0).alias("severity"),
        F.coalesce((5 - F.col("_confidence")) * 2.0, F.lit(6.0)).alias("uncertainty"),
        (F.col("total_disagreements") * 3.0).alias("disagreement"), F.coalesce("novelty", F.lit(0.0)).alias("novelty"),
        F.when(F.col("_human"), 0.0).otherwise(4.0).alias("unreviewed"))
    score = F.col("severity") + F.col("uncertainty") + F.col("disagreement") + F.col("novelty") + F.col("unreviewed")
    queue = scored.where(~F.col("_done")).withColumn("score", score).where("score > 0").drop("_done")
    return queue.orderBy(F.desc("score"), "session_id").limit(limit) if limit else queue


def issues(records: DataFrame, codes: list[str]) -> DataFrame:
    """Records with the list of what is wrong with them."""
    failed = F.col("has_failure")
    code = F.coalesce("code", F.lit(""))
    found = F.array(
        F.when(F.coalesce("session_id", F.lit("")) == "", "missing session"),
        F.when(~F.col("annotator_type").isin(*LAYERS), "unknown annotator type"),
        F.when(~F.col("label_status").isin(*STATUSES), "unknown status"),
        F.when(failed & (code == ""), "failure without code"),
        F.when(failed & (code != "") & ~code.isin(*codes), "unknown code"),
        F.when(failed & ~F.col("severity").between(1, 5), "severity out of range"),
        F.when(failed & ~F.col("confidence").between(1, 5), "confidence out of range"))
    listed = F.filter(found, lambda x: x.isNotNull())
    return records.select("session_id", "seq", F.array_join(listed, "; ").alias("issues")).where(F.col("issues") != "")


def quality_report(records: DataFrame, prefix: int = 8, dominant: float = 0.5, enough: int = 10) -> DataFrame:
    """Ledger-wide warnings: circular, conflicting, draft-only and mixed-id sessions, one code that outweighs the rest, too few reviews.

    ``imbalanced_code`` is the code of more than ``dominant`` of the failure
    records of sessions that no trusted record calls clean; ``low_sample`` says
    that fewer than ``enough`` records are reviewed or adjudicated.
    """
    trusted = F.col("label_status").isin(*TRUSTED)
    keyed = with_canonical(records, prefix)
    per = keyed.groupBy("canonical_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("annotator_type") == "detector").alias("detector_only"),
        F.bool_or(trusted & ~F.col("has_failure")).alias("_clean"), F.bool_or(trusted & F.col("has_failure")).alias("_bad"),
        F.bool_or(F.col("label_status") == "auto_labeled").alias("_draft"), F.bool_or(trusted).alias("_trusted"),
        F.count(F.when(trusted, 1)).alias("_reviewed"), F.count_distinct("session_id").alias("_ids"))
    codes = keyed.where("has_failure").join(per.where("_clean").select("canonical_id"), "canonical_id", "left_anti").groupBy("code").agg(
        F.count("*").alias("_n")).agg(F.max_by("code", "_n").alias("_code"), F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))
    report = per.agg(
        F.sum("n").alias("records"), F.count("*").alias("sessions"), n(F.col("detector_only")).alias("detector_only"),
        n(F.col("_clean") & F.col("_bad")).alias("conflicting"), n(F.col("_draft") & ~F.col("_trusted")).alias("draft_only"),
        n(F.col("_ids") > 1).alias("mixed_ids"), n(F.col("_trusted")).alias("trusted"),
        (F.coalesce(F.sum("_reviewed"), F.lit(0)) < enough).alias("low_sample")).withColumn("_one", F.lit(1))
    heavy = codes.select(F.when(F.col("_most") > dominant * F.col("_all"), F.col("_code")).alias("imbalanced_code"), F.lit(1).alias("_one"))
    return report.join(heavy, "_one").drop("_one")


def truth_records(traces: DataFrame, codes: DataFrame, annotator: str = "manual") -> DataFrame:
    """Truth per trace as label records: one per detailed failure, else one per named failure, else one clean record.

    ``traces`` has ``session_id, completed, failures`` (names) and ``details``
    (structs of ``code, onset_step, severity, confidence, rationale``, whose
    fields may be null); ``codes`` maps ``failure`` to ``code``, and an unknown
    name gets an empty code. Null lists are empty.
    """
    kind = "array<struct<name: string, code: string, onset_step: int, severity: int, confidence: int, rationale: string>>"
    names, details = F.coalesce("failures", F.array().cast("array<string>")), F.coalesce("details", F.filter("details", lambda d: F.lit(False)))
    detailed = F.transform(details, lambda d: F.struct(
        F.lit(None).cast("string").alias("name"), F.coalesce(d["code"], F.lit("")).alias("code"), F.coalesce(d["onset_step"], F.lit(0)).cast("int").alias("onset_step"),
        F.coalesce(d["severity"], F.lit(3)).cast("int").alias("severity"), F.coalesce(d["confidence"], F.lit(3)).cast("int").alias("confidence"),
        F.coalesce(d["rationale"], F.lit("")).alias("rationale"))).cast(kind)
    named = F.transform(names, lambda n: F.struct(
        n.alias("name"), F.lit(None).cast("string").alias("code"), F.lit(0).alias("onset_step"), F.lit(3).alias("severity"), F.lit(3).alias("confidence"),
        F.concat(F.lit("From ground truth actual_failures: "), n).alias("rationale"))).cast(kind)
    clean = F.array(F.struct(
        F.lit(None).cast("string").alias("name"), F.lit("").alias("code"), F.lit(0).alias("onset_step"), F.lit(0).alias("severity"), F.lit(5).alias("confidence"),
        F.concat(F.lit("Clean trace. Completed="), F.when(F.coalesce("completed", F.lit(True)), "True").otherwise("False")).alias("rationale"))).cast(kind)
    some = F.size(names) > 0
    rows = traces.select("session_id", some.alias("has_failure"), F.inline(F.when(~some, clean).when(F.coalesce(F.size(details), F.lit(0)) > 0, detailed).otherwise(named)))
    return rows.join(codes.select(F.col("failure").alias("name"), F.col("code").alias("_code")), "name", "left").select(
        "session_id", F.lit("human").alias("annotator_type"), F.lit(annotator).alias("annotator_id"), F.lit("human_reviewed").alias("label_status"), "has_failure",
        F.coalesce("code", "_code", F.lit("")).alias("code"), "onset_step", "severity", "confidence", "rationale")


def ledger_stats(records: DataFrame) -> DataFrame:
    """Counts by annotator, status and code in one pass."""
    failed = F.when(F.col("has_failure"), F.col("code"))
    rows = records.select(F.inline(F.array(
        F.struct(F.lit("annotator").alias("kind"), F.col("annotator_type").alias("name")),
        F.struct(F.lit("status").alias("kind"), F.col("label_status").alias("name")),
        F.struct(F.lit("code").alias("kind"), failed.alias("name"))))).where(F.col("name").isNotNull())
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


def size_splits(sizes: DataFrame, ident: str, size: str, dev: int, val: int) -> DataFrame:
    """dev / val / test by size, largest first."""
    ordered = number_rows(sizes.withColumns({"_all": F.lit(1), "_minus": -F.col(size)}), ["_all"], ["_minus", ident], "rank")
    at = F.col("rank")
    return ordered.result().select(ident, size, "rank", F.when(at <= dev, "dev").when(at <= dev + val, "val").otherwise("test").alias("split"))


def proportional_splits(ids: DataFrame, ident: str, shares: tuple[tuple[str, float], ...]) -> DataFrame:
    """Splits of the sorted ids in proportion to ``shares``."""
    ordered = number_rows(ids.withColumn("_all", F.lit(1)), ["_all"], [ident], "rank").result()
    total = ids.count()
    chain, upto = F, 0
    for name, share in shares[:-1]:
        upto += int(total * share)
        chain = chain.when(F.col("rank") <= upto, name)
    return ordered.select(ident, "rank", chain.otherwise(shares[-1][0]).alias("split"))


def stratified_folds(df: DataFrame, ident: str, stratum: str, k: int, seed: int) -> DataFrame:
    """Round-robin folds per stratum in an order that depends on the id only."""
    keyed = df.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")), 256))
    ordered = number_rows(keyed, [stratum], ["_h", ident], "_pos").result()
    return ordered.select(ident, stratum, ((F.col("_pos") - 1) % k).alias("fold"))


def diverse_selection(df: DataFrame, ident: str, bucket: str, project: str, size: str, limit: int) -> DataFrame:
    """Round-robin over projects within buckets, largest first.

    Spark keeps only the first ``limit`` rows of a (bucket, project) before it
    shuffles, since no later row can be selected.
    """
    w = Window.partitionBy(bucket, project).orderBy(F.desc(size), ident)
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit)
    pick = Window.partitionBy(bucket).orderBy("_rank", project, ident)
    return ranked.withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= limit).select(
        ident, bucket, project, size, "pick")


def promoted(cases: DataFrame) -> DataFrame:
    """First case of each failure per session, and every critical one."""
    firsts = cases.groupBy("session_id", "failure").agg(F.min("seq").alias("_first"))
    return cases.join(firsts, ["session_id", "failure"]).where(
        (F.col("seq") == F.col("_first")) | (F.col("severity") == "critical")).drop("_first")


def false_positive_rates(cases: DataFrame) -> DataFrame:
    """Share of reviewed cases per failure that a reviewer rejected."""
    return cases.groupBy("failure").agg(
        F.count(F.when(F.col("status") == "false_positive", 1)).alias("false_positive"),
        F.count(F.when(F.col("status") == "confirmed", 1)).alias("confirmed"),
        F.count(F.when(F.col("status") == "predicted", 1)).alias("predicted")).withColumn(
        "fp_rate", F.when(F.col("false_positive") + F.col("confirmed") > 0, F.round(
            F.col("false_positive") / (F.col("false_positive") + F.col("confirmed")), 6)))


def discounted(found: DataFrame, rates: DataFrame) -> DataFrame:
    """Confidence lowered by half the failure's false-positive rate."""
    rate = F.coalesce("fp_rate", F.lit(0.0))
    return found.join(rates.select("failure", "fp_rate"), "failure", "left").withColumn(
        "adjusted", F.round(F.col("confidence") * (1 - 0.5 * rate), 4)).drop("fp_rate")
