"""Rater agreement over the label, document and rating-ledger bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions import text as tx
from trajlens.operators import agreement as ag
from trajlens.operators import ranktests as rt
from trajlens.operators import stats
from trajlens.plans.registry import query
from trajlens.plans.sqltext import B6, b1
from trajlens.sources import bind

LATEST = B6 + """,
latest AS (SELECT * FROM b6 QUALIFY row_number() OVER (PARTITION BY session_id, rater, dimension ORDER BY ts DESC, event_id DESC) = 1)"""


def latest(spark, sf_dir):
    newest = F.struct("ts", "event_id")
    return bind.ratings(spark, sf_dir).groupBy("session_id", "rater", "dimension").agg(
        F.max_by(F.struct("value", "confidence", "ts"), newest).alias("r")).select(
        "session_id", "rater", "dimension", "r.*")


def label_pairs(spark, sf_dir):
    docs = bind.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = bind.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return labels.join(docs, "doc_id")


KAPPA = """, n AS (SELECT {g} AS g, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM {t} GROUP BY ALL),
m AS (SELECT g, sum(pa * pb) AS pe, count(*) AS k FROM (
   SELECT g, v, sum(ia) / sum(sum(ia)) OVER (PARTITION BY g) AS pa, sum(ib) / sum(sum(ib)) OVER (PARTITION BY g) AS pb FROM (
     SELECT {g} AS g, a AS v, 1 AS ia, 0 AS ib FROM {t} UNION ALL SELECT {g}, b, 0, 1 FROM {t}) GROUP BY g, v) GROUP BY g)"""


@query("kappa_by_language", f"""WITH p AS (SELECT lang, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)){KAPPA.format(g='lang', t='p')}
SELECT g AS lang, n, round(po, 6) AS agreement, round(CASE WHEN k < 2 OR pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa
FROM n JOIN m USING (g)""")
def kappa_by_language(spark, sf_dir):
    return ag.cohens_kappa(label_pairs(spark, sf_dir), ["lang"], "a", "b")


@query("kappa_bands", f"""WITH p AS (SELECT source, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)){KAPPA.format(g='source', t='p')}
SELECT source, kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa < 0.21 THEN 'slight' WHEN kappa < 0.41 THEN 'fair'
  WHEN kappa < 0.61 THEN 'moderate' WHEN kappa < 0.81 THEN 'substantial' ELSE 'almost perfect' END AS band
FROM (SELECT g AS source, round(CASE WHEN k < 2 OR pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM n JOIN m USING (g))""")
def kappa_bands(spark, sf_dir):
    k = ag.cohens_kappa(label_pairs(spark, sf_dir), ["source"], "a", "b")
    return k.select("source", "kappa", tx.kappa_band(F.col("kappa")).alias("band"))


PAIRS = LATEST + """, pr AS (SELECT x.dimension, x.rater AS rater_a, y.rater AS rater_b, x.value AS a, y.value AS b
  FROM latest x JOIN latest y ON x.session_id = y.session_id AND x.dimension = y.dimension AND x.rater < y.rater)"""


@query("rater_pair_counts", f"""WITH {PAIRS}
SELECT dimension, rater_a, rater_b, a AS value_a, b AS value_b, count(*) AS n FROM pr GROUP BY ALL""")
def rater_pair_counts(spark, sf_dir):
    return ag.rater_pairs(latest(spark, sf_dir), ["session_id", "dimension"], ["dimension"], "rater", "value")


# Ratings in which raters disagree: the value follows the confidence, not the dimension.
B6V = B6.replace("1 + k % 5 AS value", "1 + (k // 5) % 5 AS value")
PAIRS_V = PAIRS.replace(B6, B6V)


def varied(spark, sf_dir):
    ev = bind.raw_events(spark, sf_dir)
    rows = ev.select((F.col("user_id") % 40).alias("session_id"), F.col("event_type").alias("rater"),
                     (F.col("k") % 5).alias("dimension"), (1 + F.floor(F.col("k") / 5) % 5).alias("value"),
                     (F.col("k") % 4).alias("confidence"), "ts", "event_id")
    return rows.groupBy("session_id", "rater", "dimension").agg(
        F.max_by(F.struct("value", "confidence"), F.struct("ts", "event_id")).alias("r")).select(
        "session_id", "rater", "dimension", "r.*")


LINEAR = """, v AS (SELECT DISTINCT dimension, rater_a, rater_b, unnest([a, b]) AS v FROM pr),
ix AS (SELECT *, row_number() OVER (PARTITION BY dimension, rater_a, rater_b ORDER BY v) AS i, count(*) OVER (PARTITION BY dimension, rater_a, rater_b) AS k FROM v),
ob AS (SELECT dimension, rater_a, rater_b, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(abs(p.i - q.i)) AS num
  FROM pr JOIN ix p USING (dimension, rater_a, rater_b) JOIN ix q USING (dimension, rater_a, rater_b) WHERE p.v = a AND q.v = b GROUP BY ALL),
ma AS (SELECT dimension, rater_a, rater_b, a AS v, count(*) AS c FROM pr GROUP BY ALL),
mb AS (SELECT dimension, rater_a, rater_b, b AS v, count(*) AS c FROM pr GROUP BY ALL),
ex AS (SELECT dimension, rater_a, rater_b, sum(abs(p.i - q.i) * ma.c * mb.c) AS den
  FROM ma JOIN mb USING (dimension, rater_a, rater_b) JOIN ix p USING (dimension, rater_a, rater_b) JOIN ix q USING (dimension, rater_a, rater_b)
  WHERE p.v = ma.v AND q.v = mb.v GROUP BY ALL),
k AS (SELECT DISTINCT dimension, rater_a, rater_b, k FROM ix)"""


@query("rater_pair_kappa", f"""WITH {PAIRS_V}{LINEAR}
SELECT dimension, rater_a, rater_b, n, round(po, 6) AS agreement,
  round(CASE WHEN k < 2 OR den = 0 THEN 1.0 ELSE 1 - num / (den / (n * n)) END, 6) AS kappa
FROM ob JOIN ex USING (dimension, rater_a, rater_b) JOIN k USING (dimension, rater_a, rater_b)""")
def rater_pair_kappa(spark, sf_dir):
    pairs = ag.rater_pairs(varied(spark, sf_dir), ["session_id", "dimension"], ["dimension"], "rater", "value")
    return ag.cohens_kappa(pairs, ["dimension", "rater_a", "rater_b"], "value_a", "value_b", "n", linear=True)


ALPHA = """, ix AS (SELECT dimension, value, row_number() OVER (PARTITION BY dimension ORDER BY value) - 1 AS i FROM (SELECT DISTINCT dimension, value FROM lv)),
r AS (SELECT lv.*, i FROM lv JOIN ix USING (dimension, value)),
o AS (SELECT x.dimension, avg({d}) AS ob, count(DISTINCT x.session_id) AS items FROM r x JOIN r y
   ON x.dimension = y.dimension AND x.session_id = y.session_id AND x.rater <> y.rater GROUP BY x.dimension),
e AS (SELECT x.dimension, sum({d}) AS ex, any_value(n) AS n FROM r x JOIN r y ON x.dimension = y.dimension
   JOIN (SELECT dimension, count(*) AS n FROM r GROUP BY dimension) c ON c.dimension = x.dimension GROUP BY x.dimension)
SELECT dimension, items, n AS ratings, round(CASE WHEN ex = 0 THEN 1.0 ELSE 1 - ob / (ex / (n * (n - 1))) END, 6) AS alpha FROM o JOIN e USING (dimension)"""


@query("alpha_ordinal", "WITH " + LATEST.replace(B6, B6V) + ", lv AS (SELECT * FROM latest)" + ALPHA.format(d="(x.i - y.i) * (x.i - y.i)"))
def alpha_ordinal(spark, sf_dir):
    return ag.krippendorff_alpha(varied(spark, sf_dir), ["dimension"], "session_id", "value")


@query("alpha_nominal", "WITH " + LATEST.replace(B6, B6V) + ", lv AS (SELECT * FROM latest WHERE confidence >= 2)" + ALPHA.format(d="CASE WHEN x.i = y.i THEN 0.0 ELSE 1.0 END"))
def alpha_nominal(spark, sf_dir):
    sure = varied(spark, sf_dir).where("confidence >= 2")
    return ag.krippendorff_alpha(sure, ["dimension"], "session_id", "value", ordinal=False)


@query("ledger_latest", f"WITH {LATEST} SELECT session_id, rater, dimension, value, confidence, ts FROM latest")
def ledger_latest(spark, sf_dir):
    return latest(spark, sf_dir)


@query("rating_coverage", f"""WITH {LATEST.replace(B6, B6V)} SELECT rater, dimension, count(*) AS ratings,
  count(*) FILTER (WHERE value = 5) AS abstained, count(*) FILTER (WHERE value < 5 AND confidence >= 2) AS confident,
  count(*) FILTER (WHERE value = 1) AS v1, count(*) FILTER (WHERE value = 2) AS v2,
  count(*) FILTER (WHERE value = 3) AS v3, count(*) FILTER (WHERE value = 4) AS v4 FROM latest GROUP BY ALL""")
def rating_coverage(spark, sf_dir):
    v = F.when(F.col("value") < 5, F.col("value"))
    rows = varied(spark, sf_dir).withColumn("v", v)
    return rows.groupBy("rater", "dimension").agg(
        F.count("*").alias("ratings"), F.count(F.when(F.col("v").isNull(), 1)).alias("abstained"),
        F.count(F.when(F.col("v").isNotNull() & (F.col("confidence") >= 2), 1)).alias("confident"),
        *[F.count(F.when(F.col("v") == i, 1)).alias(f"v{i}") for i in range(1, 5)])


@query("top_disagreements", f"""WITH {LATEST.replace(B6, B6V)} SELECT session_id, dimension, count(*) AS raters, max(value) - min(value) AS spread
FROM latest GROUP BY ALL HAVING count(*) >= 2 ORDER BY spread DESC, session_id, dimension LIMIT 15""")
def top_disagreements(spark, sf_dir):
    return varied(spark, sf_dir).groupBy("session_id", "dimension").agg(
        F.count("*").alias("raters"), (F.max("value") - F.min("value")).alias("spread")).where(
        "raters >= 2").orderBy(F.desc("spread"), "session_id", "dimension").limit(15)


SP = b1() + """, xy AS (SELECT session_id % 5 AS g, session_id AS id, CAST(count(*) FILTER (WHERE NOT success) AS DOUBLE) AS x,
   CAST(sum(k) % 50 AS DOUBLE) AS y FROM b1 GROUP BY session_id)"""


def xy(spark, sf_dir):
    return bind.raw_events(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.when(F.col("event_type") == "error", 1)).cast("double").alias("x"),
        (F.sum("k") % 50).cast("double").alias("y")).select(
        (F.col("user_id") % 5).alias("g"), F.col("user_id").alias("id"), "x", "y")


@query("spearman_average", f"""WITH {SP}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM xy)
SELECT g, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*) * (count(*) * count(*) - 1)), 6) AS rho_d2 FROM r GROUP BY g""")
def spearman_average(spark, sf_dir):
    return ag.spearman(xy(spark, sf_dir), ["g"], "x", "y", "id")


@query("spearman_ordinal", f"""WITH {SP}, r AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY x, id) AS rx,
  row_number() OVER (PARTITION BY g ORDER BY y, id) AS ry FROM xy)
SELECT g, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*) * (count(*) * count(*) - 1.0)), 6) AS rho_d2 FROM r GROUP BY g""")
def spearman_ordinal(spark, sf_dir):
    return ag.spearman(xy(spark, sf_dir), ["g"], "x", "y", "id", ordinal=True)


@query("cohens_d", f"""WITH {SP}, s AS (SELECT id % 2 AS h, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM xy GROUP BY 1)
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d FROM s a JOIN s b ON a.h = 0 AND b.h = 1""")
def cohens_d(spark, sf_dir):
    even = F.col("id") % 2 == 0
    y = [F.when(even, F.col("y")), F.when(~even, F.col("y"))]
    s = xy(spark, sf_dir).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(y)
                                for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    return s.select(F.round(F.when(pooled < 1e-10, 0.0).otherwise((F.col("m0") - F.col("m1")) / pooled), 6).alias("d"))


@query("kruskal_wallis", f"""WITH {SP}, r AS (SELECT g, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, count(*) OVER () AS n FROM xy),
gs AS (SELECT g, sum(ry) AS s, count(*) AS c, any_value(n) AS n FROM r GROUP BY g), ts AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT count(*) AS t FROM xy GROUP BY y))
SELECT count(*) AS n_groups, round((12.0 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1))
  / (1 - any_value(tie) / (any_value(n) * any_value(n) * any_value(n) - any_value(n))), 6) AS h FROM gs, ts""")
def kruskal_wallis(spark, sf_dir):
    ranked = stats.average_ranks(xy(spark, sf_dir), [], "y", "ry")
    # Groups and values are joined into one row of sums before the formula is applied.
    groups = ranked.groupBy("g").agg(F.sum("ry").alias("s"), F.count("*").alias("c"))
    ties = ranked.groupBy("y").agg(F.count("*").cast("double").alias("t"))
    both = groups.select(F.col("s"), F.col("c"), F.lit(0.0).alias("tie"), F.lit(1).alias("is_group")).unionByName(
        ties.select(F.lit(0.0).alias("s"), F.lit(1).cast("long").alias("c"), (F.pow("t", F.lit(3)) - F.col("t")).alias("tie"),
                    F.lit(0).alias("is_group")))
    n = F.sum(F.when(F.col("is_group") == 1, F.col("c"))).cast("double")
    h = (12 / (n * (n + 1)) * F.sum(F.col("s") * F.col("s") / F.col("c")) - 3 * (n + 1)) / (1 - F.sum("tie") / (n * n * n - n))
    return both.agg(F.sum("is_group").alias("n_groups"), F.round(h, 6).alias("h"))


@query("wilcoxon_signed_rank", f"""WITH {SP}, d AS (SELECT y - x AS d FROM xy WHERE y <> x), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
SELECT count(*) AS n_pairs, sum(r) FILTER (WHERE d > 0) AS w_plus, round((sum(r) FILTER (WHERE d > 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0), 6) AS z FROM r""")
def wilcoxon_signed_rank(spark, sf_dir):
    d = xy(spark, sf_dir).select((F.col("y") - F.col("x")).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = stats.average_ranks(d, [], "size", "r")
    n, w = F.count("*").cast("double"), F.sum(F.when(F.col("d") > 0, F.col("r")))
    return ranked.agg(F.count("*").alias("n_pairs"), w.alias("w_plus"),
                      F.round((w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 6).alias("z"))


def TAIL(z: str) -> str:
    """Upper tail of the standard normal law at ``z``, by the approximation the library takes."""
    poly = "(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))"
    poly = poly.replace("t *", f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) *")
    return f"(CASE WHEN {z} < 0 THEN 1 - 0.5 * {poly} * exp(-({z}) * ({z}) / 2) ELSE 0.5 * {poly} * exp(-({z}) * ({z}) / 2) END)"


@query("wilcoxon_test", f"""WITH {SP}, d AS (SELECT y - x AS d FROM xy), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY abs(d))),
w AS (SELECT (SELECT count(*) FROM d) AS n_pairs, count(*) AS n_used, CAST(coalesce(sum(r) FILTER (WHERE d > 0), 0) AS DOUBLE) AS w_plus, any_value(ties) AS ties FROM r, t),
z AS (SELECT *, (w_plus - n_used * (n_used + 1) / 4.0) / sqrt((n_used * (n_used + 1) * (2 * n_used + 1) - ties / 2.0) / 24.0) AS z FROM w)
SELECT n_pairs, n_used, w_plus, round({TAIL('z')}, 5) AS p_value, {TAIL('z')} < 0.05 AS significant FROM z""")
def wilcoxon_test(spark, sf_dir):
    return rt.wilcoxon(xy(spark, sf_dir), "y", "x")


# The lower incomplete gamma function as its power series.
@query("kruskal_test", f"""WITH {SP}, r AS (SELECT g, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, count(*) OVER () AS n FROM xy),
gs AS (SELECT g, sum(ry) AS s, count(*) AS c, any_value(n) AS n FROM r GROUP BY g), ts AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT count(*) AS t FROM xy GROUP BY y)),
h AS (SELECT count(*) AS n_groups, (12.0 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1))
  / (1 - any_value(tie) / (any_value(n) * any_value(n) * any_value(n) - any_value(n))) AS h FROM gs, ts),
p AS (SELECT *, 1 - list_sum(list_transform(range(0, 300), lambda j: exp(((n_groups - 1) / 2.0 + j) * ln(h / 2) - h / 2 - lgamma((n_groups - 1) / 2.0 + j + 1)))) AS p FROM h)
SELECT n_groups, round(h, 6) AS h, round(p, 5) AS p_value, p < 0.05 AS significant FROM p""")
def kruskal_test(spark, sf_dir):
    return rt.kruskal(xy(spark, sf_dir), "g", "y")


@query("pairwise_mann_whitney", f"""WITH {SP}, pr AS (SELECT a.g AS group_a, b.g AS group_b, sum(CASE WHEN a.y > b.y THEN 1.0 WHEN a.y = b.y THEN 0.5 ELSE 0 END) AS u
    FROM xy a JOIN xy b ON a.g < b.g GROUP BY ALL),
c AS (SELECT g, count(*) AS n FROM xy GROUP BY g), m AS (SELECT count(*) * (count(*) - 1) / 2 AS pairs FROM c),
t AS (SELECT group_a, group_b, sum(k * k * k - k) AS ties FROM (SELECT group_a, group_b, y, count(*) AS k FROM pr JOIN xy ON g IN (group_a, group_b) GROUP BY ALL) GROUP BY ALL),
z AS (SELECT pr.group_a, pr.group_b, CAST(u AS DOUBLE) AS u, greatest(abs(u - a.n * b.n / 2.0) - 0.5, 0) / sqrt(a.n * b.n / 12.0 * (a.n + b.n + 1 - ties / ((a.n + b.n) * (a.n + b.n - 1)))) AS z
  FROM pr JOIN c a ON a.g = group_a JOIN c b ON b.g = group_b JOIN t ON t.group_a = pr.group_a AND t.group_b = pr.group_b),
p AS (SELECT z.*, least(2 * {TAIL('z')}, 1.0) AS p, pairs FROM z, m)
SELECT group_a, group_b, u, round(p, 5) AS p_raw, round(least(p * pairs, 1.0), 5) AS p_adjusted, least(p * pairs, 1.0) < 0.05 AS significant FROM p""")
def pairwise_mann_whitney(spark, sf_dir):
    return rt.pairwise_mann_whitney(xy(spark, sf_dir), "g", "y")
