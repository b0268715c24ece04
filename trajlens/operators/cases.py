"""Look-ups in the case memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(cases: DataFrame, vector: str, query: list[float], ident: str, k: int) -> DataFrame:
    """The k cases most similar to one query vector; each partition keeps its own k first."""
    given = F.array(*[F.lit(x) for x in query])

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    norm = sum(x * x for x in query) ** 0.5
    own = F.col(vector)
    cosine = dot(own, given) / (F.sqrt(dot(own, own)) * norm)
    ranked = cases.withColumn("_c", cosine).orderBy(F.desc(F.round("_c", 9)), ident).limit(k)
    return ranked.withColumn("similarity", F.round("_c", 6)).drop("_c")
