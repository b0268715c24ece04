"""Information measures as Column expressions.

Sliding measures are kept as sums that change by one term when a symbol enters
the window and by one when a symbol leaves it. The terms are fixed-point integers,
so running sums of them are exact over sessions of any length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stored(value: Column, digits: int = 4) -> Column:
    """Round a metric the way it is kept; the nudge settles ties the same way everywhere."""
    return F.round(value + F.lit(1e-12), digits)


SCALE = 2.0 ** 45


def entropy_gain(count: Column) -> Column:
    """Change of sum(c log2 c) when a count reaches ``count``, in fixed point."""
    c = count.cast("double")
    gain = c * F.log2(c) - (c - 1) * F.log2(c - 1)
    return F.when(count > 1, F.round(gain * SCALE).cast("long")).otherwise(F.lit(0).cast("long"))


def smoothed_gain(count: Column) -> Column:
    """Change of sum((c + 1) log2 (c + 1)) when a count reaches ``count``, in fixed point."""
    return entropy_gain(count + 1)


def entropy_of_sum(total: Column, n: Column) -> Column:
    """Entropy of ``n`` symbols from their fixed-point sum(c log2 c)."""
    value = F.log2(n.cast("double")) - total / SCALE / n
    return F.when(n > 0, F.greatest(value, F.lit(0.0))).otherwise(0.0)


def information_of_sums(left: Column, right: Column, joint: Column, n: Column) -> Column:
    """Mutual information of ``n`` pairs from the sums of both margins and the pairs."""
    value = F.log2(n.cast("double")) - (left + right - joint) / SCALE / n
    return F.when(n > 0, F.greatest(value, F.lit(0.0))).otherwise(0.0)


def entropy(symbols: Column) -> Column:
    """Shannon entropy in bits of the symbols in an array; 0 when it is empty."""
    counts = F.transform(
        F.array_distinct(symbols),
        lambda s: F.size(F.filter(symbols, lambda t: t == s)).cast("double"))
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    n = F.size(symbols)
    return F.when(n > 0, F.greatest(F.log2(n.cast("double")) - weighted / n, F.lit(0.0))).otherwise(0.0)


SEPARATOR = "\u0001"


def packed(symbols: Column) -> Column:
    """The array as one string, the form the compression ratio takes."""
    return F.array_join(symbols, SEPARATOR)


@F.pandas_udf(T.DoubleType())
def lz_ratio(sequences: pd.Series) -> pd.Series:
    """Phrase count of each packed sequence over the count expected of a random one.

    A phrase grows while it occurs wholly inside the part already read. Sequences
    under 20 symbols give 1, a single distinct symbol gives 0.
    """
    import math

    def ratio(text: str) -> float:
        codes: dict[str, str] = {}
        seq = "".join([codes.setdefault(s, chr(48 + len(codes))) for s in text.split(SEPARATOR)])
        n = len(seq)
        if n < 20:
            return 1.0
        kinds = len(codes)
        if kinds < 2:
            return 0.0
        phrases, at = 0, 0
        while at < n:
            size = 1
            while at + size <= n and seq.find(seq[at:at + size], 0, at) >= 0:
                size += 1
            at += max(size - 1, 1)
            phrases += 1
        return min(phrases * math.log2(kinds) / n if n >= math.log2(kinds) else float(phrases), 1.0)

    return sequences.map(ratio).astype("float64")
