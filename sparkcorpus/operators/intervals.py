"""Joins of points and half-open spans [lo, hi) of whole numbers within a key.

A span is at home in cells of the least power of two that is not shorter than itself, two of them at most.  A point, or a
shorter span, looks into its own cells of each size that spans have.  So rows meet by equality of key,
size and cell: a key with very many spans is as many groups as it has cells, and rows that meet lie near each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(lo: Column, hi: Column) -> Column:
    """The power of two of a span's home cells; null for empty spans."""
    return F.when(hi > lo, F.length(F.bin(hi - lo - 1)))


def cells(lo: Column, hi: Column, size: Column) -> Column:
    """Numbers of the cells of 2**size that [lo, hi) reaches into."""
    return F.sequence(F.floor(lo / F.pow(F.lit(2.0), size)), F.floor((hi - 1) / F.pow(F.lit(2.0), size)))


def levels_of(spans: DataFrame, lo: str, hi: str) -> list[int]:
    """The sizes that spans have, 64 at most."""
    return sorted(r[0] for r in spans.select(level(F.col(lo), F.col(hi))).distinct().collect() if r[0] is not None)


def at_home(spans: DataFrame, lo: str, hi: str) -> DataFrame:
    size = level(F.col(lo), F.col(hi))
    return spans.withColumn("__size", size).filter("__size is not null").withColumn("__cell", F.explode(cells(F.col(lo), F.col(hi), F.col("__size"))))


def renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})


def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a and b of equal keys, size and cell, with a's keys."""
    same = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    right = renamed(b, keys).withColumnsRenamed({"__size": "__s", "__cell": "__c"})
    return a.join(right, on & (F.col("__size") == F.col("__s")) & (F.col("__cell") == F.col("__c"))).drop("__s", "__c", *[f"__k{i}" for i in range(len(keys))])


def containing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Points with each span of their keys that they lie in.  Null keys and positions meet nothing; other columns have different names."""
    sizes = levels_of(spans, lo, hi)
    looks = points.filter(F.col(at).isNotNull()).withColumn("__size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    looks = looks.withColumn("__cell", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("__size"))))
    found = met(looks, at_home(spans, lo, hi), keys).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)))
    return found.drop("__size", "__cell")  # a point lies in one cell of a size


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> DataFrame:
    """Pairs of spans of equal keys that have a place in common; empty spans have none.

    The longer one is met at home, the shorter looks in; both in the cell in which what they share begins, so once.
    """
    sizes = sorted({*levels_of(a, a_lo, a_hi), *levels_of(b, b_lo, b_hi)})

    def looking(df: DataFrame, lo: str, hi: str, least: int) -> DataFrame:
        """In cells larger than a span's own by `least` steps or more."""
        own = level(F.col(lo), F.col(hi))
        rows = df.filter(own.isNotNull()).withColumn("__size", F.explode(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda s: s >= own + least)))
        return rows.withColumn("__cell", F.explode(cells(F.col(lo), F.col(hi), F.col("__size"))))

    first = F.floor(F.greatest(a_lo, b_lo) / F.pow(F.lit(2.0), F.col("__size"))) == F.col("__cell")
    share = first & (F.col(a_lo) < F.col(b_hi)) & (F.col(b_lo) < F.col(a_hi))
    b_longer = met(looking(a, a_lo, a_hi, 0), at_home(b, b_lo, b_hi), keys).filter(share)
    a_longer = met(at_home(a, a_lo, a_hi), looking(b, b_lo, b_hi, 1), keys).filter(share)
    return b_longer.unionByName(a_longer).drop("__size", "__cell")
