"""Functions on vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero, null if either is null."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 1.0).otherwise(1.0 - dot(a, b) / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column, floor: float = 1e-9) -> Column:
    size = F.greatest(norm(v), F.lit(floor))
    return F.transform(doubles(v), lambda x: x / size)


def score(distance: Column) -> Column:
    return F.lit(1.0) - distance


def encode(v: Column) -> Column:
    """Vector literal `[a,b,...]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def decode(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def centroids(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector of each group (group columns, size, centroid); null vectors do not count."""
    rows = df.filter(F.col(vector).isNotNull()).select(*group, F.posexplode(vector).alias("pos", "x"))
    means = rows.groupBy(*group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(*group).agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def choose_k(n: Column, most: int) -> Column:
    """Clusters for n vectors: round(sqrt(n / 2)), between 2 and the least of `most` and n."""
    return F.greatest(F.lit(2), F.least(F.round(F.sqrt(n / 2.0)).cast("int"), F.lit(most), n.cast("int")))
