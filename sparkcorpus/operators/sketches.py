"""Stored sketches of the files of a table: distinct counts, quantiles and moments that merge, so that an added file costs only itself.

A sketch row belongs to one file and one group of it and has a fixed size; any coarser grouping is a merge of rows, without
the table.  A file is known by its path, size and time of change: changed files are sketched again, and the sketches of files that are gone
are left out of merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2^LG registers of a distinct count; size of a quantile sketch.
LG, K = 14, 800
STAMP = ["file_path", "file_size", "file_modification_time"]


def distinct_error(lg: int = LG) -> float:
    """Relative standard error of a distinct count, after merges too."""
    return 1.04 / 2 ** (lg / 2)


def rank_error(k: int = K) -> float:
    """By how much the rank of a quantile may be off, as a share of all rows, in 99 of 100 sketches."""
    return 2.296 / k**0.9021


def sketched(rows: DataFrame, groups: list[str], item: Column, value: Column, lg: int = LG, k: int = K) -> DataFrame:
    """(*groups, n, n_values, low, high, total, squares, items, spread): moments, distinct count and quantile sketch of each group.

    Null items and values are not counted, except in n; totals beyond 38 digits are null.  Spark combines sketches in each
    task before the shuffle, so a group may hold any share of the rows.
    """
    v = value.cast("long")
    whole = v.cast("decimal(38,0)")
    moments = [F.count("*").alias("n"), F.count(v).alias("n_values"), F.min(v).alias("low"), F.max(v).alias("high"), F.try_sum(whole).alias("total"), F.try_sum((whole * whole).cast("decimal(38,0)")).alias("squares")]
    items = F.hll_sketch_agg(F.when(item.isNotNull(), F.xxhash64(item)), lg)
    return rows.groupBy(*groups).agg(*moments, items.alias("items"), F.kll_sketch_agg_bigint(v, k).alias("spread"))


def merged(sketches: DataFrame, groups: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups, or of all rows."""
    moments = [F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.min("low").alias("low"), F.max("high").alias("high")]
    # a total that is null although there are values was too long, and stays so
    lost = lambda c: F.bool_or(F.col(c).isNull() & (F.col("n_values") > 0))
    sums = [F.when(~lost(c), F.try_sum(c)).cast("decimal(38,0)").alias(c) for c in ("total", "squares")]
    return sketches.groupBy(*groups).agg(*moments, *sums, F.hll_union_agg("items").alias("items"), F.kll_merge_agg_bigint("spread", k).alias("spread"))


def statistics(sketches: DataFrame, groups: list[str], shares: tuple[float, ...] = (0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """(*groups, n, n_values, low, high, total, mean, deviation, distinct, quantiles): what sketches tell; quantiles is a map of share to value.

    Without values, what is told of them is null.
    """
    some = F.col("n_values") > 0
    mean = F.col("total").cast("double") / F.col("n_values")
    # n * sum(x^2) - sum(x)^2 in whole numbers, so that values close to one another lose no digits; doubles where these are too long
    n = F.col("n_values").cast("decimal(20,0)")
    whole = F.try_subtract(F.try_multiply(n, F.col("squares")), F.try_multiply("total", F.col("total"))).cast("double") / F.col("n_values") / F.col("n_values")
    spread = F.coalesce(whole, F.col("squares").cast("double") / F.col("n_values") - mean * mean)
    deviation = F.when(spread.isNotNull(), F.sqrt(F.greatest(spread, F.lit(0.0))))
    quantiles = F.create_map(*[x for s in shares for x in (F.lit(s), F.kll_sketch_get_quantile_bigint("spread", F.lit(s)))])
    told = [F.when(some, x).alias(name) for x, name in ((mean, "mean"), (deviation, "deviation"))]
    return sketches.select(*groups, "n", "n_values", "low", "high", "total", *told, F.hll_sketch_estimate("items").alias("distinct"), F.when(some, quantiles).alias("quantiles"))


class FileSketches:
    """The sketches of a table's files, appended to a table of their own.

    `refresh` reads only files that have no sketch yet.  Should two runs sketch a file at once, readers take one of the two.
    """

    def __init__(self, spark: SparkSession, path: str, groups: list[str], item: Column, value: Column, lg: int = LG, k: int = K):
        self.spark, self.path, self.groups, self.item, self.value, self.lg, self.k = spark, path.rstrip("/"), groups, item, value, lg, k

    @staticmethod
    def files(table: DataFrame) -> DataFrame:
        """Path, size and time of the files of a table; no column is read for it.  Files without rows are left out."""
        return table.select(*[f"_metadata.{c}" for c in STAMP]).distinct()

    def stored(self) -> DataFrame | None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)
        return self.spark.read.parquet(self.path) if there else None

    def refresh(self, table: DataFrame) -> list[str]:
        """Sketch the files of `table` that are new or changed; returns their paths, as many as files."""
        stored, now = self.stored(), self.files(table)
        new = now if stored is None else now.join(stored.select(*STAMP).distinct(), STAMP, "left_anti")
        paths = sorted(r["file_path"] for r in new.select("file_path").collect())
        if paths:
            rows = table.select(*self.groups, self.item.alias("__item"), self.value.alias("__value"), *[f"_metadata.{c}" for c in STAMP])
            rows = rows if stored is None else rows.filter(F.col("file_path").isin(paths))  # Spark does not open other files
            sketched(rows, [*STAMP, *self.groups], F.col("__item"), F.col("__value"), self.lg, self.k).write.mode("append").parquet(self.path)
        return paths

    def statistics(self, table: DataFrame, groups: list[str], shares: tuple[float, ...] = (0.1, 0.5, 0.9, 0.99)) -> DataFrame:
        """Statistics of the files that `table` has now, by some of the groups."""
        stored = self.stored()
        if stored is None:
            raise ValueError(f"no sketches at {self.path}: refresh first")
        current = stored.join(self.files(table), STAMP, "left_semi").dropDuplicates([*STAMP, *self.groups])
        return statistics(merged(current, groups, self.k), groups, shares)
