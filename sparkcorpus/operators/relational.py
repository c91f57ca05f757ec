"""Small relational operators that the flows share: top-k, windows, budgets, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def optional(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; a value of None asks for nothing."""
    for name, value in equal.items():
        df = df if value is None else df.filter(F.col(name) == value)
    return df


def in_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")


def without_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows whose key is not in the list; an empty list excludes nothing."""
    return df.filter(~F.col(key).isin(*ids)) if ids else df


def between_ids(df: DataFrame, after: int, upto: int, key: str = "id") -> DataFrame:
    return df.filter((F.col(key) > after) & (F.col(key) <= upto))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Orders end with a key, so that ties do not depend on the plan."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: list[str], k: int, *order: Column, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def mode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group, ties to the smallest; null is no value."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    return top_per_group(n, group, 1, F.desc("n"), F.asc(value), name="__rn").drop("__rn")


def first_wins(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return top_per_group(df, key, 1, *order, name="__rn").drop("__rn")


def middle_slice(df: DataFrame, group: list[str], order: str, low: int, high: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(order))).filter(F.col("rn").between(low, high))


def sample_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """A sample that any run repeats: the first n by the MD5 of their key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def prefix_within(df: DataFrame, group: list[str], order: list[Column], cost: Column, budget: float, running: str = "used") -> DataFrame:
    """Rows of each group in order, up to the first that would exceed the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(running, F.sum(cost).over(w)).filter(F.col(running) <= budget)


def lines_within(df: DataFrame, group: list[str], order: list[Column], line: str, budget: int) -> DataFrame:
    """Lines of each group while the text so far, with its newlines, and the next line fit the budget."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.length(line) + 1).over(before), F.lit(0)) + F.length(line)
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__size", size).withColumn("__most", F.max("__size").over(upto)).filter(F.col("__most") <= budget).drop("__size", "__most")


def upsert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` that may be appended: the first of each key that `old` does not have."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def delete(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return df.join(keys.select(*key), key, "left_anti")


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()})


def replace_documents(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Whole documents: what `new` has of a document replaces all that `old` has of it."""
    return old.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new, allowMissingColumns=True)


def runs(df: DataFrame, group: list[str], order: str, label: str) -> DataFrame:
    """Islands of equal neighbours: (group, run, label, first, last, n)."""
    w = Window.partitionBy(*group).orderBy(order)
    marked = df.withColumn("__new", F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1)))
    marked = marked.withColumn("run", F.sum("__new").over(w))
    return marked.groupBy(*group, "run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def same_source(docs: DataFrame) -> DataFrame:
    """Of documents with one URL (or else name), the one with most chunks, uploaded first."""
    key = F.coalesce(F.nullif(F.trim("source_url"), F.lit("")), F.col("name"))
    rows = docs.withColumn("__key", key)
    return first_wins(rows, ["__key"], F.desc("chunk_count"), F.asc("uploaded_at"), F.asc("id")).drop("__key")
