"""Versions of a corpus: tables in buckets by document, replaced bucket by bucket, and stamps that name what has changed.

Stamps form a tree of two levels: of documents, which sum hashes of their rows in any order, and of buckets, which sum those of
their documents.  Two versions are compared by buckets first; documents are read only where these differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.store import Steps

BUCKETS = 256


def bucket_of(doc: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc.cast("string")), F.lit(buckets)).cast("int")


def number(*parts: Column) -> Column:
    """60 bits of a hash of values, nulls told from texts, to be summed."""
    text = F.to_json(F.struct(*[p.cast("string").alias(f"c{i}") for i, p in enumerate(parts)]))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def document_stamps(rows: DataFrame, doc: str = "doc_id", columns: list[str] = ("seq", "content"), buckets: int = BUCKETS) -> DataFrame:
    """(bucket, doc, n, h): rows of each document and the sum of their hashes, which is combined in each task first."""
    kept = rows.select(bucket_of(F.col(doc), buckets).alias("bucket"), F.col(doc).alias("doc"), number(*map(F.col, columns)).alias("x"))
    return kept.groupBy("bucket", "doc").agg(F.count("*").alias("n"), F.sum("x").alias("h"))


def bucket_stamps(stamps: DataFrame) -> DataFrame:
    """(bucket, n, h) of document stamps."""
    return stamps.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(number(F.col("doc"), F.col("n"), F.col("h"))).alias("h"))


class Stamped:
    """The stamps of a version, written: documents in a folder a bucket, and buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def write(self, rows: DataFrame, doc: str = "doc_id", columns: list[str] = ("seq", "content")) -> Stamped:
        stamps = document_stamps(rows, doc, columns, self.buckets).select("doc", "n", "h", "bucket")
        self.schema = stamps.schema
        stamps.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/documents")
        bucket_stamps(self.documents()).write.mode("overwrite").parquet(f"{self.path}/buckets")
        return self

    def documents(self, only: list[int] | None = None) -> DataFrame:
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/documents")
        return found if only is None else found.filter(F.col("bucket").isin(only))

    def tops(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/buckets")


def differing(old: Stamped, new: Stamped) -> list[int]:
    """Buckets of which the stamps differ; there are at most as many as buckets."""
    a, b = old.tops(), new.tops().toDF("bucket", "n2", "h2")
    both = a.join(b, "bucket", "full").filter(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("h").eqNullSafe(F.col("h2"))))
    return sorted(r["bucket"] for r in both.select("bucket").collect())


def changes(old: Stamped, new: Stamped) -> DataFrame:
    """(doc, change): documents added, removed or changed; read from the buckets that differ only.  A null document is one like others."""
    only = differing(old, new)
    a, b = old.documents(only), new.documents(only).toDF("doc2", "n2", "h2", "bucket2")
    both = a.join(b, (F.col("bucket") == F.col("bucket2")) & F.col("doc").eqNullSafe(F.col("doc2")), "full")
    change = F.when(F.col("bucket").isNull(), "added").when(F.col("bucket2").isNull(), "removed").when((F.col("n") != F.col("n2")) | (F.col("h") != F.col("h2")), "changed")
    return both.select(F.when(F.col("bucket").isNull(), F.col("doc2")).otherwise(F.col("doc")).alias("doc"), change.alias("change")).filter("change is not null")


class Bucketed:
    """A table whose rows lie in a folder for each bucket of documents.

    A new version of some documents rewrites the folders that hold them, by dynamic partition overwrite; files of other
    buckets are not touched.  Readers see a bucket's old files until its new ones are moved in.
    """

    def __init__(self, spark: SparkSession, path: str, doc: str = "doc_id", buckets: int = BUCKETS):
        self.spark, self.path, self.doc, self.buckets = spark, path.rstrip("/"), doc, buckets

    def create(self, rows: DataFrame) -> Bucketed:
        self.schema = rows.schema
        self.put(rows.withColumn("__bucket", bucket_of(F.col(self.doc), self.buckets)), "overwrite")
        return self

    def put(self, rows: DataFrame, mode: str) -> None:
        rows.repartition("__bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(self.path)

    def stored(self) -> DataFrame:
        kept = self.schema.fields
        return self.spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", __bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored().drop("__bucket")

    def replace(self, new: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Put the rows of `new` in place of all rows of their documents, and remove documents of `gone`; returns the buckets rewritten."""
        steps = Steps(self.spark, "replace")
        new = steps.keep(new.select(*self.schema.names).withColumn("__bucket", bucket_of(F.col(self.doc), self.buckets)), "new")
        named = new.select(self.doc, "__bucket")
        if gone is not None:
            named = named.unionByName(gone.select(self.doc, bucket_of(F.col(self.doc), self.buckets).alias("__bucket")))
        named = steps.keep(named.distinct(), "named")
        touched = sorted(r[0] for r in named.select("__bucket").distinct().collect())  # at most as many as buckets
        old = self.stored().filter(F.col("__bucket").isin(touched))
        out = named.select(F.col(self.doc).alias("__doc"), F.col("__bucket").alias("__b"))
        left = old.join(out, (old["__bucket"] == out["__b"]) & old[self.doc].eqNullSafe(out["__doc"]), "left_anti")
        rows = steps.keep(left.unionByName(new), "rows")
        emptied = sorted(set(touched) - {r[0] for r in rows.select("__bucket").distinct().collect()})
        self.put(rows, "overwrite")
        jvm = self.spark._jvm
        for b in emptied:  # nothing is left to overwrite them with
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/__bucket={b}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        steps.drop()
        return touched
