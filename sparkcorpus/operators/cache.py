"""Content-addressed caches as tables: keys, lookups, stores, statistics, and stamps of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.functions.text import content_hash
from sparkcorpus.operators.relational import upsert_ignore


def embedding_key(text: Column, model: Column) -> Column:
    return content_hash(text, model)


def parse_key(file_hash: Column, version: str) -> Column:
    return content_hash(file_hash, F.lit(version))


def answer_key(question: Column, context: Column, history: Column, provider: Column, model: Column, temperature: Column, prompt: Column, *more: Column) -> Column:
    """Every input of an answer is a part of its key; lists of texts are hashed first."""
    listed = lambda c: content_hash(F.array_join(F.transform(c, lambda x: F.sha2(x, 256)), ","))
    return content_hash(question, listed(context), listed(history), provider, model, temperature, F.sha2(prompt, 256), *more)


def lookup(wanted: DataFrame, cache: DataFrame | None, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of rows with a key.  Without a cache all are misses."""
    if cache is None:
        return wanted.limit(0), wanted
    return wanted.join(cache.drop(*[c for c in cache.columns if c != key and c in wanted.columns]), key), wanted.join(cache.select(key), key, "left_anti")


def store(cache: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows to append: the first of each new key."""
    return upsert_ignore(cache, new, [key])


def touched(cache: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    """Hits and last use, summed from an append-only log (key, at)."""
    n = log.groupBy(key).agg(F.count("*").alias("__n"), F.max("at").alias("__at"))
    return cache.join(n, key, "left").withColumns({"hits": F.col("hits") + F.coalesce("__n", F.lit(0)), "last_hit_at": F.greatest("last_hit_at", "__at")}).drop("__n", "__at")


def stats(**caches: DataFrame) -> DataFrame:
    """(cache, entries, hits, last_hit_at) of each."""
    out = None
    for name, c in caches.items():
        row = c.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.max("last_hit_at").alias("last_hit_at")).select(F.lit(name).alias("cache"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def bucket_stamps(chunks: DataFrame, doc: str = "doc_id", seq: str = "seq", text: str = "content") -> DataFrame:
    """(bucket, n, h): counts and sums of hashes of each chunk's (doc, seq, text), in 256 buckets by document.  Sums
    do not depend on order, so they are combined in each task, whatever the size of the corpus."""
    line = F.concat_ws(":", F.col(doc).cast("string"), F.col(seq).cast("string"), F.sha1(F.encode(text, "UTF-8")))
    h = F.conv(F.substring(F.sha1(line), 1, 15), 16, 10).cast("decimal(38,0)")
    bucket = F.substring(F.sha1(F.col(doc).cast("string")), 1, 2)
    return chunks.select(bucket.alias("bucket"), h.alias("h")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("h").alias("h"))


def stamp(chunks: DataFrame, doc: str = "doc_id", seq: str = "seq", text: str = "content") -> DataFrame:
    """One row: 12 hex digits of a SHA-1 over the stamps of all buckets, and the count."""
    line = F.concat_ws(":", "bucket", F.col("n").cast("string"), F.col("h").cast("string"))
    rows = bucket_stamps(chunks, doc, seq, text).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(line)).alias("x"))  # at most 256 lines
    return rows.select(F.substring(F.sha1(F.concat_ws("|", F.col("n").cast("string"), F.array_join("x", "|"))), 1, 12).alias("stamp"), "n")


def reusable(stamps: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether vectors of a manifest (stamp) still belong to the corpus; others are to be rebuilt."""
    return stamps.join(manifest.select("stamp", F.lit(True).alias("fresh")), "stamp", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def latest_tasks(log: DataFrame, doc: str = "doc_id", at: str = "updated_at") -> DataFrame:
    """The last state of each document's task in an append-only log."""
    return log.groupBy(doc).agg(F.max_by(F.struct("id", "kind", "status", "progress", "total", "message"), F.struct(at, "id")).alias("t")).select(doc, "t.*")


def interrupted(tasks: DataFrame, message: str = "interrupted by a restart") -> DataFrame:
    running = F.col("status") == "running"
    return tasks.withColumns({"message": F.when(running, F.lit(message)).otherwise(F.col("message")), "status": F.when(running, "error").otherwise(F.col("status"))})


def stale(documents: DataFrame, model: str) -> DataFrame:
    """Indexed documents whose vectors are of another model."""
    return documents.filter((F.col("chunk_count") > 0) & (F.col("embed_model") != model)).orderBy("uploaded_at", "id")


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A cache that cannot be read is no cache: every row is a miss."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None
