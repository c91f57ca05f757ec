"""Indexing: texts to chunks, vectors and sentences; and the topic tree over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.config import Settings
from sparkcorpus.functions import vector as V
from sparkcorpus.operators import cache, chunker, cluster
from sparkcorpus.providers.base import Provider, embed_column


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Ids from content: they do not depend on other rows, so documents are indexed in any order."""
    return chunks.withColumn("id", F.xxhash64(F.col("doc_id").cast("string"), "seq", "content"))


def index_documents(docs: DataFrame, provider: Provider, model: str, cached: DataFrame | None = None, ctx: DataFrame | None = None, conf: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, new cache rows) of documents (doc_id, text).  Cached texts are not embedded again."""
    rows = chunk_ids(chunker.chunks(docs, conf=conf.chunking))
    rows = rows.join(ctx, ["doc_id", "seq"], "left") if ctx is not None else rows.withColumn("ctx", F.lit(None).cast("string"))
    rows = rows.withColumn("__text", chunker.with_context(F.col("content"), F.col("ctx")))
    rows = rows.withColumn("key", cache.embedding_key(F.col("__text"), F.lit(model)))
    hits, misses = cache.lookup(rows, cached)
    fresh = embed_column(misses.select("key", "__text").dropDuplicates(["key"]), provider, "__text").select("key", F.col("embedding").alias("vec"))
    have = fresh if cached is None else fresh.unionByName(cached.select("key", "vec"))
    done = rows.join(have, "key").withColumns({"embedding": F.col("vec"), "embed_model": F.lit(model)})
    return done.select("id", "doc_id", "seq", "content", "ctx", "embedding", "embed_model"), fresh.withColumns({"model": F.lit(model), "dim": F.size("vec"), "hits": F.lit(0).cast("long")})


def index_sentences(chunks: DataFrame, provider: Provider | None = None, stamp: str = "") -> DataFrame:
    rows = chunker.sentences(chunks.select(F.col("id").alias("chunk_id"), "content")).withColumn("stamp", F.lit(stamp))
    rows = rows.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id").withColumn("id", F.xxhash64("chunk_id", "seq"))
    return embed_column(rows, provider, "text") if provider else rows


def build_topics(chunks: DataFrame, documents: DataFrame, conf: Settings = Settings()) -> DataFrame:
    """Topic nodes (id, label, chunk_ids, centroid, doc_ids, size) of all chunks with vectors."""
    n = chunks.filter(F.col("embedding").isNotNull()).count()
    k = chunks.sparkSession.range(1).select(V.choose_k(F.lit(n), min(conf.topics.max_clusters, max(n, 1)))).first()[0]
    members = cluster.kmeans(chunks, k, conf=conf.topics).join(documents.select(F.col("id").alias("doc_id"), F.col("name").alias("__name")), "doc_id", "left")
    nodes = members.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("chunk_ids"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.collect_set("__name").alias("doc_names"))
    centre = V.centroids(members, ["cluster"])
    nodes = nodes.join(centre, "cluster").join(cluster.distinctive_terms(members), "cluster", "left")
    merged = cluster.merge_labels(cluster.labelled(nodes))
    return merged.withColumns({"id": F.row_number().over(Window.orderBy(F.desc("size"), "label")).cast("long"), "summary": F.lit("")})
