"""Tables of the engine as fixed schemas, and the checks of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR = "array<float>"
TABLES = {
    "users": "id string, username string, password_hash string, is_active boolean, created_at timestamp, updated_at timestamp, last_login_at timestamp",
    "documents": "id string, name string, suffix string, bytes long, stored_path string, uploaded_at timestamp, status string, chunk_count int, embed_model string, source_kind string, source_url string, fetched_at timestamp",
    "chunks": f"id long, doc_id string, seq int, content string, embedding {VECTOR}, embed_model string, created_at timestamp, ctx string",
    "conversations": "id string, title string, provider string, model string, created_at timestamp, updated_at timestamp, summary string, summary_upto long",
    "messages": f"id long, conv_id string, role string, content string, sources array<struct<docId:string,docName:string,seq:int,score:double,distance:double>>, provider string, model string, created_at timestamp, embedding {VECTOR}, embed_model string, index_text string, index_topic string",
    "tree_nodes": f"id long, label string, summary string, chunk_ids array<long>, centroid {VECTOR}, doc_ids array<string>, size int, built_at timestamp",
    "tree_meta": "id int, chunk_count int, cluster_count int, built_at timestamp",
    "index_tasks": "id string, doc_id string, kind string, status string, progress int, total int, message string, result map<string,string>, created_at timestamp, updated_at timestamp",
    "cache_embeddings": f"key string, model string, vec {VECTOR}, dim int, hits long, created_at timestamp, last_hit_at timestamp",
    "cache_answers": "key string, question string, answer string, provider string, model string, sources string, hits long, created_at timestamp, last_hit_at timestamp",
    "cache_parses": "key string, name string, text string, chars int, hits long, created_at timestamp, last_hit_at timestamp",
    "memory_items": "topic string, item string, src_conv string, updated_at timestamp",
    "sentences": f"id long, chunk_id long, doc_id string, seq int, char_start int, char_end int, kind string, text string, sent_hash string, stamp string, built_at timestamp, embedding {VECTOR}, embed_model string",
}
UNIQUE = {"users": ["username"], "chunks": ["doc_id", "seq"], "sentences": ["chunk_id", "seq"], "memory_items": ["topic"], "cache_embeddings": ["key"], "cache_answers": ["key"], "cache_parses": ["key"]}
FOREIGN = [("chunks", "doc_id", "documents", "id"), ("sentences", "chunk_id", "chunks", "id"), ("messages", "conv_id", "conversations", "id")]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def create_all(spark: SparkSession, database: str = "default") -> None:
    """Idempotent DDL: missing tables are created, missing columns added."""
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")
        have = {f.name for f in spark.table(f"{database}.{name}").schema}
        more = [f for f in empty(spark, name).schema if f.name not in have]
        if more:
            spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in more)})")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of uniqueness: each key with its count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Violations of a foreign key: child rows whose parent is missing."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def single_row(df: DataFrame) -> DataFrame:
    """Violations of the one-row table: rows whose id is not 1."""
    return df.filter(~F.col("id").eqNullSafe(F.lit(1)))


def cascade_delete(parents: DataFrame, gone: DataFrame, children: list[tuple[str, DataFrame, str, str]], key: str = "id") -> dict[str, DataFrame]:
    """Parents without the keys in `gone`, and tables below them: (name, rows, foreign key, own key),
    each referring to the one before."""
    out = {"": parents.join(gone.select(F.col(key)), key, "left_anti")}
    keys = gone.select(F.col(key).alias("__k"))
    for name, rows, foreign, own in children:
        lost = rows.join(keys, rows[foreign] == keys["__k"], "left_semi")
        out[name] = rows.join(keys, rows[foreign] == keys["__k"], "left_anti")
        keys = lost.select(F.col(own).alias("__k"))
    return out
