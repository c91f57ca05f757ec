"""The training-data pipeline: stages over documents, each written and reread by the next.

quality    documents that the ordinal model does not rate good go
jaccard    of each group of near-duplicates the first row by document id stays
substrings words of passages that repeat elsewhere go; a document that loses all keeps its row
mixing     documents are drawn 0 to 3 times to bring their sources to target weights
tokens     texts become subword ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.llm.bpe import encode
from sparkcorpus.llm.jaccard_join import classes
from sparkcorpus.llm.mixing import materialise, mix
from sparkcorpus.llm.quality_model import rate, train
from sparkcorpus.llm.scratch import Scratch
from sparkcorpus.llm.substring_dedup import remove_repeats


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """The documents with columns of these names renamed, since an operator uses the names; and all columns as they were."""
    own = {c: f"__own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and unlabelled texts are rated like others; those without words go.  Repeated rows are rated alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, columns = apart(docs, "expected_grade", "tail_probability", "kept")
    return rate(docs, train(docs, labels), keep_text=True).filter("kept").select(*columns)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a written number, whatever their ids: of each component of their own shingle sets
    the first by (doc_id, number) stays, null ids last.  A row without words is in no group and stays."""
    scratch = Scratch(spark, "pipeline-jaccard")
    rows = scratch.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    placed = classes(rows, key="__row").join(rows.select("__row", "doc_id"), "__row")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("x"))
    first = scratch.keep(first.select(F.col("x.__row").alias("__row")), "first")
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts become empty.  Rows stay, whatever their ids; repeated rows lose what they share."""
    rows, columns = apart(docs, "n_words", "n_removed", "kept_sha256")
    left = remove_repeats(rows, output="__left")
    new = {"text": F.col("__left"), "n_chars": F.length("__left").cast(docs.schema["n_chars"].dataType)}
    return left.select(*[new[c].alias(c) if c in new else x for c, x in zip(docs.columns, columns, strict=True)])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts have no words and may be drawn like others; a null source is one of its own."""
    docs, columns = apart(docs, "size", "source_size", "target", "times", "taken", "shards", "shard", "draw")
    return materialise(mix(docs)).select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, with its id; null texts have no tokens."""
    return encode(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("jaccard", jaccard), ("substrings", substrings), ("mixing", mixing), ("tokens", tokens)]

#: A trained model decides in the first stage, which SQL cannot express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, first = None, len(Scratch.made)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.clear(first)  # what the stage has left
        if before:
            scratch.drop(before)
        before = name
    return docs
