"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into overlapping chunks that are pre-tokenised in parallel, each from its own
first character.  The pattern looks behind nothing, so where a chunk and the one before it
have a pre-token boundary in common inside their overlap, they agree from there on: the
text is cut at such a boundary, and the pieces are encoded apart.  A junction without a
common boundary (one endless pre-token) joins its two sides before encoding.  Decoding
concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import SparkFiles  # noqa: F401  (vocabularies may be shipped with addFile on a cluster)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a chunk, and how many of them it shares with the next.
CHUNK, OVERLAP = 32_768, 1_024


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def matcher(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens, but for one that the end of the text cuts off."""
    found = [m.end() for m in matcher(pattern).finditer(text)]
    return found[:-1] if found and found[-1] == len(text) else found


def cut_points(left: str, right: str, overlap: int, pattern: str) -> int | None:
    """Where in `right` (which begins `overlap` characters before `left` ends) both agree."""
    shift = len(left) - overlap
    ours = {b - shift for b in boundaries(left, pattern) if b > shift}
    return next((b for b in boundaries(right, pattern) if b < overlap and b in ours), None)


def digests(ids: np.ndarray, enc: tiktoken.Encoding) -> tuple[str, str]:
    listed = ids.tolist()
    return hashlib.sha256(" ".join(map(str, listed)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(listed)).hexdigest()


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, digest_only: bool = False) -> DataFrame:
    """`df` without its text column, with n_tokens, ids (or not), ids_sha256 and decoded_sha256.

    A null text is encoded as an empty one.  Other columns may be of any type.  Repeated rows stay repeated.  Columns of `df` with the
    names of results are replaced; no rows give no rows.  Special tokens are ordinary text.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ([] if digest_only else ["ids"])
    rest = [c for c in df.columns if c not in (*made, text)]
    source = df.select(F.struct(*[df[c] for c in rest], F.lit(0).alias("__none")).alias("row"), F.coalesce(df[text], F.lit("")).alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digest_only else ", ids array<int>")
    row = source.schema["row"].dataType

    def finish(rows: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        enc = encoder(path, pattern)
        pairs = [digests(x, enc) for x in found]
        columns = [rows, pa.array([len(x) for x in found], pa.int64()), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())]
        if not digest_only:
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, ["row", "n_tokens", "ids_sha256", "decoded_sha256"] + ([] if digest_only else ["ids"]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                yield finish(part.column(0), [enc.encode_to_numpy(t, disallowed_special=()).astype(np.int32) for t in part.column(1).to_pylist()])

    short = source.filter(F.length("text") <= chunk).mapInArrow(whole, f"row {kind}, {tail}")

    # long texts: a row for each chunk, dealt out anew, since they may lie together
    step = chunk - overlap
    long_ = source.filter(F.length("text") > chunk).withColumn("id", F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    parts = long_.select("id", "row", "text", F.posexplode(starts).alias("no", "start"))
    parts = parts.select("id", "no", F.when(F.col("no") == 0, F.col("row")).alias("row"), F.substring("text", F.col("start") + 1, F.lit(chunk)).alias("text")).repartition("id", "no")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text_ in batch.column(3).to_pylist():
                ends = boundaries(text_, pattern)
                heads.append([b for b in ends if b < overlap])
                shift = len(text_) - overlap
                tails.append([b - shift for b in ends if b > shift])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["id", "no", "row", "text", "heads", "tails"])

    marked = parts.mapInArrow(pretokenise, f"id long, no int, row {kind}, text string, heads array<int>, tails array<int>")
    by_text = Window.partitionBy("id").orderBy("no")  # the chunks of one text
    common = F.array_intersect("heads", F.lag("tails").over(by_text))
    cut = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.try_element_at(common, F.lit(1)))
    cuts = marked.withColumn("cut", cut).withColumn("next_cut", F.lead("cut").over(by_text)).withColumn("last", F.lead("no").over(by_text).isNull())
    # a chunk whose junction failed continues the piece before it
    cuts = cuts.withColumn("piece", F.sum(F.when(F.col("cut").isNull(), 0).otherwise(1)).over(by_text))
    begin = F.coalesce("cut", F.lit(overlap))
    end = F.when(F.col("last") | F.col("next_cut").isNull(), F.length("text")).otherwise(F.length("text") - overlap + F.col("next_cut"))
    cuts = cuts.select("id", "no", "row", "piece", F.substring("text", begin + 1, end - begin).alias("text"))
    pieces = cuts.groupBy("id", "piece").agg(F.any_value("row", True).alias("row"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "").alias("text"))

    def piecewise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            ids = [enc.encode_ordinary(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], ["id", "piece", "row", "ids"])

    encoded = pieces.mapInArrow(piecewise, f"id long, piece long, row {kind}, ids array<int>")
    joined = encoded.groupBy("id").agg(F.any_value("row", True).alias("row"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids")).select("row", "ids")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                yield finish(part.column(0), [x.values.to_numpy(zero_copy_only=False).astype(np.int32) for x in part.column(1)])

    del row
    both = short.unionByName(joined.mapInArrow(close, f"row {kind}, {tail}"))
    return both.select("row.*", *made).drop("__none")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(documents, digest_only=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
