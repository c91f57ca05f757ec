"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks by a hash of the document.  A source whose
target is r times its size gives floor(r) whole passes over its blocks and a partial pass:
the first blocks of a seeded permutation, with a cut inside the last one.  The draws of all
sources are exact block quotas; a binary tree splits them among the output shards, each node
drawing the left half's quotas from a multivariate hypergeometric distribution.  A shard owns
a disjoint stretch of each source's permuted draws and is shuffled locally.

The number of shards follows the size of the corpus, and that of blocks the number of shards.  Only per-source
totals reach the driver, and the shards' quotas are made there: some bytes for each source and shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.llm.scratch import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
#: Blocks of a source: so many, and so many more for each shard.
BLOCKS, MORE = 1024, 16
#: Words of an output shard, about, and the partitions (files) that it is written in.
SHARD_WORDS, SLICES = 64_000_000, 16
SEED = 20260916
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Words to take of each source: shares of the total by weight, none above `most` times its
    size; what a source cannot give is shared by weight among those still below."""
    total, fixed = float(sum(sizes)), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_} if weight else {}
        above = [i for i in open_ if share[i] > most * sizes[i]]
        if not above:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed.update({i: most * float(sizes[i]) for i in above})


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources); columns sum to the quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(quotas: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = quotas
            return
        left = n // 2
        total = int(quotas.sum())
        # the marginals method draws source by source and bears quotas of any size
        drawn = rng.multivariate_hypergeometric(quotas, total * left // n, method="marginals") if total else quotas * 0
        split(drawn, first, left)
        split(quotas - drawn, first + left, n - left)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def keyed(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """Columns the plan needs, beside the others: size, rank within a block, hash that gives the block, and source."""
    return docs.withColumns(
        {
            "__size": word_count(docs[text]),
            "__rank": F.xxhash64(F.lit(seed), docs[key].cast("string"), F.col(text)),
            "__hash": F.xxhash64(F.lit(seed + 1), docs[key].cast("string"), F.col(text)),
            "__source": docs[source].cast("string"),
        }
    )


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("__block", F.pmod("__hash", F.lit(blocks)).cast("int"))


def shard_count(rows: DataFrame) -> int:
    return int(rows.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]) // SHARD_WORDS + 1


def plan(rows: DataFrame, scratch: Scratch, weights, shards: int, seed: int) -> DataFrame:
    """One row a block: source, source_size, target, the shards of its draws, and the highest
    rank of its documents that the last draw takes (`cut`; of the whole passes, all)."""
    spark = rows.sparkSession
    blocks = scratch.keep(rows.groupBy("__source", "__block").agg(F.sum("__size").alias("words")), "blocks")
    totals = blocks.groupBy("__source").agg(F.sum("words").alias("words"), F.count("*").alias("blocks")).collect()
    totals.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))  # UTF-8 sorts by code point
    sizes = [int(r["words"]) for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    passes = [min(int(t // s), MOST_PASSES) if s else 0 for t, s in zip(goal, sizes, strict=True)]
    rest = [max(0.0, t - p * s) if p < MOST_PASSES else 0.0 for t, p, s in zip(goal, passes, sizes, strict=True)]
    sources = spark.createDataFrame(
        [(r[0], s, float(t), p, float(x), int(r["blocks"])) for r, s, t, p, x in zip(totals, sizes, goal, passes, rest, strict=True)],
        "__source string, source_size long, target double, passes int, rest double, n_blocks int",
    )
    same = lambda a, b: a["__source"].eqNullSafe(b["__source"])
    order = Window.partitionBy("__source").orderBy(F.xxhash64(F.lit(seed + 2), "__block"), "__block")  # a source's blocks
    dealt = blocks.join(sources, same(blocks, sources)).drop(sources["__source"])
    dealt = dealt.withColumns({"place": F.row_number().over(order) - 1, "before": F.sum("words").over(order) - F.col("words")})
    dealt = dealt.withColumn("part", F.when(F.col("before") + F.col("words") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0))
    dealt = scratch.keep(dealt, "dealt")

    # the one block of each source that the partial pass ends in is cut between two of its documents, or between copies of one
    edge = dealt.filter("part = 1").select(F.col("__source").alias("s"), F.col("__block").alias("b"), (F.col("rest") - F.col("before")).alias("room"))
    inside = rows.select("__source", "__block", "__rank", "__size").join(edge, rows["__source"].eqNullSafe(F.col("s")) & (rows["__block"] == F.col("b")))
    ranks = inside.groupBy("__source", "__block", "room", "__rank").agg(F.sum("__size").alias("words"), F.count("*").alias("n"))
    upto = F.sum("words").over(Window.partitionBy("__source", "__block").orderBy("__rank"))
    ends = ranks.withColumn("left", F.col("room") - upto + F.col("words")).filter(F.col("left") > 0)
    copies = F.least(F.round(F.col("left") / (F.col("words") / F.col("n"))).cast("long"), F.col("n"))
    last = F.max(F.struct("__rank", copies.alias("copies"), "n"))
    cuts = ends.filter("words > 0").groupBy(F.col("__source").alias("s"), F.col("__block").alias("b")).agg(last.alias("x")).select("s", "b", F.col("x.__rank").alias("inner"), F.col("x.copies").alias("copies"), F.col("x.n").alias("alike"))
    dealt = dealt.join(cuts, dealt["__source"].eqNullSafe(cuts["s"]) & (dealt["__block"] == cuts["b"]), "left").drop("s", "b")
    # rows up to `cut` are drawn, and `copies` of those at `shared`
    some = (F.col("copies") > 0) & (F.col("copies") < F.col("alike"))
    inner = F.when(some | (F.col("copies") == 0), F.col("inner") - 1).otherwise(F.col("inner"))
    dealt = dealt.withColumn("cut", F.when(F.col("part") == 2, F.lit(HIGHEST)).when(F.col("part") == 1, F.coalesce(inner, F.lit(LOWEST))).otherwise(F.lit(LOWEST)))
    dealt = dealt.withColumns({"shared": F.when((F.col("part") == 1) & some, F.col("inner")), "copies": F.when((F.col("part") == 1) & some, F.col("copies"))})

    drawn = {r["__source"]: r["n"] for r in dealt.filter("part > 0").groupBy("__source").agg(F.count("*").alias("n")).collect()}
    quotas = np.array([p * int(r["blocks"]) + drawn.get(r[0], 0) for r, p in zip(totals, passes, strict=True)], dtype=np.int64)
    share = split_quotas(quotas, shards, seed)
    ends = spark.sparkContext.broadcast({r[0]: np.cumsum(share[:, i]) for i, r in enumerate(totals)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of each block's draws: draw k of a source's block p is its draw k * n + p."""
        for batch in batches:
            out = []
            for source, p, n, passes, part in zip(*[batch.column(c).to_pylist() for c in ("__source", "place", "n_blocks", "passes", "part")], strict=True):
                draws = np.arange(passes + (part > 0)) * n + p
                out.append(np.searchsorted(ends.value[source], draws, side="right").tolist())
            kept = ["__source", "__block", "source_size", "target", "passes", "cut", "shared", "copies"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.list_(pa.int32()))], [*kept, "shards"])

    placed = dealt.select("__source", "__block", "source_size", "target", "passes", "cut", "shared", "copies", "place", "n_blocks", "part").mapInArrow(
        place, "__source string, __block int, source_size long, target double, passes int, cut long, shared long, copies long, shards array<int>"
    )
    return scratch.keep(placed, "plan")


def some_of(alike: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each source's equal rows (numbered by __no), the first `copies` are drawn once more.

    Rows are counted by the task that numbered them; only the rows of the task in which the last copy falls are put in order.
    """
    rows = alike.withColumn("__task", F.shiftright("__no", 33))
    counts = rows.groupBy("__source", "copies", "__task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__source").orderBy("__task")) - F.col("n")  # a row a task
    open_ = counts.withColumn("left", F.col("copies") - before)
    edge = open_.filter("left > 0 and left < n").select(F.col("__source").alias("s"), F.col("__task").alias("t"), "left")
    ordered = rows.join(edge, rows["__source"].eqNullSafe(edge["s"]) & (rows["__task"] == edge["t"])).withColumn("i", F.row_number().over(Window.partitionBy("__source").orderBy("__no")))
    limits = ordered.filter("i = left").select(F.col("__source").alias("s"), F.col("__no").alias("last"))
    full = open_.filter("left >= n").groupBy(F.col("__source").alias("s")).agg(F.max("__task").alias("upto"))
    limits, full = scratch.keep(limits, "limits"), scratch.keep(full, "full")
    out = rows.join(limits, rows["__source"].eqNullSafe(limits["s"]), "left").drop("s")
    out = out.join(full, out["__source"].eqNullSafe(full["s"]), "left").drop("s")
    taken = (F.col("__task") <= F.coalesce("upto", F.lit(-1))) | (F.col("__no") <= F.coalesce("last", F.lit(-1)))
    return out.withColumn("times", F.col("times") + taken.cast("int"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, shards: int | None = None, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """`docs` with size, source_size, target, times, taken and the shards of each row's draws; without its text
    unless `keep_text`.  `shards`: how many; None: as the size of the corpus asks for.

    Null texts have size 0 and a null source is a source of its own, the last.  Repeated rows are taken alike,
    unless a source's target falls between them: then some of them are drawn once more than the others.  Columns of `docs` with these names are replaced.  No rows give no rows.  What is taken
    depends on the keys, texts and seed alone, so reruns agree.
    """
    made = ["size", "source_size", "target", "times", "taken", "shards"]
    docs = docs.drop(*made)
    columns = [c for c in docs.columns if keep_text or c != text]
    scratch = Scratch(docs.sparkSession, "mix")
    rows = keyed(docs, key, source, text, seed)
    needs = ["__source", "__hash", "__rank", "__size"]
    sizes = scratch.keep(rows.select(*needs, *[c for c in columns if not keep_text]), "rows")  # texts are counted once
    shards = shards or shard_count(sizes)
    blocks = BLOCKS + MORE * shards
    dealt = plan(in_blocks(sizes.select(*needs), blocks), scratch, weights, shards, seed).withColumnsRenamed({"__source": "__s", "__block": "__b"})
    rows = in_blocks(rows if keep_text else sizes, blocks)
    out = rows.join(dealt, rows["__source"].eqNullSafe(dealt["__s"]) & (rows["__block"] == dealt["__b"]))
    drawn = (F.col("__rank") <= F.col("cut")) & (F.col("cut") > LOWEST)
    out = out.withColumn("times", F.col("passes") + drawn.cast("int"))
    if not dealt.filter("shared is not null").isEmpty():
        split = F.coalesce(F.col("__rank") == F.col("shared"), F.lit(False))
        alike = some_of(scratch.keep(out.filter(split).withColumn("__no", F.monotonically_increasing_id()), "alike"), scratch)
        out = out.filter(~split).unionByName(alike.select(*out.columns))
    out = out.withColumn("shards", F.slice("shards", F.lit(1), F.col("times")))
    return out.select(*columns, F.col("__size").alias("size"), "source_size", "target", "times", (F.col("__size") * F.col("times")).alias("taken"), "shards")


def materialise(mixed: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """One row for each draw, with its shard, shuffled within it by a seeded hash: a shard is SLICES partitions in a
    row, each with a stretch of the hashes.  Columns named draw or shard are replaced."""
    shards = mixed.agg(F.coalesce(F.max(F.array_max("shards")), F.lit(0))).first()[0] + 1
    draws = mixed.drop("draw", "shard").select("*", F.posexplode("shards").alias("draw", "shard"))
    order = F.xxhash64(F.lit(seed + 3), F.col(key).cast("string"), "draw")
    part = F.col("shard") * SLICES + F.floor((order / F.lit(2.0**64) + 0.5) * SLICES).cast("int")
    return draws.repartitionById(shards * SLICES, F.least(part, F.col("shard") * SLICES + SLICES - 1)).sortWithinPartitions("shard", order)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(documents, keep_text=False).select("doc_id", "size", "source_size", "target", "taken", "times", "shards")
