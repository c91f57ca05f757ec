"""An inverted-file index of vectors: coarse centres, posting lists of 8-bit codes, exact ranking of what is left.

Equal vectors are indexed once.  Each is normalised and goes to the list of its nearest centre, with a code of one byte a
component and the length of what the code leaves out.  By that length a code bounds the cosine from both sides,
so a search over codes drops only vectors that cannot be among the k nearest of the lists it probes; the rest are
ranked by their full vectors.  With all lists probed the result is that of a full scan.  Lists are packed into shards of a bounded number of
rows: a query meets a shard in one row, whichever of its lists it probes, and takes from it what may be among the k nearest of the shard.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorpus.functions import vector as V
from sparkcorpus.operators.cluster import spherical_centres
from sparkcorpus.operators.relational import top_per_group
from sparkcorpus.store import Steps

#: Vectors that the centres are fitted on at most, and vectors of a list on average; never more lists than LISTS.
SAMPLE, PER_LIST, LISTS = 40_000, 256, 1024
#: Rows of a shard of lists, or of a slice of a longer list, and queries that probe it, that meet in one task.
SLICE = 8192
#: More than single precision loses in a product of unit vectors.
SLACK = 1e-5


@dataclass
class VectorIndex:
    """postings: (list, slice, vid, code, scale, left_out); vectors: (vid, v); members: (vid, unit); centres: a row a list;
    slices: (list, slices, shard) of each list that has rows; shards: the shard of each list, or -1."""

    steps: Steps
    postings: DataFrame
    vectors: DataFrame
    members: DataFrame
    centres: np.ndarray
    slices: DataFrame
    shards: np.ndarray


def units_of(column) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors; zero vectors stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1))
    return x / np.where(size > 0, size, 1.0)[:, None]


def usable(vector, dim: int):
    """Vectors that are ranked: of the index's dimension, with finite components."""
    v = V.doubles(vector)
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def build(units: DataFrame, unit: str = "id", vector: str = "embedding", dim: int | None = None, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index every row with a usable vector; others never rank.  Units are unique.

    Centres are fitted on at most `sample` different vectors, those with the smallest hashes.  A list beyond SLICE rows
    is cut into slices, so a crowded centre is not one task; equal vectors in any number are one row.
    """
    steps = Steps(units.sparkSession, "vector-index")
    if dim is None:
        first = units.filter(F.size(vector) > 0).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
        dim = first["n"] if first else 1
    rows = units.filter(usable(F.col(vector), dim)).select(F.col(unit).alias("unit"), V.doubles(F.col(vector)).alias("v"))
    rows = steps.keep(rows.withColumn("vid", F.sha2(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ","), 256)), "rows")
    vectors = steps.keep(rows.groupBy("vid").agg(F.any_value("v").alias("v")), "vectors")
    members = rows.select("vid", "unit")
    n = vectors.count()
    lists = lists or max(1, min(LISTS, -(-n // PER_LIST)))
    first = vectors.withColumn("h", F.xxhash64("vid")).orderBy("h", "vid").limit(sample).select("vid", "v").repartition("vid")  # each round reads them again
    centres = spherical_centres(steps.keep(first, "sample"), lists, key="vid", vector="v") if n else np.zeros((1, dim))

    def encode(batches):
        for batch in batches:
            x = units_of(batch.column(1))
            near = (x @ centres.T).argmax(axis=1)
            most = np.abs(x).max(axis=1)
            scale = np.where(most > 0, most, 1.0) / 127
            code = np.rint(x / scale[:, None]).astype(np.int8)
            gap = x - code * scale[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(np.sqrt((gap * gap).sum(axis=1)))], ["list", "vid", "code", "scale", "left_out"])

    coded = steps.keep(vectors.select("vid", "v").mapInArrow(encode, "list int, vid string, code binary, scale double, left_out double"), "coded")
    packed = sharded([tuple(r) for r in coded.groupBy("list").count().orderBy("list").collect()])  # a row a list
    slices = steps.keep(units.sparkSession.createDataFrame(packed, "list int, slices int, shard int"), "slices")
    shards = np.full(len(centres), -1, dtype=np.int32)
    shards[[r[0] for r in packed]] = [r[2] for r in packed]
    postings = coded.join(F.broadcast(slices), "list").withColumn("slice", F.pmod(F.xxhash64("vid"), F.col("slices")).cast("int")).drop("slices", "shard")
    postings = postings.repartition("list", "slice").select("vid", "slice", "code", "scale", "left_out", "list")
    return VectorIndex(steps, steps.keep(postings, "postings", by=["list"]), vectors, members, centres, slices, shards)


def sharded(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(list, slices, shard) of lists (list, rows) in order: a shard takes lists until it would have more than SLICE rows; a list with
    more is a shard of its own, cut into slices."""
    out, shard, held = [], -1, SLICE
    for list_, n in sizes:
        if held + n > SLICE:
            shard, held = shard + 1, 0
        held += n
        out.append((list_, -(-n // SLICE), shard))
    return out


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query, unit, distance, rank): of the units in the `probes` lists whose centres are nearest each query (all lists, if None), the k
    nearest, ties by unit.  A query without usable vector finds nothing."""
    centres, dim = index.centres, index.centres.shape[1]
    probes = min(probes or len(centres), len(centres))
    asked = queries.filter(usable(F.col("vector"), dim)).select("query", V.doubles(F.col("vector")).alias("q"))
    kind, run = queries.schema["query"].dataType.simpleString(), uuid.uuid4().hex[:8]

    def route(batches):
        for batch in batches:
            x = units_of(batch.column(1))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            shard, of = index_shards[near].ravel(), np.repeat(np.arange(len(x)), probes)
            order = np.lexsort((shard, of))
            order = order[shard[order] >= 0]
            shard, of, near = shard[order], of[order], near.ravel()[order]
            begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (shard[1:] != shard[:-1]))[: len(of)])
            at, bounds = pa.array(of[begin]), pa.array(np.append(begin, len(of)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shard[begin]), pa.ListArray.from_arrays(bounds, pa.array(near))], ["query", "q", "shard", "lists"])

    index_shards = index.shards
    routed = index.steps.keep(asked.mapInArrow(route, f"query {kind}, q array<double>, shard int, lists array<int>"), f"routed-{run}")
    # queries of a shard are cut into blocks too; each block meets the shard, or each slice of its list
    blocks = routed.groupBy("shard").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("blocks"))
    cut = index.slices.groupBy("shard").agg(F.max("slices").alias("slices"))
    dealt = routed.join(F.broadcast(blocks), "shard").join(F.broadcast(cut), "shard")  # both have at most a row a list
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("shard", "slice", "block", "query", "q", "lists")
    probed = [r["list"] for r in routed.select(F.explode("lists").alias("list")).distinct().collect()]  # at most LISTS numbers: the folders that are read
    met = index.postings.filter(F.col("list").isin(probed)).join(F.broadcast(index.slices.select("list", "shard")), "list").join(F.broadcast(blocks), "shard")
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "slice", "block", "list", "vid", "code", "scale", "left_out")

    def scan(key, rows, wanted):
        if not rows.num_rows or not wanted.num_rows:
            return pa.table({"query": wanted.column("query").slice(0, 0), "vid": pa.array([], pa.string()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        rows = rows.sort_by("list")
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.int8).reshape(rows.num_rows, dim).astype(np.float32)
        scale, lost, q = rows.column("scale").to_numpy(), rows.column("left_out").to_numpy(), units_of(wanted.column("q")).astype(np.float32)
        lists = wanted.column("lists").combine_chunks()
        listed, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(listed, kind="stable")
        listed, of = listed[order], of[order]
        best = np.full((len(q), k), np.inf)  # of each query, the k least upper bounds so far
        of_query, of_row, low, high = [], [], [], []
        names, first = np.unique(rows.column("list").to_numpy(), return_index=True)
        for name, begin, end in zip(names, first, np.append(first[1:], rows.num_rows), strict=True):
            mine = of[np.searchsorted(listed, name) : np.searchsorted(listed, name, side="right")]
            for i in range(0, len(mine), 256):
                some = mine[i : i + 256]
                distance = 1.0 - (q[some] @ code[begin:end].T).astype(np.float64) * scale[None, begin:end]
                near, far = distance - lost[None, begin:end] - SLACK, distance + lost[None, begin:end] + SLACK
                best[some] = np.partition(np.concatenate([best[some], far], axis=1), k - 1, axis=1)[:, :k]
                a, b = np.nonzero(near <= best[some].max(axis=1)[:, None])
                of_query.append(some[a])
                of_row.append(b + begin)
                low.append(near[a, b])
                high.append(far[a, b])
        of_query, of_row, low, high = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((of_query, int), (of_row, int), (low, float), (high, float)))
        left = low <= best.max(axis=1)[of_query]
        return pa.table({"query": wanted.column("query").take(pa.array(of_query[left])), "vid": rows.column("vid").take(pa.array(of_row[left])), "low": low[left], "high": high[left]})

    found = met.groupBy("shard", "slice", "block").cogroup(dealt.groupBy("shard", "slice", "block")).applyInArrow(scan, f"query {kind}, vid string, low double, high double")
    found = index.steps.keep(found, f"found-{run}")
    bound = top_per_group(found, ["query"], k, F.asc("high"), F.asc("vid")).groupBy("query").agg(F.max("high").alias("bound"))
    left = found.join(bound, "query").filter("low <= bound").select("query", "vid")
    exact = left.join(index.vectors, "vid").join(asked, "query").select("query", "vid", V.cosine_distance(F.col("v"), F.col("q")).alias("distance"))
    nearest = index.steps.keep(ranked_with_ties(exact, k), f"nearest-{run}")
    # of equal vectors, the first k units
    first = top_per_group(index.members.join(nearest.select("vid").distinct(), "vid", "left_semi"), ["vid"], k, F.asc("unit")).select("vid", "unit")
    return top_per_group(nearest.join(first, "vid").select("query", "unit", "distance"), ["query"], k, F.asc("distance"), F.asc("unit"), name="rank")


def ranked_with_ties(rows: DataFrame, k: int) -> DataFrame:
    """Vectors at most as far as the k-th of their query."""
    last = top_per_group(rows, ["query"], k, F.asc("distance"), F.asc("vid")).groupBy("query").agg(F.max("distance").alias("__last"))
    return rows.join(last, "query").filter(F.col("distance") <= F.col("__last")).drop("__last")


def probes_for(index: VectorIndex, k: int, least: float = 0.95, queries: int = 256) -> int:
    """The fewest lists to probe that find the share `least` of the k nearest of some of the index's own vectors, those with the
    smallest hashes, as a search of all lists finds them."""
    asked = index.vectors.withColumn("h", F.xxhash64(F.lit("probe"), "vid")).orderBy("h", "vid").limit(queries).select(F.col("vid").alias("query"), F.col("v").alias("vector"))
    asked = index.steps.keep(asked, f"asked-{uuid.uuid4().hex[:8]}")
    centres = index.centres

    def order(batches):
        for batch in batches:
            ranks = np.empty((batch.num_rows, len(centres)), dtype=np.int32)
            near = np.argsort(-(units_of(batch.column(1)) @ centres.T), axis=1, kind="stable")
            np.put_along_axis(ranks, near, np.arange(len(centres), dtype=np.int32)[None, :], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranks.tolist(), pa.list_(pa.int32()))], ["query", "ranks"])

    ranks = asked.mapInArrow(order, "query string, ranks array<int>")
    found = search(index, asked, k).join(index.members, "unit").join(index.postings.select("vid", "list"), "vid").join(ranks, "query")
    needed = found.select((F.get("ranks", F.col("list")) + 1).alias("n")).groupBy("n").count().orderBy("n").collect()  # a row a list at most
    total, seen = sum(r["count"] for r in needed), 0
    for r in needed:
        seen += r["count"]
        if seen >= least * total:
            return r["n"]
    return 1


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(queries, wanted, hit, recall): the share of the true neighbours (query, unit) that were found."""
    hit = truth.select("query", "unit").join(found.select("query", "unit", F.lit(1).alias("__h")), ["query", "unit"], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("wanted"), F.count("__h").alias("hit"), (F.count("__h") / F.count("*")).alias("recall"))
