"""Centroid clustering of integer vectors, filtered by ball trees.

Each task builds metric trees over the vectors it reads, `TREE` at a time; a ball stores its radius, count and integer sum, and its
centre is its mean rounded down.  The trees are written once.  In a round, each tree keeps for each ball the centroids that
the triangle inequality leaves: if only one is left, the ball's sum and count go to it as a whole, else the ball's
children are looked at, and at leaves the vectors themselves, in exact integers.  A task returns one sum for each centroid,
so a round moves k x d numbers a task, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcorpus.llm.scratch import Scratch

#: Vectors of a tree, and most of a leaf.
TREE, LEAF = 4096, 24
#: Digits, to this base, in which sums leave a task.
BASE = 1 << 30
#: More than the error of a square root of a distance that is below 2**53.
SLACK = 1e-6


def small(largest: float, dim: int) -> bool:
    """Whether squared distances between vectors of components up to `largest` are exact in doubles; beyond that they are taken in Python integers."""
    return 4 * dim * largest * largest < 1 << 53


def build(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the integer vectors x in which each ball is a range, and the balls: begin, end, left, right (children, -1 at leaves), radius, sums.

    A ball is split between a vector far from its centre and the one farthest from that, in halves if the parts are too unequal.
    """
    order = np.arange(len(x))
    begin, end, left, right, radius, sums = [0], [len(x)], [], [], [], []
    node = 0
    while node < len(begin):
        b, e = begin[node], end[node]
        own = x[order[b:e]]
        total = own.sum(axis=0)
        gap = own - total // (e - b)
        far = (gap * gap).sum(axis=1)
        sums.append(total)
        radius.append(float(np.sqrt(float(far.max()))) + SLACK if far.any() else 0.0)
        if e - b <= LEAF or (own == own[0]).all():
            left.append(-1)
            right.append(-1)
        else:
            one = own[far.argmax()]
            away = own - one
            other = own[(away * away).sum(axis=1).argmax()]
            side = away @ (other - one)
            cut = int(np.count_nonzero(2 * side < ((other - one) ** 2).sum()))
            n = e - b
            if not n // 8 <= cut <= n - n // 8:
                cut = n // 2
            order[b:e] = order[b:e][np.argpartition(side, cut)]
            left.append(len(begin))
            right.append(len(begin) + 1)
            begin += [b, b + cut]
            end += [b + cut, e]
        node += 1
    return order, {"begin": np.array(begin), "end": np.array(end), "left": np.array(left), "right": np.array(right), "radius": np.array(radius), "sums": np.array(sums).reshape(len(begin), -1)}


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of small integer vectors, exact, as doubles."""
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def filtered(x: np.ndarray, balls: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For small integers: the cluster of each vector, and the balls, and clusters of these, that went as a whole."""
    cluster = np.full(len(x), -1, dtype=np.int64)
    whole, whole_to = [], []
    now = np.zeros(1, dtype=np.int64)
    size = balls["end"] - balls["begin"]
    while len(now):
        centre = (balls["sums"][now] // size[now, None]).astype(np.float64)
        distance, radius = np.sqrt(squared(centre, c)), balls["radius"][now]
        left = distance <= (distance.min(axis=1) + 2 * radius + SLACK)[:, None]
        sole = left.sum(axis=1) == 1
        whole.append(now[sole])
        whole_to.append(left[sole].argmax(axis=1))
        for node, to in zip(now[sole].tolist(), whole_to[-1].tolist()):
            cluster[balls["begin"][node] : balls["end"][node]] = to
        rest = now[~sole]
        leaves = rest[balls["left"][rest] < 0]
        if len(leaves):
            at = np.concatenate([np.arange(balls["begin"][i], balls["end"][i]) for i in leaves.tolist()])
            cluster[at] = squared(x[at], c).argmin(axis=1)  # the first of equals
        inner = rest[balls["left"][rest] >= 0]
        now = np.concatenate([balls["left"][inner], balls["right"][inner]])
    return cluster, np.concatenate(whole), np.concatenate(whole_to)


def exact(x: np.ndarray, c: list[list[int]]) -> tuple[list[int], list[int]]:
    """Clusters and squared distances of integers of any size."""
    cluster, distance = [], []
    for row in x.tolist():
        all_ = [sum((int(a) - b) ** 2 for a, b in zip(row, own)) for own in c]
        distance.append(min(all_))
        cluster.append(all_.index(distance[-1]))
    return cluster, distance


def read_tree(row: pa.RecordBatch, i: int, dim: int) -> tuple[np.ndarray, dict[str, np.ndarray] | None]:
    """The vectors of a written tree as doubles, and its balls if they are small."""
    part = lambda name: row.column(row.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False)
    x = part("points").astype(np.float64).reshape(-1, dim)
    balls = {n: part(n) for n in ("begin", "end", "left", "right", "radius", "sums")}
    if not len(balls["begin"]):
        return x, None
    balls["sums"] = balls["sums"].reshape(-1, dim)
    return x, balls


def digits(values: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Integers of any size to the base BASE, lowest digits first; the last ones have the signs."""
    if max(map(abs, values), default=0) < 1 << 50:
        yield 0, values
        return
    place = 0
    while any(v >= BASE or v < -BASE for v in values):
        yield place, [v % BASE for v in values]
        values, place = [v // BASE for v in values], place + 1
    yield place, values


class Clustering:
    """The written trees of the vectors of a table, and rounds over them."""

    def __init__(self, df: DataFrame, key: str, vector: str, dim: int, scale: int, tree: int = TREE):
        self.spark, self.key, self.dim = df.sparkSession, key, dim
        self.scratch = Scratch(self.spark, "ball-kmeans")
        v = df[vector].cast("array<double>")
        fine = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        self.rows = df.filter(fine).select(df[key].alias("key"), v.alias("v"))
        self.kind, self.scale = self.rows.schema["key"].dataType, scale
        schema = T.StructType([T.StructField("keys", T.ArrayType(self.kind))] + [T.StructField(n, T.ArrayType(t)) for n, t in (("points", T.DoubleType()), ("begin", T.LongType()), ("end", T.LongType()), ("left", T.LongType()), ("right", T.LongType()), ("radius", T.DoubleType()), ("sums", T.LongType()))])

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, tree):
                    held.append(batch.slice(at, tree))
                    n += held[-1].num_rows
                    if n >= tree:
                        yield planted(held)
                        held, n = [], 0
            if n:
                yield planted(held)

        def planted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = table.column("v").combine_chunks()
            x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * float(scale))
            order, balls = np.arange(len(x)), {}
            if small(np.abs(x).max(), dim):
                order, balls = build(x.astype(np.int64))
            keys = table.column("key").take(pa.array(order)).combine_chunks()
            lists = {"points": x[order].ravel(), **{n: balls.get(n, np.zeros(0)).ravel().astype(np.float64 if n == "radius" else np.int64) for n in ("begin", "end", "left", "right", "radius", "sums")}}
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([whole(keys), *(whole(pa.array(a)) for a in lists.values())], ["keys", *lists])

        self.trees = self.scratch.keep(self.rows.mapInArrow(grow, schema), "trees")

    def first(self, k: int, seed: str) -> list[list[int]]:
        """The k vectors with the smallest SHA-256 of seed and key, in that order; equal keys by vector, null keys last."""
        hashed = F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")), 256)
        chosen = self.rows.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
        return [[int(np.floor(x * float(self.scale))) for x in r["v"]] for r in chosen]

    def sums(self, centroids: list[list[int]]) -> tuple[dict[int, tuple[int, list[int]]], int]:
        """(count, sums of components) of each cluster that is not empty, and how many vectors went with a whole ball."""
        dim, k = self.dim, len(centroids)
        near = small(max(abs(x) for c in centroids for x in c), dim)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, totals, by_ball = [0] * k, [[0] * dim for _ in range(k)], 0
            c = np.array(centroids, dtype=np.float64) if near else None
            for batch in batches:
                for i in range(batch.num_rows):
                    x, balls = read_tree(batch, i, dim)
                    if near and balls is not None:
                        cluster, whole, to = filtered(x, balls, c)
                        size = balls["end"][whole] - balls["begin"][whole]
                        by_ball += int(size.sum())
                        part = np.zeros((k, dim), dtype=np.int64)
                        np.add.at(part, to, balls["sums"][whole])
                        single = np.ones(len(x), dtype=bool)
                        for b, e in zip(balls["begin"][whole].tolist(), balls["end"][whole].tolist()):
                            single[b:e] = False
                        np.add.at(part, cluster[single], x[single].astype(np.int64))
                        number = np.bincount(cluster, minlength=k).tolist()
                        part = part.tolist()
                    else:
                        cluster, _ = exact(x, centroids)
                        number, part = [0] * k, [[0] * dim for _ in range(k)]
                        for row, to in zip(x.tolist(), cluster):
                            number[to] += 1
                            part[to] = [a + int(b) for a, b in zip(part[to], row)]
                    for j in range(k):
                        counts[j] += number[j]
                        totals[j] = [a + b for a, b in zip(totals[j], part[j])]
            out = [(j, place, counts[j] if place == 0 else 0, values) for j in range(k) if counts[j] for place, values in digits(totals[j])]
            out.append((-1, 0, by_ball, [0]))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(a), t) for a, t in zip(zip(*out), kinds)], ["cluster", "place", "n", "values"])

        parts = self.trees.mapInArrow(add, "cluster int, place int, n long, values array<long>").select("cluster", "place", "n", F.posexplode("values").alias("pos", "value"))
        found = parts.groupBy("cluster", "place", "pos").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()
        by_ball, out = sum(r["n"] for r in found if r["cluster"] < 0), {}
        for r in found:
            if r["cluster"] >= 0:
                count, total = out.setdefault(r["cluster"], (0, [0] * dim))
                total[r["pos"]] += r["value"] * BASE ** r["place"]
                out[r["cluster"]] = (count + r["n"] * (r["pos"] == 0), total)
        return out, by_ball

    def assign(self, centroids: list[list[int]]) -> DataFrame:
        """(key, cluster, distance) of each vector; a squared distance that no long holds is null."""
        dim = self.dim
        near = small(max(abs(x) for c in centroids for x in c), dim)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = np.array(centroids, dtype=np.float64) if near else None
            for batch in batches:
                for i in range(batch.num_rows):
                    x, balls = read_tree(batch, i, dim)
                    if near and balls is not None:
                        cluster, _, _ = filtered(x, balls, c)
                        gap = x - c[cluster]
                        distance = (gap * gap).sum(axis=1).astype(np.int64)
                    else:
                        cluster, distance = exact(x, centroids)
                        distance = [d if d < 1 << 63 else None for d in distance]
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("keys"))[i].values, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["key", "cluster", "distance"])

        return self.trees.mapInArrow(place, T.StructType([T.StructField("key", self.kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:", trace: list | None = None) -> DataFrame:
    """A row for each vector with exactly `dim` components, none null or non-finite: key, cluster, distance (squared), cluster_inertia, inertia
    and centroid_sha256 (hash of its centroid's components, joined by commas).  Components are floor(scale * x).

    Centroids start as the vectors with the smallest hashes of seed and key, fewer than k if there are fewer.  Ties between centroids go to
    the smaller number; an empty centroid stays.  Repeated rows count as often as they occur, equal ones in one ball.  Squared
    distances and sums that no long holds are null.  No vectors give no rows; other columns of `df` are ignored.  `trace` gets the
    number of vectors that a whole ball took along, for each round.
    """
    spark = df.sparkSession
    work = Clustering(df, key, vector, dim, scale)
    centroids = work.first(k, seed)
    fields = [T.StructField(key, work.kind), T.StructField("cluster", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")] + [T.StructField("centroid_sha256", T.StringType())]
    if not centroids:
        return spark.createDataFrame([], T.StructType(fields))
    for _ in range(rounds):
        found, by_ball = work.sums(centroids)
        if trace is not None:
            trace.append(by_ball)
        centroids = [[x // found[i][0] for x in found[i][1]] if i in found else c for i, c in enumerate(centroids)]
    placed = work.scratch.keep(work.assign(centroids), "assigned")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("*") == F.count("distance")).alias("whole")).collect()
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    of = {r["cluster"]: int(r["s"]) if r["whole"] else None for r in sums}
    all_ = fits(None if None in of.values() else sum(of.values()))
    facts = [(i, fits(of[i]), all_, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i in sorted(of)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """The rounds written out one after the other."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS no, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) - 1 AS cluster, v FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT no, min(struct_pack(d := d, cluster := cluster)) AS best FROM (
  SELECT no, cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k CROSS JOIN c{i} c) GROUP BY no)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
  SELECT cluster, list(x ORDER BY pos) AS v FROM (SELECT cluster, pos, floor_sum AS x FROM (
    SELECT best.cluster AS cluster, pos, ((sum(v[pos]) - (((sum(v[pos]) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS floor_sum
    FROM a{i} JOIN kept USING (no), range(1, {dim + 1}) AS r(pos) GROUP BY best.cluster, pos)) GROUP BY cluster) m USING (cluster))""")
    body = ",\n".join(steps)
    return f"""WITH {body}
SELECT vec_id, best.cluster::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (no) JOIN c{rounds} c ON c.cluster = best.cluster"""


SQL_OP12 = sql()
