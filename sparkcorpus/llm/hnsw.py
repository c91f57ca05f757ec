"""Embedding near-dedup with a hierarchical navigable small-world graph per shard.

Equal vectors of a label are one row with a weight.  Vectors of one label (and length) are dealt into shards
of about SHARD; each shard gets a graph.  The vectors of every shard then query every shard of their
label, in blocks of vectors that lie near each other.  A block's beam widens by whatever lies within the
threshold of any of its queries, so that a dense cluster costs one matrix product a block; and beams widen
for a whole task until an audit against brute force finds its links, and the nearest neighbours of the
audited queries.  What a beam finds counts only if the cosine in double precision says so.

Links leave a task as counts, and as a row a vector and a row for each pair of clusters that meet; the
components of these are joined over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcorpus.llm.components import connected_components
from sparkcorpus.llm.scratch import Scratch

COSINE = 0.98
SHARD = 8192
#: Links of a node (twice as many in the lowest layer), and beams while building and at first.
M, BUILD_BEAM, BEAM = 12, 48, 32
#: Audited queries of a task (half of them those with the nearest hits), the recall of links and of nearest
#: neighbours that they must show, and vectors that search together.
AUDIT, RECALL, NEAREST, TOGETHER = 64, 1.0, 0.9, 256
#: Blocks of queries in a task, beside one graph.
BLOCKS = 8
#: Single precision may round a link down by less; cosines this near the threshold are computed again, one by one.
SLACK, CLOSE = 1e-5, 1e-9


def top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, in falling order."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims, ids = np.take_along_axis(sims, part, 1), np.take_along_axis(ids, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


class Graph:
    """Layers of neighbour lists over unit vectors; -1 is no neighbour.  Searches enter at `first`.  Built deterministically."""

    first = 0

    def __init__(self, unit: np.ndarray, seed: int = 1):
        n = len(unit)
        self.unit = unit
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 6)
        if n:
            level[0] = level.max()
        self.level = level
        self.layers = [np.full((n, 2 * M if k == 0 else M), -1, dtype=np.int32) for k in range(int(level.max()) + 1 if n else 1)]
        size, done = 1, 1
        while done < n:
            size = min(size * 2, TOGETHER, n - done)
            self.insert(np.arange(done, done + size), done)
            done += size
        self.mend()

    def mend(self) -> None:
        """Nodes of the lowest layer that no other leads to get a link from each of their nearest neighbours."""
        layer = self.layers[0]
        alone = np.flatnonzero(np.bincount(layer[layer >= 0], minlength=len(layer)) == 0)
        a, b = np.repeat(alone, 4), layer[alone, :4].ravel()
        a, b = a[b >= 0], b[b >= 0]
        if not len(a):
            return
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        place = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
        more = np.full((len(layer), int(place.max()) + 1), -1, dtype=np.int32)
        more[b, place] = a
        self.layers[0] = np.concatenate([layer, more], 1)

    def insert(self, new: np.ndarray, done: int) -> None:
        """Nodes that search the graph of the first `done` nodes together, and see each other."""
        queries = self.unit[new]
        start = np.zeros(len(new), dtype=np.int64)
        among = queries @ queries.T
        np.fill_diagonal(among, -2)
        for k in range(len(self.layers) - 1, -1, -1):
            here = self.level[new] >= k
            if not here.all():
                idle = ~here
                start[idle] = self.search(queries[idle], start[idle], k, 1)[1][:, 0]
            if here.any():
                sims, ids = self.search(queries[here], start[here], k, BUILD_BEAM)
                start[here] = ids[:, 0]
                peers = np.where(here[None, :], among[here], -2.0)
                sims, ids = top(np.concatenate([sims, peers], 1), np.concatenate([ids, np.broadcast_to(new, peers.shape)], 1), BUILD_BEAM)
                self.link(new[here], sims, ids, k)

    def choose(self, sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Spread neighbours: one is taken unless it is closer to one already taken than to the node."""
        rows, width = sims.shape
        out, many = np.full((rows, most), -1, dtype=np.int32), np.zeros(rows, dtype=np.int64)
        vectors = self.unit[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros((rows, width), dtype=bool)
        for j in range(width):
            blocked = (taken & (between[:, j, :] > sims[:, j : j + 1])).any(1)
            ok = (ids[:, j] >= 0) & (sims[:, j] > -1.5) & ~blocked & (many < most)
            taken[ok, j] = True
            out[ok, many[ok]] = ids[ok, j]
            many += ok
        # what room is left goes to the nearest of the others
        for j in range(width):
            ok = (ids[:, j] >= 0) & (sims[:, j] > -1.5) & ~taken[:, j] & (many < most)
            taken[ok, j] = True
            out[ok, many[ok]] = ids[ok, j]
            many += ok
        return out

    def link(self, nodes: np.ndarray, sims: np.ndarray, ids: np.ndarray, k: int) -> None:
        layer = self.layers[k]
        picked = self.choose(sims, ids, M)
        layer[nodes, :M] = picked
        layer[nodes, M:] = -1
        a, b = np.repeat(nodes, M), picked.ravel()
        a, b = a[b >= 0], b[b >= 0]
        known = (layer[b] == a[:, None]).any(1)
        a, b = a[~known], b[~known]
        # of the new links to a node, its nearest; no more than it can hold
        s = np.einsum("ed,ed->e", self.unit[a], self.unit[b])
        order = np.lexsort((-s, b))
        a, b, s = a[order], b[order], s[order]
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
        place = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
        held = place < layer.shape[1]
        row = np.cumsum(place == 0) - 1
        to = b[begin]
        more = np.full((len(to), layer.shape[1]), -1, dtype=np.int64)
        more[row[held], place[held]] = a[held]
        have = layer[to].astype(np.int64)
        full = (have >= 0).sum(1) + (more >= 0).sum(1) > layer.shape[1]
        room = np.concatenate([have[~full], more[~full]], 1)
        left = np.argsort(room < 0, axis=1, kind="stable")[:, : layer.shape[1]]
        layer[to[~full]] = np.take_along_axis(room, left, 1)
        for i in range(0, int(full.sum()), 1024):
            some = np.flatnonzero(full)[i : i + 1024]
            both = np.concatenate([have[some], more[some]], 1)
            sims = np.where(both >= 0, (self.unit[np.maximum(both, 0)] @ self.unit[to[some]][:, :, None])[:, :, 0], -2)
            width = int((both >= 0).sum(1).max())
            layer[to[some]] = self.choose(*top(sims, both, width), layer.shape[1])

    def search(self, queries: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes found from `start` in layer k for each query: similarities and ids."""
        rows, layer = np.arange(len(queries)), self.layers[k]
        visited = np.zeros((len(queries), len(self.unit)), dtype=bool)
        visited[rows, start] = True
        sims = np.full((len(queries), beam), -3.0, dtype=np.float32)
        ids = np.full((len(queries), beam), -1, dtype=np.int64)
        sims[:, 0], ids[:, 0] = np.einsum("qd,qd->q", queries, self.unit[start]), start
        spread = np.zeros((len(queries), beam), dtype=bool)
        live, step = rows, min(beam, 4)
        while len(live):
            open_ = np.where(spread[live] | (ids[live] < 0), -4.0, sims[live])
            pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if step < beam else np.broadcast_to(np.arange(beam), (len(live), beam))
            good = np.take_along_axis(open_, pick, 1) > -3.5
            live, pick, good = live[good.any(1)], pick[good.any(1)], good[good.any(1)]
            if not len(live):
                break
            r, c = np.nonzero(good)
            spread[live[r], pick[r, c]] = True
            nodes = np.where(good, ids[live[:, None], pick], -1)
            near = np.where(nodes[:, :, None] >= 0, layer[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~visited[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(new)
            visited[live[r], near[r, c]] = True
            found = np.full(near.shape, -3.0, dtype=np.float32)
            found[r, c] = np.einsum("qd,qd->q", queries[live[r]], self.unit[near[r, c]])
            s = np.concatenate([sims[live], found], 1)
            i = np.concatenate([ids[live], np.where(new, near, -1)], 1)
            e = np.concatenate([spread[live], np.zeros(near.shape, dtype=bool)], 1)
            order = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live], spread[live] = (np.take_along_axis(x, order, 1) for x in (s, i, e))
        return sims, ids

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Where each query enters the lowest layer."""
        start = np.full(len(queries), self.first, dtype=np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            start = self.search(queries, start, k, 1)[1][:, 0]
        return start

    def reordered(self, order: np.ndarray) -> Graph:
        """The same graph with nodes numbered in this order."""
        out = Graph.__new__(Graph)
        place = np.full(len(order) + 1, -1, dtype=np.int32)  # the last is that of no neighbour
        place[order] = np.arange(len(order))
        out.unit, out.layers, out.first = self.unit[order], [place[x[order]] for x in self.layers], int(place[self.first])
        return out

    def backward(self) -> tuple[np.ndarray, np.ndarray]:
        """The lowest layer's links read backwards: of node i, begin[i] .. begin[i + 1] of the second array."""
        if not hasattr(self, "_backward"):
            layer = self.layers[0]
            a, b = np.nonzero(layer >= 0)
            to = layer[a, b]
            order = np.argsort(to, kind="stable")
            self._backward = np.searchsorted(to[order], np.arange(len(layer) + 1)), a[order].astype(np.int32)
        return self._backward

    def around(self, queries: np.ndarray, start: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a block of queries: the nodes found with at least this similarity to any of them, and the ids
        and similarities that the beams ended with.  What the beams found spreads along links in both directions, since
        of a dense cluster some nodes are named by none of their neighbours."""
        sims, ids = self.search(queries, start, 0, min(beam, len(self.unit)))
        seen = np.zeros(len(self.unit), dtype=bool)
        front = np.unique(ids[(sims >= least) & (ids >= 0)])
        seen[front] = True
        kept = [front]
        begin, back = self.backward()
        while len(front):
            many = begin[front + 1] - begin[front]
            place = np.arange(int(many.sum())) + np.repeat(begin[front] - (np.cumsum(many) - many), many)
            near = np.concatenate([self.layers[0][front].ravel(), back[place]])
            near = np.unique(near[near >= 0])
            near = near[~seen[near]]
            seen[near] = True
            front = near[((self.unit[near] @ queries.T) >= least).any(1)] if len(near) else near
            kept.append(front)
        return np.concatenate(kept), ids, sims


def unit64(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def verified(queries: np.ndarray, vectors: np.ndarray, q64: np.ndarray, v64: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of a block of queries and a block of vectors are links, in double precision."""
    cos = q64 @ v64.T
    out = cos >= least
    r, c = np.nonzero(np.abs(cos - least) < CLOSE)
    if len(r):
        out[r, c] = cosines(queries[r], vectors[c]) >= least
    return out


def spread_labels(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least label that links (a matrix) lead to, of each row and column with a link."""
    most = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(links, right[None, :], most).min(1, initial=most))
        new_right = np.minimum(right, np.where(links, new_left[:, None], most).min(0, initial=most))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that pairs lead to, of each of n nodes."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


class Searched:
    """Links of queries to the vectors of one graph: their summed weights by query, pairs of labels that
    meet, and what the audit saw."""

    def __init__(self, index: Graph, vectors: np.ndarray, weights: np.ndarray, queries: np.ndarray, same: bool, least: float, labels: np.ndarray, query_labels: np.ndarray, beam: int = BEAM):
        self.index, self.vectors, self.queries, self.same, self.least = index, vectors, queries, same, least
        self.v64, self.q64 = unit64(vectors), unit64(queries)
        units = self.q64.astype(np.float32)
        # vectors of the graph start at themselves, others where the upper layers lead them
        start = np.arange(len(units)) if same else np.concatenate([index.entries(units[i : i + TOGETHER]) for i in range(0, len(units), TOGETHER)])
        self.rounds, wider = 0, 0.0
        while True:
            self.rounds += 1
            found = [index.around(units[i : i + TOGETHER], start[i : i + TOGETHER], least - SLACK - wider, beam) for i in range(0, len(units), TOGETHER)]
            nodes = [f[0] for f in found]
            if self.passes(units, nodes, np.concatenate([f[1][:, :2] for f in found]), np.concatenate([f[2][:, :2] for f in found])):
                break
            if beam >= len(vectors):
                # every beam held the whole graph, so what is missing cannot be reached in it
                self.brute, self.found_links = len(queries), self.true_links
                nodes = [np.arange(len(vectors))] * len(found)
                break
            beam, wider = beam * 2, max(0.01, wider * 2)
        self.links = np.zeros(len(queries), dtype=np.int64)
        meets = []
        for i, some in enumerate(nodes):
            rows = slice(i * TOGETHER, (i + 1) * TOGETHER)
            some = np.sort(some)
            ok = verified(queries[rows], vectors[some], self.q64[rows], self.v64[some], least)
            if same:
                mine = np.arange(rows.start, rows.start + len(ok))
                at = np.minimum(np.searchsorted(some, mine), max(len(some) - 1, 0))
                hit = some[at] == mine if len(some) else np.zeros(len(mine), bool)
                ok[np.flatnonzero(hit), at[hit]] = False
            self.links[rows] = ok @ weights[some]
            r, c = ok.any(1), ok.any(0)
            part = ok[np.ix_(r, c)]
            a, b = query_labels[rows][r], labels[some[c]]
            x, y = spread_labels(part, a, b)
            meets.append(np.unique(np.stack([np.concatenate([a, b]), np.concatenate([x, y])], 1), axis=0))
        self.meets = np.unique(np.concatenate(meets), axis=0) if meets else np.zeros((0, 2), np.int64)

    def audit(self) -> list[int]:
        return [self.audited, self.true_links, self.found_links, self.brute]

    def passes(self, units: np.ndarray, nodes: list[np.ndarray], ids: np.ndarray, sims: np.ndarray) -> bool:
        """Whether the audited queries, some with the nearest hits and some drawn, have their links and their
        nearest neighbours among what was found."""
        self.brute = 0
        n = len(units)
        own = ids == np.arange(n)[:, None] if self.same else np.zeros(ids.shape, bool)
        best = np.where(own, -4.0, sims)
        nearest = np.take_along_axis(ids, best.argmax(1)[:, None], 1)[:, 0]
        order = np.argsort(-best.max(1), kind="stable")[: AUDIT // 2]
        drawn = np.random.default_rng(7).permutation(n)[: AUDIT // 2]
        audited = np.unique(np.concatenate([order, drawn]))
        exact = units[audited] @ self.index.unit.T
        if self.same:
            exact[np.arange(len(audited)), audited] = -4.0
        true = exact >= self.least - SLACK
        got = np.zeros(true.shape, dtype=bool)
        for i, q in enumerate(audited):
            got[i, nodes[q // TOGETHER]] = True
        self.audited, self.true_links, self.found_links = len(audited), int(true.sum()), int((true & got).sum())
        top_ = exact.max(1)
        reached = exact[np.arange(len(audited)), np.maximum(nearest[audited], 0)] >= top_ - SLACK
        alone = top_ < -1.5  # a query that has no other vector to find
        self.nearest = float((reached | alone).mean())
        return self.found_links >= RECALL * self.true_links and self.nearest >= NEAREST


#: One row a shard: its vectors in order, their weights, their links and the local cluster of each, and its graph.
INDEX = "label string, d int, shard int, shards int, ids binary, vectors binary, weights binary, groups binary, links binary, layers array<binary>, audited long, true_links long, found_links long, brute long"
AUDITED = ["audited", "true_links", "found_links", "brute"]
#: Links of a vector; or two clusters that meet; or what the audit of a task saw.
FOUND = "id long, links long, other long, audited long, true_links long, found_links long, brute long"


def as_rows(ids: np.ndarray, links: np.ndarray, meets: np.ndarray, audit: list[int]) -> pa.RecordBatch:
    none = lambda k: pa.nulls(k, pa.int64())
    a, m = len(ids), len(meets)
    whole = lambda *x: pa.concat_arrays([pa.array(y, pa.int64()) if isinstance(y, np.ndarray) else y for y in x])
    columns = [whole(ids, meets[:, 0].copy(), none(1)), whole(links, none(m + 1)), whole(none(a), meets[:, 1].copy(), none(1)), *[whole(none(a + m), np.array([x])) for x in audit]]
    return pa.RecordBatch.from_arrays(columns, ["id", "links", "other", *AUDITED])


def i8(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.int64)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE, shard: int = SHARD, with_audit: bool = False):
    """(key, n_links, component_id, kept) of each row; `with_audit`: that, and a table of one row that sums up the
    audits: queries audited, true links they have, those found, and queries that were compared by brute force.

    Rows with a null label, or a vector that is null, empty, zero or has null or non-finite
    components, have no links and are components of their own.  Rows with one key are different
    vectors; components are named by their smallest key, null if they have none.  Vectors of
    different lengths are not compared.  Keys are cast to long.  No rows give no rows; other columns are
    ignored.  Links are counted as each vector's own search finds them.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "hnsw")
    single = isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    v = df[vector] if single else df[vector].cast("array<double>")
    real = np.dtype(np.float32 if single else np.float64)
    fine = F.coalesce(F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & df[label].isNotNull()
    rows = df.select(F.monotonically_increasing_id().alias("id"), df[key].cast("long").alias("key"), F.to_json(F.struct(df[label])).alias("label"), v.alias("v"), F.size(v).alias("d"), fine.alias("fine"))
    rows = scratch.keep(rows, "rows")
    # equal vectors in any number become one row each task before they meet
    distinct = scratch.keep(rows.filter("fine").groupBy("label", "d", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "distinct")
    counts = distinct.groupBy("label", "d").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = distinct.join(counts, ["label", "d"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, weights = (table[c].to_numpy() for c in ("id", "weight"))
        vectors = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        graph = Graph(unit64(vectors).astype(np.float32))
        # in order of the nodes by which rows enter the lowest layer, so that those in a block lie near each other
        order = np.argsort(graph.entries(graph.unit), kind="stable")
        graph, ids, weights, vectors = graph.reordered(order), ids[order], weights[order], vectors[order]
        s = Searched(graph, vectors, weights, vectors, True, least, ids, ids)
        at = np.argsort(ids)
        nodes = at[np.searchsorted(ids[at], s.meets)]
        by_id = np.empty(len(ids), dtype=np.int64)
        by_id[at] = np.arange(len(ids))
        groups = ids[at][forest(by_id[nodes[:, 0]], by_id[nodes[:, 1]], len(ids))[by_id]]
        head = [pa.array([table[c][0].as_py()], t) for c, t in (("label", pa.string()), ("d", pa.int32()), ("shard", pa.int32()), ("shards", pa.int32()))]
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors.astype(real), weights, groups, s.links + weights - 1)]
        layers = pa.array([[np.int32(graph.first).tobytes(), *[x.tobytes() for x in graph.layers]]], pa.list_(pa.binary()))
        names = ["label", "d", "shard", "shards", "ids", "vectors", "weights", "groups", "links", "layers", *AUDITED]
        return pa.Table.from_arrays([*head, *packed, layers, *[pa.array([x], pa.int64()) for x in s.audit()]], names)

    # a group is one shard, of about so many rows
    n_shards = counts.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dealt = dealt.repartition(2 * n_shards + 1, "label", "d", "shard")  # as many tasks as the work asks for, however few its bytes
    index = scratch.keep(dealt.groupBy("label", "d", "shard").applyInArrow(build, INDEX), "index")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, links, groups = (i8(batch.column(c)[i]) for c in range(3))
                linked = ids != groups
                yield as_rows(ids, links, np.stack([ids[linked], groups[linked]], 1), [batch.column(c)[i].as_py() for c in range(3, 7)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of a shard as queries of a task each."""
        size = BLOCKS * TOGETHER
        for batch in batches:
            for i in range(batch.num_rows):
                ids, groups = i8(batch.column("ids")[i]), i8(batch.column("groups")[i])
                vectors = np.frombuffer(batch.column("vectors")[i].as_py(), real).reshape(len(ids), -1)
                for p, a in enumerate(range(0, len(ids), size)):
                    head = [batch.column(c).slice(i, 1) for c in ("label", "d", "shards")]
                    packed = [pa.array([x[a : a + size].tobytes()], pa.binary()) for x in (ids, vectors, groups)]
                    yield pa.RecordBatch.from_arrays([*head, batch.column("shard").slice(i, 1), pa.array([p], pa.int32()), *packed], ["label", "d", "shards", "own", "part", "query_ids", "queries", "query_groups"])

    def query(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links of some parts of other shards to a shard."""
        out = []
        if left.num_rows and right.num_rows:
            ids, weights, groups = (i8(left[c][0]) for c in ("ids", "weights", "groups"))
            vectors = np.frombuffer(left["vectors"][0].as_py(), real).reshape(len(ids), -1)
            first, *layers = left["layers"][0].as_py()
            graph = Graph.__new__(Graph)
            graph.unit, graph.first = unit64(vectors).astype(np.float32), int(np.frombuffer(first, np.int32)[0])
            graph.layers = [np.frombuffer(x, np.int32).reshape(len(ids), -1) for x in layers]
            for i in range(right.num_rows):
                query_ids, query_groups = i8(right["query_ids"][i]), i8(right["query_groups"][i])
                queries = np.frombuffer(right["queries"][i].as_py(), real).reshape(len(query_ids), -1)
                s = Searched(graph, vectors, weights, queries, False, least, groups, query_groups)
                some = s.links > 0
                out.append(as_rows(query_ids[some], s.links[some], s.meets[s.meets[:, 0] != s.meets[:, 1]], s.audit()))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([as_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), [0] * 4)])

    keys = ["label", "d", "shard", "salt"]
    many = index.filter("shards > 1")
    parts = many.select("label", "d", "shard", "shards", "ids", "vectors", "groups").mapInArrow(cut, "label string, d int, shards int, own int, part int, query_ids binary, queries binary, query_groups binary")
    # each part meets every other shard; a shard's graph goes to as many tasks as its label has shards
    targets = parts.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter("shard <> own").withColumn("salt", F.pmod(F.xxhash64("own", "part"), "shards").cast("int"))
    graphs = many.select("label", "d", "shard", "ids", "vectors", "weights", "groups", "layers", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("salt"))
    n_tasks = index.filter("shards > 1").count() * 4 + 1
    graphs, targets = graphs.repartition(n_tasks, *keys), targets.drop("own", "part", "shards").repartition(n_tasks, *keys)
    across = graphs.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInArrow(query, FOUND)
    within = index.select("ids", "links", "groups", *AUDITED).mapInArrow(unpack, FOUND)
    found = scratch.keep(within.unionByName(across), "found")
    links = found.filter("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    classes = links.join(groups, links["id"] == groups["node"], "left").select("id", "links", F.coalesce("component", "id").alias("g"))
    classes = scratch.keep(distinct.join(classes, "id").select("label", "d", "v", "links", "g"), "classes")
    named = rows.join(classes, ["label", "d", "v"], "left").select("id", "key", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("g", "id").alias("g"))
    named = scratch.keep(named, "named")
    least_key = scratch.keep(named.groupBy(F.col("g").alias("h")).agg(F.min("key").alias("component_id")), "least")
    out = named.join(least_key, F.col("g") == F.col("h"))
    out = out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
    scratch.drop("distinct", "index", "classes", "rows")
    return (out, found.filter("audited is not null").agg(*[F.sum(c).alias(c) for c in AUDITED])) if with_audit else out


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL_OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
