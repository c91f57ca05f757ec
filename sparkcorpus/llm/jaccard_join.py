"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Texts become sets of word-shingle hashes; equal sets are one vertex.  Shingles have a global
order, rare ones first.  If two sets of Jaccard similarity s share at least t shingles, then for
any l the first n - t + l shingles of each hold at least l common ones.  Every set picks its own
l: where the estimated cost of its candidates is high, it takes a longer prefix and asks for
more common shingles.  A pair is a candidate only if its prefixes share min(l, l') shingles, which is counted
before sketches and sets are compared.

Which shingles are common is found in two ways: those that several texts of one group of rows share,
and, by exact counts over all documents, those that many prefixes in order of hash have.

Nothing emits all pairs of a group that shares a shingle:
  1. of the owners of a shingle each is paired with the most central one, and with the one before it in
     that order; of these pairs every set keeps the two with most common shingles;
  2. verified links form components, and only owners of a shingle that lie in different ones
     are paired further, so that no component is split.
The result is components only: links inside a component beyond those that made it are not verified or counted.
Pairs first meet with sketches of their sets, two to four parity bits a shingle: no two sets differ in
fewer shingles than their sketches in bits, so a pair whose sketches differ too much is no link.
The sets of the few others are made from the texts again and compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.llm.components import connected_components
from sparkcorpus.llm.kernels import Runs, U, Words, chunks, i64, mix, window_starts
from sparkcorpus.llm.scratch import Scratch

SHINGLE, PERCENT = 5, 80
#: A shingle is heavy if it makes up this share of all (so at most 1 / SHARE are, which bounds what is
#: broadcast), and has so many owners at least.
SHARE, LEAST_HEAVY, LOCAL = 2e-6, 32, 3
#: Or if so many prefixes have it; prefixes are counted somewhat longer than they will be.
LEAST_COMMON, LONGER = 6, 1.5
#: Texts that are looked through together for heavy shingles, in bytes; the fewest bits of a sketch.
SCAN_BYTES, SKETCH = 2 << 20, 256
#: Groups of owners up to FEW are paired as rows, larger ones in blocks.
FEW, BLOCK = 6, 512
#: The longest prefixes ask for so many common shingles.
MOST_SHARED = 8
#: Shingles of pairs that are verified together.
VERIFIED = 1 << 18


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted; their bounds; and a hash of each set."""
    w = Words(raw, off, lower=True)
    runs = Runs(w.hashes())
    starts, many = window_starts(w.bounds, width)
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    owner = np.concatenate([np.repeat(np.arange(len(many)), many), few])
    hashes = np.concatenate([runs.of(starts, starts + width), runs.of(w.bounds[few], w.bounds[few + 1])])
    if len(few):
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    cut = np.searchsorted(owner, np.arange(len(many) + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    cut = np.searchsorted(owner, np.arange(len(many) + 1))
    sums = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(mix(hashes ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    return hashes, cut, mix(sums[cut[1:]] - sums[cut[:-1]] + np.diff(cut).astype(U) * U(0x9E3779B97F4A7C15))


def sketches(hashes: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Of each set, which of so many buckets get an odd number of its shingles, as 64-bit words.

    The number of buckets is a power of two; both halves of a sketch together (by exclusive or) are
    the sketch of half the size.
    """
    sizes = np.diff(cut)
    bits = SKETCH << np.ceil(np.log2(np.maximum(2 * sizes / SKETCH, 1))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    bucket = hashes & (np.repeat(bits, sizes).astype(U) - U(1))
    odd = np.bincount(np.repeat(begin[:-1], sizes) + bucket.astype(np.int64), minlength=int(begin[-1])) & 1
    words = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array((begin // 64).astype(np.int32)), pa.array(words))


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of n must share with any set it is linked with."""
    return (percent * n + 99) // 100


class Order:
    """The global order of shingles: those not known as heavy by hash, then heavy ones by owners."""

    def __init__(self, tokens: np.ndarray, owners: np.ndarray):
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
        self.most_shared = MOST_SHARED
        self.tokens, self.owners = tokens[first], np.maximum.reduceat(owners, first) if len(first) else owners

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the table of heavy shingles; -1 for others."""
        if not len(self.tokens):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        return np.where(self.tokens[at] == hashes, at, -1)

    def prefix(self, hashes: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The set in global order with its heavy places, the prefix's length and l."""
        n = len(hashes)
        least = least_overlap(n, percent)
        heavy = at >= 0
        if not heavy.any():
            return hashes, at, n - least + 1, 1
        rank = np.where(heavy, self.owners[at], 0)
        order = np.argsort(rank, kind="stable")  # hashes come sorted, so ties stay in order of hash
        hashes, at, rank = hashes[order], at[order], rank[order]
        ells = np.arange(1, min(self.most_shared, max(least, 1)) + 1)
        upto = np.cumsum(rank)[np.minimum(n - least + ells, n) - 1]
        # owners to go through, and candidates to verify, of which l common shingles are asked
        ell = int(ells[np.argmin(ells + upto + n * (upto / ells))])
        return hashes, at, n - least + ell, ell


def scan(documents: DataFrame, key: str, text: str) -> DataFrame:
    """kind 0: (key, set size, vertex, sketch) of each row; kind 1: (shingle, owners) of shingles
    that several texts of a group of rows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in chunks(batches, "text", SCAN_BYTES):
            hashes, cut, vertex = shingle_sets(raw, off)
            sizes = np.diff(cut)
            names = ["kind", "a", "b", "c", "sketch"]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int8)), batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(i64(vertex), mask=sizes == 0), sketches(hashes, cut)], names)
            sorted_ = np.sort(hashes)
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, int)
            many = np.diff(np.append(first, len(sorted_)))
            hot = many >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(hot.sum()), np.int8)), pa.array(i64(sorted_[first[hot]])), pa.array(many[hot].astype(np.int64)), pa.nulls(int(hot.sum()), pa.int64()), pa.nulls(int(hot.sum()), pa.list_(pa.int64()))], names)

    return documents.select(documents[key].cast("long").alias("key"), documents[text].alias("text")).mapInArrow(run, "kind byte, a long, b long, c long, sketch array<long>")


def common_order(documents: DataFrame, text: str, scanned: DataFrame, percent: int):
    """The broadcast order: at most 2 / SHARE common shingles of 16 bytes, those with most owners."""
    sc = documents.sparkSession.sparkContext
    most = int(1 / SHARE)
    total = scanned.filter("kind = 0").agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    least = max(LEAST_HEAVY, int(total * SHARE) + 1)  # so many owners have at most `most` shingles
    arrays = lambda df: [df.toArrow()[c].to_numpy() for c in ("shingle", "owners")]
    heavy = arrays(scanned.filter("kind = 1").groupBy(F.col("a").alias("shingle")).agg(F.sum("b").alias("owners")).filter(F.col("owners") >= least))
    first = sc.broadcast(Order(heavy[0].view(np.uint64), heavy[1]))
    counted = prefixes(documents, text, first, percent, LONGER).groupBy("shingle").agg(F.count("*").alias("owners")).filter(F.col("owners") >= LEAST_COMMON)
    common = arrays(counted.orderBy(F.desc("owners"), "shingle").limit(most))
    return sc.broadcast(Order(np.concatenate([heavy[0], common[0]]).view(np.uint64), np.concatenate([heavy[1], common[1]])))


def prefixes(documents: DataFrame, text: str, order, percent: int, longer: float | None = None) -> DataFrame:
    """(v, n, l, q, light, heavy) for every text with words: the shingles of its prefix, those known as common apart.
    With `longer`, the light shingles alone, a row each, of prefixes so many times as long.  q is the share of
    common shingles in the set: in a family of near copies it is largest for those with fewest changes of
    their own, which so become the leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for _, raw, off in chunks(batches, "text"):
            hashes, cut, vertex = shingle_sets(raw, off)
            at = known.find(hashes)
            sizes = np.diff(cut)
            lengths, ells = sizes - least_overlap(sizes, percent) + 1, np.ones(len(sizes), np.int64)
            lengths[sizes == 0] = 0
            sums = np.concatenate([[0], np.cumsum(at >= 0)])
            for i in np.flatnonzero(sums[cut[1:]] > sums[cut[:-1]]):
                part = slice(cut[i], cut[i + 1])
                hashes[part], at[part], lengths[i], ells[i] = known.prefix(hashes[part], at[part], percent)
            if longer:
                lengths = np.minimum((lengths * longer).astype(np.int64), sizes)
            begin = np.cumsum(lengths) - lengths
            take = np.arange(int(lengths.sum())) + np.repeat(cut[:-1] - begin, lengths)
            light = at[take] < 0
            if longer:
                yield pa.RecordBatch.from_arrays([pa.array(i64(hashes[take][light]))], ["shingle"])
                continue
            owner, some = np.repeat(np.arange(len(sizes)), lengths), np.flatnonzero(sizes)

            def lists(which: np.ndarray) -> pa.Array:
                bounds = np.searchsorted(owner[which], np.append(some, len(sizes))).astype(np.int32)  # noqa: B023
                return pa.ListArray.from_arrays(pa.array(bounds), pa.array(i64(hashes[take][which])))  # noqa: B023

            central = (1000 * (sums[cut[1:]] - sums[cut[:-1]]) // np.maximum(sizes, 1)).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i64(vertex)[some]), pa.array(sizes[some].astype(np.int32)), pa.array(ells[some].astype(np.int8)), pa.array(central[some]), lists(light), lists(~light)], ["v", "n", "l", "q", "light", "heavy"]
            )

    rows = documents.select(documents[text].alias("text"))
    return rows.mapInArrow(run, "shingle long" if longer else "v long, n int, l byte, q short, light array<long>, heavy array<long>")


def runs_to_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """From sorted runs: kinds 0 and 2, pairs (first of the run, or the one before; other); kind 1, owners of
    shingles with two or more.  A pair or owner may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)]
        for batch in batches:
            if not batch.num_rows:
                continue
            t, v, n, l = (np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
            t, v, n, l = t[new], v[new], n[new], l[new]
            first = np.concatenate([[True], t[1:] != t[:-1]])
            begin = np.flatnonzero(first)
            many = np.diff(np.append(begin, len(t)))
            lead = np.repeat(begin, many)
            ok = lambda x, y: 100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64)
            big = np.repeat(many >= 2, many)
            owners, later = np.flatnonzero(big), np.flatnonzero(~first)
            x, y = np.concatenate([lead[later], later - 1]), np.concatenate([later, later])
            pair = np.repeat(np.array([0, 2], np.int8), len(later))
            x, y, pair = x[ok(x, y)], y[ok(x, y)], pair[ok(x, y)]
            kind = np.concatenate([pair, np.ones(len(owners), np.int8)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(np.concatenate([v[x], t[owners]])), pa.array(np.concatenate([v[y], v[owners]])), pa.array(np.concatenate([n[y] * 0, n[owners]])), pa.array(np.concatenate([l[y] * 0, l[owners]]))],
                ["kind", "a", "b", "n", "l"],
            )
            held = [x[begin[-1] : begin[-1] + 3] for x in (t, v, n, l)]

    return rows.mapInArrow(run, "kind byte, a long, b long, n int, l byte")


def sets_of(documents: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(v, items): the sets of wanted vertices, from one document each."""
    texts = documents.select(documents[key].cast("long").alias("key"), documents[text].alias("text")).join(wanted, "key").select("v", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in chunks(batches, "text"):
            hashes, cut, vertex = shingle_sets(raw, off)
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(i64(hashes)))
            right = pa.array(i64(vertex) == batch.column(0).to_numpy())  # a key may have several rows
            yield pa.RecordBatch.from_arrays([pa.array(i64(vertex)), lists], ["v", "items"]).filter(right)

    return texts.mapInArrow(run, "v long, items array<long>")


def shared(pairs: DataFrame, owned: DataFrame) -> DataFrame:
    """Of (a, b), those whose prefixes have min(l, l') shingles in common at least, as links do."""
    side = lambda x: owned.select(F.col("v").alias(x), F.col("l").alias(f"l_{x}"), F.concat("light", "heavy").alias(f"p_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.filter(F.size(F.array_intersect("p_a", "p_b")) >= F.least("l_a", "l_b")).select("a", "b")


def common_items(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """Of each row, how many items two lists without repetitions share."""
    flat = np.concatenate([x.flatten().to_numpy(), y.flatten().to_numpy()])
    row = np.concatenate([np.repeat(np.arange(len(x)), z.value_lengths().to_numpy()) for z in (x, y)])
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    return np.bincount(row[1:][(flat[1:] == flat[:-1]) & (row[1:] == row[:-1])], minlength=len(x))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those that are linked."""
    side = lambda x: sets.select(F.col("v").alias(x), F.col("items").alias(f"x_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "x_a", "x_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            upto = np.cumsum(sum(whole.column(c).value_lengths().to_numpy().astype(np.int64) for c in (2, 3)))
            begin = 0
            while begin < whole.num_rows:
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + VERIFIED, side="right")))
                batch = whole.slice(begin, end - begin)
                x, y = batch.column(2), batch.column(3)
                common = common_items(x, y)
                union = x.value_lengths().to_numpy() + y.value_lengths().to_numpy() - common
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(100 * common >= percent * union))
                begin = end

    return both.mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose sketches allow a link."""
    side = lambda x: vertices.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    size = F.least(F.size("s_a"), F.size("s_b"))
    xor = lambda x, y: F.zip_with(x, y, lambda i, j: i.bitwiseXOR(j))
    # sizes of possible links differ by less than two, so a sketch is at most twice the other
    fold = lambda s: F.when(F.size(s) > size, xor(F.slice(s, 1, size), F.slice(s, size + 1, size))).otherwise(F.col(s))
    apart = F.aggregate(xor(fold("s_a"), fold("s_b")), F.lit(0), lambda x, y: x + F.bit_count(y))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.filter(fits & ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def blockwise(rows: DataFrame, vertices: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): owners of a common shingle in different components whose sketches allow a link.

    rows: (shingle, v, n, g, k).  The k owners of a shingle are dealt into blocks of about BLOCK; blocks meet in
    pairs, and a pair of blocks is compared as matrices of sketches, so only what may be a link leaves the task.
    """
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("v"), F.ceil(F.col("k") / BLOCK)).cast("int"))
    drawn = dealt.join(vertices.select("v", "sketch"), "v")
    blocks = drawn.groupBy("shingle", "block").agg(F.collect_list(F.struct("v", "n", "g", "sketch")).alias("x"))  # about BLOCK rows
    blocks = scratch.keep(blocks, "blocks")
    both = blocks.join(blocks.select("shingle", F.col("block").alias("other"), F.col("x").alias("y")), "shingle").filter("block <= other").select("x", "y")

    def read(column: pa.ListArray) -> tuple[np.ndarray, list]:
        flat = column.flatten()
        words = flat.field(3)
        return column.offsets.to_numpy(), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)] + [words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), words.offsets.to_numpy()]

    def part(side: list, a: int, b: int) -> dict[int, tuple]:
        """Members a .. b by the length of their sketches."""
        v, n, g, words, off = side
        size = off[a + 1 : b + 1] - off[a:b]
        out = {}
        for s in np.unique(size):
            at = a + np.flatnonzero(size == s)
            out[int(s)] = v[at], n[at].astype(np.int64), g[at], np.stack([words[off[i] : off[i + 1]] for i in at])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ox, x), (oy, y) = read(batch.column(0)), read(batch.column(1))
            for i in range(batch.num_rows):
                left, right, out = part(x, ox[i], ox[i + 1]), part(y, oy[i], oy[i + 1]), []
                for s, (v, n, g, w) in left.items():
                    for t, (v2, n2, g2, w2) in right.items():
                        if max(s, t) > 2 * min(s, t):
                            continue
                        size = min(s, t)
                        fold = lambda z, size=size: z if z.shape[1] == size else z[:, :size] ^ z[:, size:]
                        apart = np.zeros((len(v), len(v2)), dtype=np.int64)
                        for p, q in zip(fold(w).T, fold(w2).T, strict=True):
                            apart += np.bitwise_count(p[:, None] ^ q[None, :])
                        total = n[:, None] + n2[None, :]
                        ok = (g[:, None] != g2[None, :]) & (100 * np.minimum(n[:, None], n2[None, :]) >= percent * np.maximum(n[:, None], n2[None, :])) & ((100 + percent) * apart <= (100 - percent) * total)
                        a, b = np.nonzero(ok)
                        out.append((np.minimum(v[a], v2[b]), np.maximum(v[a], v2[b])))
                if out:
                    pairs = np.unique(np.stack([np.concatenate([o[k] for o in out]) for k in range(2)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of each row.

    Rows without words have an empty set, which is linked with nothing.  Rows with a null key are
    not linked either; their component is null.  Repeated rows, and rows with one key, are all
    returned.  No rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    scanned = scratch.keep(scan(documents, key, text), "scanned")
    linked_docs = documents.filter(documents[key].isNotNull())
    order = common_order(linked_docs, text, scanned, percent)
    rows = scanned.filter("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("n"), F.col("c").alias("v"), "sketch")
    linkable = rows.filter("v is not null and key is not null")
    vertices = scratch.keep(linkable.groupBy("v").agg(F.min("key").alias("key"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "vertices")

    # equal sets have equal prefixes: one row a vertex
    owned = scratch.keep(prefixes(linked_docs, text, order, percent).dropDuplicates(["v"]), "prefixes")
    light = owned.select(F.explode("light").alias("shingle"), "v", "n", "l", "q").repartition("shingle").sortWithinPartitions("shingle", F.desc("q"), "v")
    counts = runs_to_pairs(light, percent).groupBy("kind", "a", "b").agg(F.count("*").alias("c"), F.any_value("n").alias("n"), F.any_value("l").alias("l"))
    runs = scratch.keep(counts, "runs")
    heavy = owned.select(F.explode("heavy").alias("shingle"), "v", "n", "l", "q")
    first = scratch.keep(heavy.groupBy("shingle").agg(F.max_by("v", F.struct("q", "v")).alias("lead")), "leads")
    led = heavy.join(first, "shingle").filter("lead <> v").groupBy(F.col("lead").alias("a"), F.col("v").alias("b")).agg(F.count("*").alias("c")).withColumn("kind", F.lit(0))
    owners = runs.filter("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("v"), "n", "l").unionByName(heavy.drop("q"))
    best = runs.filter("kind <> 1").select("kind", "a", "b", "c").unionByName(led).groupBy("kind", "b").agg(F.max(F.struct("c", -F.col("a"), "a")).alias("x"))
    pairs = best.select(F.least("x.a", "b").alias("a"), F.greatest("x.a", "b").alias("b")).distinct()
    pairs = scratch.keep(pairs, "pairs")

    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    links, groups = None, None
    for round_ in range(2):
        if round_:
            # owners of a shingle that lie in different components
            placed = owners.join(groups, owners["v"] == groups["node"], "left").select("shingle", "v", "n", "l", F.coalesce("component", "v").alias("g"))
            placed = scratch.keep(placed, "placed")
            mixed = scratch.keep(placed.groupBy("shingle").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("k")).filter("g0 <> g1").select("shingle", "k"), "mixed")
            left = placed.join(mixed, "shingle")
            few = left.filter(F.col("k") <= FEW)
            other = few.select("shingle", F.col("v").alias("w"), F.col("n").alias("m"), F.col("g").alias("h"))
            more = few.join(other, "shingle").filter((F.col("v") < F.col("w")) & (F.col("g") != F.col("h")) & fits(F.col("n"), F.col("m"))).select(F.col("v").alias("a"), F.col("w").alias("b")).distinct()
            pairs, done = scratch.keep(more.join(pairs, ["a", "b"], "left_anti"), "more"), pairs
            found = blockwise(left.filter(F.col("k") > FEW).drop("l"), vertices, scratch, percent)
            close = scratch.keep(alike(shared(pairs, owned), vertices, percent).unionByName(shared(found.join(done, ["a", "b"], "left_anti"), owned)).distinct(), "close-1")
        else:
            close = scratch.keep(alike(shared(pairs, owned), vertices, percent), "close-0")
        names = close.select(F.col("a").alias("v")).unionByName(close.select(F.col("b").alias("v"))).distinct()
        wanted = scratch.keep(vertices.select("v", "key").join(names, "v"), f"wanted-{round_}")
        sets = scratch.keep(sets_of(documents, key, text, scratch.narrow(wanted)), f"sets-{round_}")
        found = scratch.keep(verify(close, sets, percent), f"links-{round_}")
        links = found if links is None else links.unionByName(found)
        groups = scratch.keep(connected_components(links, scratch, f"components-{round_}"), f"groups-{round_}")
        scratch.drop(f"sets-{round_}")
    scratch.drop("runs", "prefixes", "placed", "blocks")

    labelled = scratch.keep(rows.join(groups, rows["v"] == groups["node"], "left").select("key", "n", "v", F.coalesce("component", "v").alias("g")), "labelled")
    least = scratch.keep(labelled.filter("g is not null").groupBy(F.col("g").alias("h")).agg(F.min("key").alias("least")), "least")
    out = labelled.join(least, F.col("g") == F.col("h"), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("least", "key")).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 e AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS g FROM s),
 l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""
