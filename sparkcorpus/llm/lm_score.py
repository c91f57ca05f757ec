"""Scores of texts by a causal attention model and by a word unigram model, both learnt from them.

Training rows are those whose crc32(key as text) mod 5 is not 1.  All their words are counted,
and the subword counts of the attention model come from these counts.  A text becomes the subword ids of its
lower-cased words, each with a space before it.  Neighbours are counted in all ids of all training texts, and the weights
are trained on all of them, in blocks as they are scored: a local pass in each bucket of texts, and the mean of the results, that of
an input vector by how often each bucket had it.  Buckets and their order come from hashes of the texts, so scores do not depend on how rows are
partitioned, but for rounding.  The attention model says which class begins a word and whether a word goes on; which subword goes on has the probability that it follows
the one before inside words, smoothed by its own share.  The most frequent words, KNOWN at most, are broadcast with their counts;
for others, rows (text, word) meet the table of counts in a join, so that all are counted alike.  So it is with pairs of subwords inside
words: those that make up SHARE of all tokens are broadcast (at most 1 / SHARE a subword of a word), others meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.llm import attention as at
from sparkcorpus.llm.bpe import VOCABULARY, encoder
from sparkcorpus.llm.kernels import LOWER, Words, chunks, i64
from sparkcorpus.llm.scratch import Scratch

FOLDS, HELD_OUT = 5, 1
SHARE = 1e-6
KNOWN = 1_000_000
#: Weight of a subword's own share beside what follows the one before; words whose ids a task remembers.
SMOOTH, REMEMBERED = 2.0, 400_000
#: Bits of a hash that say its cell.
CELLS = 20
SHIFT = np.uint64(64 - CELLS)
#: Texts are laid out together up to so many subwords; a longer text makes a group of its own.
GROUP_IDS = 1 << 18
#: Subwords and ends of a bucket of texts from which one local pass learns.
LEARNT_IDS = 1 << 22
LOWER_TABLE = LOWER.tobytes()


def fold(key) -> F.Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS


class Places:
    """A number for each different hash, in the order in which they came first.

    A hash is looked for in the cell of its first bits, which holds the last one that was missed there, and only if it is
    not there among all, which ascend.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes, and the number of each
        self.cell = ~(np.arange(1 << CELLS, dtype=np.uint64) << SHIFT)  # none that belongs there
        self.cell_slot = np.zeros(1 << CELLS, np.int32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each hash; and where those stand, by number, that came first now."""
        cell = (hashes >> SHIFT).view(np.int64)
        slots, missed = self.cell_slot[cell], np.flatnonzero(self.cell[cell] != hashes)
        distinct, first, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        there = np.append(self.hashes, np.uint64(0))[place] == distinct
        new = np.flatnonzero(~(there & (place < len(self.hashes))))
        if len(new):
            self.slot = np.insert(self.slot, place[new], len(self.slot) + np.arange(len(new)))
            self.hashes = np.insert(self.hashes, place[new], distinct[new])
        slots[missed] = self.slot[np.searchsorted(self.hashes, distinct)][inverse]
        self.cell[cell[missed]], self.cell_slot[cell[missed]] = hashes[missed], slots[missed]
        return slots, missed[first[new]]


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, word, c) over all words of the texts; the end of a text is the empty word.  A task counts its words until there are too many
    different ones to remember."""
    names = ["h", "word", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, hashes, words = Places(), np.zeros(0, np.int64), [], []
        for batch, raw, off in chunks(batches, "text"):
            w = Words(raw, off, lower=True)
            all_ = w.hashes()
            slots, new = seen.places(all_)
            counts = np.bincount(slots, minlength=len(seen.slot)) + np.append(counts, np.zeros(len(new), np.int64))
            starts, ends = w.starts[new], w.ends[new]
            bounds = np.concatenate([[0], np.cumsum(ends - starts)])
            take = np.arange(int(bounds[-1])) + np.repeat(starts - bounds[:-1], ends - starts)
            words.append(pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(w.raw[take])]))
            hashes.append(all_[new])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([b""], pa.binary()), pa.array([batch.num_rows], pa.int64())], names)
            if len(seen.slot) > REMEMBERED:
                yield from counted(hashes, words, counts)
                seen.forget()
                counts, hashes, words = counts[:0], [], []
        yield from counted(hashes, words, counts)

    def counted(hashes: list[np.ndarray], words: list[pa.Array], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = 0
        for h, word in zip(hashes, words, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(i64(h)), word, pa.array(counts[begin : begin + len(h)])], names)
            begin += len(h)

    return texts.mapInArrow(run, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


#: Bytes that occur in white space other than that which parts words: a word with one is spelled by itself.
ODD = np.zeros(256, dtype=bool)
ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def spell(enc, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words (spans of bytes), each with a space before it, and how many each has.

    Pieces do not reach over a space, so words are joined and encoded at once; a piece of theirs that begins with
    a space begins a word.
    """
    odd = np.concatenate([[0], np.cumsum(ODD[raw])])
    alone = odd[ends] > odd[starts]
    spaced = spaced_ids(enc)
    joined = np.flatnonzero(~alone)
    sizes = ends[joined] - starts[joined] + 1
    text = np.full(int(sizes.sum()), 32, dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    body = np.ones(len(text), dtype=bool)
    body[begin] = False
    text[body] = raw[np.arange(int((sizes - 1).sum())) + np.repeat(starts[joined] - (begin - np.arange(len(joined))), sizes - 1)]
    ids = enc.encode_to_numpy(text.tobytes().decode(errors="replace"), disallowed_special=()).astype(np.int32) if len(text) else np.zeros(0, np.int32)
    first = np.flatnonzero(spaced[ids])
    many = np.zeros(len(starts), dtype=np.int64)
    many[joined] = np.diff(np.append(first, len(ids)))
    if not alone.any():
        return ids, many
    single = [enc.encode_ordinary(" " + raw[starts[i] : ends[i]].tobytes().decode(errors="replace")) for i in np.flatnonzero(alone)]
    many[alone] = [len(x) for x in single]
    bounds = np.concatenate([[0], np.cumsum(many)])
    out, own = np.zeros(int(bounds[-1]), dtype=np.int32), np.repeat(alone, many)
    out[~own], out[own] = ids, np.array([y for x in single for y in x], dtype=np.int32)
    return out, many


@lru_cache(maxsize=4)
def spaced_ids(enc) -> np.ndarray:
    """Which ids begin with a space."""
    return np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(enc.n_vocab)])


def frequent_words(counts: DataFrame, most: int = KNOWN) -> DataFrame:
    """The words with the largest counts, at most so many: those above a step of counts, of which there are eight to a
    doubling.  How many words each step has is counted first."""
    rows = counts.filter(F.length("word") > 0).withColumn("step", F.floor(F.log2("c") * 8).cast("int"))
    least, total = None, 0
    for step, n in sorted(map(tuple, rows.groupBy("step").agg(F.count("*")).collect()), reverse=True):  # some hundred rows
        total += n
        if total > most:
            break
        least = step
    return rows.filter(F.lit(False) if least is None else F.col("step") >= least).drop("step")


def subword_counts(counts: DataFrame, path: str, pattern: str) -> DataFrame:
    """(before, id, c): subwords of all counted words, with the one before in the word, or -1; the end is -1, -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            word, c = batch.column(0), batch.column(1).to_numpy()
            raw, off = strings_of(word)
            full = off[1:] > off[:-1]
            ids, many = spell(enc, raw, off[:-1][full], off[1:][full])
            before = np.full(len(ids), -1, dtype=np.int64)
            goes_on = np.ones(len(ids), dtype=bool)
            goes_on[np.cumsum(many) - many] = False
            before[goes_on] = ids[np.flatnonzero(goes_on) - 1]
            weight = np.append(np.repeat(c[full], many), c[~full].sum())
            pairs, place = np.unique(np.append(before << 32 | ids, np.int64(-1)), return_inverse=True)
            total = np.bincount(place, weights=weight).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), pa.array(total)], ["before", "id", "c"])

    return counts.select("word", "c").mapInArrow(run, "before int, id int, c long").groupBy("before", "id").agg(F.sum("c").alias("c"))


def strings_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its rows."""
    _, offsets, data = words.cast(pa.large_binary()).buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass(frozen=True)
class Inside:
    """log10 probability of a subword after another inside a word: sorted pairs with their counts, how often each
    subword is followed by a counted one, and each subword's share of all continuations."""

    pairs: np.ndarray
    counts: np.ndarray
    after: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(before: np.ndarray, ids: np.ndarray, counts: np.ndarray, own: np.ndarray, spaced: np.ndarray, after: np.ndarray | None = None) -> Inside:
        """own: how often each subword goes on a word; spaced: those that never do; after: how often each is followed by any, if
        the pairs are not all there are."""
        pairs = before.astype(np.int64) << 32 | ids
        order = np.argsort(pairs)
        share = np.where(spaced, 0.0, own + 0.5)
        return Inside(pairs[order], counts[order], np.bincount(before, weights=counts, minlength=len(own)) if after is None else after, share / max(share.sum(), 0.5))

    def seen(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 if it is not among these."""
        at_ = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        return np.where(self.pairs[at_] == pairs, self.counts[at_], 0) if len(self.pairs) else np.zeros(len(pairs), np.int64)

    def log10(self, before: np.ndarray, ids: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        seen = self.seen(before.astype(np.int64) << 32 | ids) if seen is None else seen
        return np.log10((seen + SMOOTH * self.share[ids]) / (self.after[before] + SMOOTH))

    def gain(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the count of a pair that is not among these adds to its log10 probability."""
        return np.log10(1 + counts / (SMOOTH * self.share[ids]))


class Spelled(Places):
    """Of words by their hash: their ids, the log10 probability of all ids but the first, and log10 of the share of
    the word (NaN if it is not among the known ones); kept between batches."""

    def __init__(self, enc, inside: Inside, known: np.ndarray, shares: np.ndarray):
        self.enc, self.inside, self.known, self.shares = enc, inside, known, shares
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.ids, self.bounds, self.logs, self.base = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0)
        self.rare, self.rare_bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def __call__(self, w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row; how many each word has, its log10 probability of going on so, and its share."""
        if len(self.slot) > REMEMBERED:
            self.forget()
        slots, new = self.places(hashes)
        if len(new):
            flat, lengths = spell(self.enc, w.raw, w.starts[new], w.ends[new])
            owner = np.repeat(np.arange(len(new)), lengths)
            on = np.flatnonzero(owner[1:] == owner[:-1]) + 1
            pairs = flat[on - 1].astype(np.int64) << 32 | flat[on]
            seen = self.inside.seen(pairs)
            lacking = seen == 0
            self.logs = np.append(self.logs, np.bincount(owner[on], weights=self.inside.log10(flat[on - 1], flat[on], seen), minlength=len(new)))
            self.rare = np.append(self.rare, pairs[lacking])
            self.rare_bounds = np.append(self.rare_bounds, self.rare_bounds[-1] + np.cumsum(np.bincount(owner[on][lacking], minlength=len(new))))
            self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(lengths))
            self.ids = np.append(self.ids, flat)
            place = np.minimum(np.searchsorted(self.known, hashes[new]), max(len(self.known) - 1, 0))
            hit = self.known[place] == hashes[new] if len(self.known) else np.zeros(len(new), bool)
            self.base = np.append(self.base, np.where(hit, self.shares[place] if len(self.known) else 0.0, np.nan))
        take, many = self.spans(self.bounds, slots)
        self.last = slots
        return self.ids[take], many, self.logs[slots], self.base[slots]

    def unseen(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the words of the last call: the pairs of subwords that were taken as unseen, and how many each word has."""
        many = np.diff(self.rare_bounds)[self.last]
        take, _ = self.spans(self.rare_bounds, self.last[many > 0])
        return self.rare[take], many

    @staticmethod
    def spans(bounds: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = bounds[slots]
        many = bounds[slots + 1] - begin
        return np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many), many


def packing(size: int) -> np.dtype:
    """How subwords lie in the bytes of a text's row, which Spark copies as a whole."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of their texts (packed in the last column) and the offsets of these."""
    for batch in batches:
        raw, off = strings_of(batch.column(batch.num_columns - 1))
        flat, off = raw.view(packing(size)), off // packing(size).itemsize
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + GROUP_IDS, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(begin, end - begin), flat[off[begin] : off[end]], off[begin : end + 1] - off[begin]
            begin = end


def neighbours(learnt: DataFrame, frequent: np.ndarray, size: int) -> np.ndarray:
    """How often one frequent id follows another: a matrix of fixed size, summed in each task."""
    place = np.full(size, -1, dtype=np.int64)
    place[frequent] = np.arange(len(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(frequent) ** 2, dtype=np.int64)
        for _, ids, off in groups(batches, size):
            flat = place[ids]
            pair = np.ones(max(len(flat) - 1, 0), dtype=bool)
            inner = off[1:-1]
            pair[inner[(inner > 0) & (inner < len(flat))] - 1] = False
            pair &= (flat[:-1] >= 0) & (flat[1:] >= 0)
            total += np.bincount(flat[:-1][pair] * len(frequent) + flat[1:][pair], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "c"])

    out = np.zeros(len(frequent) ** 2, dtype=np.int64)
    got = learnt.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out[got["pair"].to_numpy()] = got["c"].to_numpy()
    return out.reshape(len(frequent), len(frequent))


def dealt(learnt: DataFrame, scratch: Scratch, most: int | None = None, width: int | None = None) -> DataFrame:
    """(bucket, fp, ids): texts in buckets of about `most` subwords and ends, which depend on the texts alone.  width: bytes of a
    subword, if ids are packed.

    Equal texts have one fingerprint and go to one bucket, unless together they have more than `most`: of these, at most as many as
    buckets, one is kept with the number of its copies, and the copies are dealt one by one.
    """
    most = most or LEARNT_IDS
    texts = learnt.select(F.xxhash64("ids").alias("fp"), "ids")
    tokens = (F.size("ids") if width is None else F.octet_length("ids") / width).cast("long") + 1
    same = scratch.keep(texts.groupBy("fp").agg(F.count("*").alias("copies"), F.sum(tokens).alias("n")), "same")
    buckets = -(-(same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // most) or 1
    many = F.broadcast(same.filter(F.col("n") > most).select(F.col("fp").alias("f"), "copies", "n"))  # at most a row a bucket
    single = texts.join(many, F.col("fp") == F.col("f"), "left_anti")
    one = texts.join(many, F.col("fp") == F.col("f")).groupBy("fp").agg(F.first("ids").alias("ids"), F.first("copies").alias("copies"), F.first("n").alias("n"))
    # first slices of about `most` subwords, then the copies of each
    slices = F.ceil(F.col("n") / most)
    sliced = one.withColumn("slices", slices).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).repartition("fp", "slice")
    begin, end = (F.floor(F.col("copies") * (F.col("slice") + i) / F.col("slices")).cast("long") for i in (0, 1))
    copies = sliced.filter(end > begin).select("fp", "ids", F.explode(F.sequence(begin, end - 1)).alias("copy"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).alias("bucket")
    return single.select(bucket("fp"), "fp", "ids").unionByName(copies.select(bucket("fp", "copy"), "fp", "ids"))


def averaged(learnt: DataFrame, p: dict, vocab: at.Vocabulary, scratch: Scratch) -> tuple[dict, int]:
    """The mean of what each bucket makes of the weights in a pass over its own, in the order of fingerprints: by subwords and
    ends, or, of an input vector, by how often the bucket had it; and how many subwords and ends these were."""
    shared = learnt.sparkSession.sparkContext.broadcast((p, vocab))
    names, size = [f"x{i}" for i in range(at.WIDTH)], len(vocab.group)

    def learn(bucket: pa.Table) -> pa.Table:
        order = np.argsort(bucket.column("fp").to_numpy(), kind="stable")  # those with one fingerprint are equal
        texts = bucket.select(["ids"]).take(pa.array(order)).combine_chunks().to_batches()
        params, used, n = at.train(*shared.value, ((ids, off) for _, ids, off in groups(texts, size)))
        rest = at.pack(params)
        rest = np.append(rest, np.zeros(-len(rest) % at.WIDTH, rest.dtype)).reshape(-1, at.WIDTH)
        some = np.flatnonzero(used)
        weights = np.concatenate([np.full(len(rest), n), used[some]])
        rows = np.concatenate([rest, params["embed"][some]]) * weights[:, None].astype(np.float64)
        where = np.concatenate([-1 - np.arange(len(rest)), some])
        return pa.Table.from_arrays([pa.array(where.astype(np.int32)), pa.array(weights), *[pa.array(x) for x in np.ascontiguousarray(rows.T)]], ["at", "n", *names])

    made = dealt(learnt, scratch, width=packing(size).itemsize).groupBy("bucket").applyInArrow(learn, f"at int, n long, {', '.join(f'{x} double' for x in names)}")
    sums = made.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    got = sums.toArrow().sort_by("at")  # at most a row for each subword, and those of the other weights
    scratch.drop("same")
    if not got.num_rows:
        return p, 0
    where, n = got["at"].to_numpy(), got["n"].to_numpy()
    rows = np.stack([got[x].to_numpy() for x in names], 1) / n[:, None]
    embed = p["embed"].copy()
    embed[where[where >= 0]] = rows[where >= 0]
    return at.unpack(rows[where < 0][::-1].ravel(), p) | {"embed": embed.astype(np.float32)}, int(n[0])


def score(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    A null text is an empty one and has one token, its end.  A null key counts as the empty text
    for the fold.  `score` is the log10 probability of the text's lower-cased words.  Repeated rows are scored
    (and, if they train, counted) one by one.  Without training tokens, base_score is null.  No rows give no
    rows; other columns are ignored.
    """
    spark, path = df.sparkSession, path or public_tokenizers.path(VOCABULARY)
    scratch = Scratch(spark, "lm")
    rows = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"), (fold(df[key]) == HELD_OUT).alias("held_out"))
    training = rows.filter("not held_out").select("text")

    counts = scratch.keep(word_counts(training), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = frequent_words(counts).select("h", "c").toArrow()  # at most KNOWN rows
    order = np.argsort(common["h"].to_numpy().view(np.uint64))
    table = (common["h"].to_numpy().view(np.uint64)[order], common["c"].to_numpy()[order])

    enc = encoder(path, pattern)
    size = enc.n_vocab + 1
    pieces = scratch.keep(subword_counts(counts, path, pattern), "pieces")
    totals = [np.zeros(size, dtype=np.int64) for _ in range(2)]
    for total, some in zip(totals, (pieces, pieces.filter("before >= 0")), strict=True):
        got = some.groupBy("id").agg(F.sum("c").alias("c")).toArrow()  # at most one row a subword
        total[got["id"].to_numpy()] += got["c"].to_numpy()
    ids, own = totals
    spaced = np.append(spaced_ids(enc), False)
    often = F.col("c") >= max(2, int(n * SHARE) + 1)
    pairs = pieces.filter((F.col("before") >= 0) & often).toArrow()  # at most 1 / SHARE rows a subword of a word
    followed, got = np.zeros(size), pieces.filter("before >= 0").groupBy("before").agg(F.sum("c").alias("c")).toArrow()  # at most one row a subword
    followed[got["before"].to_numpy()] = got["c"].to_numpy()
    inside = Inside.of(*(pairs[c].to_numpy() for c in ("before", "id", "c")), own, np.append(spaced[:-1], True), followed)
    frequent = np.argsort(-ids[:-1], kind="stable")[: at.FREQUENT]
    frequent = frequent[ids[frequent] > 0]
    denominator = n + 0.5 * (v + 1)
    known_words, known_pairs = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(inside)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c = known_words.value
        spelled = Spelled(encoder(path, pattern), known_pairs.value, known, np.log10((c + 0.5) / denominator) if n else np.zeros(len(c)))
        names = ["id", "key", "held_out", "n_tokens", "n_known", "part", "inside", "rare", "pairs", "ids"]
        for batch, raw, off in chunks(batches, "text"):
            w = Words(raw, off, lower=True)
            hashes, mine = w.hashes(), w.text_of_word()
            flat, many, going_on, base = spelled(w, hashes)
            unseen, rares = spelled.unseen()
            hit = ~np.isnan(base)
            part = np.bincount(mine, weights=np.where(hit, base, 0.0), minlength=batch.num_rows)
            n_hit = np.bincount(mine[hit], minlength=batch.num_rows)
            # lists of a text: hashes of the words and pairs that meet their counts in a join, and all its subwords
            bounds = lambda n, k=1: (k * np.concatenate([[0], np.cumsum(n)])[w.bounds]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds(n)), pa.array(x)) for n, x in ((~hit, i64(hashes[~hit])), (rares, unseen))]
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds(many, packing(size).itemsize)), pa.py_buffer(flat.astype(packing(size)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(w.counts + 1), pa.array(n_hit), pa.array(part), pa.array(np.bincount(mine, weights=going_on, minlength=batch.num_rows)), *lists, packed], names)

    kind = rows.schema["key"].dataType.simpleString()
    whole = rows.select(F.monotonically_increasing_id().alias("id"), "key", "text", "held_out")
    encoded = scratch.keep(whole.mapInArrow(encode, f"id long, key {kind}, held_out boolean, n_tokens long, n_known long, part double, inside double, rare array<long>, pairs array<long>, ids binary"), "encoded")
    learnt = encoded.filter("not held_out").select("ids")
    after = neighbours(learnt, frequent, size)
    vocab = at.vocabulary(ids.astype(np.float64), spaced, after, frequent)
    params = at.start(vocab, after, np.bincount(vocab.group, weights=ids, minlength=at.CLASSES), frequent)
    params, _ = averaged(learnt, params, vocab, scratch)
    shared = spark.sparkContext.broadcast((params, vocab))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, voc = shared.value
        for batch, flat, off in groups(batches, size):
            inputs, targets, first, owner = at.laid_out(voc, flat, off)
            lm = np.bincount(owner, weights=at.log10_probabilities(p, voc, inputs, targets, first), minlength=batch.num_rows)
            lm += batch.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lm)], [*batch.schema.names[:-2], "score"])

    columns = ["id", "key", "held_out", "n_tokens", "n_known", "part", "inside"]
    scored = scratch.keep(encoded.select(*columns, "ids").mapInArrow(judge, f"id long, key {kind}, held_out boolean, n_tokens long, n_known long, part double, score double"), "scored")
    rare = encoded.select("id", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
    value = lambda c: F.log10((c + 0.5) / F.lit(float(denominator)))
    sums = rare.groupBy("id").agg(F.sum(value(F.coalesce("c", F.lit(0)))).alias("more"), F.count("c").alias("known"))
    sums = scratch.keep(sums.withColumnRenamed("id", "i"), "sums")

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, ids, c = (x.to_numpy() for x in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(before.astype(np.int64) << 32 | ids), pa.array(known_pairs.value.gain(ids, c))], ["pair", "gain"])

    seldom = pieces.filter((F.col("before") >= 0) & ~often).select("before", "id", "c").mapInArrow(gains, "pair long, gain double")
    more = scratch.keep(encoded.select(F.col("id").alias("j"), F.explode("pairs").alias("pair")).join(seldom, "pair").groupBy("j").agg(F.sum("gain").alias("gain")), "gains")
    scratch.drop("encoded")
    ends = counts.filter(F.length("word") == 0).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    out = scored.join(sums, F.col("id") == F.col("i"), "left").join(more, F.col("id") == F.col("j"), "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
    base = F.col("part") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10((ends + 0.5) / denominator)))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (base if n else F.lit(None).cast("double")).alias("base_score"), "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
