"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Grades are ordered (0 toxic, 1 poor, 2 good).  One weight vector over hashed text features gives
a score s, shared by all grades; ordered thresholds turn it into P(grade <= k) =
sigmoid(threshold_k - s).  Expected grade and the tail P(grade >= 2) select documents.

Features of a text are its words, their first bytes and their shapes, each hashed; a text's values are the square
roots of shares of its words, so texts of any length compare.  The model is fitted on
at most SAMPLE labelled texts of SAMPLE_BYTES together, chosen by hashes of key and text; everything else is over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcorpus.llm.kernels import LOWER, U, Words, chunks, mix
from sparkcorpus.llm.scratch import small_batches

GRADES = 3
#: Labelled texts that the model is fitted on, at most, and bytes of these together; bits of the feature hashes.
SAMPLE, SAMPLE_BYTES, BITS = 10_000, 1 << 26, 18
#: Features of fewer labelled rows have no weight; steps, rate and decay of the fit.
LEAST_ROWS, STEPS, RATE, DECAY, SEED = 3, 250, 0.5, 3e-6, 11
#: Bytes of a word's stem.
STEM = 4
#: Marks that are cut off a word's end, and go into its shape.
MARKS = np.zeros(256, dtype=bool)
MARKS[[ord(c) for c in ".,;:!?*#$%&|<>()[]{}\"'"]] = True


def features(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices and values of each text, and the bounds of its features."""
    w = Words(raw, off)
    low = LOWER[raw]
    ends = w.ends.copy()
    for _ in range(4):  # marks at the end, up to four
        last = np.maximum(ends - 1, w.starts)
        ends = np.where(MARKS[low[last]] & (ends - 1 > w.starts), ends - 1, ends) if len(ends) else ends
    lower = Words(low, off)
    sums = lower.byte_sums()
    words = lower.span_hashes(w.starts, ends, sums)
    tails = lower.span_hashes(ends, w.ends, sums)
    is_upper = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw >= 65) & (raw <= 90), out=is_upper[1:])
    upper = np.minimum(is_upper[ends] - is_upper[w.starts], 2).astype(U)
    length = np.minimum((ends - w.starts) // 4, 6).astype(U)
    shapes = mix(tails * U(31) + upper * U(7) + length * U(131) + U(1))
    owner = w.text_of_word().astype(U)
    same = np.zeros(len(words), dtype=bool)
    if len(words):
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    shapes = np.where(same, mix(shapes ^ U(0xABCDEF)), shapes)  # a word said twice has a shape of its own
    stems = lower.span_hashes(w.starts, np.minimum(w.starts + STEM, ends), sums)
    size = U(1) << U(bits - 2)
    owner <<= U(bits)
    # words have half of the features; stems and shapes have a quarter each
    keys = np.concatenate([owner | words % (U(2) * size), owner | (U(2) * size + stems % size), owner | (U(3) * size + shapes % size)])
    keys, counts = np.unique(keys, return_counts=True)
    text = (keys >> U(bits)).astype(np.int64)
    values = np.sqrt(counts / np.maximum(w.counts, 1)[text]).astype(np.float32)
    return (keys & U((1 << bits) - 1)).astype(np.int32), values, np.searchsorted(text, np.arange(len(off)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:], dtype=np.float64)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def fit(index: np.ndarray, values: np.ndarray, bounds: np.ndarray, grades: np.ndarray, bits: int = BITS, steps: int = STEPS) -> Model:
    """Weights and thresholds by full-batch Adam on the mean negative log-likelihood."""
    common = np.bincount(index, minlength=1 << bits)[index] >= LEAST_ROWS
    n_values = np.zeros(len(index) + 1, dtype=np.int64)
    np.cumsum(common, out=n_values[1:])
    index, values, bounds = index[common], values[common].astype(np.float32), n_values[bounds]
    used = np.unique(index)
    local = np.searchsorted(used, index).astype(np.int32)
    n, rows = len(grades), np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(bounds))
    share = np.array([max(1e-3, (grades <= k).mean()) if n else 0.5 for k in range(GRADES - 1)])
    share = np.minimum(share, 1 - 1e-3)
    base = np.log(share / (1 - share))
    theta = np.array([base[0], *np.log(np.maximum(np.diff(base), 1e-2))])
    w = np.zeros(len(used))
    state = [np.zeros(len(used) + len(theta)) for _ in range(2)]
    for step in range(1, steps + 1 if n else 1):
        cuts = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])
        s = row_sums(values * w.astype(np.float32)[local], bounds)
        below = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None, :], -60, 60)))
        full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        p = np.maximum(full[np.arange(n), grades + 1] - full[np.arange(n), grades], 1e-12)
        slope = full * (1 - full)
        hi, lo = slope[np.arange(n), grades + 1], slope[np.arange(n), grades]
        by_score = (hi - lo) / p / n  # of the loss
        by_cut = np.array([(np.where(grades == k, -hi / p, 0) + np.where(grades == k + 1, lo / p, 0)).sum() / n for k in range(GRADES - 1)])
        grad_theta = np.array([by_cut.sum(), *[by_cut[k + 1 :].sum() * np.exp(theta[k + 1]) for k in range(GRADES - 2)]])
        grad = np.concatenate([np.bincount(local, weights=values * by_score.astype(np.float32)[rows], minlength=len(used)) + DECAY * w, grad_theta])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad * grad
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, theta = w - move[: len(w)], theta - move[len(w) :] * 0.3
    weights = np.zeros(1 << bits, dtype=np.float32)
    weights[used] = w
    return Model(weights, theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]))


def grade_of(quality, toxic):
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, bits: int = BITS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most `sample` labelled texts of at most `most_bytes` together, none over a sixteenth of that; rows without a grade or a text are none.

    Several labels of one document, and several texts of one labelled document, are all fitted within these bounds, equal ones
    once.  They are taken in the order of a hash, and fitted in an order of their own, however rows are dealt.  Labels of
    documents that are not there do not count.  Without any, no document is rated better than another.
    """
    rated = labels.select(labels[key].alias("k"), grade_of(labels["quality"], F.coalesce(labels["toxic"], F.lit(0))).alias("grade")).filter("grade is not null and k is not null")
    have = docs.filter(docs[text].isNotNull()).select(docs[key].alias("k"))
    first = rated.distinct().join(have, "k", "left_semi").orderBy(F.xxhash64("k", F.lit(SEED)), "k", "grade").limit(sample)
    # labels are at most as many as the sample, so they may be broadcast; their texts are counted before any is taken
    texts = docs.select(docs[key].alias("k"), docs[text].alias("text")).filter("text is not null").join(F.broadcast(first), "k").withColumn("h", F.xxhash64("text"))
    found = texts.groupBy("k", "grade", "h").agg(F.max(F.octet_length("text")).alias("bytes"))
    found = found.filter(F.col("bytes") <= most_bytes // 16).orderBy(F.xxhash64("k", F.lit(SEED)), "k", "grade", "h").limit(sample)
    upto = F.sum("bytes").over(Window.orderBy(F.xxhash64("k", F.lit(SEED)), "k", "grade", "h"))  # of the sample
    chosen = found.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).select("k", "grade", "h")
    taken = texts.join(F.broadcast(chosen), ["k", "grade", "h"]).select("k", "grade", "h", "text")
    kind = taken.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of the sample; a task passes on each text once
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            new = [seen.add(r) or True if r not in seen else False for r in rows]
            for part, raw, off in chunks([batch.filter(pa.array(new, pa.bool_()))], "text"):
                index, values, bounds = features(raw, off, bits)
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (index, values)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], ["k", "grade", "h", "index", "values"])

    got = taken.mapInArrow(run, f"k {kind}, grade int, h long, index array<int>, values array<float>")
    got = got.groupBy("k", "grade", "h").agg(F.any_value(F.struct("index", "values")).alias("x")).select("k", "grade", "h", "x.index", "x.values").toArrow()
    if not got.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0), np.zeros(1, int), np.zeros(0, int), bits)
    got = got.sort_by([("k", "ascending"), ("grade", "ascending"), ("h", "ascending")])
    index, values = (got[c].combine_chunks() for c in ("index", "values"))
    return fit(index.flatten().to_numpy(), values.flatten().to_numpy(), index.offsets.to_numpy() - index.offsets[0].as_py(), got["grade"].to_numpy().astype(int), bits)


MADE = "expected_grade double, tail_probability double, kept boolean"


def rate(df: DataFrame, model: Model, text: str = "text", least: float = 0.5, keep_text: bool = False) -> DataFrame:
    """`df` (without its text unless `keep_text`) with expected_grade, tail_probability and kept.

    A row is kept if its probability of the highest grade is at least `least`.  A row without words
    is of the lowest grade and not kept.  Columns of `df` with the names of results are replaced;
    repeated rows are rated alike; no rows give no rows.
    """
    made = ["expected_grade", "tail_probability", "kept"]
    rest = [c for c in df.columns if c not in (*made, text)]
    columns = [c for c in df.columns if c not in made] if keep_text else rest
    source = df.select(*[df[c] for c in rest], df[text].alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema] + [MADE])
    bits = int(len(model.weights)).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast(model)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, raw, off in chunks(batches, "__text"):
            index, values, bounds = features(raw, off, bits)
            tails = m.tails(row_sums(m.weights[index] * values, bounds))
            empty = np.diff(bounds) == 0
            tails[empty] = 0
            out = [batch.column(rest.index(c) if c in rest else len(rest)) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array((tails[:, -1] >= least) & ~empty)], [*columns, *made])

    return source.mapInArrow(run, schema)


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rate(documents, train(documents, labels)).select("doc_id", "expected_grade", "tail_probability", "kept")
