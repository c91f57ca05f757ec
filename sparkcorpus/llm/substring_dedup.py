"""Substring dedup by seed and extend over winnowed anchors.

A window of WIDTH words holds WIDTH - ANCHOR + 1 anchors (runs of ANCHOR words); winnowing
selects the one with the least hash, so equal windows select the same anchor at the same
place.  Neighbouring windows mostly select one anchor, and make one seed: its span is what the
anchor can extend to on both sides while it stays the selected one.

Seeds that share an anchor are joined.  If all their spans are equal, every window around
them extends to a match.  Where spans differ, the seeds are extended window by window to both
sides of the anchor and compared, so that each side reaches as far as some other occurrence agrees.
Matched windows are merged into maximal repeats, none shorter than WIDTH, and cut out.

Occurrences are never paired with each other: an anchor or window is summed up in each task
before the shuffle, and joined back, so a passage in a third of all texts costs a row an occurrence.
Texts are known by (hash, number of words); equal texts share their repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.llm.kernels import Runs, U, Words, chunks, i64, window_starts
from sparkcorpus.llm.scratch import Scratch

WIDTH, ANCHOR = 35, 12


def seeds(runs: Runs, bounds: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and selected anchor's place of each seed."""
    starts, many = window_starts(bounds, width)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    total = int(bounds[-1]) - anchor + 1
    at = np.arange(total, dtype=np.int64)
    hashes = runs.of(at, at + anchor)
    # leftmost place of the least hash among so many anchors from each on, by doubling
    reach, place = width - anchor + 1, at
    step = 1

    def merge(shift: int) -> np.ndarray:
        other = place[shift:]
        mine = place[: len(other)]
        return np.where(hashes[other] < hashes[mine], other, mine)

    while step * 2 <= reach:
        place, step = merge(step), step * 2
    if step < reach:
        place = merge(reach - step)
    chosen = place[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), chosen[first]


def texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.xxhash64(df[text]).alias("t"), df[text].alias("text")).filter("text is not null")


def seed_rows(df: DataFrame, text: str, width: int, anchor: int) -> DataFrame:
    """(anchor, span, t, n, first, many): the seeds of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in chunks(batches, "text"):
            w = Words(raw, off)
            runs = Runs(w.hashes())
            first, many, chosen = seeds(runs, w.bounds, width, anchor)
            owner = np.searchsorted(w.bounds, first, side="right") - 1
            key = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            # the place of the anchor in its span is a part of the span
            spans = runs.of(first, first + many - 1 + width) ^ ((chosen - first).astype(U) * U(0xC2B2AE3D27D4EB4F))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i64(runs.of(chosen, chosen + anchor))), pa.array(i64(spans)), pa.array(key), pa.array(w.counts[owner].astype(np.int32)), pa.array((first - w.bounds[owner]).astype(np.int32)), pa.array(many.astype(np.int32))],
                ["anchor", "span", "t", "n", "first", "many"],
            )

    return texts(df, text).mapInArrow(run, "anchor long, span long, t long, n int, first int, many int")


def window_rows(located: DataFrame, width: int) -> DataFrame:
    """(anchor, window, t, n, first): the windows of seeds whose spans differ, from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in chunks(batches, "text"):
            w = Words(raw, off)
            runs = Runs(w.hashes())
            # mapInArrow gives lists of structs (anchor, first, many)
            lists = batch.column(batch.schema.get_field_index("seeds"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            anchor, first, many = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            right = w.counts[owner] == batch.column(1).to_numpy()[owner]
            owner, anchor, first, many = owner[right], anchor[right], first[right], many[right]
            at = np.repeat(w.bounds[owner] + first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            mine = np.repeat(owner, many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(anchor, many)), pa.array(i64(runs.of(at, at + width))), pa.array(batch.column(0).to_numpy()[mine]), pa.array(w.counts[mine].astype(np.int32)), pa.array((at - w.bounds[mine]).astype(np.int32))],
                ["anchor", "window", "t", "n", "first"],
            )

    return located.mapInArrow(run, "anchor long, window long, t long, n int, first int")


def repeats(df: DataFrame, text: str, scratch: Scratch, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(t, n, spans): of each text with repeats, array of (first window, windows) matched."""
    rows = seed_rows(df, text, width, anchor)
    found = rows.groupBy("anchor").agg(F.count("*").alias("c"), F.min("span").alias("s0"), F.max("span").alias("s1")).filter("c > 1")
    found = scratch.keep(found.select("anchor", (F.col("s0") == F.col("s1")).alias("alike")), "anchors")
    met = scratch.keep(rows.drop("span").join(found, "anchor"), "met")
    scratch.drop("anchors")
    alike = met.filter("alike").select("t", "n", "first", "many")

    differ = met.filter("not alike").groupBy("t", "n").agg(F.collect_set(F.struct("anchor", "first", "many")).alias("seeds"))
    differ = scratch.keep(differ, "differ")
    located = texts(df, text).join(differ, "t").select("t", "n", "text", "seeds")
    windows = scratch.keep(window_rows(located, width), "windows")
    twice = scratch.keep(windows.groupBy("anchor", "window").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "twice")
    extended = windows.join(twice, ["anchor", "window"]).select("t", "n", "first", F.lit(1).alias("many"))
    spans = alike.unionByName(extended).distinct().groupBy("t", "n").agg(F.collect_list(F.struct("first", "many")).alias("spans"))
    spans = scratch.keep(spans, "spans")
    scratch.drop("met", "differ", "windows", "twice")
    return spans


def covered(w: Words, text: np.ndarray, first: np.ndarray, many: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether a matched window covers it."""
    begin = w.bounds[text] + first
    steps = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(steps, begin, 1)
    np.add.at(steps, begin + many - 1 + width, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(df: DataFrame, text: str = "text", width: int = WIDTH, anchor: int = ANCHOR, output: str | None = None) -> DataFrame:
    """`df` without its text column, with n_words, n_removed and kept_sha256 of each row.

    Every occurrence of a window that also starts elsewhere goes, the first as well.  With
    `output`, what is left of the text is added under that name: kept words with the white space
    before them.  A null text has no words; texts under `width` words keep all.  Repeated rows are
    occurrences of each other.  Columns of `df` with the names of results are replaced.
    """
    if not 0 < anchor <= width:
        raise ValueError("an anchor is no longer than a window")
    made = ["n_words", "n_removed", "kept_sha256"] + ([output] if output else [])
    rest = [c for c in df.columns if c not in (*made, text)]
    scratch = Scratch(df.sparkSession, "substrings")
    spans = repeats(df, text, scratch, width, anchor)
    whole = df.select(F.struct(*[df[c] for c in rest], F.lit(0).alias("__none")).alias("row"), df[text].alias("text"), F.xxhash64(df[text]).alias("t"))
    # texts with one hash and different numbers of words are told apart in the task
    lists = scratch.keep(spans.groupBy("t").agg(F.collect_list(F.struct("n", "spans")).alias("by_n")), "lists")
    both = whole.join(lists, "t", "left").select("row", "text", "by_n")
    kind = whole.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words long, n_removed long, kept_sha256 string" + (f", `{output}` string" if output else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in chunks(batches, "text"):
            w = Words(raw, off)
            by_n = batch.column(2)
            per = np.repeat(np.arange(batch.num_rows), np.diff(by_n.offsets.to_numpy()))
            flat = by_n.flatten()
            numbers, inner = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1)
            which = np.repeat(np.arange(len(per)), np.diff(inner.offsets.to_numpy()))
            spots = inner.flatten()
            ok = (numbers == w.counts[per])[which]
            first, many = (spots.field(i).to_numpy(zero_copy_only=False)[ok] for i in range(2))
            gone = covered(w, per[which[ok]], first, many, width)
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.bounds[:-1]) * (w.counts > 0)
            data, hashes, left = raw.tobytes(), [], []
            for i in range(batch.num_rows):
                a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                mine = data[off[i] : off[i + 1]]
                if not removed[i]:
                    hashes.append(hashlib.sha256(b" ".join(mine.split())).hexdigest())
                    left.append(mine.decode())
                    continue
                keep = np.flatnonzero(~gone[a:b]) + a
                hashes.append(hashlib.sha256(b" ".join([data[w.starts[k] : w.ends[k]] for k in keep])).hexdigest())
                if output:
                    left.append(b"".join([data[w.ends[k - 1] if k > a else off[i] : w.ends[k]] for k in keep]).decode().strip(" \t\n\v\f\r"))
            columns = [batch.column(0), pa.array(w.counts.astype(np.int64)), pa.array(removed), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(left, pa.string())] if output else []), ["row", *made])

    return both.mapInArrow(run, schema).select("row.*", *made).drop("__none")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(documents).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL_OP10 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 g AS MATERIALIZED (SELECT r, unnest(range(len(w) - 34)) AS i, unnest(list_transform(range(len(w) - 34), lambda i: sha256(array_to_string(w[i + 1 : i + 35], ' ')))) AS h FROM w WHERE len(w) >= 35),
 d AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
 c AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM g JOIN d USING (h)),
 p AS (SELECT r, doc_id, unnest(range(len(w))) AS j, unnest(w) AS word FROM w),
 k AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.j) AS kept FROM p ANTI JOIN c ON c.r = p.r AND c.j = p.j GROUP BY p.r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM c GROUP BY r) n USING (r)
"""
