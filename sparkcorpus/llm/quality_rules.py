"""Quality rules, lines first.

Every line is judged on its own: does it end like a sentence, does it look like navigation,
is it boilerplate or a line the text has had before.  Lines that fail are removed, and a
document that loses too much of its text with them is rejected.  Statistics of the whole
text (repeated windows of words, repeated lines, symbols) are taken beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkcorpus.llm.kernels import LOWER, U, Runs, Words, chunks, mix, window_starts

#: Symbols that are counted, and phrases of boilerplate lines (lower case).
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved",
    "licensed under the",
    "is licensed under",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
)
#: Bytes that may end a sentence, among them the last bytes of typographic marks.
ENDINGS = '.!?:;"\')]' + "…»”’。！？"

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
IS_ENDING = np.zeros(256, dtype=bool)
IS_ENDING[[c.encode()[-1] for c in ENDINGS]] = True
IS_START = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    most_repeated_percent: int = 30
    #: A line fails if its symbols are more than this share of its characters,
    most_symbols: float = 0.1
    #: if bars stand for more than this share of its words,
    most_bars: float = 0.2
    #: if it has more exclamation and question marks than this share of its words,
    most_marks: float = 0.5
    #: or if it ends unlike a sentence and is no longer than so many words.
    short_line: int = 60
    #: A document is rejected that keeps less than this share of its words.
    least_kept: float = 0.5


def repeated_in_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each element, whether its text has the same hash elsewhere."""
    key = mix(hashes + owner.astype(U) * U(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found = np.zeros(len(key), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def repeats_earlier(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each element, whether an earlier one of its text has the same hash."""
    key = mix(hashes + owner.astype(U) * U(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")
    found = np.zeros(len(key), dtype=bool)
    found[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    return found


def per_range(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[starts]


def measure(raw: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    w = Words(raw, off)
    n_texts = len(off) - 1
    out = {
        "n_words": w.counts.astype(np.int64),
        "word_chars": per_range(w.solid & IS_START[raw], off[:-1], off[1:]),
        "n_symbols": per_range(IS_SYMBOL[raw], off[:-1], off[1:]),
    }
    sums = w.byte_sums()

    starts, many = window_starts(w.bounds, rules.window)
    repeated = repeated_in_text(Runs(w.span_hashes(w.starts, w.ends, sums)).of(starts, starts + rules.window), np.repeat(np.arange(n_texts), many))
    steps = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(steps, starts[repeated], 1)
    np.add.at(steps, starts[repeated] + rules.window, -1)
    out["n_repeat_words"] = per_range(np.cumsum(steps[:-1]) > 0, w.bounds[:-1], w.bounds[1:])

    # lines: each text's first byte and what follows each newline, up to the next
    breaks = np.flatnonzero(raw == 10)
    owner = np.concatenate([np.arange(n_texts), np.searchsorted(off, breaks, side="right") - 1])
    order = np.argsort(owner, kind="stable")  # a line behind the last newline stays with its own text
    begins, line_text = np.concatenate([off[:-1], breaks + 1])[order], owner[order]
    ends = np.empty_like(begins)
    if len(begins):
        ends[:-1] = np.where(line_text[1:] == line_text[:-1], begins[1:] - 1, off[line_text[:-1] + 1])
        ends[-1] = off[line_text[-1] + 1]
    first_word, after = np.searchsorted(w.starts, begins), np.searchsorted(w.starts, ends)
    full = after > first_word
    begins, ends, line_text, first_word, after = (x[full] for x in (begins, ends, line_text, first_word, after))
    earlier = repeats_earlier(w.span_hashes(begins, ends, sums), line_text)
    out["n_dup_lines"] = np.bincount(line_text[earlier], minlength=n_texts).astype(np.int64)

    words = after - first_word
    lone_bar = (w.ends - w.starts == 1) & (raw[w.starts] == 124)
    last = raw[w.ends[after - 1] - 1] if len(after) else np.zeros(0, dtype=np.uint8)
    chars = per_range(w.solid & IS_START[raw], begins, ends)
    bad_end = ~IS_ENDING[last] & (words <= rules.short_line)
    marks = per_range((raw == 33) | (raw == 63), begins, ends) > rules.most_marks * words
    symbols = per_range(IS_SYMBOL[raw], begins, ends) > rules.most_symbols * chars
    navigation = per_range(lone_bar, first_word, after) > rules.most_bars * words
    boiler = np.zeros(len(begins), dtype=bool)
    lowered = LOWER[raw].tobytes()
    for phrase in BOILERPLATE:
        p, at = phrase.encode(), lowered.find(phrase.encode())
        while at >= 0:
            k = int(np.searchsorted(begins, at, side="right")) - 1
            if k >= 0 and at + len(p) <= ends[k]:
                boiler[k] = True
            at = lowered.find(p, at + 1)
    removed = bad_end | marks | symbols | navigation | boiler | earlier
    out["n_lines"] = np.bincount(line_text, minlength=n_texts).astype(np.int64)
    out["n_lines_removed"] = np.bincount(line_text[removed], minlength=n_texts).astype(np.int64)
    out["n_words_removed"] = np.bincount(line_text[removed], weights=words[removed], minlength=n_texts).astype(np.int64)
    out["_lines"] = (begins, ends, line_text, removed)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.most_repeated_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["n_words"] - out["n_words_removed"] >= rules.least_kept * out["n_words"])
    return out


MADE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_lines_removed long, n_words_removed long, base_failed boolean, kept boolean"
NAMES = [x.split()[0] for x in MADE.split(", ")]


def clean_text(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> str:
    return "\n".join(raw[a:b].tobytes().decode() for a, b in zip(begins, ends, strict=True))


def judge(df: DataFrame, text: str = "text", rules: Rules = Rules(), cleaned: str | None = None) -> DataFrame:
    """`df` without its text column, with the statistics and verdict of each row.

    With `cleaned`, the text without the lines that failed is added under that name.  A null or
    empty text has no words and fails the base rules.  Columns of `df` with the names of
    results are replaced; repeated rows are judged one by one; no rows give no rows.
    """
    made = NAMES + ([cleaned] if cleaned else [])
    rest = [c for c in df.columns if c not in (*made, text)]
    source = df.select(*[df[c] for c in rest], df[text].alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema] + [MADE] + ([f"`{cleaned}` string"] if cleaned else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in chunks(batches, "__text"):
            found = measure(raw, off, rules)
            columns = [batch.column(i) for i in range(len(rest))] + [pa.array(found[c]) for c in NAMES]
            if cleaned:
                begins, ends, owner, removed = found["_lines"]
                good = ~removed
                cut = np.searchsorted(owner[good], np.arange(batch.num_rows + 1))
                columns.append(pa.array([clean_text(raw, begins[good][a:b], ends[good][a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, rest + made)

    return source.mapInArrow(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(documents).select("doc_id", *NAMES)
