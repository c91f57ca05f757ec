"""BPE encoding and decoding by contiguous rank arrays, for vocabularies of merges in tokenizer.json files.

A text is cut at the special tokens it holds and pre-tokenised by classes of code points, a megabyte at a time.
Each distinct pre-token of a task is merged once: a list holds the boundaries of its parts and a
list beside it the rank of the merge of each part with the next; the smallest rank is scanned for, the boundary between
its two parts deleted, and the ranks on both sides looked up anew, until no rank is left.  Scanning is quadratic, so
pre-tokens of more than `LONG` bytes take their smallest rank from a heap instead; the merges are the same.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.llm.scratch import small_batches

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a pre-token beyond which a heap finds the smallest rank.
LONG = 128
#: Characters that are pre-tokenised together, and pre-tokens that a task remembers.
GROUP, REMEMBERED = 1 << 20, 500_000
NONE = 1 << 60
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Where a text may be cut: a piece starts at a lone space between characters that are none.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    table = np.zeros(0x110000, dtype=np.uint8)
    surrogates = range(0xD800, 0xE000)
    for below, above in ((0, surrogates.start), (surrogates.stop, 0x110000)):
        run = "".join(map(chr, range(below, above)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, run):
                table[below + m.start() : below + m.end()] = kind
    return table


def starts(text: str, segments: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of `public_tokenizers.PATTERN` begin.  `text` is several texts on end, which begin at `segments`.

    Runs of one class are pre-tokens, but for three rules: the last of the white space before something else
    is apart, and joins it if it is a space; a lone apostrophe takes s, t, m, d, re, ve or ll with it,
    unless a space has joined it.
    """
    n = len(text)
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kind = classes()[code]
    first = np.zeros(n + 1, dtype=bool)
    first[segments] = True
    edge = first.copy()  # of texts
    edge[n] = True
    first[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
    first[last] = True
    first[last[code[last] == 0x20] + 1] = False
    at = np.flatnonzero((code == 0x27) & first[:n])
    code = np.append(code, np.zeros(2, dtype=np.uint32))
    one, two = code[at + 1], code[at + 2]
    inside = ~edge[at + 1]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    longer = inside & ~edge[np.minimum(at + 2, n)] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    first[at[short | longer] + 1] = False
    first[at[short] + 2] = True
    first[at[longer] + 2] = False
    first[at[longer] + 3] = True
    first[n] = False
    return np.flatnonzero(first)


class Ranks:
    """The vocabulary of a tokenizer.json: ids of bytes, ranks of merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a byte-level BPE that this operator knows")
        if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens that match by what stands beside them are not known")
        # bytes that are no printable Latin-1 characters are written as characters from 256 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_byte = [0] * 256
        for c, b in byte.items():
            self.by_byte[b] = vocab[c]
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.raw = [b""] * self.size
        for token, i in vocab.items():
            self.raw[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.raw[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocab[a] * self.size + vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> tuple[list[int], list[int]]:
        """The ids of a pre-token, and the boundaries between them."""
        if len(word) > LONG:
            return self.merge_long(word)
        size, get, made = self.size, self.rank.get, self.made
        ids, bounds = [self.by_byte[b] for b in word], list(range(len(word) + 1))
        ranks = [get(a * size + b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)  # the first of equals
            ids[i] = made[least]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] * size + ids[i + 1], NONE)
        return ids, bounds

    def merge_long(self, word: bytes) -> tuple[list[int], list[int]]:
        """The same merges in n log n: ranks wait in a heap by (rank, place), parts are linked."""
        size, get, n = self.size, self.rank.get, len(word)
        ids = [self.by_byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1], NONE)) != NONE]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] * size + ids[j], NONE) != r:
                continue  # one of its parts has changed since
            ids[i], ids[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := get(ids[i] * size + ids[after[i]], NONE)) != NONE:
                    heapq.heappush(waiting, (s, i))
            if (h := before[i]) >= 0 and (s := get(ids[h] * size + ids[i], NONE)) != NONE:
                heapq.heappush(waiting, (s, h))
        kept = [i for i in range(n) if ids[i] >= 0]
        return [ids[i] for i in kept], [*kept, n]

    def packed(self, piece: str) -> bytes:
        """The ids of a pre-token as little-endian 32-bit integers; remembered, as most return."""
        found = np.array(self.merge(piece.encode())[0], dtype="<u4").tobytes()
        if len(piece) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """Packed ids of each text, in parts of about `GROUP` characters at most."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []
        held = 0
        for i, text in enumerate(texts):
            for k, segment in enumerate(self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]):
                if k % 2:
                    if waiting:
                        self.encode_group(waiting, out)
                        waiting, held = [], 0
                    out[i].append(np.array([self.special[segment]], dtype="<u4").tobytes())
                    continue
                for part in windows(segment):
                    waiting.append((i, part))
                    held += len(part)
                    if held >= GROUP:
                        self.encode_group(waiting, out)
                        waiting, held = [], 0
        if waiting:
            self.encode_group(waiting, out)
        return out

    def encode_group(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        parts = [p for p in parts if p[1]]
        if not parts:
            return
        text = "".join(p for _, p in parts)
        begins = np.cumsum([0, *(len(p) for _, p in parts)])
        first = starts(text, begins[:-1])
        of_part = np.searchsorted(first, begins).tolist()
        first = first.tolist()
        get, packed = self.known.get, self.packed
        found = [get(p) or packed(p) for p in (text[a:b] for a, b in zip(first, [*first[1:], len(text)]))]
        for (i, _), a, b in zip(parts, of_part, of_part[1:]):
            out[i].append(b"".join(found[a:b]))

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


def windows(text: str, most: int = GROUP) -> Iterator[str]:
    """The text in parts of at least `most` characters, cut where pre-tokens begin in any case."""
    begin = 0
    while len(text) - begin > most and (m := LONE_SPACE.search(text, begin + most)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:] if begin else text


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Ranks:
    return Ranks(path)


def encode(df: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """`df` without its text column, with n_tokens, ids (or not), ids_sha256 (of ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of what the ids decode to, in UTF-8).

    Special tokens written out in a text become their ids.  A null text is encoded as an empty one: no ids, and digests of nothing.
    Very long texts are encoded by parts of a megabyte, a word without end as a whole.  Other columns may be of any type; those
    with the names of results are replaced.  Repeated rows stay repeated; no rows give no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(df.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])
    rest = [c for c in df.columns if c not in (*made, text)]
    source = df.select(F.struct(*[df[c] for c in rest], F.lit(0).alias("__none")).alias("row"), F.coalesce(df[text], F.lit("")).alias("text"))
    kind = source.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            sizes, of_ids, of_text, ids = [], [], [], []
            for parts in words.encode(batch.column(1).to_pylist()):
                a, b = hashlib.sha256(), hashlib.sha256()
                for part in parts:
                    a.update(part)
                    b.update(words.decode(part).decode("utf-8", "replace").encode())
                sizes.append(sum(map(len, parts)) // 4)
                of_ids.append(a.hexdigest())
                of_text.append(b.hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(b"".join(parts), dtype="<i4"))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["row", *made])

    out = source.mapInArrow(run, f"row {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
    return out.select("row.*", *made).drop("__none")


def decode(df: DataFrame, ids: str = "ids", output: str = "text", path: str | None = None) -> DataFrame:
    """`df` with the text of its ids in column `output`.  Special tokens are written out; ids outside the vocabulary, and null ones,
    are skipped, and bytes that are no UTF-8 become U+FFFD.  Null ids give a null text."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("string")
    def text_of(column):
        words = vocabulary(path)
        return column.map(lambda x: None if x is None else b"".join(words.raw[int(i)] for i in x if i is not None and i == i and 0 <= i < words.size).decode("utf-8", "replace"))

    return df.withColumn(output, text_of(F.col(ids)))


def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(documents, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
