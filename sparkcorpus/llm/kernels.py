"""Vectorised kernels over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed
and carriage return.  All functions work on whole texts; `chunks` only groups rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Rows are taken together up to this many bytes of text; a longer text makes a group of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, dtype=U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U))
        return self.up[:n], self.down[:n]


OF_BYTES = Powers(0x9E3779B97F4A7C15)
OF_WORDS = Powers(0xD6E8FEB86659FD93)


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = strings(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + most, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(begin, end - begin), raw[off[begin] : off[end]], off[begin : end + 1] - off[begin]
            begin = end


class Words:
    """Words of a group of texts: byte starts and ends, and for each text its first word."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = False):
        self.raw, self.off = (LOWER[raw] if lower else raw), off
        solid = ~SPACE[self.raw]
        first, last = solid.copy(), solid.copy()
        if len(raw):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            begins, ends = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
            first[begins] |= solid[begins]
            last[ends] |= solid[ends]
        self.solid = solid
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, off)  # words of text i: bounds[i] .. bounds[i + 1]
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def byte_sums(self) -> np.ndarray:
        up, _ = OF_BYTES.get(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, dtype=U)
        np.cumsum(BYTE[self.raw] * up[:-1], out=sums[1:])
        return sums

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """A hash of the bytes of each span."""
        sums = self.byte_sums() if sums is None else sums
        _, down = OF_BYTES.get(len(self.raw) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


class Runs:
    """Hashes of runs of consecutive words, from prefix sums over the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = OF_WORDS.get(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=U)
        np.cumsum(hashes * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U) * U(0x8CB92BA72F3D8DD7))


def window_starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the starts of its windows of so many words; and how many it has."""
    many = np.maximum(np.diff(bounds) - width + 1, 0)
    total = int(many.sum())
    shift = np.repeat(bounds[:-1] - (np.cumsum(many) - many), many)
    return np.arange(total) + shift, many


def i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
