"""Vectorised tokens and hashes over Arrow text columns.

A token is a maximal run of the letters a-z, digits and characters beyond ASCII in the lower-cased text, in SQL
``regexp_extract_all(lower(text), TOKEN)``. A null text counts as an empty one. Each token is known by a 64-bit
polynomial hash of its UTF-8 bytes, computed for a whole batch with a handful of numpy passes and in blocks, so that a text
of any length needs little memory beside its own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The tokens as an RE2 or Java pattern.
TOKEN = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base % 2**64, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Hasher:
    """Tables for hashing; build one in each task."""

    def __init__(self) -> None:
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.word = np.zeros(256, bool)
        self.word[48:58] = self.word[97:123] = self.word[128:] = True
        self.power, self.inverse = powers(BASE, BLOCK + 1), powers(pow(BASE, -1, 2**64), BLOCK + 1)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash for each span of the bytes; spans are sorted and don't overlap."""
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
            low = start[i]
            part = self.letter[data[low : end[j - 1]]]
            power, inverse = self.power, self.inverse
            if len(part) > BLOCK:  # one token longer than a block
                power, inverse = powers(BASE, len(part) + 1), powers(pow(BASE, -1, 2**64), 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=total[1:])
            s, e = start[i:j] - low, end[i:j] - low
            out[i:j] = (total[e] - total[s]) * inverse[s]
            i = j
        return mix(out)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all tokens, and for each text where its own begin; one bound more than texts."""
        data, at, start, end = self.split(texts)
        return self.spans(data, start, end), np.searchsorted(start, at)

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, where each text begins in them, and the tokens' spans."""
        data, at = lowered(texts)
        mask = self.word[data]
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        if len(mask) and mask[0]:
            edge = np.concatenate([[0], edge])
        return data, at, edge[0::2], edge[1::2]


def lowered(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with a line end after each text, and the texts' bounds."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    one = pa.scalar("", pa.large_string())
    joined = pc.binary_join_element_wise(texts, one, pa.scalar("\n", pa.large_string()))
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def grams(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k tokens that stay within a text, and where each begins."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i, p in enumerate(powers(BASE, k)):
        total += h[i : i + n] * p
    inside = np.ones(n, bool)
    for b in range(1, k):  # runs that would cross a bound
        x = at[1:-1] - b
        inside[x[(x >= 0) & (x < n)]] = False
    begin = np.flatnonzero(inside)
    return mix(total[begin]), begin


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about that many bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


