"""Texts of an Arrow batch as one array of UTF-8 bytes, with polynomial hashes of any stretch of it.

The hash of bytes a..b is a polynomial in an odd base modulo 2^64; the powers of
the base have inverses, so prefix sums give the hash of any stretch by one
subtraction and one product, wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
OTHER_BASE = np.uint64(0xD1342543DE82EF95)
LOW_BITS = 12
#: A batch is worked on in slices of at most so many bytes, or one text.
SLICE_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: np.uint64, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` below 2^LOW_BITS, and every 2^LOW_BITS-th power as far as ``length``."""
    high = (length >> LOW_BITS) + 2
    low, far = _powers.get(int(base), (None, np.empty(0, np.uint64)))
    if low is None:
        low = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << LOW_BITS) - 1, base, np.uint64)]), dtype=np.uint64)
    if len(far) < high:
        step = np.uint64(pow(int(base), 1 << LOW_BITS, 1 << 64))
        far = np.cumprod(np.concatenate([[np.uint64(1)], np.full(high, step, np.uint64)]), dtype=np.uint64)
    _powers[int(base)] = low, far
    return low, far


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which every bit depends on all."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Prefix hashes of an array of small numbers."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE):
        low, far = _tables(base, len(values))
        n = (len(values) >> LOW_BITS) + 1
        powers = (far[:n, None] * low[None, :]).ravel()[: len(values)]
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers, out=self.prefix[1:])
        self.low, self.far = _tables(np.uint64(pow(int(base), -1, 1 << 64)), len(values))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches start..end; equal stretches have equal hashes wherever they stand."""
        shift = self.far[start >> LOW_BITS] * self.low[start & ((1 << LOW_BITS) - 1)]
        return (self.prefix[end] - self.prefix[start]) * shift


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text starts (one more entry than texts); null counts as empty."""
    if pa.types.is_string(texts.type):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    else:
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in parts of at most ``most`` bytes of text, or one row, each with its flat bytes."""
    at = 0
    if not batch.num_rows:
        return
    _, starts = flat(batch.column(text))
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        part = batch.slice(at, to - at)
        yield (part, *flat(part.column(text)))
        at = to


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of all texts, and how many words each text has."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(IS_SPACE[data], out=inside[:-1])
    before = np.concatenate([[False], inside[:-1]])
    cuts = starts[(starts > 0) & (starts <= len(data))]
    before[cuts] = False  # a text's first byte starts a word although the text before ended in one
    first = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[cuts - 1] = False
    last = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(first, starts))
    return first, last, counts


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z as a-z, and how many words each text has."""
    first, last, counts = word_spans(data, starts)
    return span_hashes(data, first, last), counts


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch first..last, A-Z as a-z."""
    found = Hashes(LOWER[data]).span(first, last)
    return mix(found + (last - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of sorted ``keys`` with the bounds of its run."""
    own, first = np.unique(keys, return_index=True)
    yield from zip(own.tolist(), first.tolist(), np.append(first[1:], len(keys))[: len(first)].tolist(), strict=True)
