"""Cost-balanced packing of documents into sequences of a fixed token capacity.

Every document is its ids and an end id. Full stretches of CAPACITY ids take a
sequence of their own; the rest of a document is one piece, but for a small share
of documents, picked by a hash of the id, whose rests are cut into grains that
later fill gaps. Pieces are dealt to groups by a hash; a group estimates the cost
of each piece as ``LINEAR * n + QUADRATIC * n * n``, opens as many sequences as
its tokens need, and gives the pieces in descending order each to the sequence
of lowest cost with room left, opening another where none has room. A group has
a bounded number of pieces on average whatever the input, and only lengths and
checksums are shuffled, never ids.

Null and empty texts pack as their end id alone. Rows with equal ids are documents of
their own, packed separately and spread over all groups. A very long text is many full
stretches, each a row. Of pieces of equal length the order is that of a hash, and of
sequences of equal cost the smaller number wins. An empty table gives no rows; columns
other than id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tables import settled
from cairn.llm.tokens import encoder

CAPACITY = 2048
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
END_ID = 1
#: One document in so many has its rest cut into grains of so many ids.
GRAIN_EVERY = 12
GRAIN = 96
#: Pieces to a group, on average.
GROUP_PIECES = 8000

#: Words that a Python worker remembers in each of two generations.
MEMORY_WORDS = 1 << 19

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def cuts(doc: int, n: int) -> list[tuple[int, int]]:
    """Where a document of ``n`` ids is cut: (start, length) of its pieces."""
    full = n // CAPACITY * CAPACITY
    out = [(at, CAPACITY) for at in range(0, full, CAPACITY)]
    step = GRAIN if zlib.crc32(str(doc).encode()) % GRAIN_EVERY == 0 else CAPACITY
    return out + [(at, min(step, n - at)) for at in range(full, n, step)]


def pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and PIECES of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, MEMORY_WORDS)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                source, rows = [], []
                for i, ids in enumerate(encode([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()])):
                    body = ids + end
                    n = len(body) // 4
                    for start, length in cuts(part.column(0)[i].as_py(), n):
                        source.append(i)
                        rows.append((start, length, zlib.crc32(body[4 * start : 4 * (start + length)]), n))
                columns = [part.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(cut, f"doc_id {id_type}, {PIECES}")


def cost(length: np.ndarray) -> np.ndarray:
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces come longest first. Ties go to the sequence with the smaller number."""
    opened = max(1, -(-int(lengths.sum()) // CAPACITY))
    costs = cost(lengths.astype(float))
    # one heap of (cost, sequence) for each amount of room; a tree over the amounts knows the cheapest above a given one
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(CAPACITY + 1)]
    heaps[CAPACITY] = [(0.0, s) for s in range(opened)]
    width = 1 << (CAPACITY + 1 - 1).bit_length()
    none = (float("inf"), -1)
    tree = [none] * (2 * width)

    def put(room: int) -> None:
        at = width + room
        tree[at] = heaps[room][0] if heaps[room] else none
        while at > 1:
            at >>= 1
            best = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best

    put(CAPACITY)
    used = [0] * opened
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        best, lo, hi = none, width + n, 2 * width
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo >>= 1
            hi >>= 1
        if best[1] < 0:
            best = (0.0, len(used))
            used.append(0)
        else:
            heapq.heappop(heaps[CAPACITY - used[best[1]]])
            put(CAPACITY - used[best[1]])
        s = best[1]
        sequence[i], offset[i] = s, used[s]
        used[s] += n
        heapq.heappush(heaps[CAPACITY - used[s]], (best[0] + costs[i], s))
        put(CAPACITY - used[s])
    return sequence, offset


def _pack(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group = pa.Table.from_batches(list(parts))
    lengths = group.column("length").to_numpy()
    order = np.lexsort((group.column("ids_crc32").to_numpy(), group.column("start").to_numpy(), group.column("at").to_numpy(), -lengths))
    group = group.take(pa.array(order))
    sequence, offset = assign(lengths[order])
    group = group.drop_columns(["part", "at"])
    numbered = pa.array(sequence * 2**31 + key[0].as_py())
    group = group.append_column("sequence_id", numbered).append_column("offset", pa.array(offset))
    yield from group.combine_chunks().to_batches()


def pack(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, PIECES, sequence_id and offset. Sequences are padded to CAPACITY."""
    cut = settled(pieces(docs, path, text))
    groups = max(1, cut.count() // GROUP_PIECES)
    at = F.xxhash64("doc_id", "start", F.monotonically_increasing_id())  # the written rows fix the number, so rows of one id spread
    dealt = cut.withColumn("part", F.pmod(at, F.lit(groups)).cast("int")).withColumn("at", at)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("part").applyInArrow(_pack, f"doc_id {id_type}, {PIECES}, sequence_id long, offset long")
