"""Removing repeated passages: every byte under a WIDTH-byte string that also starts earlier goes.

Each window of WIDTH bytes is anchored at the place in it whose GRAM-byte hash is
least (the leftmost of equals), a choice that depends on the window's bytes alone,
so equal windows have anchors at equal places. A stretch is the run of windows
that share an anchor. Stretches equal as a whole collapse to their first place:
within a task at once, then over all tasks in one shuffle by anchor hash, packed by
buckets whose number follows the bytes of the input. That leaves two kinds of work:

* a stretch seen before as a whole (two polynomial hashes in different bases,
  beside the anchor's, find no difference) is removed;
* anchors with several different stretches (where a repeated passage begins or
  ends) go to the suffix sort. The suffixes at the anchors are merge sorted;
  prefix polynomial hashes and a binary search find the common extension of two
  suffixes, so a comparison takes logarithmic time. Neighbours' common extensions
  cut the order into classes, one cut for each offset of a window from its anchor,
  and within a class the bytes before the anchor decide. Windows found equal are
  compared byte by byte before one is removed.

A sort holds CROWD stretches of one anchor at most, a bound on a task's memory.
Beyond it the anchor's group is split: its windows meet one by one, by two hashes,
first collapsed per block of documents, with the same result. Texts move
once, dealt by their id to blocks whose number follows the bytes of the input.

Only strings within one text count. Null text counts as empty. A row is known by
its id and a hash of its text (``twin``): rows of equal id and text are the same
place, so neither counts as earlier, wherever they lie; rows of one id with
different texts are places of their own, in the order of that hash. Null ids come first.
Texts below WIDTH bytes lose nothing; a very long text is one row of its block.
A table without rows gives none. Extra columns of any name pass through ``remaining``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import textbytes as tb
from cairn.llm.tables import settled_parquet

WIDTH = 100
GRAM = 16
#: Places in a window where an anchor can stand.
REACH = WIDTH - GRAM + 1
#: Different stretches of one anchor hash that one task may sort.
CROWD = 1 << 16
#: Bytes of text to a block of documents, about.
BLOCK_BYTES = 1 << 24
#: Stands for a null id.
NO_ID = int(np.iinfo(np.int64).min)

#: Columns of an entry: a stretch's anchor hash (its upper half), content hashes, place, and last window and anchor from its start on.
ENTRY = (("anchor", "<u4"), ("content", "<u8"), ("proof", "<u4"), ("doc_id", "<i8"), ("twin", "<i8"), ("s", "<u4"), ("e", "u1"), ("a", "u1"))
#: Columns of a span of bytes that is removed at once.
SPAN = (("doc_id", "<i8"), ("twin", "<i8"), ("low", "<u4"), ("high", "<u4"))
RANKED = "anchor long, doc_id long, twin long, s long, e long, a long, whole boolean, crowded boolean"


def _blob(columns: list[np.ndarray], kind: tuple) -> bytes:
    raw = b"".join(np.ascontiguousarray(c, t).tobytes() for c, (_, t) in zip(columns, kind, strict=True))
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unblob(blobs: list[bytes], kind: tuple) -> list[np.ndarray]:
    found = [[np.empty(0, t) for _, t in kind]]
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        raw = pa.decompress(blob[8:], decompressed_size=n * sum(np.dtype(t).itemsize for _, t in kind), codec="zstd")
        at = np.concatenate([[0], np.cumsum([n * np.dtype(t).itemsize for _, t in kind])]).tolist()
        found.append([np.frombuffer(raw, t, n, i) for (_, t), i in zip(kind, at, strict=False)])
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _powers(length: int) -> np.ndarray:
    low, far = tb._tables(tb.INVERSE, length)
    n = (length >> tb.LOW_BITS) + 1
    return (far[:n, None] * low[None, :]).ravel()[:length]


def stretches(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts of a slice: first and last window start, anchor, text number, anchor hash and two content hashes of each stretch."""
    n = len(data)
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if n < WIDTH:
        return none
    hashes = tb.Hashes(data)
    grams = tb.mix((hashes.prefix[GRAM:] - hashes.prefix[:-GRAM]) * _powers(n - GRAM + 1))
    least, at = grams, np.arange(len(grams), dtype=np.int32)
    span = 1
    while span * 2 <= REACH:
        nearer = least[:-span] <= least[span:]
        at = np.where(nearer, at[:-span], at[span:])
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = REACH - span
    if rest:
        at = np.where(least[:-rest] <= least[rest:], at[:-rest], at[rest:])
    sizes = np.diff(starts)
    windows = np.maximum(sizes - WIDTH + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    p = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts[:-1], windows)
    if not len(p):
        return none
    anchor = at[p]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    s, e, a, t = p[new], p[np.concatenate([new[1:] - 1, [len(p) - 1]])], anchor[new].astype(np.int64), text[new]
    content = tb.mix(hashes.span(s, e + WIDTH) + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return s, e, a, t, grams[a], content, tb.Hashes(data, tb.OTHER_BASE).span(s, e + WIDTH)


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of the stretches low..high of each document; touching ones become one."""
    if not len(doc):
        return doc, low, high
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    base = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + base)
    first = np.concatenate([[True], (low + base)[1:] > reach[:-1]])
    first[1:] |= doc[1:] != doc[:-1]
    cut = np.flatnonzero(first)
    return doc[cut], low[cut], (reach - base)[np.concatenate([cut[1:] - 1, [len(doc) - 1]])]


def _places(doc: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's number in the order of distinct (doc, twin), and these pairs."""
    order = np.lexsort((twin, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (twin[order][1:] != twin[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, doc[order][new], twin[order][new]


def _find(buckets: int) -> Callable:
    """Stretches of a task's texts, by bucket of their anchors, the first place of each; all others are removed at once (``spans``)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        texts: list[list[np.ndarray]] = []
        size = n_texts = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            anchor, content, proof, of, s, e, a = (np.concatenate(x) for x in zip(*held, strict=True))
            number, ids, twins = _places(*(np.concatenate(x) for x in zip(*texts, strict=True)))
            doc = number[of]
            held.clear()
            texts.clear()
            order = np.lexsort((s, doc, proof, content, anchor))
            same = np.ones(len(order), bool)
            same[:1] = False
            for key in (anchor, content, proof):
                same[1:] &= key[order][1:] == key[order][:-1]
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            place = lambda x: (doc[order] == doc[order[x]]) & (s[order] == s[order[x]])
            again = same & ~place(head)  # a repeated row is not an earlier place
            gone = order[again]
            docs, low, high = merged(doc[gone], s[gone], e[gone] + WIDTH)
            spans = _blob([ids[docs], twins[docs], low, high], SPAN)
            kept = order[~same]
            bucket = (anchor[kept] % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            kept, bucket = kept[by], bucket[by]
            for b, lo, hi in tb.runs(bucket):
                i = kept[lo:hi]
                entries = [anchor[i] >> np.uint64(32), content[i], proof[i] >> np.uint64(32), ids[doc[i]], twins[doc[i]], s[i], e[i] - s[i], a[i] - s[i]]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_blob(entries, ENTRY)], pa.binary()), pa.array([spans], pa.binary())], ["bucket", "entries", "spans"])
                spans = None

        for batch in batches:
            for part, data, starts in tb.slices(batch, "text"):
                s, e, a, t, anchor, content, proof = stretches(data, starts)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                texts.append([ids, part.column("twin").to_numpy()])
                held.append([anchor, content, proof, t + n_texts, s - starts[t], e - starts[t], a - starts[t]])
                size += len(s)
                n_texts += len(ids)
                if size > 1_500_000:
                    yield from emptied()
                    size = n_texts = 0
        if held:
            yield from emptied()

    return find


def _rank(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's stretches those to remove (``whole``) and those to sort, which share an anchor with different ones."""
    entries, spans = [], []
    for part in parts:
        entries += [x.as_py() for x in part.column("entries")]
        spans += [x.as_py() for x in part.column("spans") if x.is_valid]
    columns = _unblob(entries, ENTRY)
    del entries
    anchor, content, proof, doc, twin, s, e, a = columns
    order = np.lexsort((s, twin, doc, proof, content, anchor))
    anchor, content, proof, doc, twin, s, e, a = (c[order] for c in columns)
    n = len(order)

    def as_before(*keys: np.ndarray) -> np.ndarray:
        same = np.ones(n, bool)
        same[:1] = False
        for k in keys:
            same[1:] &= k[1:] == k[:-1]
        return same

    seen = as_before(anchor, content, proof)
    again = seen & as_before(doc, twin, s)  # a repeated row's stretch, found in another task
    group = np.cumsum(~as_before(anchor)) - 1
    kinds = np.bincount(group, ~seen, minlength=1)[group] if n else np.empty(0)
    kept = np.flatnonzero(~again & (seen | (kinds > 1)))
    s, e, a = s.astype(np.int64), e.astype(np.int64), a.astype(np.int64)
    s_doc, s_twin, low, high = _unblob(spans, SPAN)
    whole = np.concatenate([seen[kept], np.ones(len(s_doc), bool)])
    zero = np.zeros(len(s_doc), np.int64)
    made = {
        "anchor": np.concatenate([anchor[kept].astype(np.int64) + (key[0].as_py() << 32), zero]),
        "doc_id": np.concatenate([doc[kept], s_doc]),
        "twin": np.concatenate([twin[kept], s_twin]),
        "s": np.concatenate([s[kept], low.astype(np.int64)]),
        "e": np.concatenate([s[kept] + e[kept], high.astype(np.int64) - WIDTH]),
        "a": np.concatenate([s[kept] + a[kept], zero]),
        "whole": whole,
        "crowded": np.concatenate([kinds[kept] > CROWD, zero > 0]),
    }
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made.values()], list(made))


# ---------------------------------------------------------------- the suffix sort


class Suffixes:
    """Suffixes of one array of bytes, each ending where its stretch ends, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.data, self.at, self.end, self.hashes = data, at, end, tb.Hashes(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search over hash comparisons."""
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.end[x] - self.at[x], self.end[y] - self.at[y])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hashes.span(self.at[x], self.at[x] + mid) == self.hashes.span(self.at[y], self.at[y] + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y; a suffix sorts before its extensions, equal ones by number."""
        n = self.common(x, y)
        left, right = self.at[x] + n, self.at[y] + n
        ended_x, ended_y = left >= self.end[x], right >= self.end[y]
        bx = self.data[np.minimum(left, len(self.data) - 1)].astype(np.int16)
        by = self.data[np.minimum(right, len(self.data) - 1)].astype(np.int16)
        bx[ended_x], by[ended_y] = -1, -1
        return np.where(bx == by, x < y, bx < by)

    def sorted(self) -> np.ndarray:
        """The suffix array: a merge sort whose merges rank all elements of a level at once."""
        n, width = len(self.at), 1
        order = np.arange(n)
        while width < n:
            place = np.arange(n)
            run = place // (2 * width) * (2 * width)
            in_left = place - run < width
            low = np.where(in_left, np.minimum(run + width, n), run)
            high = np.where(in_left, np.minimum(run + 2 * width, n), np.minimum(run + width, n))
            base = low.copy()
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                before = self.less(order[mid], order[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = run + (place - np.where(in_left, run, run + width)) + (low - base)
            moved = np.empty_like(order)
            moved[to] = order
            order, width = moved, width * 2
        return order


def repeated_windows(data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, a: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each stretch (its bytes at ``off``) and offset from the anchor: whether that window also starts earlier in another."""
    n = len(off)
    at = off + (a - s)
    suffixes = Suffixes(data, at, off + (e - s) + WIDTH)
    order = suffixes.sorted()
    extent = np.concatenate([[0], suffixes.common(order[:-1], order[1:])])
    rank = np.empty(n, np.int64)
    rank[np.lexsort((a, doc))] = np.arange(n)
    found = np.zeros((n, REACH), bool)
    for d in range(REACH):
        has = (d <= (a - s)[order]) & (d >= (a - e)[order])
        if has.sum() < 2:
            continue
        cls = np.cumsum(extent < WIDTH - d)[has]
        own = order[has]
        before = suffixes.hashes.span(at[own] - d, at[own])
        key = tb.mix(before + cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.lexsort((rank[own], key))
        own, key = own[by], key[by]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        head = own[np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))]
        twin, first = own[same], head[same]
        placed = (doc[twin] != doc[first]) | (a[twin] != a[first])
        twin, first = twin[placed], first[placed]
        for cut in range(0, len(twin), 50_000):  # collision verification, byte by byte
            x, y = twin[cut : cut + 50_000], first[cut : cut + 50_000]
            inside = np.arange(WIDTH)
            equal = (data[(at[x] - d)[:, None] + inside] == data[(at[y] - d)[:, None] + inside]).all(axis=1)
            found[x[equal], d] = True
            if not equal.all():
                _settle_collisions(data, at, d, x[~equal], own, rank, found)
    return found


def _settle_collisions(data, at, d, odd, own, rank, found) -> None:  # noqa: ANN001
    """Windows whose hash met another window's: decided by their bytes."""
    seen: dict[bytes, int] = {}
    for i in own[np.argsort(rank[own])]:
        seen.setdefault(data[at[i] - d : at[i] - d + WIDTH].tobytes(), i)
    for i in odd:
        if seen[data[at[i] - d : at[i] - d + WIDTH].tobytes()] != i:
            found[i, d] = True


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, lowest and highest column of each run of true values in the rows of a matrix."""
    edge = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    edge[:, 1:-1] = found
    step = np.diff(edge, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return row, low, high - 1


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Spans to remove: from suffix-sorted stretches, and from hashed windows, which have no context."""
    windows = table.filter(table.column("context").is_null())
    table = table.filter(table.column("context").is_valid())
    number, ids, twins = _places(*(np.concatenate([t.column(c).to_numpy() for t in (table, windows)]) for c in ("doc_id", "twin")))
    doc, w_doc = number[: table.num_rows], number[table.num_rows :]
    s, e, a, s_block = (table.column(c).to_numpy() for c in ("s", "e", "a", "block"))
    blobs = table.column("context").to_pylist()
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], np.int64)
    found = repeated_windows(data, np.cumsum(sizes) - sizes, s, e, a, doc) if len(blobs) > 1 else np.zeros((len(blobs), REACH), bool)
    row, low, high = _runs(found)

    w, w_proof, w_at, w_block = (windows.column(c).to_numpy() for c in ("anchor", "proof", "s", "block"))
    gone = windows.column("gone").to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((w_at, w_doc, w_proof, w))
    same = np.concatenate([[False], (w[order][1:] == w[order][:-1]) & (w_proof[order][1:] == w_proof[order][:-1])])[: len(order)]
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    gone[order] |= same & ((w_doc[order] != w_doc[head]) | (w_at[order] != w_at[head]))
    docs = np.concatenate([doc[row], w_doc[gone]])
    places = np.concatenate([s_block[row], w_block[gone]])
    docs, low, high = merged(docs, np.concatenate([a[row] - high, w_at[gone]]), np.concatenate([a[row] - low, w_at[gone]]) + WIDTH)
    return _packed(docs, low, high, places, np.concatenate([doc[row], w_doc[gone]]), ids, twins)


def _packed(doc: np.ndarray, low: np.ndarray, high: np.ndarray, blocks: np.ndarray, of: np.ndarray, ids: np.ndarray, twins: np.ndarray) -> pa.Table:
    """One row for each block of documents, with its spans as lists; ``blocks`` are those of the documents ``of``."""
    known, first = np.unique(of, return_index=True)
    block = blocks[first][np.searchsorted(known, doc)]
    order = np.argsort(block, kind="stable")
    names, starts = np.unique(block[order], return_index=True)
    ends = pa.array(np.append(starts, len(order)), pa.int32())
    lists = {n: pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int64())) for n, x in (("doc_id", ids[doc]), ("twin", twins[doc]), ("low", low), ("high", high))}
    return pa.table({"block": pa.array(names, pa.int32()), **lists})


# ---------------------------------------------------------------- blocks of documents


def _dealt(docs: DataFrame, carry: list[str], blocks: int) -> DataFrame:
    """Places and texts by block, with the columns ``carry`` as ``row``."""
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text", F.struct(*carry).alias("row"))
    return placed.withColumn("block", _block(blocks)).repartition(blocks, "block")


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")


def _block(blocks: int) -> Column:
    """The block of a place; a null id is dealt as the number that stands for it in the stretches."""
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "twin"), F.lit(blocks)).cast("int")


def _texts(table: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, int, int]]:
    """Of each place, the flat bytes it lies in and where."""
    out: dict = {}
    for batch in table.to_batches():
        data, starts = tb.flat(batch.column("text"))
        for i, place in enumerate(zip(batch.column("doc_id").fill_null(NO_ID).to_pylist(), batch.column("twin").to_pylist(), strict=True)):
            out.setdefault(place, (data, int(starts[i]), int(starts[i + 1])))
    return out


def _contexts(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """The bytes of each stretch asked for; of crowded anchors the hashes of its windows instead."""
    texts = _texts(docs)
    doc, twin, s, e, a, crowd = (asked.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "twin", "s", "e", "a", "crowded"))
    doc, ids, twins = _places(doc, twin)
    anchor = asked.column("anchor").to_numpy()
    places = list(zip(ids.tolist(), twins.tolist(), strict=True))
    blobs = []
    for d, x, y in zip(doc.tolist(), s.tolist(), e.tolist(), strict=True):
        data, at, _ = texts[places[d]]
        blobs.append(data[at + x : at + y + WIDTH].tobytes())
    crowd = crowd.astype(bool)
    calm = np.flatnonzero(~crowd)
    own_block = int(asked.column("block")[0].as_py()) if asked.num_rows else 0
    columns = {"anchor": anchor[calm], "proof": anchor[calm], "doc_id": ids[doc[calm]], "twin": twins[doc[calm]], "s": s[calm], "e": e[calm], "a": a[calm], "block": np.full(len(calm), own_block)}
    contexts = [blobs[i] for i in calm]
    busy = np.flatnonzero(crowd)
    w_doc, w_at, w_hash, w_proof = [], [], [], []
    for cut in range(0, len(busy), 10_000):
        own = busy[cut : cut + 10_000]
        sizes = np.array([len(blobs[i]) for i in own], np.int64)
        joined = np.frombuffer(b"".join(blobs[i] for i in own), np.uint8)
        count = sizes - WIDTH + 1
        at = np.repeat(np.cumsum(sizes) - sizes, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        w_hash.append(tb.mix(tb.Hashes(joined).span(at, at + WIDTH)).view(np.int64))
        w_proof.append(tb.Hashes(joined, tb.OTHER_BASE).span(at, at + WIDTH).view(np.int64))
        w_doc.append(np.repeat(doc[own], count))
        w_at.append(np.repeat(s[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    made = pa.table({**{k: pa.array(v, pa.int32() if k == "block" else pa.int64()) for k, v in columns.items()}, "context": pa.array(contexts, pa.binary()), "gone": pa.array(np.zeros(len(calm), bool))})
    if not w_hash:
        return made
    w, v, d, p = np.concatenate(w_hash), np.concatenate(w_proof), np.concatenate(w_doc), np.concatenate(w_at)
    order = np.lexsort((p, d, v, w))
    w, v, d, p = w[order], v[order], d[order], p[order]
    gone = np.concatenate([[False], (w[1:] == w[:-1]) & (v[1:] == v[:-1])])
    head = np.maximum.accumulate(np.where(gone, 0, np.arange(len(w))))
    repeat_row = gone & (d == d[head]) & (p == p[head])
    w, v, d, p, gone = (x[~repeat_row] for x in (w, v, d, p, gone))
    zero = np.zeros(len(w), np.int64)
    columns = {"anchor": w, "proof": v, "doc_id": ids[d], "twin": twins[d], "s": p, "e": p, "a": p, "block": np.full(len(w), own_block)}
    more = pa.table({**{k: pa.array(v, pa.int32() if k == "block" else pa.int64()) for k, v in columns.items()}, "context": pa.array([None] * len(zero), pa.binary()), "gone": pa.array(gone)})
    return pa.concat_tables([made, more])


def _collector(finish: Callable, fields: list[tuple[str, pa.DataType]]) -> Callable:
    """``row`` of every text of a block, and what ``finish(bytes, low, high)`` makes of it and its united spans; null for null text where it is text."""

    def of_block(docs: pa.Table, spans: pa.Table) -> pa.Table:
        of, twin, low, high = (pc.list_flatten(spans.column(c)).to_numpy() for c in ("doc_id", "twin", "low", "high"))
        number, ids, twins = _places(of, twin)
        doc, low, high = merged(number, low, high)
        first, last = (np.searchsorted(doc, np.arange(len(ids)), side).tolist() for side in ("left", "right"))
        at = dict(zip(zip(ids.tolist(), twins.tolist(), strict=True), zip(first, last, strict=True), strict=True))
        schema = pa.schema([docs.schema.field("row"), *fields])
        out = []
        for batch in docs.to_batches():
            data, starts = tb.flat(batch.column("text"))
            made = []
            for i, (own, mark) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist(), strict=True)):
                j, k = at.get((NO_ID if own is None else own, mark), (0, 0))
                made.append(finish(data[starts[i] : starts[i + 1]], low[j:k], high[j:k]))
            columns = [pa.array([m[c] for m in made], t) for c, (_, t) in enumerate(fields)]
            out.append(pa.RecordBatch.from_arrays([batch.column("row"), *columns], schema=schema))
        return pa.Table.from_batches(out, schema)

    return of_block


def _kept_bytes(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    ends = np.concatenate([low, [len(body)]])
    starts = np.concatenate([[0], high])
    return b"".join(body[a:b].tobytes() for a, b in zip(starts, ends, strict=True))


def removed_spans(docs: DataFrame, dealt: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id, twin, low, high: lists of stretches of bytes to remove, not yet united, by block of documents."""
    found = _placed(docs).mapInArrow(_find(blocks), "bucket int, entries binary, spans binary")
    ranked = settled_parquet(found.groupBy("bucket").applyInArrow(_rank, RANKED))
    block = _block(blocks)
    asked = ranked.filter("not whole").select("anchor", "doc_id", "twin", "s", "e", "a", "crowded", block.alias("block"))
    whole = ranked.filter("whole").select(block.alias("block"), F.array("doc_id").alias("doc_id"), F.array("twin").alias("twin"), F.array("s").alias("low"), F.array(F.col("e") + WIDTH).alias("high"))
    schema = "anchor long, proof long, doc_id long, twin long, s long, e long, a long, block int, context binary, gone boolean"
    known = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_contexts, schema)
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(blocks * 2)).cast("int")
    sorted_ = known.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_sort_bucket, "block int, doc_id array<long>, twin array<long>, low array<long>, high array<long>")
    return whole.union(sorted_)


def _apply(docs: DataFrame, carry: list[str], finish: Callable, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """The columns ``carry`` of every document as ``row``, and what ``finish`` makes of its bytes and united spans."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    dealt = _dealt(docs, carry, blocks)
    placed = removed_spans(docs, dealt, blocks)
    made = T.StructType([dealt.schema["row"], *T._parse_datatype_string(schema).fields])
    return dealt.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_collector(finish, fields), made)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def facts(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
        return len(body), int((high - low).sum()), len(low), hashlib.sha256(_kept_bytes(body, low, high)).hexdigest()

    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    found = _apply(docs, ["doc_id"], facts, fields, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.select("row.doc_id", *(n for n, _ in fields))


def remaining(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of every text; a character cut in two at an edge goes too. Null text stays null.

    Rows travel once, with their texts.
    """

    def text(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
        return (_kept_bytes(body, low, high).decode("utf-8", "ignore"),)

    marked = docs.select("*", F.col("text").isNull().alias("__no_text"))
    rest = [c for c in docs.columns if c != "text"]
    left = _apply(marked, [*rest, "__no_text"], text, [("left", pa.string())], "left string")
    kept = F.when(~F.col("row").getField("__no_text"), F.col("left"))
    return left.select(*(kept.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
