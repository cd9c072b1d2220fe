"""Language-model scores: an exact unigram baseline and logistic mixing of hashed-context bit predictors.

Baseline. Texts are dealt to blocks by their id and text; the number of blocks
follows the bytes of the input. A block counts its distinct words and sends them to
shards by their hash; a shard sums the training counts of all blocks, and the sums go
back to the blocks, which score their texts. Only a block's distinct words travel,
packed, so a word that fills half of all texts is one entry a block, and what is
gathered grows with the corpus.

Mixing. Bytes are written in Huffman codes of the training texts, one for each
byte before, so a byte is a short run of bits. For each of ORDERS, the last bytes and
the place in the code pick a slot of a hashed table, filled from all training texts:
log odds of a one, and how often the slot was seen. A gate, made of how
often the slots were seen, picks the weights that combine the predictors' log odds,
and a table refines the mixed odds. Both are learned from every bit of every training text:
the texts are dealt to FOLDS folds by their hash, a bit is looked up in tables of the
other folds alone, and what is looked up is counted, by gate and by odds in steps;
the weights of a gate are the best ones for its counts.

Adaptive refinement. A text is read in order, word by word with the white space before
it. Each word is also predicted from how often it occurs in all training texts of
the corpus, and from how the text's words so far were spelled (capitals, white
space); the two predictions are mixed by weights that follow which of them did
better on the text's words before, gated by how frequent the word before is. Weights
never depend on the word that they weigh, nor on other texts, so scores are
probabilities and do not depend on the order of texts.

A text ends in an end symbol. Null text counts as empty; a null id counts as the
empty string when texts are held out. Rows with equal ids are scored one by one:
both models score a row in the same task, so nothing is joined by id. A very long text is
one row of its block. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textbytes as tb
from cairn.llm.tables import settled_parquet
from cairn.llm.tokens import pack_numbers, unpack_numbers

END_WORD = np.uint64(0x5851F42D4C957F2D)
END = 256
SYMBOLS = END + 1
#: Bytes of context of each predictor; WORD takes what the current word has so far, and at least the byte before it.
WORD = 7
ORDERS = (2, 4, WORD)
TABLE_BITS = 20
#: Bytes of text whose bits a task holds at a time.
SLICE = 1 << 17
SHARD = 1 << 15
#: Bits that are looked up at a time, few enough for a core's cache.
BITS_AT_ONCE = 1 << 15
#: Parts of the training texts: what the weights see of a text's bits comes from the other parts.
FOLDS = 2
SEEN = np.array([1, 4, 24])
STEPS = len(SEEN) + 1
GATES = STEPS ** len(ORDERS)
#: Steps of a unit of log odds in the tables and in the refining table, which covers -8 to 8.
TABLE_STEP = 4
REFINE_STEP = 8
LEVELS = 16 * REFINE_STEP + 1
#: For the fit, log odds are counted in so many steps, two of the tables' each; weights start from PRIOR, as if by PRIOR_BITS bits.
ODDS = 33
PRIOR = 0.45
PRIOR_BITS = 16.0
#: Bytes of text to a block, and to a shard of the words, about.
BLOCK_BYTES = 1 << 24
#: Forms of a word that the counts can predict (white space before it, capitals), and one for all others.
FORMS = 5
#: Whether a symbol is white space.
IS_SPACE = np.append(tb.IS_SPACE, False)
#: Counts above these divide what the word before says about the weights.
FREQUENT = np.array([1, 32, 1024])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# ---------------------------------------------------------------- words


def _count_words(shards: int):  # noqa: ANN202
    """Distinct words of a block, by shard, with how often its training texts hold them."""

    def count(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            distinct, at = np.unique(words, return_inverse=True)
            return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)

        for part in parts:
            for texts, data, starts in tb.slices(part, "text"):
                hashes, counts = tb.word_hashes(data, starts)
                training = ~texts.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                held.append((np.append(hashes, END_WORD), np.append(np.repeat(training, counts), training.sum()).astype(np.int64)))
                if len(held) >= 16:
                    held[:] = [merged()]
        words, counts = merged()
        shard = (words % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rows = [(own, pack_words(words[order[lo:hi]]), pack_numbers(counts[order[lo:hi]])) for own, lo, hi in tb.runs(shard[order])]
        own, *packed = zip(*rows, strict=True)
        columns = [pa.array(np.full(len(own), key[0].as_py(), np.int32)), pa.array(own, pa.int32()), *(pa.array(c, pa.binary()) for c in packed)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "words", "n"])

    return count


def pack_words(words: np.ndarray) -> bytes:
    return words.astype("<u8").tobytes()


def _sum_shard(_: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts over all blocks of the words of one shard, for each block; its first row tells how many there are."""
    rows = [(b.as_py(), np.frombuffer(w.as_py(), "<u8"), unpack_numbers(n.as_py())) for part in parts for b, w, n in zip(*(part.column(c) for c in ("block", "words", "n")), strict=True)]
    known, at = np.unique(np.concatenate([w for _, w, _ in rows]), return_inverse=True)
    total = np.bincount(at, np.concatenate([n for _, _, n in rows]), len(known)).astype(np.int64)
    end = 0
    for i, (block, words, _) in enumerate(rows):
        begin, end = end, end + len(words)
        columns = [pa.array([block], pa.int32()), pa.array([pack_words(words)], pa.binary()), pa.array([pack_numbers(total[at[begin:end]])], pa.binary())]
        sums = [pa.array([int(total.sum()) if i == 0 else 0]), pa.array([int((total > 0).sum()) if i == 0 else 0])]
        yield pa.RecordBatch.from_arrays([*columns, *sums], ["block", "words", "counts", "all_n", "all_v"])


# ---------------------------------------------------------------- codes and contexts


class Codes:
    """A Huffman code of the bytes and the end symbol for each byte before (END stands for a text's begin)."""

    def __init__(self, pairs: np.ndarray):
        alone = pairs.sum(axis=0)
        share = alone * SYMBOLS // max(int(alone.sum()), 1) + 1
        starts, lengths, nodes, bits = [], [], [], []
        shared = None
        size = 0
        for before in range(SYMBOLS):
            if not pairs[before].any() and shared is not None:
                starts.append(starts[shared])
                lengths.append(lengths[shared])
                continue
            if not pairs[before].any():
                shared = before
            start, length, node, bit = self._tree(pairs[before] * 64 + share)
            starts.append(start + size)
            lengths.append(length)
            nodes.append(node + before * SYMBOLS)
            bits.append(bit)
            size += len(node)
        self.start = np.concatenate(starts).astype(np.int32)
        self.length = np.concatenate(lengths).astype(np.int32)
        self.node = np.concatenate(nodes).astype(np.uint32) * np.uint32(0x9E3779B1)
        self.bit = np.concatenate(bits).astype(np.uint8)

    @staticmethod
    def _tree(counts: np.ndarray) -> tuple[np.ndarray, ...]:
        heap = [(c, i) for i, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        name = SYMBOLS
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (name, 0), (name, 1)
            heapq.heappush(heap, (a + b, name))
            name += 1
        nodes, bits, lengths = [], [], []
        for symbol in range(SYMBOLS):
            path, at = [], symbol
            while at in parent:
                at, bit = parent[at]
                path.append((at - SYMBOLS, bit))
            lengths.append(len(path))
            nodes += [n for n, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
        length = np.array(lengths)
        return np.cumsum(length) - length, length, np.array(nodes), np.array(bits)


def _symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts, each text's with its end symbol; their classes (the byte before); where each text starts."""
    n_texts = len(starts) - 1
    ends = starts[1:] + np.arange(1, n_texts + 1)
    symbols = np.full(len(data) + n_texts, END, np.int32)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = data
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[:1] = END  # after an end symbol a text begins
    return symbols, before, starts[:-1] + np.arange(n_texts)


def _bits(data: np.ndarray, starts: np.ndarray, codes: Codes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of all bits of all texts: the slot in each table and the bit; and at which bit each symbol begins (one more entry than symbols)."""
    symbols, before, first = _symbols(data, starts)
    key = (before * SYMBOLS + symbols).astype(np.intp)
    lengths = codes.length.take(key)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    of = np.repeat(np.arange(len(symbols)), lengths)  # the symbol of each bit, by which all else is looked up
    at = (codes.start.take(key) - ends[:-1]).take(of)
    at += np.arange(len(of))
    node, bit = codes.node.take(at), codes.bit.take(at)
    index = np.arange(len(symbols), dtype=np.int32)
    padded = np.concatenate([np.zeros(8, np.uint8), symbols.astype(np.uint8)])
    last = np.ndarray(len(symbols), "<u8", padded, strides=(1,)).copy()  # the eight bytes before each symbol, the latest highest
    spaces = index * IS_SPACE.take(symbols)
    since_space = index - np.maximum.accumulate(np.concatenate([[0], spaces[:-1]])).astype(np.int32)
    word = np.clip(since_space, 1, WORD).astype(np.uint64)
    # the first symbols of each text, whose contexts reach no further than its start
    place = np.tile(np.arange(max(ORDERS)), len(first))
    near = np.repeat(first, max(ORDERS)) + place
    own = near < np.repeat(np.append(first, len(symbols))[1:], max(ORDERS))
    near, place = near[own], place[own].astype(np.uint64)
    slots = []
    for k in ORDERS:
        reach = word if k == WORD else np.uint64(k)
        context = _contexts(k, last >> (np.uint64(64) - np.uint64(8) * reach), reach)
        short = np.minimum(word[near] if k == WORD else np.uint64(k), place)
        known = np.where(short > 0, last[near] >> (np.uint64(64) - np.uint64(8) * np.maximum(short, np.uint64(1))), np.uint64(0))
        context[near] = _contexts(k, known, short)
        slot = context.take(of)
        slot += node
        slot >>= np.uint32(32 - TABLE_BITS)
        slots.append(slot)
    return slots, bit, ends


def _contexts(k: int, known: np.ndarray, reach: np.ndarray | np.uint64) -> np.ndarray:
    """A hash of the ``reach`` bytes that predictor ``k`` knows."""
    return (tb.mix(known + ((reach << np.uint64(56)) + (np.uint64(k) << np.uint64(60)))) >> np.uint64(32)).astype(np.uint32)


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each symbol follows each in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for _, data, starts in tb.slices(batch, "text"):
                symbols, before, _ = _symbols(data, starts)
                seen += np.bincount(before * SYMBOLS + symbols, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], ["pair", "n"])

    out = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for row in docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[row.pair] = row.n  # at most SYMBOLS * SYMBOLS rows
    return out.reshape(SYMBOLS, SYMBOLS)


def fold(text: Column) -> Column:
    """The fold of a training text; equal texts share one."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def _fold_bits(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Fold, slots and bits of the texts, SLICE bytes of a fold at a time."""
    for batch in batches:
        own = batch.column("fold").to_numpy()
        for f in range(FOLDS):
            for _, data, starts in tb.slices(batch.filter(pa.array(own == f)), "text", SLICE):
                slots, bit, _ = _bits(data, starts, codes)
                yield f, slots, bit


def tables(docs: DataFrame, codes: Broadcast) -> np.ndarray:
    """Of every slot of every table one byte: the log odds of a one in steps, and below them how often the slot was seen, in STEPS.

    First the tables of all texts, then for each fold those of all texts but its own.
    """
    size = 2 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((FOLDS, len(ORDERS), size), np.int64)
        for f, slots, bit in _fold_bits(batches, codes.value):
            for k, slot in enumerate(slots):
                for at in range(0, len(bit), BITS_AT_ONCE):
                    cell = slot[at : at + BITS_AT_ONCE].astype(np.intp)
                    cell <<= 1
                    cell += bit[at : at + BITS_AT_ONCE]
                    np.add.at(seen[f, k], cell, 1)
        for f, k in np.ndindex(FOLDS, len(ORDERS)):
            shards = [pack_numbers(seen[f, k, at : at + SHARD]) for at in range(0, size, SHARD)]
            columns = [pa.array(np.full(len(shards), x, np.int32)) for x in (k, f)] + [pa.array(np.arange(len(shards), dtype=np.int32)), pa.array(shards, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "fold", "shard", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, SHARD), np.int64)
        for part in parts:
            for f, blob in zip(part.column("fold").to_pylist(), part.column("counts"), strict=True):
                total[f] += unpack_numbers(blob.as_py())
        every = total.sum(axis=0)
        cells = []
        for left in (every, *(every - own for own in total)):
            zeros, ones = left.reshape(-1, 2).T
            odds = np.clip(np.rint(TABLE_STEP * np.log((ones + 0.3) / (zeros + 0.3))), -31, 31).astype(np.int64) + 32
            cells.append((odds * STEPS + np.searchsorted(SEEN, zeros + ones, "right")).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([b"".join(cells)], pa.binary())], ["k", "shard", "cells"])

    parts = docs.select("text", fold(F.col("text")).alias("fold")).mapInArrow(count, "k int, fold int, shard int, counts binary").groupBy("k", "shard").applyInArrow(add, "k int, shard int, cells binary")
    half = SHARD // 2
    out = np.full((1 + FOLDS, len(ORDERS), size // 2), 32 * STEPS, np.uint8)
    for row in parts.toLocalIterator():  # the tables have a fixed size, one byte a slot
        out[:, row.k, row.shard * half : (row.shard + 1) * half] = np.frombuffer(row.cells, np.uint8).reshape(1 + FOLDS, half)
    return out


#: Of a cell, its log odds; what is left is how often it was seen.
CELL_ODDS = ((np.arange(256) // STEPS - 32) / TABLE_STEP).astype(np.float32)


def _gate(cells: list[np.ndarray]) -> np.ndarray:
    gate = cells[0] % np.uint8(STEPS)
    for c in cells[1:]:
        gate *= np.uint8(STEPS)
        gate += c % np.uint8(STEPS)
    return gate


def level(mixed: np.ndarray) -> np.ndarray:
    x = np.clip(mixed, -8, 8)
    x += np.float32(8)
    x *= np.float32(REFINE_STEP)
    return np.rint(x, out=x).astype(np.int32)


def _odds_step(cell: np.ndarray) -> np.ndarray:
    """The step of a cell's log odds for the fit, the same on both sides of zero."""
    odds = cell // STEPS - 32
    return (ODDS // 2 + np.sign(odds) * ((np.abs(odds) + 1) // 2)).clip(0, ODDS - 1)


#: What each predictor's cell adds to the number of a cell of the fit's counts: gate first, then the steps of all log odds, then the bit.
FIT_CELLS = GATES * ODDS ** len(ORDERS)
FIT_KEYS = [
    2 * ((np.arange(256) % STEPS) * STEPS ** (len(ORDERS) - 1 - k) * ODDS ** len(ORDERS) + _odds_step(np.arange(256)) * ODDS ** (len(ORDERS) - 1 - k)).astype(np.intp)
    for k in range(len(ORDERS))
]
#: The log odds that a step stands for, a step of two of the tables' steps by the middle of both.
STEP_ODDS = np.array([np.sign(x) * min(2 * abs(x) - 0.5, 31) / TABLE_STEP for x in range(-(ODDS // 2), ODDS // 2 + 1)])


def best_weights(odds: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The weights of the predictors' ``odds`` (a row each) that make the bits most likely, by Newton's method."""
    weights = np.full(len(odds), PRIOR)
    n = zeros + ones

    def loss(w: np.ndarray) -> float:
        mixed = w @ odds
        return float((n * np.logaddexp(0, mixed) - ones * mixed).sum() + PRIOR_BITS / 2 * ((w - PRIOR) ** 2).sum())

    now = loss(weights)
    for _ in range(50):
        one = 1 / (1 + np.exp(-(weights @ odds)))
        slope = odds @ (n * one - ones) + PRIOR_BITS * (weights - PRIOR)
        bend = (odds * (n * one * (1 - one))) @ odds.T + PRIOR_BITS * np.eye(len(odds))
        move = np.linalg.solve(bend, slope)
        while (then := loss(weights - move)) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        if then > now or np.abs(move).max() < 1e-9:
            break
        weights, now = weights - move, then
    return weights


def refined(odds: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each level of the mixed odds the probability of a one: what the odds say, moved by how far they were off around that level."""
    mixed = np.clip(weights @ odds, -8, 8)
    at, n = level(mixed), zeros + ones
    near = np.array([1, 2, 3, 4, 3, 2, 1]) / 4
    spread = lambda x: np.convolve(np.bincount(at, x, LEVELS), near, "same")
    said = 1 / (1 + np.exp(-np.linspace(-8, 8, LEVELS)))
    return said + spread(ones - n / (1 + np.exp(-mixed))) / (40 + spread(n))


def fitted(docs: DataFrame, codes: Broadcast, cells: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and predictor, and the probability of a one by gate and level, from all bits of the texts."""
    own = ODDS ** len(ORDERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * FIT_CELLS, np.int64)
        for f, slots, bit in _fold_bits(batches, codes.value):
            for at in range(0, len(bit), BITS_AT_ONCE):
                key = bit[at : at + BITS_AT_ONCE].astype(np.intp)
                for k, slot in enumerate(slots):
                    key += FIT_KEYS[k].take(cells.value[1 + f, k].take(slot[at : at + BITS_AT_ONCE]))
                np.add.at(seen, key, 1)
        by_gate = seen.reshape(GATES, 2 * own)
        met = np.flatnonzero(by_gate.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([pack_numbers(by_gate[g]) for g in met], pa.binary())], ["gate", "counts"])

    def fit(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * own, np.int64)
        for part in parts:
            for blob in part.column("counts"):
                total += unpack_numbers(blob.as_py()).astype(np.int64)
        met = np.flatnonzero(total.reshape(-1, 2).any(axis=1))
        zeros, ones = total.reshape(-1, 2)[met].T.astype(float)
        gate = key[0].as_py()
        steps = np.stack(np.unravel_index(met, (ODDS,) * len(ORDERS)))
        odds = STEP_ODDS[steps]
        weights = best_weights(odds, zeros, ones)
        yield pa.RecordBatch.from_arrays([pa.array([gate], pa.int32()), pa.array([weights.tolist()]), pa.array([refined(odds, zeros, ones, weights).tolist()])], ["gate", "weights", "one"])

    weights = np.full((GATES, len(ORDERS)), PRIOR)
    one = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, LEVELS))), (GATES, 1))
    counted = docs.select("text", fold(F.col("text")).alias("fold")).mapInArrow(count, "gate int, counts binary")
    for row in counted.groupBy("gate").applyInArrow(fit, "gate int, weights array<double>, one array<double>").collect():  # GATES rows at most
        weights[row.gate], one[row.gate] = row.weights, row.one
    return weights, one


def mixing_model(docs: DataFrame) -> Broadcast:
    """The bit model of the training texts: codes, tables, each predictor's part of the mixed odds by gate and cell, and log10 probabilities by bit, gate and level; of a fixed size."""
    context = docs.sparkSession.sparkContext
    training = docs.filter(~held_out(F.col("doc_id"))).select("text")
    codes = Codes(pair_counts(training))
    shared = context.broadcast(codes)
    cells = tables(training, shared)
    folds = context.broadcast(cells)
    weights, one = fitted(training, shared, folds)
    folds.destroy()
    parts = [(weights[:, k : k + 1] * CELL_ODDS).astype(np.float32).ravel() for k in range(len(ORDERS))]
    one = np.clip(one, 1e-5, 1 - 1e-5)
    return context.broadcast((codes, cells[0].copy(), parts, np.log10(np.stack([1 - one, one])).astype(np.float32).ravel()))


# ---------------------------------------------------------------- scores


def _bit_logs(slots: list[np.ndarray], bit: np.ndarray, cells: np.ndarray, parts: list[np.ndarray], logs: np.ndarray) -> np.ndarray:
    """log10 probability of every bit."""
    out = np.empty(len(bit), np.float32)
    for at in range(0, len(bit), BITS_AT_ONCE):
        part = slice(at, at + BITS_AT_ONCE)
        own = [cells[k].take(s[part]) for k, s in enumerate(slots)]
        gate = _gate(own).astype(np.intp)
        base = gate << 8
        mixed = parts[0].take(base + own[0].astype(np.intp))
        for k in range(1, len(own)):
            mixed += parts[k].take(base + own[k].astype(np.intp))
        row = bit[part].astype(np.intp)
        row *= GATES
        row += gate
        row *= LEVELS
        row += level(mixed)
        out[part] = logs.take(row)
    return out


def _before(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word the sum of ``values`` over the words before it in its text."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[:-1] - np.repeat(total[first], counts)


class Counts:
    """Counts of words by their hash; a word's place follows from the first bits of its hash, and a few steps from there."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = np.append(words[order], ~np.uint64(0)), np.append(counts[order], 0)
        bits = len(words).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.words[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The counts of ``hashes``, all of them known."""
        at = self.first.take((hashes >> self.shift).astype(np.intp))
        todo = np.flatnonzero(self.words.take(at) < hashes)
        while len(todo):
            at[todo] += 1
            todo = todo[self.words.take(at[todo]) < hashes[todo]]
        return self.counts.take(at)


def _score_texts(data: np.ndarray, starts: np.ndarray, known: Counts, mass: float, model: tuple) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, logs (of the baseline's numerators) and score of every text."""
    codes, cells, parts, log_table = model
    begin, end, counts = tb.word_spans(data, starts)
    hashes = tb.span_hashes(data, begin, end)
    n_texts = len(counts)
    text = np.repeat(np.arange(n_texts), counts)
    first = np.cumsum(counts) - counts
    c = known.of(hashes)
    end_c = known.of(np.array([END_WORD]))[0]

    slots, bit, bit_of = _bits(data, starts, codes)
    units = np.empty(len(begin) + n_texts, np.int64)  # each word with the white space before it, and each text's tail
    units[first + np.arange(n_texts)] = starts[:-1] + np.arange(n_texts)
    units[np.arange(len(begin)) + text + 1] = end + text
    sums = np.add.reduceat(_bit_logs(slots, bit, cells, parts, log_table), bit_of[units], dtype=np.float64) if n_texts else np.empty(0)
    tails = first + counts + np.arange(n_texts)
    spelled = sums[np.arange(len(begin)) + text]

    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    capitals, capital = upper[end] - upper[begin], upper[np.minimum(begin + 1, len(data))] - upper[begin]
    gap = begin - np.where(np.arange(len(begin)) == first[text], starts[text], np.concatenate([[0], end[:-1]]))
    space = data[np.maximum(begin - 1, 0)] if len(data) else np.empty(0, np.uint8)
    usual = (gap == 1) & ((space == 32) | (space == 10)) & (capitals == capital)
    form = np.where(usual, 2 * (space == 10) + capital, FORMS - 1)
    so_far = np.arange(len(begin)) - first[text]
    of_form = np.zeros(len(begin))
    for f in range(FORMS):
        own = form == f
        of_form[own] = _before(own.astype(float), first, counts)[own]
    counted = np.where(usual & (c > 0), np.log10(np.maximum(c, 1) / mass) + np.log10((of_form + 0.5) / (so_far + 0.5 * FORMS)), -np.inf)

    better = 1 / (1 + 10 ** np.clip(spelled - counted, -300, 300))
    earlier = np.concatenate([[0], c[:-1]])
    gate = np.where(so_far == 0, 0, np.searchsorted(FREQUENT, earlier, "right"))
    weight = np.empty(len(begin))
    for g in range(len(FREQUENT) + 1):
        own = gate == g
        won, met = _before(np.where(own, better, 0.0), first, counts)[own], _before(own.astype(float), first, counts)[own]
        weight[own] = (won + 1) / (met + 2)
    high = np.maximum(spelled, counted)
    word_logs = high + np.log10(weight * 10 ** (counted - high) + (1 - weight) * 10 ** (spelled - high))
    per_text = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[np.append(first, len(begin))])
    n_known = per_text((c > 0).astype(float)).astype(np.int64) + int(end_c > 0)
    return counts.astype(np.int64) + 1, n_known, per_text(np.log10(c + 1.0)) + np.log10(end_c + 1.0), per_text(word_logs) + sums[tails]


def scores(docs: DataFrame) -> DataFrame:
    """Of every text, both scores (log10 probabilities) and what they rest on.

    doc_id, held_out, n_tokens, n_known, train_tokens and base_score of the baseline,
    n_bytes and score of the mixed model; bits a byte follow from these two.
    """
    model = mixing_model(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    placed = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), block.alias("block"))
    counted = placed.groupBy("block").applyInArrow(_count_words(blocks), "block int, shard int, words binary, n binary")
    known = settled_parquet(counted.groupBy("shard").applyInArrow(_sum_shard, "block int, words binary, counts binary, all_n long, all_v long"))
    all_n, all_v = known.agg(F.coalesce(F.sum("all_n"), F.lit(0)), F.coalesce(F.sum("all_v"), F.lit(0))).first()
    mass = float(all_n + all_v + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "n_bytes", "score"]

    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        own = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in words.column("words")])
        total = np.concatenate([unpack_numbers(x.as_py()) for x in words.column("counts")]).astype(np.int64)
        known = Counts(own, total)
        out = []
        for batch in texts.to_batches():
            for part, data, starts in tb.slices(batch, "text", SLICE):
                n_tokens, n_known, logs, score = _score_texts(data, starts, known, mass, model.value)
                columns = [part.column("doc_id"), part.column("held_out"), *map(pa.array, (n_tokens, n_known, logs, np.diff(starts), score))]
                out.append(pa.RecordBatch.from_arrays(columns, names))
        return pa.Table.from_batches(out)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, n_bytes long, score double"
    scored = placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(mass))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(all_n).cast("long").alias("train_tokens"), base.alias("base_score"), "n_bytes", "score")
