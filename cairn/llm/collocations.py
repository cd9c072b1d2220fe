"""Collocations of two to four words, counted in the dictionary of a prefix-free parse.

Parsing. A text is cut where the hash of three consecutive words says so; a chunk goes from one such place to the end of the
next, so neighbours share three words and equal passages give equal chunks wherever they stand. Equal chunks
are one entry of the dictionary with the number of times they occur. A phrase is counted in the chunk in which it starts, unless it
starts in the three words that the next chunk repeats; as no phrase has more than four words, each of its
occurrences lies whole in exactly one chunk. The last chunk of a text keeps its last words, so it is an entry of its own.

Counting. A phrase with enough occurrences holds only phrases with as many. So the dictionary is read level by level: 64-bit
hashes of words, of pairs, then of triples and quadruples are counted, weighted by the chunks' frequencies, and a
table of bits keeps which hashes reached the bound; the next level counts only what lies within the bits. Collisions add
to counts and never take from them, so nothing is lost; the last reading spells out the phrases that are left and
counts their strings exactly. The table of bits has one size at every scale; a fuller one lets more
phrases through to the exact counts and changes no result.

Words are parted by blanks and tabs; phrases do not cross ``.,;:!?`` or a line break of any kind; A-Z count as a-z. Null text is empty,
a null language is ``und``; texts without words give nothing, and an empty table gives no rows. Repeated rows count like any
others. A text without a cutting place is one chunk, whatever its length. Only the two named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.tables import settled_parquet
from cairn.llm.textbytes import LOWER, OTHER_BASE, Hashes, mix, slices

#: Most words of a phrase, and the words that neighbouring chunks share.
LONGEST = 4
OVERLAP = LONGEST - 1
#: One place in so many ends a chunk.
EVERY = 32
#: Bits of a table of hashes, 8 MB.
TABLE = 1 << 26
#: Bytes of the table to a row.
PAGE = 1 << 14
#: Distinct hashes that a task gathers before it hands them on, about.
GATHERED = 1 << 20

CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", 10, 11, 12, 13]] = True
BREAKS = CUTS.copy()
BREAKS[[9, 32]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The words of some texts: bounds, two hashes each, and how many words from each on belong to its piece (4 at most) and to its text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, twice: bool = False):
        inside = np.zeros(len(data) + 1, bool)
        np.logical_not(BREAKS[data], out=inside[:-1])
        before = np.concatenate([[False], inside[:-1]])
        ends = np.concatenate([inside[1:], [False]])
        cuts = starts[(starts > 0) & (starts <= len(data))]
        before[cuts] = False
        ends[cuts - 1] = False
        self.first = np.flatnonzero(inside & ~before)
        self.last = np.flatnonzero(inside & ~ends) + 1
        self.bounds = np.searchsorted(self.first, starts)  # of each text
        size = (self.last - self.first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        self.hash = mix(Hashes(data).span(self.first, self.last) + size)
        self.other = mix(Hashes(data, OTHER_BASE).span(self.first, self.last) + size) if twice else None
        n = len(self.first)
        parted = np.concatenate([[0], np.cumsum(CUTS[data])])
        apart = np.ones(n, bool)  # whether the next word belongs to another piece
        if n:
            apart[:-1] = parted[self.first[1:]] > parted[self.last[:-1]]
            apart[self.bounds[1:][self.bounds[1:] > 0] - 1] = True
        self.run = np.ones(n, np.int8)
        for _ in range(LONGEST - 1):
            self.run[:-1] = np.where(apart[:-1], 1, np.minimum(self.run[1:] + 1, LONGEST))

    def grams(self, n: int, other: bool = False) -> np.ndarray:
        """A hash for the n words from each word on; those within a piece are the ones with ``run >= n``."""
        each, step = (self.other, _OTHER_STEP) if other else (self.hash, _STEP)
        out = each.copy()
        for k in range(1, n):
            out[:-k] = out[:-k] * step + each[k:]
        return mix(out + np.uint64(n))


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: lang, chunk, tail (whether it ends its text), words (those that it counts) and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in slices(batch, "text"):
                data = LOWER[data]
                w = Words(data, starts)
                body = data.tobytes()
                trigger = w.grams(OVERLAP) % np.uint64(EVERY) == 0
                found: dict[tuple, int] = defaultdict(int)
                for lang, a, b in zip(part.column("lang").to_pylist(), w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    inner = np.flatnonzero(trigger[a + 1 : max(b - OVERLAP, 0)]) + a + 1  # never one at the text's last words
                    at = a
                    for to in inner.tolist():
                        found[lang, False, body[w.first[at] : w.last[to + OVERLAP - 1]], to - at] += 1
                        at = to
                    found[lang, True, body[w.first[at] : w.last[b - 1]], b - at] += 1
                keys = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[3] for k in keys], pa.int64()), pa.array(list(found.values()), pa.int64())],
                    names=["lang", "chunk", "tail", "words", "times"],
                )

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = rows.mapInArrow(run, "lang string, chunk binary, tail boolean, words long, times long")
    return settled_parquet(parts.groupBy("lang", "chunk", "tail", "words").agg(F.sum("times").alias("times")), "zstd")


def _own(batch: pa.RecordBatch, twice: bool = False) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and words of a batch of chunks; for each word the row it is in, its weight, and whether phrases from there on count."""
    data, starts = _flat(batch.column("chunk").to_pylist())
    w = Words(data, starts, twice)
    row = np.repeat(np.arange(batch.num_rows), np.diff(w.bounds))
    within = np.arange(len(row)) - w.bounds[:-1][row]
    counts = within < batch.column("words").to_numpy()[row]
    return data, w, row, batch.column("times").to_numpy()[row], counts


def _salts(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row's language."""
    known: dict[str, np.uint64] = {}
    for lang in batch.column("lang").unique().to_pylist():
        data, starts = _flat([lang.encode()])
        known[lang] = mix(Hashes(data).span(np.array([0]), np.array([len(data)])) + np.uint64(len(data) + 1))[0]
    return np.array([known[x] for x in batch.column("lang").to_pylist()], np.uint64)


def _within(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _passing(w: Words, salt: np.ndarray, counts: np.ndarray, n: int, bits: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of phrases of ``n`` words whose parts of every known length are within the bits, and the hashes of these phrases."""
    open_ = counts & (w.run >= n)
    for k, table in bits.items():
        if k > n:
            continue
        fits = _within(table.value, mix(w.grams(k) ^ salt))
        for shift in range(n - k + 1):
            open_[: len(open_) - shift] &= fits[shift:]
    at = np.flatnonzero(open_)
    return at, mix(w.grams(n)[at] ^ salt[at])


def _packed(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of numbers byte by byte of equal weight, as most of these bytes are zero, and what follows them."""
    return pa.compress(b"".join(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns) + tail, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, columns: int = 2, tail: int = 0) -> tuple[list[np.ndarray], bytes]:
    body = pa.decompress(data, 8 * columns * n + tail, codec="zstd", asbytes=True)
    planes = np.frombuffer(body, np.uint8, 8 * columns * n).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes], body[8 * columns * n :]


def _ranges(places: int) -> tuple[int, int]:
    """How many bits of a hash tell values apart in a dictionary of so many words, and how many of them name a range."""
    width = min(64, places.bit_length() + 6)
    return width, min(width, max(6, (places >> 21).bit_length()))


def _edges(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """The bounds of each run of equal values."""
    cuts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, np.int64)
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(sorted_)).tolist(), strict=True))


def _summed(values: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(np.concatenate(values), return_inverse=True)
    return own, np.bincount(place, np.concatenate(times), len(own)).astype(np.int64)


def _bits(chunks: DataFrame, sizes: list[int], least: int, known: dict, places: int) -> np.ndarray:
    """The table of bits of all phrases of these sizes whose hash occurs often enough.

    Of the hashes as many bits count as ``places``, the number of words in the dictionary, asks for: one value in 64 is taken. A task
    sums what it reads and sends its values packed, by ranges; the ranges follow ``places`` too.
    """
    width, split = _ranges(places)
    mask, inner, table = np.uint64((1 << width) - 1), np.uint64(width - split), min(TABLE, 1 << width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, weights, held = [], [], 0

        def out() -> pa.RecordBatch:
            own, total = _summed(values, weights)
            part = own >> inner
            bounds = _edges(part)
            rows = [_packed(np.diff(own[a:b] - (part[a] << inner), prepend=np.uint64(0)), total[a:b]) for a, b in bounds]
            return pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in bounds], pa.int64()), pa.array([b - a for a, b in bounds], pa.int64()), pa.array(rows, pa.binary())], names=["part", "n", "packed"])

        for batch in batches:
            _, w, row, times, counts = _own(batch)
            salt = _salts(batch)[row]
            for n in sizes:
                at, found = _passing(w, salt, counts, n, known)
                values.append(found & mask)
                weights.append(times[at])
                held += len(at)
            if held > 4 * GATHERED:
                own, total = _summed(values, weights)
                values, weights, held = [own], [total], len(own)
                if held > GATHERED:
                    yield out()
                    values, weights, held = [], [], 0
        if values:
            yield out()

    def frequent(rows: pa.Table) -> pa.Table:
        found = [_unpacked(p.as_py(), n.as_py())[0] for p, n in zip(rows.column("packed"), rows.column("n"), strict=True)]
        own, total = _summed([np.cumsum(v, dtype=np.uint64) for v, _ in found], [t.astype(np.int64) for _, t in found])
        value = own[total >= least] + (np.uint64(rows.column("part")[0].as_py()) << inner)
        return pa.table({"hash": np.unique(value & np.uint64(table - 1)).astype(np.int64)})

    often = chunks.mapInArrow(count, "part long, n long, packed binary").groupBy("part").applyInArrow(frequent, "hash long")
    size = min(PAGE, table >> 3)
    bit = F.expr("shiftleft(1, cast(hash & 7 AS INT))")
    filled = often.groupBy(F.shiftright("hash", 3).alias("byte")).agg(F.bit_or(bit).alias("bits"))

    def page(rows: pa.Table) -> pa.Table:
        byte = rows.column("byte").to_numpy()
        own = np.zeros(size, np.uint8)
        own[byte % size] = rows.column("bits").to_numpy()
        return pa.table({"page": [int(byte[0]) // size], "own": pa.array([own.tobytes()], pa.binary())})

    out = np.zeros(table >> 3, np.uint8)
    for p in filled.groupBy(F.floor(F.col("byte") / size)).applyInArrow(page, "page long, own binary").collect():  # the table, 8 MB at any size
        out[p.page * size : (p.page + 1) * size] = np.frombuffer(p.own, np.uint8)
    return out


def counted(chunks: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size (words) and times of every phrase of one to four words that occurs ``least`` times or more."""
    spark, tables = chunks.sparkSession, {}
    places = chunks.agg(F.sum("words")).first()[0] or 0
    inner = np.uint64(64 - _ranges(places)[1])
    for sizes in ([1], [2], [3, 4]):
        bits = spark.sparkContext.broadcast(_bits(chunks, sizes, least, tables, places))
        tables.update(dict.fromkeys(sizes, bits))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}  # both hashes of a phrase to its place in the lists
        langs, phrases, sums = [], [], np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            part = np.array([k[0] for k in held], np.uint64) >> inner
            rows = pa.table({"lang": pa.array(langs, pa.string()), "part": part.astype(np.int64), "phrase": pa.array(phrases, pa.large_binary()), "times": sums})
            rows = rows.sort_by([("lang", "ascending"), ("part", "ascending"), ("phrase", "ascending")]).combine_chunks()
            lang, part, phrase, times = (rows.column(i).chunk(0) for i in range(4))
            number = lang.dictionary_encode().indices.to_numpy().astype(np.int64) << 32
            offsets, body = np.frombuffer(phrase.buffers()[1], np.int64), phrase.buffers()[2]
            for a, b in _edges(number + part.to_numpy()):
                text = body[offsets[a] : offsets[b]]
                packed = _packed(np.diff(offsets[a : b + 1]), times.to_numpy()[a:b], tail=text.to_pybytes())
                yield pa.RecordBatch.from_arrays([lang[a : a + 1], part[a : a + 1], pa.array([b - a], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([packed], pa.binary())], names=["lang", "part", "n", "bytes", "packed"])

        for batch in batches:
            data, w, row, times, counts = _own(batch, twice=True)
            salt, body, names = _salts(batch)[row], data.tobytes(), batch.column("lang").to_pylist()
            for n in range(1, LONGEST + 1):
                at, found = _passing(w, salt, counts, n, tables)
                if not len(at):
                    continue
                other = w.grams(n, other=True)[at]
                own, first, place = np.unique(found, return_index=True, return_inverse=True)
                if (other != other[first][place]).any():  # two phrases of one hash in a batch
                    own, first, place = np.unique(np.stack([found, other], axis=1), axis=0, return_index=True, return_inverse=True)
                    place = place.ravel()
                total, at = np.bincount(place, times[at], len(first)).astype(np.int64), at[first]
                seen = np.array([held.setdefault(k, len(held)) for k in zip(found[first].tolist(), other[first].tolist(), strict=True)])
                fresh = at[seen >= len(phrases)]
                words = [[body[a:b] for a, b in zip(w.first[fresh + k].tolist(), w.last[fresh + k].tolist(), strict=True)] for k in range(n)]
                phrases += [b" ".join(p) for p in zip(*words, strict=True)]
                langs += [names[r] for r in row[fresh].tolist()]
                sums = np.append(sums, np.zeros(len(held) - len(sums), np.int64))
                sums[seen] += total
            if len(held) > GATHERED:
                yield from out()
                held.clear()
                langs, phrases, sums = [], [], np.zeros(0, np.int64)
        if held:
            yield from out()

    def exact(rows: pa.Table) -> pa.Table:
        found = []
        for n, size, packed in zip(*(rows.column(c).to_pylist() for c in ("n", "bytes", "packed")), strict=True):
            (lengths, times), text = _unpacked(packed, n, 2, size)
            offsets = np.append(0, np.cumsum(lengths.astype(np.int64)))
            found.append(pa.table({"phrase": pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(text)]), "times": times.astype(np.int64)}))
        total = pa.concat_tables(found).group_by("phrase").aggregate([("times", "sum")])
        total = total.filter(pc.greater_equal(total.column("times_sum"), least))
        phrase = total.column("phrase").cast(pa.binary()).cast(pa.string(), safe=False)
        size = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * total.num_rows, pa.string()), "phrase": phrase, "size": size, "times": total.column("times_sum")})

    packed = chunks.mapInArrow(spell, "lang string, part long, n long, bytes long, packed binary")
    return settled_parquet(packed.groupBy("lang", "part").applyInArrow(exact, "lang string, phrase string, size int, times long"))


def mine(docs: DataFrame, least: int = 30, most: int = 2000, covered: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``most`` collocations.

    A phrase with ``a`` occurrences, cut after its first words, has ``l`` and ``r`` occurrences of its parts and the score floor(2000000 a / (l + r));
    its lowest cut counts. Phrases of which a longer one takes up at least ``covered`` percent go.
    """
    chunks = parse(docs)
    often = counted(chunks, least)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("times") * F.col("words")).alias("n"))
    exact = lambda name: F.col(name).cast("decimal(20,0)")

    candidates = often.filter("size >= 2").withColumnRenamed("times", "a")
    words = F.split("phrase", " ")
    join = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cut = candidates.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "size", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, times: often.select("lang", F.col("phrase").alias(name), F.col("times").alias(times))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    inside = candidates.filter("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = lowest.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * covered))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
