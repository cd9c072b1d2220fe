"""Near-duplicate documents: circulant MinHash finds candidates, full shingle sets confirm them.

A text's set holds its distinct five-word shingles (a text of fewer words, but
at least one, has all its words as one shingle). Two permutations make the whole
signature: the first deals the shingles' hashes over a universe of UNIVERSE
places, the second, shifted circularly by k, gives coordinate k, so the
coordinates of a shingle are one stretch of a table. BANDS bands of ROWS
coordinates put texts of similarity 0.85 into a common bucket but for less than
one pair in a million.

Texts with equal sets form a class, with a number of its own and its smallest id,
before anything is paired. Within a bucket, classes are first compared with two
leaders, the smallest and the one that meets most others in all its buckets; the
components of what they confirm leave only pairs across components. Those classes
are joined on the prefixes of their shingles, rarest first, and a pair goes on to
be compared if the place of the shingle leaves room for enough common ones. So a
group of n near copies costs about n comparisons, and a link is skipped only
where its ends are connected already.

Null and empty texts, and those without words, have the empty set and stay
alone. Rows of equal id are told apart by their sets: each is linked like any other. A
row of null id links with nothing and keeps a null component. Very long texts are taken
whole, further columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textbytes as tb
from cairn.llm.components import components
from cairn.llm.tables import gathered, settled

SHINGLE = 5
UNIVERSE = 1 << 20
BANDS = 24
ROWS = 5
#: Least similarity in percent: 100 * intersection >= LEAST * union.
LEAST = 85

_made: list[tuple[np.ndarray, np.ndarray]] = []


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The dealing permutation, and for each place the stretch of the second permutation that starts there."""
    if not _made:
        deal = np.random.default_rng(11).permutation(UNIVERSE).astype(np.uint32)
        turn = np.random.default_rng(12).permutation(UNIVERSE).astype(np.uint32)
        ring = np.concatenate([turn, turn[: BANDS * ROWS]])
        _made.append((deal, np.lib.stride_tricks.sliding_window_view(ring, BANDS * ROWS)))
    return _made[0]


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, counts = tb.word_hashes(data, starts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    factors = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]
    full = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for j, factor in enumerate(factors):
        full += words[j : j + len(full)] * factor
    full = tb.mix(full)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * np.array(factors[: b - a])).sum(dtype=np.uint64, keepdims=True)
            out.append(tb.mix(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k: the least value of the second permutation, shifted by k, over the dealt shingles."""
    deal, stretches = permutations()
    places = np.unique(deal[(shingles >> np.uint64(44)).astype(np.int64)])
    low = stretches[places[:4096]].min(axis=0)
    for at in range(4096, len(places), 4096):
        np.minimum(low, stretches[places[at : at + 4096]].min(axis=0), out=low)
    return low


def bands(signed: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)
    for column in signed.reshape(BANDS, ROWS).T:
        keys = tb.mix(keys + column)
    return keys.view(np.int64)


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two hashes of each set."""
    marks = [(tb.mix(s).sum(dtype=np.uint64), tb.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)) for s in sets]
    keys = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, starts in tb.slices(batch, "text"):
            sets = shingle_sets(data, starts)
            sizes = np.array([len(s) for s in sets], np.int64)
            found = [bands(signature(s)) if len(s) else np.empty(0, np.int64) for s in sets]
            ends = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            columns = [part.column("doc_id"), pa.array(sizes), *_marks(sets), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, starts in tb.slices(batch, "text"):
            sets = shingle_sets(data, starts)
            ends = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(x) for x in sets], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends).astype(np.int64)), *_marks(sets), lists], ["n", "k1", "k2", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for name in ("sa", "sb"):
            lists = batch.column(name)
            sides.append((lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()))
        (xs, xe), (ys, ye) = sides
        linked = []
        for i in range(batch.num_rows):
            x, y = xs[xe[i] : xe[i + 1]], ys[ye[i] : ye[i + 1]]
            if len(y) < len(x):
                x, y = y, x
            common = 0
            if 100 * len(x) >= LEAST * len(y):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
            linked.append(100 * common >= LEAST * (len(x) + len(y) - common))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_confirm, "a long, b long")


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold members of two components or more."""
    spans = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    return placed.join(spans.filter("c1 <> c2").select("bucket"), "bucket")


def _across(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of open classes in different components that may be similar enough.

    Shingles are ordered by how few open classes hold them. Similar sets share a shingle within their prefixes, and
    the places of the first one they share bound all that they share.
    """
    reps = open_.select("rep", "n", "component").distinct()
    held = sets.join(reps, "rep").select("rep", "n", "component", F.explode("shingles").alias("shingle"))
    spread = held.groupBy("shingle").agg(F.count("*").alias("c"))
    ranked = held.join(spread, "shingle").groupBy("rep", "n", "component").agg(F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("order"))
    prefix = F.slice("order", 1, (F.col("n") - F.floor((F.col("n") * LEAST + 99) / 100) + 1).cast("int"))
    rows = ranked.select("rep", "n", "component", F.posexplode(prefix).alias("pos", "t")).filter("t.c > 1")
    rows = rows.select("rep", "n", "component", "pos", F.col("t.shingle").alias("shingle"))
    x, y = rows.alias("x"), rows.alias("y")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    near = most * (100 + LEAST) >= (F.col("x.n") + F.col("y.n")) * LEAST
    return x.join(y, apart & near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id in reach) and kept (whether it is its own) of every row of ``docs``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = settled(docs.select("doc_id", "text").mapInArrow(_signatures, f"doc_id {id_type}, n long, k1 long, k2 long, bands array<long>"))
    key = ["n", "k1", "k2"]
    known = signed.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = settled(gathered(known)).withColumn("rep", F.monotonically_increasing_id())  # a number of its own for each class, fixed by the written rows

    members = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    crowds = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    crowded = settled(gathered(members.join(crowds, "bucket")))
    wanted = classes.join(crowded.select("rep").distinct(), "rep", "left_semi").select(*key, "rep", "least")
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "n long, k1 long, k2 long, shingles array<long>").join(wanted.select(*key, "rep"), key)
    sets = settled(gathered(sets.select("rep", "shingles").dropDuplicates(["rep"])))

    # leaders: a bucket's member with the most company over all its buckets, and its smallest
    company = crowded.groupBy("rep").agg(F.sum("size").alias("company"))
    leaders = crowded.join(company, "rep").groupBy("bucket").agg(F.min("rep").alias("l1"), F.min_by("rep", F.struct(-F.col("company"), "rep")).alias("l2"))
    led = crowded.join(leaders, "bucket").select("rep", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("leader")).filter("rep <> leader")
    pairs = settled(gathered(led.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()))
    links = settled(gathered(_confirmed(pairs, sets)))
    joined = components(links)

    # what the leaders left: members of one bucket that are not connected yet
    placed = crowded.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "bucket", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    across = settled(gathered(_across(_mixed(placed), sets).join(pairs, ["a", "b"], "left_anti")))
    if not across.isEmpty():
        more = settled(gathered(_confirmed(across, sets)))
        if not more.isEmpty():
            joined = components(links.union(more))

    joined = joined.select(F.col("node").alias("rep"), "component")
    about = classes.select(*key, "rep", "least", "copies").join(joined, "rep", "left").filter("copies > 1 or component is not null")
    about = settled(gathered(about))
    lows = about.filter("component is not null").groupBy("component").agg(F.min("least").alias("low"))
    about = about.join(lows, "component", "left").select(*key, F.coalesce("low", "least").alias("low"))
    found = signed.select("doc_id", *key).join(about, key, "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull() | F.col("low").isNull()
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
