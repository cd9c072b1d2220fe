"""Near-duplicate vectors by sorted projection passes, and exact counts within the groups they find.

Each pass draws its own random hyperplanes; the sides a vector lies on make a
string of bits, and sorting by label and bits brings similar vectors close
together, ties in an order of the pass's own. Every vector is compared with the
next WINDOW vectors of the order, on rounded copies (half precision, NEAR allows for
the rounding). The order is cut into pieces of PIECE rows by its row numbers, each
piece together with the next WINDOW rows, so no neighbours are lost at an edge and a
hot label spreads over many tasks. A piece gives each vector one partner at most, the
smallest it reaches, and the passes' partners are united to groups.

A window sees a bounded number of neighbours, so links are not counted there. The
vectors of a group meet once more in double precision, a large group in cells of
two blocks of about BLOCK rows; a cell gives each vector's number of links and the
smallest vector they lead to, never pairs. So within a group every link is found,
however dense it is; a link is missed only if no chain of neighbours in any pass
joins its ends. Comparing a group is quadratic in its size, spread over its cells.

Equal vectors of a label collapse before all that, so a vector repeated very often is
one row. Vectors are compared only if their labels are equal and not null and they
have equally many components. A vector that is null, empty or zero, or holds null or
non-finite components, is linked with nothing, as is one without a label or id. Every row
gives one row: rows of equal id are vectors of their own, each with the links of its
vector. A null id keeps a null component. An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import components
from cairn.llm.tables import settled

LEAST = 0.93
#: Least cosine of rounded copies: half precision moves a cosine by less than 0.0015.
NEAR = LEAST - 0.0015
PASSES = 24
BITS = 48
WINDOW = 96
PIECE = 1024
#: Vectors of a block, about; a cell holds at most two blocks.
BLOCK = 2048
#: Rows of a block multiplied at a time.
STEP = 256


# ---------------------------------------------------------------- passes


def _planes(turn: int, size: int) -> np.ndarray:
    return np.random.default_rng([turn, size]).standard_normal((size, BITS))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector and pass, with its string of bits as a number of the same order and its rounded unit vector."""
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        lists = batch.column("vector")
        flat, ends = lists.values.to_numpy().astype(np.float64), lists.offsets.to_numpy()
        sizes = np.diff(ends)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            matrix = flat[ends[rows][:, None] + np.arange(size)]
            unit = (matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))).astype("<f2")
            own = batch.take(pa.array(rows))
            rounded = pa.array([x.tobytes() for x in unit], pa.binary())
            for turn in range(PASSES):
                keys = ((matrix @ _planes(turn, int(size)) > 0) * weights).sum(axis=1)
                columns = [pa.array(np.full(len(rows), turn, np.int32)), own.column("label"), pa.array(np.full(len(rows), size, np.int32)), pa.array(keys), own.column("cid"), rounded]
                yield pa.RecordBatch.from_arrays(columns, ["turn", "label", "size", "key", "cid", "rounded"])


def _reached(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and column of a matrix of links, the smallest number that links lead to; each row is visited once."""
    low_left, low_right = left.copy(), right.copy()
    open_left = linked.any(axis=1)
    new_right = np.ones(linked.shape[1], bool)
    for start in np.flatnonzero(open_left):
        if not open_left[start]:
            continue
        rows, columns, front = [], [], np.array([start])
        while len(front):
            open_left[front] = False
            rows.append(front)
            met = np.flatnonzero(linked[front].any(axis=0) & new_right)
            new_right[met] = False
            columns.append(met)
            front = np.flatnonzero(linked[:, met].any(axis=1) & open_left)
        x, y = np.concatenate(rows), np.concatenate(columns)
        low_left[x] = low_right[y] = min(left[x].min(), right[y].min())
    return low_left, low_right


def _neighbours(table: pa.Table) -> pa.Table:
    """Of each vector of a piece, the smallest one that links within windows lead to, where there is one."""
    table = table.take(pc.sort_indices(table, [("at", "ascending")])).combine_chunks()
    turn, size, ids = (table.column(c).to_numpy() for c in ("turn", "size", "cid"))
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    rounded = table.column("rounded").to_pylist()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    groups = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (size[1:] != size[:-1]) | (label[1:] != label[:-1])]))
    for lo, hi in zip(groups, np.append(groups[1:], len(ids)), strict=True):
        unit = np.frombuffer(b"".join(rounded[lo:hi]), "<f2").astype(np.float32).reshape(hi - lo, -1)
        for i in range(0, hi - lo, WINDOW):
            left, right = unit[i : i + WINDOW], unit[i : i + 2 * WINDOW]
            apart = np.arange(len(right)) - np.arange(len(left))[:, None]
            linked = (left @ right.T >= NEAR) & (np.abs(apart) <= WINDOW) & (apart != 0)
            if not linked.any():
                continue
            own, other = ids[lo + i : lo + i + len(left)], ids[lo + i : lo + i + len(right)]
            for node, low in zip((own, other), _reached(linked, own, other), strict=True):
                found.append((node[node != low], low[node != low]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    pairs = np.unique(np.stack([a, b]), axis=1)
    return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


def partners(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of cid that join all rows (cid, label, vector) which some pass brought together and which look similar."""
    spark = classes.sparkSession
    label = classes.schema["label"].dataType.simpleString()
    keyed = classes.select("cid", "label", "vector").mapInArrow(_keys, f"turn int, label {label}, size int, key long, cid long, rounded binary")
    order = ["turn", "label", "size", "key", F.xxhash64("turn", "cid")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = settled(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = sorted_.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("part").count().orderBy("part").collect()  # one row for each partition
    starts, total = [], 0
    for row in counts:
        starts.append((row["part"], total))
        total += row["count"]
    offsets = spark.createDataFrame(starts or [(0, 0)], "part int, start long")
    placed = placed.join(F.broadcast(offsets), "part").withColumn("at", F.col("start") + F.col("row"))
    home = F.floor(F.col("at") / PIECE)
    both = F.when(F.col("at") % PIECE < WINDOW, F.array(home, home - 1)).otherwise(F.array(home))
    dealt = placed.select("at", "turn", "label", "size", "cid", "rounded", F.explode(both).alias("piece"))
    return dealt.filter("piece >= 0").groupBy("piece").applyInArrow(_neighbours, "a long, b long").distinct()


# ---------------------------------------------------------------- exact links of a group


def _unit(side: pa.Table) -> np.ndarray:
    lists = side.column("vector").combine_chunks()
    flat = lists.flatten().to_numpy().astype(np.float64).reshape(side.num_rows, -1)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _compare(table: pa.Table) -> pa.Table:
    """Of each vector of a cell that has links there: how many, and the smallest vector they lead to."""
    own = table.column("block").to_numpy() == table.column("i").to_numpy()
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    left, right = table.filter(pa.array(own)), table.filter(pa.array(own if same else ~own))
    ids, copies = ([side.column(c).to_numpy() for side in (left, right)] for c in ("cid", "copies"))
    x, y = _unit(left), _unit(right)
    linked = np.zeros((len(x), len(y)), bool)
    for i in range(0, len(x), STEP):
        linked[i : i + STEP] = x[i : i + STEP] @ y.T >= LEAST
    if same:
        np.fill_diagonal(linked, False)
    n_left = np.concatenate([np.zeros(0, np.int64), *(linked[i : i + STEP].astype(np.float64) @ copies[1] for i in range(0, len(x), STEP))]).astype(np.int64)
    n_right = np.zeros(len(y))
    for i in range(0, len(x), STEP):
        n_right += copies[0][i : i + STEP] @ linked[i : i + STEP].astype(np.float64)
    if same:
        np.fill_diagonal(linked, linked.any(axis=1))
    low_left, low_right = _reached(linked, *ids)
    columns = [(ids[0], n_left, low_left)] + ([] if same else [(ids[1], n_right.astype(np.int64), low_right)])
    cid, n, low = (np.concatenate(c) for c in zip(*columns, strict=True))
    return pa.table({"cid": cid[n > 0], "linked": n[n > 0], "low": low[n > 0]})


def links(grouped: DataFrame) -> DataFrame:
    """cid, linked, low of the rows (cid, group, vector, copies): by cell, how many rows are linked with ``cid`` and the smallest reached."""
    large = grouped.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")  # one row for BLOCK rows at most
    dealt = grouped.join(large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("cid", "group", "vector", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return cells.groupBy("group", "i", "j").applyInArrow(_compare, "cid long, linked long, low long")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (vec_id, label, embedding)."""
    vector = F.col("embedding").cast("array<float>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    keyed = rows.select("vec_id", "label", vector.alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"))
    keyed = keyed.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64("vector", F.lit(1)))
    key = ["label", "h1", "h2"]
    made = keyed.filter("usable").groupBy(*key).agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = settled(made).withColumn("cid", F.monotonically_increasing_id())  # a number of its own for each class, fixed by the written rows

    groups = components(partners(classes)).select(F.col("node").alias("cid"), F.col("component").alias("group"))
    found = settled(links(classes.select("cid", "vector", "copies").join(groups, "cid")))
    joined = components(found.select(F.col("cid").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("cid"), "component")
    counts = found.groupBy("cid").agg(F.sum("linked").alias("linked"))

    about = classes.select(*key, "cid", "least", "copies").join(counts, "cid", "left").join(joined, "cid", "left")
    lows = about.filter("component is not null").groupBy("component").agg(F.min("least").alias("low"))
    about = about.join(lows, "component", "left").filter("copies > 1 or linked is not null")
    about = about.select(*key, F.coalesce("low", "least").alias("low"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("linked"))
    out = keyed.select("vec_id", "usable", *key).join(about, key, "left")
    alone = ~F.col("usable") | F.col("low").isNull()
    out = out.select(
        "vec_id",
        F.when(alone, 0).otherwise(F.col("linked")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("low")).cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
