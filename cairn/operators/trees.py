"""Directory trees kept as path tables: roll-ups, empty directories, wrappers, virtual moves, rename order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.media import media_type
from cairn.functions.paths import ancestors, natural_key, parent, under
from cairn.lineage import settled


def direct_stats(files: DataFrame) -> DataFrame:
    """Files, images, videos and bytes directly in each directory."""
    kind = media_type(F.col("suffix"))
    return files.groupBy("root_key", parent(F.col("relative_path")).alias("directory")).agg(*_counts(kind))


def rollup(files: DataFrame) -> DataFrame:
    """The same for everything below each directory: one partial aggregate over exploded ancestors."""
    kind = media_type(F.col("suffix"))
    spread = files.select("root_key", F.explode(ancestors(F.col("relative_path"))).alias("directory"), "size", kind.alias("kind"))
    return spread.groupBy("root_key", "directory").agg(*_counts(F.col("kind")))


def _counts(kind: Column) -> list[Column]:
    return [
        F.count("*").alias("files"),
        F.count_if(kind == "image").alias("images"),
        F.count_if(kind == "video").alias("videos"),
        F.sum("size").alias("total_bytes"),
    ]


def directories(files: DataFrame) -> DataFrame:
    """All directories that the files imply, with the number of their subdirectories."""
    every = files.select("root_key", F.explode(ancestors(F.col("relative_path"))).alias("directory")).distinct()
    below = every.filter("directory <> ''").groupBy("root_key", parent(F.col("directory")).alias("directory")).agg(F.count("*").alias("folders"))
    return every.join(below, ["root_key", "directory"], "left").withColumn("folders", F.coalesce("folders", F.lit(0)))


def empty_directories(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed directories with no file below, deepest first by ``removal_order`` within the root."""
    full = files.select("root_key", F.explode(ancestors(F.col("relative_path"))).alias("directory")).distinct()
    empty = listed.join(full, ["root_key", "directory"], "left_anti")
    order = Window.partitionBy("root_key").orderBy(F.size(F.split("directory", "/")).desc(), "directory")
    return empty.withColumn("removal_order", F.row_number().over(order))


def single_child_wrappers(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Directories whose only entry is one directory, with where that child would move and whether the place is taken."""
    inner = listed.filter("directory <> ''").select("root_key", parent(F.col("directory")).alias("directory"), F.col("directory").alias("child"), F.lit(True).alias("is_dir"))
    leaves = files.select("root_key", parent(F.col("relative_path")).alias("directory"), F.col("relative_path").alias("child"), F.lit(False).alias("is_dir"))
    entries = inner.unionByName(leaves)
    single = entries.groupBy("root_key", "directory").agg(F.count("*").alias("entries"), F.max("is_dir").alias("is_dir"), F.max("child").alias("child"))
    single = single.filter("entries = 1 and is_dir and directory <> ''")
    up = parent(F.col("directory"))
    target = F.concat(up, F.when(up == "", "").otherwise("/"), F.substring_index("child", "/", -1))
    moved = single.select("root_key", "directory", "child", target.alias("target"))
    taken = entries.select("root_key", F.col("child").alias("target")).distinct().withColumn("taken", F.lit(True))
    state = F.when(F.col("target") == F.col("directory"), "same_name").when(F.col("taken"), "target_exists").otherwise("movable")
    return moved.join(taken, ["root_key", "target"], "left").select("root_key", "directory", "child", "target", state.alias("state"))


def flatten_one_level(files: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Where files directly in a wrapper (root_key, wrapper) would go, and whether another file wants or holds the place."""
    own = files.withColumn("wrapper", parent(F.col("relative_path"))).join(wrappers, ["root_key", "wrapper"])
    up = parent(F.col("wrapper"))
    moved = own.withColumn("target", F.concat(up, F.when(up == "", "").otherwise("/"), "basename"))
    held = files.select("root_key", F.col("relative_path").alias("target"), F.lit(True).alias("held"))
    wanted = F.count("*").over(Window.partitionBy("root_key", "target"))
    state = F.when(wanted > 1, "PLANNED_TARGET_COLLISION").when(F.col("held"), "TARGET_EXISTS").otherwise("ACTIONABLE")
    return moved.join(held, ["root_key", "target"], "left").select("id", "root_key", "relative_path", "target", state.alias("state"))


def final_paths(paths: DataFrame, renames: DataFrame) -> DataFrame:
    """``final`` of every path after its directories and itself got new names (path, new_name)."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = paths.select("path", F.posexplode(prefixes).alias("place", "prefix")).join(renames.withColumnRenamed("path", "prefix"), "prefix", "left")
    name = F.coalesce("new_name", F.substring_index("prefix", "/", -1))
    pieces = F.array_sort(F.collect_list(F.struct("place", name.alias("name"))))
    return spread.groupBy("path").agg(F.array_join(F.transform(pieces, lambda p: p["name"]), "/").alias("final"))


def rename_order(items: DataFrame) -> DataFrame:
    """``level`` (1 for a rename that can go first) and ``cyclic`` of renames (source, target).

    A rename waits for the one whose source is its target, so every item has one successor at most: pointers are
    doubled each round, so a chain of n takes log n rounds. A round that ends no chain leaves only items that are on a
    cycle or wait for one; their level is null.
    """
    first = items.select("source", "target", F.lit(1).cast("long").alias("level"), F.col("target").alias("next"))
    sources = items.select(F.col("source").alias("next"), F.lit(True).alias("on"))
    steps, before = settled(first), -1
    while (still := steps.join(sources, "next", "left_semi").count()) not in (0, before):
        before = still
        ahead = steps.select(F.col("source").alias("next"), F.col("level").alias("more"), F.col("next").alias("beyond"))
        grown = steps.join(ahead, "next", "left")
        level = F.col("level") + F.coalesce("more", F.lit(0))
        steps = settled(grown.select("source", "target", level.alias("level"), F.coalesce("beyond", "next").alias("next")))
    ended = steps.join(sources, "next", "left")
    return ended.select("source", "target", F.when(F.col("on"), None).otherwise(F.col("level")).alias("level"), F.coalesce("on", F.lit(False)).alias("cyclic"))


def conflicts(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Every problem of planned renames (source, target), one row each: source, conflict.

    ``existing`` lists all paths (path). A target is free if nothing holds it or what holds it is itself renamed away
    without a problem; that last condition is a fixpoint, found by pushing blocks along the chain of occupants.
    """
    target_dir, target_name = parent(F.col("target")), F.substring_index("target", "/", -1)
    per_target = Window.partitionBy("target")
    per_fold = Window.partitionBy(target_dir, F.lower(target_name))
    marked = (
        items.withColumn("wanted", F.count("*").over(per_target))
        .withColumn("spellings", F.size(F.collect_set("target").over(per_fold)))
        .join(existing.select(F.col("path").alias("target"), F.lit(True).alias("held")), "target", "left")
        .join(items.select(F.col("source").alias("target"), F.lit(True).alias("leaves")), "target", "left")
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("wanted") > 1, F.lit("PLANNED_TARGET_COLLISION")),
            F.when(F.col("spellings") > 1, F.lit("CASE_ONLY_COLLISION")),
            F.when(F.col("held") & F.col("leaves").isNull(), F.lit("TARGET_OCCUPIED")),
            F.when(F.octet_length(target_name) > 255, F.lit("NAME_TOO_LONG")),
        )
    )
    return marked.select("source", "target", F.explode(found).alias("conflict"))


def blocked(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Conflicts with the renames that wait for a blocked one added as BLOCKED_OCCUPANT.

    Pointers along the chain of occupants are doubled each round, so a chain of n takes log n rounds; a round that
    finds no further blocked rename is the last.
    """
    bad = settled(conflicts(items, existing))
    marked = bad.select("source", F.lit(True).alias("bad")).distinct()
    steps = items.select("source", F.col("target").alias("next")).join(marked, "source", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    steps, before = settled(steps), -1
    while (stuck := steps.filter("bad").count()) not in (0, before):
        before = stuck
        ahead = steps.select(F.col("source").alias("next"), F.col("next").alias("beyond"), F.col("bad").alias("bad_ahead"))
        grown = steps.join(ahead, "next", "left")
        steps = settled(grown.select("source", F.coalesce("beyond", "next").alias("next"), (F.col("bad") | F.coalesce("bad_ahead", F.lit(False))).alias("bad")))
    waits = steps.filter("bad").select("source").join(marked, "source", "left_anti").join(items, "source")
    return bad.unionByName(waits.select("source", "target", F.lit("BLOCKED_OCCUPANT").alias("conflict")))


def primary(conflict_rows: DataFrame, priority: list[str]) -> DataFrame:
    """Each source's most important conflict."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("conflict"))
    ordered = Window.partitionBy("source").orderBy(rank, "conflict", "target")
    return conflict_rows.withColumn("rn", F.row_number().over(ordered)).filter("rn = 1").drop("rn")


def browsed(entries: DataFrame, skip: int, size: int) -> DataFrame:
    """A page of a directory's entries (type_rank, name), directories first, names in natural order."""
    return entries.orderBy("type_rank", natural_key(F.col("name")), "name").offset(skip).limit(max(1, min(size, 500)))


def stats_below(files: DataFrame, directory: str) -> DataFrame:
    """files, images, videos, folders and bytes below one directory."""
    held = files.filter(under(F.col("relative_path"), directory)).withColumn("kind", media_type(F.col("suffix")))
    folder = F.when(parent(F.col("relative_path")) != directory, parent(F.col("relative_path")))
    return held.agg(
        F.count("*").alias("files"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"),
        F.countDistinct(folder).alias("folders"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
    )


def origins(items: DataFrame) -> DataFrame:
    """``origin`` and ``hops`` of each chained move (source, target): where a file was before all moves that led to its source.

    Pointers to the move before are doubled each round; what moves in a circle has no origin.
    """
    before = items.select(F.col("target").alias("source"), F.col("source").alias("origin"), F.lit(1).cast("long").alias("hops"))
    first = items.select("source", "target").join(before, "source", "left").select("source", "target", F.coalesce("origin", "source").alias("origin"), F.coalesce("hops", F.lit(0)).alias("hops"))
    ends = items.select(F.col("target").alias("origin"), F.lit(True).alias("on"))
    steps, last = settled(first), -1
    while (still := steps.join(ends, "origin", "left_semi").count()) not in (0, last):
        last = still
        ahead = steps.select(F.col("source").alias("origin"), F.col("origin").alias("further"), F.col("hops").alias("more"))
        grown = steps.join(ahead, "origin", "left")
        steps = settled(grown.select("source", "target", F.coalesce("further", "origin").alias("origin"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    done = steps.join(ends, "origin", "left")
    return done.select("source", "target", F.when(F.col("on").isNull(), F.col("origin")).alias("origin"), F.when(F.col("on").isNull(), F.col("hops")).alias("hops"))


def colliding(proposals: DataFrame) -> DataFrame:
    """``proposals`` (target) with ``collides``: whether another one has the same directory and case-folded name."""
    same = Window.partitionBy(parent(F.col("target")), F.lower(F.substring_index("target", "/", -1)))
    return proposals.withColumn("collides", F.count("*").over(same) > 1)


def package_paths(directories: DataFrame) -> DataFrame:
    """``directories`` (path) with ``valid``: YYMM/YYMMDD/author/package, the day within the month."""
    parts = F.split("path", "/")
    month, day = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    shape = (F.size(parts) == 4) & month.rlike(r"^\d{2}(0[1-9]|1[0-2])$") & day.rlike(r"^\d{4}(0[1-9]|[12]\d|3[01])$") & day.startswith(month)
    plain = ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    return directories.withColumn("valid", F.coalesce(shape & plain, F.lit(False)))
