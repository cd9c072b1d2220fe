"""Moving what lies in wrapper directories one level up: checks of the wrappers, every conflict, and the order of the moves.

Tables stand for the file system. ``entries`` is what is there now (path, kind: file, directory, symlink or other, device,
inode, mtime_ns, size). ``items`` are the planned moves with what was seen when they were planned (source, target, wrapper,
is_dir, device, inode, mtime_ns, size).

A move can be made if nothing speaks against it and if all others that must leave its place first can be made: the
one whose source is its target, and all whose sources lie below its target. That is a fixpoint, found from the blocked moves outwards;
each round only follows what the last one blocked. Among the moves that are left, one that makes a directory comes before those into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.paths import basename, parent
from cairn.lineage import settled
from cairn.operators.numbering import numbered
from cairn.operators.ordering import levels


def folded(name: Column) -> Column:
    """A name without case; upper case first, so that letters with longer capitals fold as these do."""
    return F.lower(F.concat(F.upper(name), F.lit("")))  # lower(upper(x)) itself would be simplified to lower(x)


def _below(path: Column, directory: str) -> Column:
    return path.startswith(directory.rstrip("/") + "/")


def _above(path: Column) -> Column:
    """All directories strictly above an absolute path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _root_of(path: Column, roots: list[str]) -> Column:
    return F.coalesce(*(F.when(_below(path, r) | (path == r), r) for r in roots), F.lit(None).cast("string"))


def preflight(wrappers: DataFrame, entries: DataFrame, roots: list[str], reserved: str) -> DataFrame:
    """``wrappers`` (path) with ``problem``, the first that stands against flattening it, or null.

    In this order: INVALID_CONFIG (not absolute), SCOPE_NOT_FOUND, SYMLINK_BLOCKED, INVALID_CONFIG (no directory),
    CROSS_ROOT (reserved or outside the roots), INVALID_CONFIG (a root itself), SCOPE_OVERLAP (the same directory twice, by name or
    identity, or one wrapper inside another).
    """
    here = entries.select("path", "kind", "device", "inode")
    seen = wrappers.select(F.regexp_replace("path", "(?<=.)/+$", "").alias("path")).groupBy("path").agg(F.count("*").alias("named"))
    seen = seen.join(here, "path", "left")
    seen = seen.withColumn("alike", F.when(F.col("inode").isNotNull(), F.count("*").over(Window.partitionBy("device", "inode"))).otherwise(1))
    names = seen.select("path")
    inner = seen.select(F.col("path").alias("inside"), F.explode(_above(F.col("path"))).alias("path")).join(names, "path", "left_semi")
    nested = inner.select("path").union(inner.select("inside")).distinct().withColumn("nested", F.lit(True))
    seen = seen.join(nested, "path", "left")
    problem = (
        F.when(~F.col("path").startswith("/"), "INVALID_CONFIG")
        .when(F.col("kind").isNull(), "SCOPE_NOT_FOUND")
        .when(F.col("kind") == "symlink", "SYMLINK_BLOCKED")
        .when(F.col("kind") != "directory", "INVALID_CONFIG")
        .when(_below(F.col("path"), reserved) | (F.col("path") == reserved) | _root_of(F.col("path"), roots).isNull(), "CROSS_ROOT")
        .when(F.col("path").isin(roots), "INVALID_CONFIG")
        .when((F.col("named") > 1) | (F.col("alike") > 1) | F.coalesce("nested", F.lit(False)), "SCOPE_OVERLAP")
    )
    return seen.select("path", problem.alias("problem"))


def _source_problem(roots: list[str], reserved: str) -> Column:
    own = F.col("is_dir") & (F.col("kind") == "directory") | ~F.col("is_dir") & (F.col("kind") == "file")
    observed = (F.col("device") != 0) | (F.col("inode") != 0) | (F.col("mtime_ns") != 0)
    changed = (F.col("now_device") != F.col("device")) | (F.col("now_inode") != F.col("inode")) | (F.col("now_mtime_ns") != F.col("mtime_ns"))
    changed = changed | ((F.col("kind") == "file") & (F.col("now_size") != F.col("size")))
    return (
        F.when(F.coalesce("wrapper_gone", F.lit(False)), "WRAPPER_IDENTITY_CHANGED")
        .when(F.col("kind").isNull(), "SOURCE_MISSING")
        .when(F.col("kind") == "symlink", "WRAPPER_CHILD_SYMLINK")
        .when(~F.col("kind").isin("file", "directory"), "UNSUPPORTED_OBJECT")
        .when(~own, "SOURCE_TYPE_CHANGED")
        .when(observed & changed, "SOURCE_IDENTITY_CHANGED")
        .when(_below(F.col("source"), reserved) | _root_of(F.col("source"), roots).isNull(), "TARGET_OUTSIDE_ALLOWED_ROOT")
        .when(F.coalesce("wrapper_touched", F.lit(False)), "WRAPPER_IDENTITY_CHANGED")
    )


def resolve(items: DataFrame, entries: DataFrame, wrappers: DataFrame, roots: list[str], reserved: str) -> DataFrame:
    """source, target, conflicts (sorted, distinct; empty if the move can be made), level and sequence (from 1; null if it cannot).

    ``wrappers`` (path, device, inode, mtime_ns) is what was seen of each wrapper. Every problem of a source excludes all
    checks of its target. Equal sources block one another; of equal rows both do.
    """
    now = entries.select(F.col("path").alias("source"), "kind", *(F.col(c).alias(f"now_{c}") for c in ("device", "inode", "mtime_ns", "size")))
    at = entries.select("path", F.col("kind").alias("k"), F.col("device").alias("d"), F.col("inode").alias("i"), F.col("mtime_ns").alias("m"))
    gone = (F.col("k").isNull() | (F.col("k") != "directory") | (F.col("d") != F.col("device")) | (F.col("i") != F.col("inode"))).alias("wrapper_gone")
    states = wrappers.join(at, "path", "left").select(F.col("path").alias("wrapper"), gone, (F.col("m") != F.col("mtime_ns")).alias("wrapper_touched"))
    seen = items.join(now, "source", "left").join(states, "wrapper", "left").withColumn("problem", _source_problem(roots, reserved))
    twice = F.count_if(F.col("problem").isNull()).over(Window.partitionBy("source")) > 1
    seen = settled(seen.withColumn("problem", F.coalesce("problem", F.when(twice, "PLANNED_TARGET_COLLISION"))).select("source", "target", "problem"))

    # targets of sound sources
    sound = seen.filter("problem IS NULL").select("source", "target")
    held = entries.select(F.col("path").alias("target"), F.col("kind").alias("held"))
    name, home = basename(F.col("target")), parent(F.col("target"))
    first = (
        F.when(F.col("held") == "symlink", "TARGET_SYMLINK")
        .when(_below(F.col("target"), reserved) | (F.col("target") == reserved), "RESERVED_TARGET")
        .when(_root_of(F.col("target"), roots).isNull(), "TARGET_OUTSIDE_ALLOWED_ROOT")
        .when(F.octet_length(name) > 255, "NAME_TOO_LONG")
        .when(~_root_of(F.col("target"), roots).eqNullSafe(_root_of(F.col("source"), roots)), "TARGET_OUTSIDE_ALLOWED_ROOT")
    )
    spots = entries.select(parent(F.col("path")).alias("home"), folded(basename(F.col("path"))).alias("fold"), basename(F.col("path")).alias("there"))
    checked = sound.join(held, "target", "left").withColumn("home", home).withColumn("fold", folded(name))
    spelled = spots.join(checked.select("home", "fold").distinct(), ["home", "fold"], "left_semi").groupBy("home", "fold").agg(F.min("there").alias("low"), F.max("there").alias("high"))
    folds = Window.partitionBy("home", "fold")
    checked = checked.join(spelled, ["home", "fold"], "left").withColumn("wanted", F.count("*").over(Window.partitionBy("target")))
    checked = checked.withColumn("spellings", F.min("target").over(folds) != F.max("target").over(folds))
    other = F.coalesce((F.col("low") != name) | (F.col("high") != name), F.lit(False))
    leaving = sound.select(F.col("source").alias("target"), F.lit(True).alias("leaves")).distinct()
    checked = checked.join(leaving, "target", "left")
    stays = F.col("held").isNotNull() & F.col("leaves").isNull()
    found = F.array_compact(F.array(first, F.when(F.col("wanted") > 1, "PLANNED_TARGET_COLLISION"), F.when(F.col("spellings") | other, "CASE_ONLY_COLLISION"), F.when(stays & ~F.coalesce(F.col("held") == "symlink", F.lit(False)) & first.isNull() & (F.col("wanted") == 1) & ~F.col("spellings") & ~other, "TARGET_EXISTS")))
    checked = settled(checked.select("source", "target", "held", found.alias("conflicts")))

    # who must leave first, and what a blocked one blocks
    into = checked.select(F.col("source").alias("after"), F.col("target").alias("place"), "held")
    direct = into.filter("held IS NOT NULL").join(checked.select(F.col("source").alias("before"), F.col("source").alias("place")), "place").select("before", "after")
    inside = checked.select(F.col("source").alias("before"), F.explode(_above(F.col("source"))).alias("place")).join(into.select("after", "place"), "place").select("before", "after")
    waits = settled(direct.union(inside).distinct())
    bad = checked.filter(F.size("conflicts") > 0).select("source")
    reached = settled(bad)
    edge = reached
    late = None
    while True:
        more = waits.join(edge.select(F.col("source").alias("before")), "before", "left_semi").select(F.col("after").alias("source")).distinct()
        edge = settled(more.join(reached, "source", "left_anti"))
        if edge.isEmpty():
            break
        late = edge if late is None else late.union(edge)
        reached = settled(reached.union(edge))
    free = settled(checked.join(reached, "source", "left_anti").select("source", "target"))
    makes = free.select(F.col("source").alias("before"), F.col("target").alias("place"))
    nested = free.select(F.col("source").alias("after"), F.explode(_above(F.col("target"))).alias("place")).join(makes, "place").select("before", "after")
    mine = free.select(F.col("source").alias("after"))
    among = waits.filter("before <> after").join(mine, "after", "left_semi").unionByName(nested.filter("before <> after")).distinct()
    placed = levels(free.select(F.col("source").alias("node"), F.lit(1).alias("level")), among.withColumn("weight", F.lit(1).cast("long")))
    ordered = settled(free.join(placed.withColumnRenamed("node", "source"), "source", "left"))
    run = numbered(ordered.filter("level IS NOT NULL"), [F.col("level"), F.col("source")], "place").select("source", "target", F.array().cast("array<string>").alias("conflicts"), "level", (F.col("place") + 1).alias("sequence"))

    none = [F.lit(None).cast("long").alias(c) for c in ("level", "sequence")]
    rounds = ordered.filter("level IS NULL").select("source", "target", F.array(F.lit("RENAME_CYCLE")).alias("conflicts"), *none)
    blocked = checked.join(bad, "source", "left_semi").select("source", "target", F.array_sort(F.array_distinct("conflicts")).alias("conflicts"), *none)
    unsound = seen.filter("problem IS NOT NULL").select("source", "target", F.array("problem").alias("conflicts"), *none)
    out = run.unionByName(rounds).unionByName(blocked).unionByName(unsound)
    if late is None:
        return out
    behind = checked.join(late, "source", "left_semi").select("source", "target", F.array(F.lit("TARGET_EXISTS")).alias("conflicts"), *none)
    return out.unionByName(behind)
