"""Which copy of a duplicate group stays, and why.

Policies and weighted scores are windows over a group. Where a choice depends on what earlier groups released
(balancing, protecting a directory's last file), ``dedupe_run`` takes the groups in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.paths import ancestors, glob_regex, suffix
from cairn.operators import dedupe_run

GROUP = ["content_hash", "size"]


def root_rank(root: Column, order: list[str]) -> Column:
    """The place of a root in the order; unknown roots after all known ones."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), root), F.lit(0)) - 1, F.lit(len(order)))


def pattern_rank(value: Column, patterns: list[str]) -> Column:
    """The index of the first pattern that matches; a large number where none does."""
    out = F.lit(len(patterns) + 10**6 if patterns else 10**9)
    for i, pattern in reversed(list(enumerate(patterns))):
        out = F.when(value.rlike(glob_regex(pattern)), i).otherwise(out)
    return out


def preference(policy: str, order: list[str], patterns: list[str] | None = None) -> list[Column]:
    """Sort keys of a policy; the first file by them is kept."""
    rank, path = root_rank(F.col("root_key"), order), F.col("absolute_path")
    if policy == "keep-first-root":
        return [rank, path]
    if policy == "keep-newest":
        return [F.col("mtime_ns").desc(), rank, path]
    if policy == "keep-oldest":
        return [F.col("mtime_ns"), rank, path]
    if policy == "path-priority":
        return [pattern_rank(path, patterns or []), rank, path]
    if policy == "relative-path-preference":
        return [pattern_rank(F.col("relative_path"), patterns or []), rank, path]
    raise ValueError(f"unknown policy: {policy}")


def decide(members: DataFrame, policy: str, order: list[str], patterns: list[str] | None = None) -> DataFrame:
    """``members`` of groups of two or more with ``kept``."""
    group = Window.partitionBy(*GROUP)
    ranked = members.withColumn("members", F.count("*").over(group))
    ranked = ranked.withColumn("rn", F.row_number().over(group.orderBy(*preference(policy, order, patterns))))
    return ranked.filter("members >= 2").withColumn("kept", F.col("rn") == 1).drop("rn")


def scored(members: DataFrame, rules: list[str], rule_weight: int, extensions: list[str], extension_weight: int, mtime: str, mtime_weight: int) -> DataFrame:
    """``members`` with the three contributions, ``score``, ``kept`` and ``selection``.

    The first path rule and the first extension that any eligible member has are the group's; ties at the newest or
    oldest time all score; files that may not be kept score nothing and are never kept.
    """
    group = Window.partitionBy(*GROUP)
    able = F.col("eligible")
    out = members.withColumn("members", F.count("*").over(group)).filter("members >= 2")
    hit = [F.col("relative_path").rlike(glob_regex(r)) for r in rules]
    rule_of = lambda i: F.when(able & hit[i], i)
    first_rule = F.coalesce(*(rule_of(i) for i in range(len(rules)))) if rules else F.lit(None).cast("int")
    out = out.withColumn("active_rule", F.min(first_rule).over(group))
    path_points = F.lit(0)
    for i in range(len(rules)):
        path_points = F.when(able & (F.col("active_rule") == i) & hit[i], rule_weight).otherwise(path_points)
    ext = F.lower(suffix(F.col("basename")))
    place = F.nullif(F.array_position(F.array(*map(F.lit, extensions)), ext), F.lit(0)) if extensions else F.lit(None).cast("long")
    out = out.withColumn("active_ext", F.min(F.when(able, place)).over(group))
    ext_points = F.when(able & (place == F.col("active_ext")), extension_weight).otherwise(0)
    edge = {"newest": F.max, "oldest": F.min}.get(mtime)
    time_points = F.when(able & (F.col("mtime_ns") == edge(F.when(able, F.col("mtime_ns"))).over(group)), mtime_weight).otherwise(0) if edge else F.lit(0)
    out = out.withColumn("path_points", path_points).withColumn("extension_points", ext_points).withColumn("mtime_points", time_points)
    out = out.withColumn("score", F.col("path_points") + F.col("extension_points") + F.col("mtime_points"))
    best = F.max(F.when(able, F.col("score"))).over(group)
    out = out.withColumn("top", able & (F.col("score") == best)).withColumn("tops", F.sum(F.col("top").cast("int")).over(group))
    out = out.withColumn("able_members", F.sum(able.cast("int")).over(group))
    rank = F.row_number().over(group.orderBy(F.col("top").desc(), "absolute_path"))
    out = out.withColumn("kept", (rank == 1) & F.col("top"))
    reason = F.when(F.col("able_members") == 1, "sole_eligible").when(F.col("tops") == 1, "unique_top_score").otherwise("deterministic_path_tie_break")
    skipped = F.when(F.col("able_members") == 0, "NO_ELIGIBLE_KEEP_CANDIDATE")
    selection = F.when(skipped.isNotNull(), skipped).when(~able, "ineligible").when(F.col("kept"), reason).otherwise("quarantined")
    return out.withColumn("selection", selection).drop("active_ext", "tops", "able_members", "active_rule")


def released_by_directory(decided: DataFrame) -> DataFrame:
    """Bytes that removals free below every directory."""
    gone = decided.filter(~F.col("kept"))
    spread = gone.select("root_key", F.explode(ancestors(F.col("relative_path"))).alias("directory"), "size")
    return spread.groupBy("root_key", "directory").agg(F.sum("size").alias("released_bytes"))


def released_by_root(decided: DataFrame, roots: list[str]) -> DataFrame:
    """Bytes that removals free in each root, roots without any included."""
    spark = decided.sparkSession
    every = spark.createDataFrame([(r,) for r in roots], "root_key string")
    freed = decided.filter(~F.col("kept")).groupBy("root_key").agg(F.sum("size").alias("freed"))
    return every.join(freed, "root_key", "left").select("root_key", F.coalesce("freed", F.lit(0)).alias("released_bytes"))


def balanced(members: DataFrame, roots: list[str], by: str = "files", protect_last_file: bool = False) -> DataFrame:
    """The copy of each group whose keeping leaves removals most even over the roots: content_hash, size, keep.

    ``by="files"`` counts removals, groups in order of hash and size; ``by="bytes"`` counts released bytes, groups in
    order of size, largest first, and hash. The smallest (spread, sum of squares, root rank, path) wins. With
    ``protect_last_file`` a choice that would empty a directory is not made, and a group without a safe choice is
    left out; ``directory`` and ``directory_files``, the number of files right in it, must then be given. Every choice
    comes after all before it, at any size (``dedupe_run``).
    """
    place = F.col("directory") if protect_last_file else F.lit("")
    every = members.withColumn("directory", place).withColumn("eligible", F.lit(True)).withColumn("top", F.lit(True))
    counts = every.groupBy("root_key", "directory").agg(F.max("directory_files").cast("long").alias("files")) if protect_last_file else None
    return _kept(dedupe_run.run(several(every), roots, counts, by))


def balanced_recursively(members: DataFrame, roots: list[str]) -> DataFrame:
    """The copy of each group whose keeping leaves released bytes most even over roots, then over directories: content_hash, size, keep.

    Groups go by size, largest first, then by hash. Within a root the directories right below the deepest common one
    of the group's copies are compared, by all that was released below them so far. ``directory`` is each member's,
    relative to its root; the roots are all roots that occur.
    """
    return _kept(dedupe_run.run(several(members.withColumn("eligible", F.lit(True)).withColumn("top", F.lit(True))), roots))


def several(members: DataFrame) -> DataFrame:
    """Members of groups of two or more."""
    return members.withColumn("members", F.count("*").over(Window.partitionBy(*GROUP))).filter("members >= 2").drop("members")


def _kept(decided: DataFrame) -> DataFrame:
    return decided.filter("keep IS NOT NULL").select(*GROUP, "keep")


def fingerprint(members: DataFrame) -> DataFrame:
    """A digest of each group's member paths in order."""
    paths = F.array_join(F.array_sort(F.collect_list("absolute_path")), "\n")
    return members.groupBy(*GROUP).agg(F.sha2(paths, 256).alias("fingerprint"), F.count("*").alias("members")).filter("members >= 2")
