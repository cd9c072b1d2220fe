"""Finding entries that belong together: by path, by content, between two trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.paths import under


def java_replacement(text: str) -> str:
    r"""A Python replacement (``\1``) in Java's notation (``$1``)."""
    import re

    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def match_key(mode: str, pattern: str | None = None, replacement: str = "") -> Column:
    if mode == "relative-path":
        return F.col("relative_path")
    if mode == "basename":
        return F.col("basename")
    if mode == "stem":
        return F.col("stem")
    if mode == "normalized":
        return F.regexp_replace("relative_path", pattern or "", java_replacement(replacement))
    raise ValueError(f"unknown match mode: {mode}")


def path_groups(files: DataFrame, mode: str, pattern: str | None = None, replacement: str = "") -> DataFrame:
    """match_key, members, total_bytes of keys that two or more files share."""
    keyed = files.filter(~F.col("is_dir")).withColumn("match_key", match_key(mode, pattern, replacement))
    return keyed.groupBy("match_key").agg(F.count("*").alias("members"), F.sum("size").alias("total_bytes")).filter("members >= 2")


def content_groups(files: DataFrame) -> DataFrame:
    """content_hash, size, members and the bytes that keeping one copy frees."""
    grouped = files.groupBy("content_hash", "size").agg(F.count("*").alias("members")).filter("members >= 2")
    return grouped.withColumn("reclaimable_bytes", F.col("size") * (F.col("members") - 1))


def content_members(files: DataFrame) -> DataFrame:
    """The files of all groups, by semi join, so that a very large group is never gathered."""
    return files.join(content_groups(files).select("content_hash", "size"), ["content_hash", "size"], "left_semi")


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries (relative_path, kind, size) of two trees with the status of each path."""
    a = left.select("relative_path", F.col("kind").alias("kind_a"), F.col("size").alias("size_a"))
    b = right.select("relative_path", F.col("kind").alias("kind_b"), F.col("size").alias("size_b"))
    status = (
        F.when(F.col("kind_a").isNull(), "only_b")
        .when(F.col("kind_b").isNull(), "only_a")
        .when(F.col("kind_a") != F.col("kind_b"), "type_mismatch")
        .when(F.col("kind_a") == "directory", "both_directories")
        .when(F.col("size_a") != F.col("size_b"), "size_different")
        .otherwise("same_size_unverified")
    )
    return a.join(b, "relative_path", "full").withColumn("status", status)


def inventory_diff(remote: DataFrame, local: DataFrame) -> DataFrame:
    """The same for a remote listing and local files, with that feature's labels."""
    a = remote.select("relative_path", F.col("kind").alias("remote_kind"), F.col("size").alias("remote_size"))
    b = local.select("relative_path", F.col("kind").alias("local_kind"), F.col("size").alias("local_size"))
    status = (
        F.when(F.col("remote_kind").isNull(), "ONLY_LOCAL")
        .when(F.col("local_kind").isNull(), "ONLY_REMOTE")
        .when(F.col("remote_kind") != F.col("local_kind"), "TYPE_MISMATCH")
        .when((F.col("remote_kind") == "file") & (F.col("remote_size") != F.col("local_size")), "SIZE_MISMATCH")
        .when(F.col("remote_kind") == "directory", "DIRECTORY_MATCH")
        .otherwise("PENDING_SHA256")
    )
    return a.join(b, "relative_path", "full").select("relative_path", F.coalesce("remote_kind", "local_kind").alias("kind"), status.alias("status"), "remote_size", "local_size")


def verified(diff: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """Pending files of a diff, decided by content hash where both sides have one."""
    hashes = remote.select("relative_path", F.col("content_hash").alias("ha")).join(local.select("relative_path", F.col("content_hash").alias("hb")), "relative_path")
    decided = F.when(F.col("ha").isNull() | F.col("hb").isNull(), "METADATA_MATCH").when(F.col("ha") == F.col("hb"), "VERIFIED_MATCH").otherwise("HASH_MISMATCH")
    return diff.filter("status = 'PENDING_SHA256'").join(hashes, "relative_path").select("relative_path", decided.alias("status"))


def containing_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path with the deepest root (root, root_index) that holds it; the smaller index on ties.

    The candidate roots of a path are its own ancestors, so this is an equality join on exploded ancestors.
    """
    parts = F.split("path", "/")
    up = paths.withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    held = up.join(roots, "root").withColumn("deep", F.size(F.split("root", "/")))
    best = held.groupBy("path").agg(F.max_by(F.struct("root", "root_index"), F.struct("deep", -F.col("root_index"))).alias("r"))
    return paths.join(best, "path", "left").select(*paths.columns, F.col("r.root").alias("root"), F.col("r.root_index").alias("root_index"))


def diagnose(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Why files ``a`` and ``b`` (ids) are duplicates or not: the first reason that holds."""
    columns = ["id", "size", "content_hash", "device", "inode", "is_dir"]
    a = files.select(*(F.col(c).alias(f"{c}_a") for c in columns))
    b = files.select(*(F.col(c).alias(f"{c}_b") for c in columns))
    joined = pairs.join(a, F.col("a") == F.col("id_a"), "left").join(b, F.col("b") == F.col("id_b"), "left")
    reason = (
        F.when(F.col("id_a").isNull() | F.col("id_b").isNull(), "NOT_INDEXED")
        .when(F.col("a") == F.col("b"), "SAME_PATH")
        .when(F.col("is_dir_a") | F.col("is_dir_b"), "NOT_A_FILE")
        .when((F.col("device_a") == F.col("device_b")) & (F.col("inode_a") == F.col("inode_b")), "HARD_LINKED")
        .when(F.col("size_a") != F.col("size_b"), "SIZE_DIFFERS")
        .when(F.col("content_hash_a") != F.col("content_hash_b"), "CONTENT_DIFFERS")
        .otherwise("DUPLICATE")
    )
    return joined.select("a", "b", reason.alias("reason"))


def reindex(old: DataFrame, new: DataFrame, root: str) -> DataFrame:
    """The index after a scan of one root: seen entries replace theirs and keep first_seen_at, unseen ones of the root go."""
    before = old.select("absolute_path", F.col("first_seen_at").alias("__first"))
    fresh = new.join(before, "absolute_path", "left").withColumn("first_seen_at", F.coalesce("__first", "first_seen_at")).drop("__first")
    return old.filter(F.col("root_key") != root).unionByName(fresh)


def hardlink_survivors(entries: DataFrame, files: DataFrame) -> DataFrame:
    """How many other paths share an entry's inode, and how many other inodes hold the same content.

    Both are counts of aggregates, less the entry's own part; no two files are paired. Entries are rows of ``files``.
    """
    inode = ["device", "inode"]
    linked = files.groupBy(*inode).agg(F.count("*").alias("paths"))
    holders = files.select(*inode, "content_hash").distinct()
    held = holders.groupBy("content_hash").agg(F.count("*").alias("inodes"))
    own = holders.select(*inode, "content_hash", F.lit(1).alias("own"))
    joined = entries.join(linked, inode, "left").join(held, "content_hash", "left").join(own, [*inode, "content_hash"], "left")
    return joined.select("path", (F.col("paths") - 1).alias("links"), (F.coalesce("inodes", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("copies"))


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__rn = 1").drop("__rn")


def overlapping(paths: DataFrame) -> DataFrame:
    """Pairs (outer, inner) where one listed path lies below another."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inner = paths.select(F.col("path").alias("inner"), F.explode(ups).alias("outer"))
    return inner.join(paths.select(F.col("path").alias("outer")), "outer").filter("outer <> inner").select("outer", "inner")


def allowed(rows: DataFrame, path: str, roots: list[str], reserved: str) -> DataFrame:
    inside = F.lit(False)
    for root in roots:
        inside = inside | under(F.col(path), root)
    return rows.filter(inside & ~under(F.col(path), reserved))


def grouped_members(members: DataFrame, by: list[str]) -> DataFrame:
    """Each group with its members (root_key, relative_path) in order."""
    return members.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("root_key", "relative_path"))).alias("members"))


def first_of(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each group, aggregated before it is shuffled."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def ranked_members(members: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``members`` with ``kept``: the first of each group in an order without ties."""
    return members.withColumn("kept", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)
