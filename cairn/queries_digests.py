"""Queries of digests over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.paths import ancestors
from cairn.operators import digest_trees
from cairn.queries import FILES, files
from cairn.registry import query

_LEAF = 16
_FIELDS = ["relative_path", "size", "mtime_ns", "inode"]


def _record(columns: list[str]) -> str:
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in columns)


def _tree(rows: str, by: str, columns: list[str], name: str = "z") -> str:
    """CTEs: the nodes ``name`` of ``rows``; a record's leaf is its first prefix with few enough records, inner nodes level by level from below."""
    out = f"""{name}_h AS (SELECT {by}, hash, count(*) AS copies FROM (SELECT {by}, sha256({_record(columns)}) AS hash FROM {rows}) GROUP BY ALL),
  {name}_c AS (SELECT *, count(*) OVER (PARTITION BY {by}, prefix) AS items FROM (SELECT *, left(hash, l) AS prefix FROM {name}_h, range(8) t(l))),
  {name}_l AS (SELECT {by}, prefix, any_value(items) AS items, true AS leaf, sha256(string_agg(hash || ':' || copies, chr(10) ORDER BY hash)) AS digest FROM (SELECT *, min(l) OVER (PARTITION BY {by}, hash) AS first FROM {name}_c WHERE items <= {_LEAF}) WHERE l = first GROUP BY {by}, prefix),
  {name}_7 AS (SELECT * FROM {name}_l WHERE length(prefix) = 7)"""
    for level in range(6, -1, -1):
        out += f""",
  {name}_{level} AS (SELECT * FROM {name}_l WHERE length(prefix) = {level} UNION ALL SELECT {by}, left(prefix, {level}), sum(items), false, sha256(string_agg(right(prefix, 1) || digest, chr(10) ORDER BY prefix)) FROM {name}_{level + 1} GROUP BY 1, 2)"""
    return out + f",\n  {name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_{level}" for level in range(8)) + ")"


@query(f"WITH {FILES}, {_tree('(SELECT *, id AS inode FROM files)', 'root_key', _FIELDS)} SELECT root_key, prefix, length(prefix) AS level, CAST(items AS BIGINT) AS items, leaf, digest FROM z")
def snapshot_tree(spark, sf_dir):
    return digest_trees.tree(digest_trees.records(files(spark, sf_dir), ["root_key"], _FIELDS), ["root_key"], _LEAF)


@query(
    f"WITH {FILES}, up AS (SELECT unnest([root_key, root_key || '/' || split_part(relative_path, '/', 1), root_key || '/' || directory]) AS scope, relative_path, size, id AS inode FROM files), "
    f"{_tree('up', 'scope', ['relative_path', 'size', 'inode'])} SELECT scope, CAST(items AS BIGINT) AS items, digest FROM z_0"
)
def recursive_snapshots(spark, sf_dir):
    inside = files(spark, sf_dir).withColumn("below", F.explode(ancestors(F.col("relative_path"))))
    inside = inside.withColumn("scope", F.concat_ws("/", "root_key", F.nullif(F.col("below"), F.lit(""))))
    return digest_trees.roots(digest_trees.tree(digest_trees.records(inside, ["scope"], ["relative_path", "size", "inode"]), ["scope"], _LEAF))


_KEPT = "k AS (SELECT 'dedupe' AS preview, content_hash, absolute_path, size, row_number() OVER (PARTITION BY content_hash, size ORDER BY mtime_ns DESC, absolute_path) = 1 AS kept FROM files)"


@query(f"WITH {FILES}, {_KEPT}, {_tree('k', 'preview', ['content_hash', 'absolute_path', 'size', 'kept'])} SELECT preview, CAST(items AS BIGINT) AS items, digest FROM z_0")
def preview_digest(spark, sf_dir):
    """One digest over the decisions for all files."""
    f = files(spark, sf_dir)
    newest = f.groupBy("content_hash", "size").agg(F.min_by("absolute_path", F.struct(-F.col("mtime_ns"), "absolute_path")).alias("keeper"))
    decided = f.join(newest, ["content_hash", "size"]).select(F.lit("dedupe").alias("preview"), "content_hash", "absolute_path", "size", (F.col("absolute_path") == F.col("keeper")).alias("kept"))
    return digest_trees.roots(digest_trees.tree(digest_trees.records(decided, ["preview"], ["content_hash", "absolute_path", "size", "kept"]), ["preview"], _LEAF))


#: The files as a later scan finds them: those of one source are gone or touched, long ones have grown, and one language's are listed twice.
_LATER = "SELECT root_key, relative_path, size + CASE WHEN size > 9000 THEN 1 ELSE 0 END AS size, mtime_ns + CASE WHEN split_part(relative_path, '/', 2) = 'src3' AND size % 3 = 1 THEN 1 ELSE 0 END AS mtime_ns, inode FROM now WHERE NOT (split_part(relative_path, '/', 2) = 'src3' AND size % 3 = 2) UNION ALL SELECT root_key, relative_path, size, mtime_ns, inode FROM now WHERE split_part(relative_path, '/', 1) = 'de' AND size <= 1000"


@query(
    f"""WITH {FILES}, now AS (SELECT *, id AS inode FROM files), later AS ({_LATER}), b AS (SELECT root_key, relative_path, size, mtime_ns, inode, count(*) AS n FROM now GROUP BY ALL), a AS (SELECT root_key, relative_path, size, mtime_ns, inode, count(*) AS n FROM later GROUP BY ALL)
  SELECT root_key, relative_path, size, mtime_ns, inode, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM b FULL JOIN a USING (root_key, relative_path, size, mtime_ns, inode) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)"""
)
def snapshot_changes(spark, sf_dir):
    now = files(spark, sf_dir)
    later = spark.sql(_LATER.replace("now", "{now}"), now=now)
    before, after = (digest_trees.records(t, ["root_key"], _FIELDS) for t in (now, later))
    return digest_trees.differing(before, after, ["root_key"], _LEAF)
