"""Queries of organized trees, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import ancestors, depth
from cairn.lineage import settled
from cairn.operators import organizer
from cairn.registry import query
from cairn.sources import manifest as mf

_LONG = "n" * 250

#: Where the file of a document lies: shelves of twenty documents, each document one kind of directory.
_PLACES = {
    0: "{b}/alpha (Copy)/f.jpg", 1: "{b}/alpha/f.jpg", 2: "{b}/Gamma/f.jpg", 3: "{b}/gamma/f.jpg", 4: "{b}/delta KEEP/f.mp4", 5: "{b}/epsilon (copy) KEEP (copy)/f.mp4",
    6: "{b}/zeta/f.jpg", 7: "{b}/theta [1P 2 B] KEEP [3P 4 B]/f.txt", 8: "{b}/nums/10.txt", 9: "{b}/nums/9.txt", 10: "{b}/nums/001.txt", 11: "{b}/nums/0.txt", 12: "{b}/" + _LONG + "/f.jpg", 18: "{b}/New iota/f.jpg",
}

_TREE = (
    """d AS (SELECT doc_id AS id, doc_id // 20 AS k, doc_id % 20 AS r, '/data/r' || (doc_id // 20) % 4 AS root_key, 'c' || (doc_id // 20) % 5 AS c, 'c' || (doc_id // 20) % 5 || '/s' || doc_id // 20 AS b FROM documents),
  f AS (SELECT id, k, r, root_key, CASE """
    + " ".join(f"WHEN r = {r} THEN b || '{p[3:]}'" for r, p in _PLACES.items())
    + """
      WHEN r = 13 AND k % 2 = 0 THEN b || '/@cache/f.jpg' WHEN r = 13 THEN 'skip/f' || id || '.jpg'
      WHEN r = 14 THEN b || '/mix/img/f.' || CASE WHEN k % 3 = 0 THEN 'jpg' ELSE 'mp4' END WHEN r = 15 THEN b || '/mix/' || CASE WHEN k % 3 = 1 THEN 'vid' ELSE 'old' END || '/f.jpg'
      WHEN r = 16 AND k % 4 = 0 THEN 'trash/x' || id || '/f.jpg' WHEN r = 16 THEN b || '/b' || id || '.mp4'
      WHEN r = 17 AND (k % 4 = 0 OR k % 8 = 6) THEN c || '/w' || k || '/in' || k || '/f.jpg' WHEN r = 17 AND k % 4 = 1 THEN c || '/w' || k || '/f.jpg' WHEN r = 17 AND k % 8 = 2 THEN c || '/w' || k || '/l' WHEN r = 17 THEN c || '/w' || k || '/s' || k || '/f.jpg'
      WHEN k % 3 = 0 THEN b || '/kappa/f.png' ELSE c || '/loose' || id || '.dat' END AS path,
    CASE WHEN r = 10 AND k % 4 = 1 THEN 'directory' WHEN r = 17 AND k % 8 = 2 THEN 'symlink' ELSE 'file' END AS kind, CASE WHEN r IN (6, 7) THEN 500 ELSE id // 2 * 37 % 3000000 END AS size,
    CASE WHEN k % 5 = 2 AND r IN (2, 3) THEN 1000000000000000 + k ELSE id END AS m FROM d
    UNION ALL SELECT id, k, 20, root_key, b || '/zeta [1P 500 B]', CASE k % 3 WHEN 0 THEN 'file' ELSE 'symlink' END, 0, id FROM d WHERE r = 6 AND k % 3 < 2),
  x AS (SELECT root_key, path, kind, size, m, inode, len(string_split(path, '/')) AS n, parse_filename(path) AS nm, regexp_extract(path, '^(.*)/[^/]*$', 1) AS up,
      NOT list_contains(string_split(path, '/'), '@cache') AND NOT regexp_matches(root_key || '/' || path, '^/data/r[13]/skip(/|$)') AS inc,
      list_transform(regexp_extract_all(lower(parse_filename(path)), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN {'a': 0, 'n': CAST(t AS HUGEINT), 's': ''} ELSE {'a': 1, 'n': CAST(0 AS HUGEINT), 's': t} END) AS nk
    FROM (SELECT root_key, path, kind, size, m, id * 10 + CASE r WHEN 20 THEN 9 ELSE 0 END AS inode FROM f WHERE kind <> 'directory'
      UNION ALL SELECT root_key, array_to_string(p[:i], '/'), 'directory', 0, max(m), min(id) * 10 + i FROM (SELECT *, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + CASE kind WHEN 'directory' THEN 1 ELSE 0 END)) AS i FROM f) GROUP BY root_key, array_to_string(p[:i], '/'), i)),
  st AS (SELECT root_key, array_to_string(p[:i], '/') AS path, count_if(regexp_matches(nm, '[.](jpg|png)$')) AS images, count_if(ends_with(nm, '.mp4')) AS videos, count_if(kind <> 'directory') AS files, count_if(kind = 'directory') AS folders, CAST(sum(size) AS BIGINT) AS total_bytes
    FROM (SELECT *, string_split(path, '/') AS p, unnest(range(1, n)) AS i FROM x WHERE inc AND kind <> 'symlink') GROUP BY 1, 2),
  q AS (SELECT root_key, path AS source, nm, m, n, up, coalesce(images, 0) AS images, coalesce(videos, 0) AS videos, coalesce(files, 0) AS files, coalesce(folders, 0) AS folders, coalesce(total_bytes, 0) AS total_bytes, row_number() OVER (PARTITION BY root_key ORDER BY n, nk, nm, path) AS place
    FROM x LEFT JOIN st USING (root_key, path) WHERE kind = 'directory' AND inc)"""
)

_SIZE = "CASE WHEN total_bytes < 1024 THEN total_bytes || ' B' WHEN total_bytes < 1048576 THEN printf('%.2f KB', ((total_bytes * 200 + 1024) // 2048) / 100.0) WHEN total_bytes < 1073741824 THEN printf('%.2f MB', ((total_bytes * 200 + 1048576) // 2097152) / 100.0) ELSE printf('%.2f GB', ((total_bytes * 200 + 1073741824) // 2147483648) / 100.0) END"
_CLEAN = "nm"
for _ in range(4):  # no name of the tree needs more than three rounds
    for _pattern in (r"\s*\[\d+P( \d+V)? [\d.]+ [KMG]?B\]$", r"\(copy\)", r" KEEP$"):
        _CLEAN = f"rtrim(regexp_replace({_CLEAN}, '{_pattern}', '', 'gi'))"
_TAG = "CASE WHEN contains(nm, 'KEEP') THEN ' KEEP' ELSE '' END"
_RICH = f"{_CLEAN} || {_TAG} || ' [' || images || 'P' || CASE WHEN videos > 0 THEN ' ' || videos || 'V' ELSE '' END || ' ' || {_SIZE} || ']'"
_PLAIN = "CASE WHEN images > 0 THEN 'img' ELSE '' END || CASE WHEN videos > 0 THEN 'vid' ELSE '' END || CASE WHEN folders > 0 THEN 'dir' ELSE '' END"


def _rounds(rows: str, name: str) -> str:
    """CTEs: ``name`` is ``rows`` with cycles, of (root_key, source, target, changed, conflict, type)."""
    return f"""{name}_w AS (SELECT root_key, source AS s, target AS t FROM {rows} WHERE changed AND conflict IS NULL AND type <> 'wrapper_collapse'),
  {name}_r(root_key, s, t) AS (SELECT * FROM {name}_w UNION SELECT r.root_key, r.s, w.t FROM {name}_r r JOIN {name}_w w ON r.root_key = w.root_key AND r.t = w.s),
  {name}_o AS (SELECT root_key, s FROM {name}_r WHERE s = t UNION SELECT r.root_key, r.s FROM {name}_r r JOIN {name}_r o ON r.root_key = o.root_key AND r.t = o.s AND o.s = o.t),
  {name} AS (SELECT l.* EXCLUDE (conflict), coalesce(conflict, CASE WHEN o.s IS NOT NULL AND changed AND type <> 'wrapper_collapse' THEN 'RENAME_CYCLE' END) AS conflict FROM {rows} l LEFT JOIN {name}_o o ON o.root_key = l.root_key AND o.s = l.source)"""


def _drafts(title: str, tags: str) -> str:
    return f"""{_TREE},
  t AS (SELECT *, CASE WHEN up = '' THEN title ELSE up || '/' || title END AS target FROM (SELECT *, {title} AS title, {tags} AS tags FROM q)),
  l AS (SELECT t.root_key, source, target, 'directory_rename' AS type, 'directory' AS object, images, videos, files, folders, total_bytes, tags, target <> source AS changed, place, t.m, t.n, t.up,
    CASE WHEN title = '' THEN 'INVALID_TARGET_NAME' WHEN strlen(title) > 255 THEN 'NAME_TOO_LONG' WHEN h.kind = 'symlink' THEN 'SYMLINK_BLOCKED' WHEN h.path IS NOT NULL AND NOT (h.kind = 'directory' AND h.inc) THEN 'TARGET_EXISTS'
      WHEN place > min(place) OVER (PARTITION BY t.root_key, target) THEN 'PLANNED_TARGET_COLLISION' END AS conflict FROM t LEFT JOIN x h ON h.root_key = t.root_key AND h.path = target),
  {_rounds("l", "a")}"""


_WRAPPERS = """wr AS (SELECT i.root_key, w.path AS wrapper, child, w.up || '/' || parse_filename(child) AS target, w.inode AS wi, i.inode AS ci, i.kind FROM (SELECT root_key, up, max(path) AS child, max(kind) AS kind, max(inode) AS inode FROM {x} WHERE n = 3 GROUP BY 1, 2 HAVING count(*) = 1) i
    JOIN {x} w ON w.root_key = i.root_key AND w.path = i.up AND w.inc AND w.kind = 'directory'),
  wc AS (SELECT wr.*, CASE WHEN wr.kind = 'symlink' THEN 'WRAPPER_CHILD_SYMLINK' WHEN wr.kind <> 'directory' THEN 'WRAPPER_CHILD_NOT_DIRECTORY' WHEN EXISTS (SELECT 1 FROM {x} h WHERE h.root_key = wr.root_key AND h.path = target) THEN 'WRAPPER_TARGET_EXISTS' END AS conflict FROM wr)"""

_ADVANCED = f"""WITH RECURSIVE {_drafts(_RICH, "CASE WHEN contains(nm, 'KEEP') THEN 'KEEP' ELSE '' END")},
  {_WRAPPERS.replace("{x}", "x")},
  b AS (SELECT * REPLACE (CASE WHEN n < 2 THEN source ELSE target END AS target, changed AND n > 1 AS changed, CASE WHEN n > 1 THEN conflict END AS conflict) FROM a),
  c0 AS (SELECT *, up <> '' AND m = max(m) OVER (PARTITION BY root_key, up) AS top FROM b), c1 AS (SELECT *, count_if(top) OVER (PARTITION BY root_key, up) AS tops FROM c0),
  c2 AS (SELECT * REPLACE (CASE WHEN top AND tops = 1 AND NOT starts_with(parse_filename(target), 'New ') THEN up || '/New ' || parse_filename(target) ELSE target END AS target,
      CASE WHEN top AND tops = 1 THEN 'latest_child_prefix' ELSE type END AS type, CASE WHEN top AND tops > 1 THEN 'LATEST_CHILD_TIE' ELSE conflict END AS conflict) FROM c1),
  c3 AS (SELECT root_key, source, target, type, object, images, videos, files, folders, total_bytes, tags, CASE WHEN top AND tops = 1 THEN target <> source ELSE changed END AS changed, place, conflict FROM c2
    UNION ALL SELECT *, target <> source, NULL, NULL FROM (SELECT root_key, path AS source, up || '/' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END || regexp_extract(nm, '^.+([.][^.]+)$', 1) AS target, 'file_rename', 'file', 0, 0, 1, 0, size, ''
      FROM (SELECT *, row_number() OVER (PARTITION BY root_key, up ORDER BY nk, nm) AS rn FROM x WHERE inc AND kind = 'file' AND n > 1))
    UNION ALL SELECT root_key, child, target, 'wrapper_collapse', 'directory', 0, 0, 0, 1, 0, '', conflict IS NULL, NULL, conflict FROM wc),
  c4 AS (SELECT c.* EXCLUDE (conflict), h.kind AS held, o.object AS owner, coalesce(conflict, CASE WHEN changed AND type <> 'wrapper_collapse' THEN CASE WHEN strlen(parse_filename(target)) > 255 THEN 'NAME_TOO_LONG' WHEN regexp_matches(c.root_key || '/' || target, '^/data/r0/trash/[^/]*$') OR regexp_matches(c.root_key || '/' || target, '^/data/r0/trash/.*/') THEN 'OUTSIDE_ALLOWED_ROOT' WHEN h.kind = 'symlink' THEN 'SYMLINK_BLOCKED' END END) AS conflict
    FROM c3 c LEFT JOIN x h ON h.root_key = c.root_key AND h.path = target LEFT JOIN (SELECT root_key, source AS path, object FROM c3 WHERE changed AND type <> 'wrapper_collapse') o ON o.root_key = c.root_key AND o.path = target),
  c5 AS (SELECT *, conflict IS NULL AND changed AND type <> 'wrapper_collapse' AS open FROM c4),
  c6 AS (SELECT * REPLACE (CASE WHEN open AND count_if(open) OVER (PARTITION BY root_key, regexp_extract(target, '^(.*)/[^/]*$', 1), lower(parse_filename(target))) > 1 THEN 'PLANNED_TARGET_COLLISION' WHEN open AND held IS NOT NULL AND (owner IS NULL OR owner <> object) THEN 'TARGET_EXISTS' ELSE conflict END AS conflict) FROM c5),
  {_rounds("c6", "z")}"""

_BASIC = f"WITH RECURSIVE {_drafts(_PLAIN, chr(39) * 2)}"
_SHOWN = "root_key, source, target, type, images, videos, files, folders, total_bytes, tags, changed, conflict, place"

RICH = organizer.Rules(
    ("jpg", ".PNG"), ("mp4",), tags=("KEEP", "LOST"), cleanup=(r"\s*\[\d+P( \d+V)? [\d.]+ [KMG]?B\]$", r"\(copy\)", r" KEEP$"),
    from_depth=2, file_numbers_from=1, latest_prefix="New ", collapse_wrappers=True, excluded_names=("@cache",), excluded_roots=("/data/r1/skip", "/data/r3/skip"), reserved="/data/r0/trash",
)
PLAIN = organizer.Rules(("jpg", "png"), ("mp4",), name="{?images:img}{?videos:vid}{?folders:dir}", touch_in_order=True, excluded_names=("@cache",), excluded_roots=("/data/r1/skip", "/data/r3/skip"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the entries of four roots."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    i, k, r, b, c = F.col("id"), F.col("k"), F.col("r"), F.col("b"), F.col("c")
    d = mf.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 20).alias("k"), (F.col("doc_id") % 20).alias("r"))
    d = d.withColumn("root_key", text("/data/r", k % 4)).withColumn("c", text("c", k % 5)).withColumn("b", text("c", k % 5, "/s", k))
    w = text(c, "/w", k)
    place = F.element_at(F.array(*(F.lit(_PLACES.get(n)) for n in range(20))), (r + 1).cast("int"))
    path = (
        F.when(place.isNotNull(), F.concat(b, F.substring(place, 4, 300)))
        .when(r == 13, F.when(k % 2 == 0, text(b, "/@cache/f.jpg")).otherwise(text("skip/f", i, ".jpg")))
        .when(r == 14, text(b, "/mix/img/f.", F.when(k % 3 == 0, "jpg").otherwise("mp4")))
        .when(r == 15, text(b, "/mix/", F.when(k % 3 == 1, "vid").otherwise("old"), "/f.jpg"))
        .when(r == 16, F.when(k % 4 == 0, text("trash/x", i, "/f.jpg")).otherwise(text(b, "/b", i, ".mp4")))
        .when((r == 17) & ((k % 4 == 0) | (k % 8 == 6)), text(w, "/in", k, "/f.jpg"))
        .when((r == 17) & (k % 4 == 1), text(w, "/f.jpg"))
        .when((r == 17) & (k % 8 == 2), text(w, "/l"))
        .when(r == 17, text(w, "/s", k, "/f.jpg"))
        .when(k % 3 == 0, text(b, "/kappa/f.png"))
        .otherwise(text(c, "/loose", i, ".dat"))
    )
    kind = F.when((r == 10) & (k % 4 == 1), "directory").when((r == 17) & (k % 8 == 2), "symlink").otherwise("file")
    size = F.when(r.isin(6, 7), 500).otherwise(F.floor(i / 2) * 37 % 3_000_000).cast("long")
    m = F.when((k % 5 == 2) & r.isin(2, 3), 1_000_000_000_000_000 + k).otherwise(i).cast("long")
    more = d.filter("r = 6 AND k % 3 < 2").select("root_key", text(b, "/zeta [1P 500 B]").alias("path"), F.when(k % 3 == 0, "file").otherwise("symlink").alias("kind"), F.lit(0).cast("long").alias("size"), i.alias("mtime_ns"), (i * 10 + 9).alias("inode"), "id")
    f = d.select("root_key", path.alias("path"), kind.alias("kind"), size.alias("size"), m.alias("mtime_ns"), (i * 10).alias("inode"), "id").unionByName(more)
    own = F.when(F.col("kind") == "directory", F.array("path")).otherwise(F.array().cast("array<string>"))
    up = f.select("root_key", F.explode(F.concat(ancestors(F.col("path")), own)).alias("path"), "mtime_ns", "id").filter("path <> ''")
    dirs = up.groupBy("root_key", "path").agg(F.max("mtime_ns").alias("mtime_ns"), F.min("id").alias("id"))
    dirs = dirs.select("root_key", "path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size"), "mtime_ns", (F.col("id") * 10 + depth(F.col("path"))).alias("inode"))
    return settled(f.filter("kind <> 'directory'").drop("id").unionByName(dirs).withColumn("device", F.lit(1).cast("long")))


def _shown(proposals: DataFrame) -> DataFrame:
    return proposals.withColumn("tags", F.array_join("tags", ",")).drop("object")


@query(f"{_ADVANCED} SELECT {_SHOWN} FROM z")
def organizer_preview(spark, sf_dir):
    return _shown(organizer.preview(tree(spark, sf_dir), RICH))


@query(f"{_BASIC} SELECT {_SHOWN} FROM a")
def organizer_renames(spark, sf_dir):
    return _shown(organizer.preview(tree(spark, sf_dir), PLAIN))


@query(
    f"""{_ADVANCED} SELECT z.root_key, count_if(place IS NOT NULL) AS directories, count_if(place IS NOT NULL AND changed AND conflict IS NULL) AS changed_directories, count_if(changed AND conflict IS NULL) AS changes, count_if(conflict IS NOT NULL) AS conflicts,
    count_if(type = 'file_rename') AS files, count_if(type = 'wrapper_collapse') AS wrappers, bool_or(type = 'wrapper_collapse' AND conflict IS NULL) AS structural, any_value(bytes) AS total_bytes
    FROM z JOIN (SELECT root_key, CAST(sum(size) AS BIGINT) AS bytes FROM x WHERE inc AND kind IN ('file', 'other') AND n > 1 GROUP BY 1) s ON s.root_key = z.root_key GROUP BY 1"""
)
def organizer_summary(spark, sf_dir):
    entries = tree(spark, sf_dir)
    return organizer.summary(organizer.preview(entries, RICH), entries, RICH)


@query(
    f"""{_BASIC}, g AS (SELECT * FROM a WHERE changed AND conflict IS NULL),
  lv AS (SELECT g.root_key, source, target, n, 1 + (SELECT count(*) FROM a_r r JOIN g o ON o.root_key = r.root_key AND o.source = r.t WHERE r.root_key = g.root_key AND r.s = g.source) AS level FROM g),
  pa AS (SELECT root_key, source, place, string_agg(coalesce(parse_filename(t), parse_filename(pre)), '/' ORDER BY i) AS final FROM (SELECT p.*, g.target AS t FROM (SELECT root_key, source, place, i, array_to_string(string_split(source, '/')[:i], '/') AS pre FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM a)) p LEFT JOIN g ON g.root_key = p.root_key AND g.source = pre) GROUP BY ALL),
  op AS (SELECT root_key, 'rename' AS operation, source, target, 0 AS phase, -n AS major, level FROM lv UNION ALL SELECT root_key, 'touch', final, NULL, 1, place, 0 FROM pa)
  SELECT root_key, row_number() OVER (PARTITION BY root_key ORDER BY phase, major, level, source) AS sequence, operation, source, target FROM op"""
)
def organizer_operations(spark, sf_dir):
    return organizer.operations(organizer.preview(tree(spark, sf_dir), PLAIN), PLAIN)


#: What has happened since the preview: other children, further entries, taken places.
_LATER = """y AS (SELECT * REPLACE (CASE WHEN n = 3 AND starts_with(nm, 'in') AND CAST(nm[3:] AS BIGINT) // 2 % 5 = 2 THEN -inode ELSE inode END AS inode) FROM x
    UNION ALL BY NAME SELECT root_key, up || '/more' AS path, 'file' AS kind, 3 AS n, up FROM x WHERE n = 3 AND kind = 'directory' AND starts_with(nm, 'in') AND CAST(nm[3:] AS BIGINT) // 2 % 5 = 3
    UNION ALL BY NAME SELECT root_key, split_part(path, '/', 1) || '/' || nm AS path, 'directory' AS kind, 2 AS n FROM x WHERE n = 3 AND kind = 'directory' AND starts_with(nm, 'in') AND CAST(nm[3:] AS BIGINT) // 2 % 5 = 4)"""


@query(
    f"""WITH {_TREE}, {_LATER}, {_WRAPPERS.replace("{x}", "x")}, {_WRAPPERS.replace("{x}", "y").replace("wr AS", "wr2 AS").replace("wc AS", "wc2 AS").replace("wr.", "wr2.").replace("FROM wr)", "FROM wr2)")},
  s AS (SELECT p.root_key, p.wrapper, p.child, p.target, CASE WHEN n.wrapper IS NULL THEN 'WRAPPER_GONE' WHEN n.conflict IS NOT NULL THEN 'NOT_READY' WHEN p.child <> n.child OR p.wi <> n.wi OR p.ci <> n.ci THEN 'CHANGED' END AS problem
    FROM wc p LEFT JOIN wc2 n ON n.root_key = p.root_key AND n.wrapper = p.wrapper WHERE p.conflict IS NULL)
  SELECT *, CASE WHEN problem IS NULL THEN 2 * row_number() OVER (PARTITION BY problem ORDER BY root_key, wrapper) - 1 END AS sequence FROM s"""
)
def organizer_structural(spark, sf_dir):
    entries = tree(spark, sf_dir)
    inner = (F.size(F.split("path", "/")) == 3) & F.regexp_like("path", F.lit("/in[0-9]+$"))
    state = F.when(inner, F.floor(F.regexp_extract("path", "([0-9]+)$", 1).try_cast("long") / 2) % 5)
    later = entries.withColumn("inode", F.when(state == 2, -F.col("inode")).otherwise(F.col("inode")))
    taken = F.concat(F.substring_index("path", "/", 1), F.lit("/"), F.substring_index("path", "/", -1))
    later = later.unionByName(entries.filter(state == 3).withColumn("path", F.concat(F.regexp_extract("path", "^(.*)/", 1), F.lit("/more"))).withColumn("kind", F.lit("file")))
    later = later.unionByName(entries.filter(state == 4).withColumn("path", taken))
    return organizer.structural(organizer.wrappers(entries, RICH), later, RICH)
