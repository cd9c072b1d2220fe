"""Queries of works in a tree of media, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import ancestors
from cairn.lineage import settled
from cairn.operators import units
from cairn.registry import query
from cairn.sources import manifest as mf

RULES = units.Rules(excluded_names=("@eaDir",), excluded_roots=("/data/r1/skip", "/data/r3/skip"), per_bucket=20)

#: Each document is four files; shelves of four documents (k) are of fourteen kinds (v), one of them a single large work. In Spark's and DuckDB's words.
_PLACES = """CASE
    WHEN v = 0 THEN b || '/IMG_' || r || '.jpg'
    WHEN v = 1 AND r % 4 = 0 THEN b || '/' || r || '.JPG' WHEN v = 1 AND r % 4 = 1 THEN b || '/Video/' || r || '.mp4' WHEN v = 1 AND r % 4 = 3 AND r < 15 THEN b || '/photo/' || r || '.png'
    WHEN v = 1 AND r = 2 THEN b || '/notes.txt' WHEN v = 1 AND r = 6 THEN b || '/P/NOTES.txt' WHEN v = 1 AND r = 10 THEN b || '/V_2/notes.TXT' WHEN v = 1 AND r = 14 THEN b || '/other/notes.txt' WHEN v = 1 THEN b || '/notes__dup003.txt'
    WHEN v = 2 THEN b || '/P_' || CASE r % 3 WHEN 0 THEN '1' WHEN 1 THEN '10' ELSE '2' END || ' [5 1B]/' || r || '.jpg'
    WHEN v = 3 THEN b || '/0' || CASE WHEN r < 9 THEN '0' ELSE '' END || (r + 1) || '.jpg'
    WHEN v = 4 AND r < 8 THEN b || '/P/NO.' || r % 2 || '/' || r || '.jpg' WHEN v = 4 THEN b || '/' || r || '.mp4'
    WHEN v = 5 AND r < 4 THEN b || '/12/' || r || '.jpg' WHEN v = 5 AND r < 8 THEN b || '/新建文件夹 (2)/' || r || '.jpg' WHEN v = 5 AND r = 15 THEN b || '/empty/P' WHEN v = 5 THEN b || '/vol ' || r % 2 || '/' || r || '.mp4'
    WHEN v = 6 AND r = 0 THEN b || '/link' WHEN v = 6 THEN b || '/' || r || '.mkv'
    WHEN v = 7 AND r = 0 THEN b || '/.NFC-stage/x' WHEN v = 7 THEN b || '/' || r || '.jpg'
    WHEN v = 8 AND r = 0 THEN b || '/P [14 140B]' WHEN v = 8 THEN b || '/' || r || CASE r WHEN 1 THEN '.mp4' ELSE '.jpg' END
    WHEN v = 9 AND r < 2 THEN b || '/001.jpg/' || r || '.jpg' WHEN v = 9 THEN b || '/' || r || '.jpg'
    WHEN v = 10 AND r < 4 THEN b || CASE w % 2 WHEN 0 THEN '' ELSE '/V' END || '/@EADIR/' || r || '.jpg' WHEN v = 10 THEN b || '/' || r || '.mp4'
    WHEN v = 11 AND r < 8 THEN 'skip/s' || k || '/' || r || '.jpg' WHEN v = 11 THEN b || '/图片/P/' || r || '.jpg'
    WHEN v = 12 AND r = 0 AND w % 2 = 0 THEN b || '/mount' WHEN v = 12 AND r = 0 THEN b || repeat('/V', 34) || '/f.jpg' WHEN v = 12 THEN b || '/' || r || '.jpg'
    WHEN r % 4 = 0 THEN 'all/IMG' || id || '_' || r || '.jpg' WHEN r % 4 = 3 THEN 'all/photos/' || id || '_' || r || '.png' ELSE 'all/P_' || r || ' [7 7B]/' || id || '_' || r || '.jpg' END"""
_KIND = "CASE WHEN v = 5 AND r = 15 THEN 'directory' WHEN v = 6 AND r = 0 THEN 'symlink' WHEN v = 8 AND r = 0 AND w % 2 = 0 THEN 'directory' WHEN v = 12 AND r = 0 AND w % 2 = 0 THEN 'directory' ELSE 'file' END"
_SIZE = "CASE WHEN v = 8 THEN 10 ELSE (id * 4 + r) * 7919 % 3000000 END"
_DEVICE = "CASE WHEN v = 12 AND r = 0 AND w % 2 = 0 THEN 2 ELSE 1 END"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the entries of four roots."""
    d = mf.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    d = d.selectExpr("id", "CAST(floor(id / 4) AS LONG) AS k", "id % 4 * 4 + j AS r").selectExpr("*", "k % 14 AS v", "CAST(floor(k / 14) AS LONG) AS w")
    d = d.selectExpr("*", "concat('/data/r', if(v = 13, 0, k % 4)) AS root_key", "concat('lib/c', k % 5, '/work ', k) AS b")
    f = d.selectExpr("root_key", f"{_PLACES} AS path", f"{_KIND} AS kind", f"CAST({_SIZE} AS LONG) AS size", f"CAST({_DEVICE} AS LONG) AS device")
    up = f.select("root_key", F.explode(ancestors(F.col("path"))).alias("path")).filter("path <> ''").distinct()
    dirs = up.selectExpr("root_key", "path", "'directory' AS kind", "CAST(0 AS LONG) AS size", "CAST(1 AS LONG) AS device")
    return settled(f.unionByName(dirs).withColumn("root_device", F.lit(1).cast("long")))


#: The same entries; visited directories and the wrappers below them level by level; files in their order; what fits where.
_SQL = f"""WITH RECURSIVE d AS (SELECT *, k % 14 AS v, k // 14 AS w, 'lib/c' || k % 5 || '/work ' || k AS b FROM (SELECT doc_id AS id, doc_id // 4 AS k, doc_id % 4 * 4 + j AS r FROM documents, range(4) t(j))),
  f AS (SELECT '/data/r' || CASE v WHEN 13 THEN 0 ELSE k % 4 END AS root_key, {_PLACES} AS path, {_KIND} AS kind, CAST({_SIZE} AS BIGINT) AS size, {_DEVICE} AS device FROM d),
  e AS (SELECT *, parse_filename(path) AS nm, regexp_extract(path, '^(.*)/[^/]*$', 1) AS up FROM (SELECT * FROM f UNION ALL SELECT DISTINCT root_key, array_to_string(p[:i], '/'), 'directory', 0, 1 FROM (SELECT root_key, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS i FROM f))),
  y AS (SELECT *, lower(nm) = '@eadir' OR regexp_matches(root_key || '/' || path, '^/data/r[13]/skip$') AS ex, starts_with(lower(nm), '.nfc-') AS rs, device <> 1 AS fo,
    regexp_full_match(lower(nm), '[pv](_?[1-9][0-9]*)?|[pv](_[1-9][0-9]*)? \\[[0-9]+ [^/]+\\]|other \\[[0-9]+ [^/]+\\]|other|图片|图|照片|photos?|images?|pictures?|pic|视频|videos?') AS wr,
    regexp_full_match(lower(nm), '[0-9]{{1,3}}|新建文件夹( *\\([0-9]+\\))?') AS un, regexp_matches(lower(nm), '^(no[. _-]?[0-9]+|a[0-9]+-[0-9]+)') AS cw FROM e),
  vi(root_key, path, unit, ws) AS (SELECT DISTINCT root_key, '', '', 0 FROM e UNION ALL
    SELECT y.root_key, y.path, CASE WHEN y.wr THEN vi.unit ELSE y.path END, CASE WHEN y.wr THEN ws + 1 ELSE 0 END FROM vi JOIN y ON y.root_key = vi.root_key AND y.up = vi.path
    WHERE y.kind = 'directory' AND NOT ex AND NOT rs AND NOT fo AND CASE WHEN y.wr THEN ws < 32 WHEN ws = 0 THEN NOT un ELSE ws = 1 AND cw END),
  s AS (SELECT y.*, unit, ws, CASE WHEN unit = '' THEN y.path ELSE substr(y.path, length(unit) + 2) END AS rel, CASE WHEN y.kind = 'directory' AND wr AND NOT ex AND ws = 32 THEN 1 WHEN rs THEN 2 WHEN y.kind = 'directory' AND ex THEN CASE WHEN ws > 0 THEN 3 END WHEN fo THEN 4 WHEN y.kind = 'directory' AND NOT wr THEN CASE WHEN ws > 0 THEN 5 END WHEN y.kind NOT IN ('directory', 'file') THEN 6 END AS bad,
      CASE WHEN y.kind <> 'directory' THEN CASE WHEN regexp_matches(nm, '(?i)\\.(jpg|png)$') THEN 'P' WHEN regexp_matches(nm, '(?i)\\.(mp4|mkv)$') THEN 'V' ELSE 'Other' END END AS ki FROM y JOIN vi ON vi.root_key = y.root_key AND vi.path = y.up),
  u0 AS (SELECT root_key, unit, min(bad) AS bad, count(*) FILTER (WHERE ki = 'P' AND bad IS NULL) AS p, count(*) FILTER (WHERE ki = 'V' AND bad IS NULL) AS v, count(*) FILTER (WHERE ki = 'Other' AND bad IS NULL) AS other, count_if(kind = 'directory' AND ws = 0 AND (ex OR NOT wr)) AS protected, count_if(kind = 'directory' AND wr AND NOT ex) AS folders
    FROM s GROUP BY 1, 2 HAVING bool_or(ws = 0 AND ((kind = 'file' AND NOT rs) OR (kind = 'directory' AND wr AND NOT ex AND NOT rs AND NOT fo)))),
  u AS (SELECT *, CASE WHEN p + v + other = 0 THEN NULL WHEN other > 0 OR (p > 0 AND v > 0) THEN 'sort' WHEN p + v > 20 THEN 'buckets' ELSE 'flatten' END AS op FROM u0),
  o AS (SELECT s.root_key, s.unit, s.path, nm, ki, size, op, row_number() OVER (PARTITION BY s.root_key, s.unit, ki ORDER BY list_transform(range(1, len(string_split(rel, '/')) + 1), lambda i: CASE WHEN i = len(string_split(rel, '/')) THEN {{'a': lower(string_split(rel, '/')[i]), 'b': -1, 'c': ''}}
        WHEN regexp_full_match(lower(string_split(rel, '/')[i]), '[pv]_[1-9][0-9]* \\[[0-9]+ [^/]+\\]') THEN {{'a': lower(string_split(rel, '/')[i][:2]), 'b': CAST(regexp_extract(string_split(rel, '/')[i], '_([0-9]+)', 1) AS BIGINT), 'c': lower(regexp_extract(string_split(rel, '/')[i], ' (.*)', 1)) || '/'}} ELSE {{'a': lower(string_split(rel, '/')[i]) || '/', 'b': -1, 'c': ''}} END), s.path) - 1 AS place
    FROM s JOIN u ON u.root_key = s.root_key AND u.unit = s.unit WHERE u.bad IS NULL AND op IS NOT NULL AND s.kind = 'file'),
  o1 AS (SELECT *, CASE WHEN op = 'flatten' OR ki = 'Other' THEN 0 ELSE place // 20 END AS bucket, regexp_extract(nm, '^.+([.][^.]+)$', 1) AS tail FROM o),
  g AS (SELECT root_key, unit, ki AS kind, bucket, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM o1 WHERE op <> 'flatten' GROUP BY ALL),
  g1 AS (SELECT *, kind || CASE bucket WHEN 0 THEN '' ELSE '_' || bucket END || ' [' || files || ' ' || CASE WHEN bytes < 1024 THEN bytes || 'B' WHEN bytes < 1048576 THEN replace(((bytes * 10 + 512) // 1024 / 10.0) || 'KiB', '.0KiB', 'KiB') ELSE replace(((bytes * 10 + 524288) // 1048576 / 10.0) || 'MiB', '.0MiB', 'MiB') END || ']' AS name FROM g),
  g2 AS (SELECT *, CASE WHEN unit = '' THEN name ELSE unit || '/' || name END AS path FROM g1),
  own AS (SELECT root_key, unit, list(lower(nm)) AS every FROM o1 WHERE ki = 'Other' GROUP BY 1, 2),
  n AS (SELECT o1.*, row_number() OVER (PARTITION BY o1.root_key, o1.unit, ki, lower(nm) ORDER BY place) - 1 AS again, every FROM o1 LEFT JOIN own USING (root_key, unit)),
  n1 AS (SELECT *, CASE WHEN ki <> 'Other' THEN printf('%03d', place - bucket * 20 + 1) || tail WHEN again = 0 THEN nm
    ELSE left(nm, length(nm) - length(tail)) || '__dup' || printf('%03d', list_filter(range(2, again + 10), lambda q: NOT list_contains(every, lower(left(nm, length(nm) - length(tail)) || '__dup' || printf('%03d', q) || tail)))[again]) || tail END AS fresh FROM n),
  i AS (SELECT n1.*, coalesce(g2.path, n1.unit) || CASE WHEN coalesce(g2.path, n1.unit) = '' THEN '' ELSE '/' END || fresh AS target FROM n1 LEFT JOIN g2 ON g2.root_key = n1.root_key AND g2.unit = n1.unit AND g2.kind = ki AND g2.bucket = n1.bucket),
  bad AS (SELECT root_key, unit, arg_min(why, o) AS why FROM (
      SELECT i.root_key, i.unit, 'TARGET_OCCUPIED' AS why, (CASE ki WHEN 'P' THEN 0 WHEN 'V' THEN 1 ELSE 2 END, i.place, 0) AS o FROM i JOIN e ON e.root_key = i.root_key AND e.path = i.target WHERE NOT EXISTS (SELECT 1 FROM i z WHERE z.root_key = i.root_key AND z.unit = i.unit AND z.path = i.target)
      UNION ALL SELECT g2.root_key, g2.unit, CASE WHEN e.kind <> 'directory' THEN 'FOLDER_NOT_DIRECTORY' ELSE 'FOLDER_NOT_AN_INPUT' END, (CASE g2.kind WHEN 'P' THEN 0 WHEN 'V' THEN 1 ELSE 2 END, bucket * 20, 1) FROM g2 JOIN e ON e.root_key = g2.root_key AND e.path = g2.path
        WHERE e.kind <> 'directory' OR NOT EXISTS (SELECT 1 FROM o z WHERE z.root_key = g2.root_key AND z.unit = g2.unit AND starts_with(z.path, g2.path || '/'))) GROUP BY 1, 2),
  u1 AS (SELECT u.* EXCLUDE (bad), coalesce(['WRAPPER_DEPTH', 'RESERVED_WORKSPACE', 'EXCLUDED_IN_WRAPPER', 'CROSS_DEVICE', 'INDEPENDENT_WORK', 'SPECIAL_FILE'][u.bad], why) AS reason FROM u LEFT JOIN bad ON bad.root_key = u.root_key AND bad.unit = u.unit),
  c AS (SELECT s.root_key, s.unit, s.path, row_number() OVER (PARTITION BY s.root_key, s.unit ORDER BY len(string_split(s.path, '/')) DESC, s.path) AS sequence FROM s JOIN u1 ON u1.root_key = s.root_key AND u1.unit = s.unit WHERE reason IS NULL AND op IS NOT NULL AND s.kind = 'directory' AND wr AND NOT ex AND NOT EXISTS (SELECT 1 FROM g2 WHERE g2.root_key = s.root_key AND g2.path = s.path))"""
_FINE = "JOIN u1 ON u1.root_key = t.root_key AND u1.unit = t.unit WHERE reason IS NULL"


@query(
    f"""{_SQL}, t AS (SELECT u1.*, coalesce(moves, 0) AS moves, coalesce(renamed, 0) AS renamed, coalesce(stale, 0) AS stale FROM u1 LEFT JOIN (SELECT root_key, unit, count_if(path <> target) AS moves, count_if(nm <> fresh) AS renamed FROM i GROUP BY 1, 2) m ON m.root_key = u1.root_key AND m.unit = u1.unit LEFT JOIN (SELECT root_key, unit, count(*) AS stale FROM c GROUP BY 1, 2) x ON x.root_key = u1.root_key AND x.unit = u1.unit)
  SELECT root_key, unit, CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN op IS NULL THEN 'skipped' WHEN moves + stale > 0 THEN 'ready' ELSE 'already_organized' END AS status, reason, CASE WHEN reason IS NULL THEN op END AS operation, """
    + ", ".join(f"CASE WHEN reason IS NULL THEN {c} ELSE 0 END AS {c}" for c in ("p", "v", "other", "protected", "folders", "moves", "renamed", "stale"))
    + " FROM t"
)
def media_units(spark, sf_dir):
    return units.layout(tree(spark, sf_dir), RULES).units


@query(f"{_SQL} SELECT t.root_key, t.unit, t.path AS source, target, ki AS kind, bucket, place, size AS bytes FROM i t {_FINE}")
def media_unit_items(spark, sf_dir):
    return units.layout(tree(spark, sf_dir), RULES).items


@query(f"{_SQL} SELECT t.root_key, t.unit, kind, bucket, name, files, bytes FROM g2 t {_FINE}")
def media_unit_groups(spark, sf_dir):
    return units.layout(tree(spark, sf_dir), RULES).groups


@query(f"{_SQL} SELECT * FROM c")
def media_unit_cleanup(spark, sf_dir):
    return units.layout(tree(spark, sf_dir), RULES).cleanup


@query(f"{_SQL} SELECT root_key, path, CASE WHEN rs THEN 'RESERVED_WORKSPACE' WHEN fo THEN 'CROSS_DEVICE' WHEN kind NOT IN ('directory', 'file') THEN 'SPECIAL_FILE' ELSE 'UNCLEAR_FOLDER' END AS reason FROM s WHERE ws = 0 AND NOT (kind = 'directory' AND ex) AND (rs OR fo OR kind NOT IN ('directory', 'file') OR (kind = 'directory' AND un))")
def media_unit_held(spark, sf_dir):
    return units.held(units.discovered(tree(spark, sf_dir), RULES))
