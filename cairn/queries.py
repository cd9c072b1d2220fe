"""The registered manifest queries, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import media as md
from cairn.functions import names, paths, schedules
from cairn.operators import dedupe, filters, layout, lifecycle, matching, trees
from cairn.plans import workflow
from cairn.registry import ORACLE_SQL, QUERIES, query
from cairn.sources import manifest as mf

#: DuckDB's version of the files view.
FILES = """files AS (
  SELECT *, '/data/r' || (id % 4) || '/' || relative_path AS absolute_path, 'doc_' || id || '.' || ext AS basename, '.' || ext AS suffix, 'doc_' || id AS stem
  FROM (SELECT doc_id AS id, '/data/r' || (doc_id % 4) AS root_key, ext, lang || '/' || source || '/doc_' || doc_id || '.' || ext AS relative_path,
          lang || '/' || source AS directory, strlen(text) AS size, sha256(text) AS content_hash,
          1700000000000000000 + ((doc_id * 7919) % 1000003) * 1000000000 AS mtime_ns
        FROM (SELECT *, ['jpg','mp4','txt','PDF','zip','mp3','dat'][doc_id % 7 + 1] AS ext FROM documents)))"""
DUPES = f"""{FILES}, dup AS (SELECT content_hash, size, count(*) AS members FROM files GROUP BY 1, 2 HAVING count(*) >= 2),
  member AS (SELECT files.*, members FROM files JOIN dup USING (content_hash, size))"""
PACKAGES = """pk AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN strftime(l_shipdate, '%y%m') || '/' || strftime(l_shipdate, '%y%m%d') || '/' || l_suppkey ELSE strftime(l_shipdate, '%y01') || '/' || strftime(l_shipdate, '%y0101') || '/all' END AS package,
    l_orderkey || '_' || l_linenumber || '.' || ['jpg','mp4','txt','png'][(l_orderkey * 8 + l_linenumber) % 4 + 1] AS name,
    ['P','V','Other','P'][(l_orderkey * 8 + l_linenumber) % 4 + 1] AS kind, CAST(floor(l_extendedprice) * (l_linenumber * l_linenumber * 9) ** CAST(l_linenumber % 4 AS INTEGER) AS BIGINT) AS bytes FROM lineitem)"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.packages(spark, sf_dir)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.files(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_keep_newest(spark, sf_dir)


# ---------------------------------------------------------------- filters


def _filtered(name: str, node: dict, sql: str, excludes: list[str] | None = None) -> None:
    """A query that selects the files under a filter, and its SQL condition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.select(files(spark, sf_dir), mf.ROOTS, node, excludes or []).select("id", "relative_path", "size")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {FILES} SELECT id, relative_path, size FROM files WHERE {sql}"


def _leaf(field: str, operator: str, value: object, exact: bool = False) -> dict:
    return {"field": field, "operator": operator, "value": value, "case_sensitive": exact}


for _op, _sign in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _filtered(f"filter_size_{_op}", _leaf("size", _op, 423), f"size {_sign} 423")
    _filtered(f"filter_mtime_{_op}", _leaf("mtime", _op, 1700007919), f"mtime_ns {_sign} 1700007919000000000")
_filtered("filter_extension_eq", _leaf("extension", "eq", "pdf"), "lower(suffix) = '.pdf'")
_filtered("filter_extension_neq", _leaf("extension", "neq", "PDF"), "lower(suffix) <> '.pdf'")
_filtered("filter_extension_in", _leaf("extension", "in", ["jpg", "zip"]), "lower(suffix) IN ('.jpg', '.zip')")
_filtered("filter_extension_nin", _leaf("extension", "nin", ["jpg", "zip"]), "lower(suffix) NOT IN ('.jpg', '.zip')")
_filtered("filter_media_type", _leaf("media_type", "eq", "image"), "ext = 'jpg'")
_filtered("filter_media_type_neq", _leaf("media_type", "neq", "audio"), "ext <> 'mp3'")
_filtered("filter_media_type_in", _leaf("media_type", "in", ["image", "video"]), "ext IN ('jpg', 'mp4')")
_filtered("filter_media_type_nin", _leaf("media_type", "nin", ["document", "archive"]), "ext NOT IN ('txt', 'PDF', 'zip')")
_filtered("filter_media_type_other", _leaf("media_type", "eq", "other"), "ext = 'dat'")
_filtered("filter_name_eq", _leaf("name", "eq", "DOC_10.PDF"), "lower(basename) = 'doc_10.pdf'")
_filtered("filter_name_eq_exact", _leaf("name", "eq", "doc_10.PDF", True), "basename = 'doc_10.PDF'")
_filtered("filter_path_contains", _leaf("path", "contains", "SRC1"), "contains(lower(relative_path), 'src1')")
_filtered("filter_path_contains_literal", _leaf("path", "contains", "c_1"), "contains(lower(relative_path), 'c_1')")
_filtered("filter_path_startswith", _leaf("path", "startswith", "En/src1"), "starts_with(relative_path, 'en/src1')")
_filtered("filter_path_endswith_exact", _leaf("path", "endswith", ".PDF", True), "ends_with(relative_path, '.PDF')")
_filtered("filter_path_in", _leaf("path", "in", ["en/src1/doc_1.mp4", "DE/SRC2/DOC_2.TXT"]), "lower(relative_path) IN ('en/src1/doc_1.mp4', 'de/src2/doc_2.txt')")
_filtered("filter_name_nin", _leaf("name", "nin", ["doc_1.mp4"]), "lower(basename) NOT IN ('doc_1.mp4')")
_filtered(
    "filter_tree",
    {"op": "and", "children": [_leaf("size", "gte", 1000), {"op": "not", "child": _leaf("extension", "eq", "dat")}, {"op": "or", "children": [_leaf("path", "startswith", "en/"), _leaf("size", "gt", 4000)]}]},
    "size >= 1000 AND NOT lower(suffix) = '.dat' AND (starts_with(relative_path, 'en/') OR size > 4000)",
)
_filtered("filter_excludes", _leaf("size", "gte", 0), "NOT list_contains(string_split(lower(relative_path), '/'), 'src3')", ["SRC3"])


@query(f"WITH {FILES} SELECT count(*) AS matched_files, coalesce(CAST(sum(size) AS BIGINT), 0) AS matched_bytes FROM files WHERE size >= 1000 AND root_key IN ('/data/r0', '/data/r2')")
def filter_totals(spark, sf_dir):
    return filters.totals(filters.select(files(spark, sf_dir), ["/data/r0", "/data/r2"], _leaf("size", "gte", 1000)))


@query(f"WITH {FILES} SELECT id, size FROM files WHERE size >= 100 ORDER BY size DESC, id DESC LIMIT 20 OFFSET 20")
def filter_page(spark, sf_dir):
    return filters.page(filters.select(files(spark, sf_dir), mf.ROOTS, _leaf("size", "gte", 100)), "size", True, 2, 20).select("id", "size")


@query(f"WITH {FILES} SELECT id FROM files WHERE (relative_path = 'en/src1' OR starts_with(relative_path, 'en/src1/')) AND starts_with(absolute_path, '/data/r1/')")
def filter_subpath(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.filter(paths.under(F.col("relative_path"), "en/src1") & paths.under(F.col("absolute_path"), "/data/r1")).select("id")


@query(
    f"WITH {FILES}, t AS (SELECT id, CASE WHEN id % 3 = 0 THEN '/data/r0/' || repeat('x', 300) WHEN id % 3 = 1 THEN '/other/' || basename ELSE '/data/r0/trash/' || basename END AS target FROM files) "
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'NAME_TOO_LONG' WHEN id % 3 = 1 THEN 'OUTSIDE_ROOTS' ELSE 'RESERVED_TREE' END AS problem FROM t"
)
def filter_target_problems(spark, sf_dir):
    which = F.col("id") % 3
    target = (
        F.when(which == 0, F.concat(F.lit("/data/r0/"), F.repeat(F.lit("x"), 300)))
        .when(which == 1, F.concat(F.lit("/other/"), "basename"))
        .otherwise(F.concat(F.lit("/data/r0/trash/"), "basename"))
    )
    return files(spark, sf_dir).withColumn("target", target).select("id", filters.target_problem("/data/r0", "/data/r0/trash").alias("problem"))


@query(f"WITH {FILES} SELECT indexed_path_id, basename, integrity_status FROM (SELECT doc_id AS indexed_path_id, CASE quality WHEN 1 THEN 'healthy' ELSE 'corrupt' END AS integrity_status FROM labels) m JOIN files ON id = indexed_path_id WHERE integrity_status = 'corrupt' AND root_key = '/data/r1' AND basename ILIKE '%1%'")
def media_catalog(spark, sf_dir):
    assets = mf.media(spark, sf_dir).filter("integrity_status = 'corrupt'")
    held = files(spark, sf_dir).filter("root_key = '/data/r1'").filter(lifecycle.search("basename", "1"))
    return assets.join(held, F.col("indexed_path_id") == F.col("id")).select("indexed_path_id", "basename", "integrity_status")


# ---------------------------------------------------------------- matching and joins


@query(f"WITH {FILES} SELECT stem AS match_key, count(*) AS members, CAST(sum(size) AS BIGINT) AS total_bytes FROM (SELECT regexp_replace(relative_path, '[0-9]+\\.[A-Za-z0-9]+$', '') AS stem, size FROM files) GROUP BY 1 HAVING count(*) >= 2")
def match_normalized(spark, sf_dir):
    return matching.path_groups(files(spark, sf_dir), "normalized", r"\d+\.[A-Za-z0-9]+$", "")


@query(f"WITH {FILES}, folded AS (SELECT 'doc_' || id % 30 || '.' || ext AS basename, size FROM files) SELECT basename AS match_key, count(*) AS members, CAST(sum(size) AS BIGINT) AS total_bytes FROM folded GROUP BY 1 HAVING count(*) >= 2")
def match_basename(spark, sf_dir):
    return matching.path_groups(_folded(spark, sf_dir), "basename")


@query(f"WITH {FILES} SELECT 'doc_' || id % 30 AS match_key, count(*) AS members, CAST(sum(size) AS BIGINT) AS total_bytes FROM files GROUP BY 1 HAVING count(*) >= 2")
def match_stem(spark, sf_dir):
    return matching.path_groups(_folded(spark, sf_dir), "stem")


@query(f"WITH {FILES} SELECT lang_path AS match_key, count(*) AS members, CAST(sum(size) AS BIGINT) AS total_bytes FROM (SELECT split_part(relative_path, '/', 1) || '/doc_' || id % 30 || '.' || ext AS lang_path, size FROM files) GROUP BY 1 HAVING count(*) >= 2")
def match_relative_path(spark, sf_dir):
    return matching.path_groups(_folded(spark, sf_dir), "relative-path")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose numbers repeat, so that names meet."""
    f = files(spark, sf_dir)
    relative = F.concat("lang", F.lit("/doc_"), (F.col("id") % 30).cast("string"), "suffix")
    return mf.described(f.select("id", "root_key", relative.alias("relative_path"), "size", "is_dir"))


@query(f"WITH {DUPES} SELECT content_hash, size, members, size * (members - 1) AS reclaimable_bytes FROM dup")
def duplicate_groups(spark, sf_dir):
    return matching.content_groups(files(spark, sf_dir))


@query(f"WITH {DUPES} SELECT count(*) AS groups, CAST(sum(members) AS BIGINT) AS files, CAST(sum(size * (members - 1)) AS BIGINT) AS reclaimable_bytes FROM dup")
def duplicate_totals(spark, sf_dir):
    g = matching.content_groups(files(spark, sf_dir))
    return g.agg(F.count("*").alias("groups"), F.sum("members").alias("files"), F.sum("reclaimable_bytes").alias("reclaimable_bytes"))


@query(f"WITH {DUPES} SELECT id, content_hash FROM member")
def duplicate_members(spark, sf_dir):
    return matching.content_members(files(spark, sf_dir)).select("id", "content_hash")


@query(f"WITH {FILES} SELECT content_hash, size FROM files WHERE root_key IN ('/data/r0', '/data/r1') GROUP BY 1, 2 HAVING count(DISTINCT root_key) >= 2")
def duplicate_isolated(spark, sf_dir):
    held = files(spark, sf_dir).filter(F.col("root_key").isin("/data/r0", "/data/r1"))
    return held.groupBy("content_hash", "size").agg(F.countDistinct("root_key").alias("n")).filter("n >= 2").drop("n")


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    quarter, half = F.floor(F.col("id") / 4), F.floor(F.col("id") / 2)
    f = files(spark, sf_dir).select(
        "id", F.when(F.col("id") % 16 > 7, F.sha2(quarter.cast("string"), 256)).otherwise(F.col("content_hash")).alias("content_hash"), F.concat(F.lit("d/"), F.floor(F.col("id") / 2).cast("string")).alias("relative_path"), F.when(F.col("id") % 10 < 2, "directory").otherwise("file").alias("kind"),
        F.when(F.col("id") % 16 > 7, quarter).when(F.col("id") % 16 > 5, half).otherwise(F.col("size")).alias("size"),
    )
    return f.filter("id % 2 = 0 and id % 3 <> 0"), f.filter("id % 2 = 1 and id % 5 <> 0")


_TREES = f"""{FILES}, tr AS (SELECT id, CASE WHEN id % 16 > 7 THEN sha256(CAST(id // 4 AS VARCHAR)) ELSE content_hash END AS content_hash, 'd/' || (id // 2) AS relative_path, CASE WHEN id % 10 < 2 THEN 'directory' ELSE 'file' END AS kind, CASE WHEN id % 16 > 7 THEN id // 4 WHEN id % 16 > 5 THEN id // 2 ELSE size END AS size FROM files),
  a AS (SELECT * FROM tr WHERE id % 2 = 0 AND id % 3 <> 0), b AS (SELECT * FROM tr WHERE id % 2 = 1 AND id % 5 <> 0),
  d AS (SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, a.kind AS ka, b.kind AS kb, a.size AS sa, b.size AS sb, a.content_hash AS ha, b.content_hash AS hb FROM a FULL JOIN b ON a.relative_path = b.relative_path)"""
_TREE_STATUS = "CASE WHEN ka IS NULL THEN 'only_b' WHEN kb IS NULL THEN 'only_a' WHEN ka <> kb THEN 'type_mismatch' WHEN ka = 'directory' THEN 'both_directories' WHEN sa <> sb THEN 'size_different' ELSE 'same_size_unverified' END"


@query(f"WITH {_TREES} SELECT relative_path, {_TREE_STATUS} AS status FROM d")
def tree_diff(spark, sf_dir):
    return matching.tree_diff(*_trees(spark, sf_dir)).select("relative_path", "status")


@query(f"WITH {_TREES} SELECT {_TREE_STATUS} AS status, count(*) AS entries FROM d GROUP BY 1")
def tree_diff_counts(spark, sf_dir):
    return matching.tree_diff(*_trees(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("entries"))


_INVENTORY_STATUS = "CASE WHEN ka IS NULL THEN 'ONLY_LOCAL' WHEN kb IS NULL THEN 'ONLY_REMOTE' WHEN ka <> kb THEN 'TYPE_MISMATCH' WHEN ka = 'file' AND sa <> sb THEN 'SIZE_MISMATCH' WHEN ka = 'directory' THEN 'DIRECTORY_MATCH' ELSE 'PENDING_SHA256' END"


@query(f"WITH {_TREES} SELECT relative_path, coalesce(ka, kb) AS kind, {_INVENTORY_STATUS} AS status FROM d")
def inventory_diff(spark, sf_dir):
    return matching.inventory_diff(*_trees(spark, sf_dir)).select("relative_path", "kind", "status")


@query(f"WITH {_TREES} SELECT relative_path, CASE WHEN ha = hb THEN 'VERIFIED_MATCH' ELSE 'HASH_MISMATCH' END AS status FROM d WHERE ka = 'file' AND kb = 'file' AND sa = sb")
def inventory_verified(spark, sf_dir):
    a, b = _trees(spark, sf_dir)
    return matching.verified(matching.inventory_diff(a, b), a, b)


@query(f"WITH {FILES} SELECT absolute_path AS path, CASE WHEN starts_with(relative_path, 'en/') THEN root_key || '/en' ELSE root_key END AS root FROM files WHERE root_key <> '/data/r3'")
def containing_root(spark, sf_dir):
    roots = ["/data/r0", "/data/r1", "/data/r2", "/data/r0/en", "/data/r1/en", "/data/r2/en"]
    table = spark.createDataFrame([(r, i) for i, r in enumerate(roots)], "root string, root_index int")
    found = matching.containing_root(files(spark, sf_dir).select(F.col("absolute_path").alias("path")), table)
    return found.filter("root is not null").select("path", "root")


@query(
    f"WITH {FILES}, p AS (SELECT id AS a, (id * 7 + 1) % (SELECT count(*) + 20 FROM files) AS b FROM files) SELECT a, b, CASE WHEN y.id IS NULL THEN 'NOT_INDEXED' WHEN a = b THEN 'SAME_PATH' "
    "WHEN x.size <> y.size THEN 'SIZE_DIFFERS' WHEN x.content_hash <> y.content_hash THEN 'CONTENT_DIFFERS' ELSE 'DUPLICATE' END AS reason FROM p JOIN files x ON a = x.id LEFT JOIN files y ON b = y.id"
)
def pair_diagnosis(spark, sf_dir):
    f = files(spark, sf_dir)
    n = f.agg((F.count("*") + 20).alias("n"))  # one row
    pairs = f.select(F.col("id").alias("a")).join(F.broadcast(n)).select("a", ((F.col("a") * 7 + 1) % F.col("n")).alias("b"))
    return matching.diagnose(pairs, f)


@query(
    f"WITH {FILES}, old AS (SELECT absolute_path, root_key, 1 AS gen, 10 AS first_seen_at FROM files WHERE id % 3 <> 0), new AS (SELECT absolute_path, root_key, 2 AS gen, 20 AS first_seen_at FROM files WHERE id % 5 <> 0 AND root_key = '/data/r1') "
    "SELECT absolute_path, root_key, gen, first_seen_at FROM old WHERE root_key <> '/data/r1' UNION ALL SELECT n.absolute_path, n.root_key, n.gen, coalesce(o.first_seen_at, n.first_seen_at) FROM new n LEFT JOIN old o USING (absolute_path)"
)
def reindex(spark, sf_dir):
    f = files(spark, sf_dir)
    old = f.filter("id % 3 <> 0").select("absolute_path", "root_key", F.lit(1).alias("gen"), F.lit(10).alias("first_seen_at"))
    new = f.filter("id % 5 <> 0 and root_key = '/data/r1'").select("absolute_path", "root_key", F.lit(2).alias("gen"), F.lit(20).alias("first_seen_at"))
    return matching.reindex(old, new, "/data/r1")


@query(
    f"WITH {FILES}, f AS (SELECT absolute_path AS path, id // 3 AS inode, content_hash FROM files), e AS (SELECT * FROM f WHERE inode % 2 = 0) "
    "SELECT e.path, (SELECT count(*) FROM f WHERE f.inode = e.inode AND f.path <> e.path) AS links, (SELECT count(DISTINCT f.inode) FROM f WHERE f.content_hash = e.content_hash AND f.inode <> e.inode) AS copies FROM e"
)
def hardlink_survivors(spark, sf_dir):
    f = files(spark, sf_dir).select(F.col("absolute_path").alias("path"), "device", F.floor(F.col("id") / 3).alias("inode"), "content_hash")
    return matching.hardlink_survivors(f.filter("inode % 2 = 0"), f)


@query(f"WITH {DUPES} SELECT x.id, count(*) AS siblings FROM member x JOIN member y ON x.content_hash = y.content_hash AND x.size = y.size AND x.id <> y.id GROUP BY 1")
def duplicate_siblings(spark, sf_dir):
    members = matching.content_members(files(spark, sf_dir))
    count = F.count("*").over(Window.partitionBy("content_hash", "size"))
    return members.select("id", (count - 1).alias("siblings"))


@query(f"WITH {FILES}, g AS (SELECT absolute_path, id % 7 AS grp FROM files UNION ALL SELECT absolute_path, id % 3 AS grp FROM files) SELECT absolute_path, count(DISTINCT grp) AS groups FROM g GROUP BY 1 HAVING count(DISTINCT grp) > 1")
def conflicting_membership(spark, sf_dir):
    f = files(spark, sf_dir)
    both = f.select("absolute_path", (F.col("id") % 7).alias("grp")).union(f.select("absolute_path", F.col("id") % 3))
    return both.groupBy("absolute_path").agg(F.countDistinct("grp").alias("groups")).filter("groups > 1")


@query("SELECT event_type AS plan, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_job(spark, sf_dir):
    e = mf.table(spark, sf_dir, "events")
    return matching.latest(e, ["event_type", "user_id"], [F.col("event_id").desc()]).select(F.col("event_type").alias("plan"), "user_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = o_orderkey)")
def dependent_scans(spark, sf_dir):
    wanted = mf.table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("o_orderkey"))
    return mf.table(spark, sf_dir, "orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def root_counts(spark, sf_dir):
    counts = mf.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return mf.table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query(f"WITH {FILES} SELECT doc_id AS indexed_path_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM files WHERE id = doc_id AND ext IN ('jpg', 'mp4'))")
def media_orphans(spark, sf_dir):
    held = files(spark, sf_dir).filter(md.media_type(F.col("suffix")).isin("image", "video")).select(F.col("id").alias("indexed_path_id"))
    return mf.media(spark, sf_dir).join(held, "indexed_path_id", "left_anti").select("indexed_path_id")


@query("SELECT o.p AS outer, i.p AS inner FROM (SELECT DISTINCT lang AS p FROM documents) o JOIN (SELECT DISTINCT lang || '/' || source AS p FROM documents) i ON starts_with(i.p, o.p || '/')")
def overlapping_paths(spark, sf_dir):
    d = mf.table(spark, sf_dir, "documents")
    both = d.select(F.col("lang").alias("path")).union(d.select(F.concat("lang", F.lit("/"), "source"))).distinct()
    return matching.overlapping(both)


# ---------------------------------------------------------------- aggregates


@query("SELECT count_if(quality = 1) AS healthy, count_if(quality = 0) AS corrupt, count_if(toxic = 1) AS changed, count_if(toxic = 0) AS verified, count(*) AS total FROM labels")
def media_summary(spark, sf_dir):
    m = mf.media(spark, sf_dir)
    integrity, verification = F.col("integrity_status"), F.col("verification_status")
    return m.agg(
        F.count_if(integrity == "healthy").alias("healthy"),
        F.count_if(integrity == "corrupt").alias("corrupt"),
        F.count_if(verification == "changed").alias("changed"),
        F.count_if(verification == "verified").alias("verified"),
        F.count("*").alias("total"),
    )


@query("SELECT count(*) AS jobs, count_if(event_type = 'purchase') AS purchases, max(event_id) AS latest, max_by(event_type, event_id) AS latest_kind FROM events")
def dashboard(spark, sf_dir):
    e = mf.table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("jobs"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.max("event_id").alias("latest"), F.max_by("event_type", "event_id").alias("latest_kind"))


_KINDS = "count(*) AS files, count_if(ext = 'jpg') AS images, count_if(ext = 'mp4') AS videos, CAST(sum(size) AS BIGINT) AS total_bytes"


@query(f"WITH {FILES} SELECT root_key, directory, {_KINDS} FROM files GROUP BY 1, 2")
def directory_stats(spark, sf_dir):
    return trees.direct_stats(files(spark, sf_dir))


@query(f"WITH {FILES}, up AS (SELECT root_key, unnest(['', split_part(relative_path, '/', 1), directory]) AS directory, ext, size FROM files) SELECT root_key, directory, {_KINDS} FROM up GROUP BY 1, 2")
def directory_rollup(spark, sf_dir):
    return trees.rollup(files(spark, sf_dir))


@query(f"WITH {FILES}, up AS (SELECT DISTINCT root_key, unnest(['', split_part(relative_path, '/', 1), directory]) AS directory FROM files) SELECT u.root_key, u.directory, (SELECT count(*) FROM up v WHERE v.root_key = u.root_key AND v.directory <> '' AND CASE WHEN contains(v.directory, '/') THEN split_part(v.directory, '/', 1) ELSE '' END = u.directory) AS folders FROM up u")
def directory_folders(spark, sf_dir):
    return trees.directories(files(spark, sf_dir))


@query("SELECT count(*) AS total, min(ts) AS oldest, max(ts) AS newest, count_if(ts < (SELECT max(ts) FROM events) - INTERVAL 2 DAY) AS expired FROM events")
def retention_preview(spark, sf_dir):
    e = mf.table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    return lifecycle.retention_preview(e.join(F.broadcast(newest)), F.col("newest") - F.expr("INTERVAL 2 DAYS"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00'")
def retention_apply(spark, sf_dir):
    return lifecycle.retained(mf.table(spark, sf_dir, "events"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).select("event_id")


@query(f"WITH {DUPES} SELECT content_hash, size, members, sha256(string_agg(absolute_path, chr(10) ORDER BY absolute_path)) AS fingerprint FROM member GROUP BY 1, 2, 3")
def group_fingerprint(spark, sf_dir):
    return dedupe.fingerprint(files(spark, sf_dir))


@query(
    "WITH i AS (SELECT o_custkey AS plan_id, CASE WHEN o_custkey % 4 = 0 THEN 'completed' WHEN o_custkey % 4 = 1 OR o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS state, ['cancelled', 'completed', 'failed'][o_custkey % 3 + 1] AS outcome FROM orders) "
    "SELECT plan_id, CASE WHEN bool_and(state = 'completed') THEN 'completed' WHEN bool_or(state IN ('completed', 'failed')) THEN 'partial' WHEN any_value(outcome) = 'cancelled' THEN 'ready' WHEN any_value(outcome) = 'completed' THEN 'partial' ELSE 'failed' END AS status FROM i GROUP BY 1"
)
def plan_status(spark, sf_dir):
    group, kind = F.col("o_custkey") % 4, F.col("o_orderstatus")
    state = F.when(group == 0, "completed").when((group == 1) | (kind == "P"), "pending").when(kind == "F", "completed").otherwise("failed")
    outcome = F.element_at(F.array(*map(F.lit, ["cancelled", "completed", "failed"])), (F.col("o_custkey") % 3 + 1).cast("int"))
    items = mf.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), state.alias("state"), outcome.alias("outcome"))
    return lifecycle.plan_status(items, F.col("outcome"))


# ---------------------------------------------------------------- keep decisions

_RANK = "CASE root_key WHEN '/data/r2' THEN 0 WHEN '/data/r0' THEN 1 ELSE 2 END"
_ROOT_ORDER = ["/data/r2", "/data/r0"]
_PATTERN = "CASE WHEN regexp_matches(relative_path, '^en/.*$') THEN 0 WHEN regexp_matches(relative_path, '^.*/src1.*$') THEN 1 ELSE 1000002 END"


def _policy(name: str, policy: str, order_sql: str, patterns: list[str] | None = None) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dedupe.decide(files(spark, sf_dir), policy, _ROOT_ORDER, patterns).select("id", "members", "kept")

    run.__name__ = name
    return query(f"WITH {DUPES} SELECT id, members, row_number() OVER (PARTITION BY content_hash, size ORDER BY {order_sql}) = 1 AS kept FROM member")(run)


_policy("dedupe_keep_first_root", "keep-first-root", f"{_RANK}, absolute_path")
dedupe_keep_newest = _policy("dedupe_keep_newest", "keep-newest", f"mtime_ns DESC, {_RANK}, absolute_path")
_policy("dedupe_keep_oldest", "keep-oldest", f"mtime_ns, {_RANK}, absolute_path")
_policy("dedupe_relative_path", "relative-path-preference", f"{_PATTERN}, {_RANK}, absolute_path", ["en/*", "*/src1*"])
_policy("dedupe_path_priority", "path-priority", "CASE WHEN starts_with(absolute_path, '/data/r1/') THEN 0 ELSE 1000001 END, " + f"{_RANK}, absolute_path", ["/data/r1/*"])


@query(
    f"""WITH {DUPES}, e AS (SELECT *, id % 5 <> 0 AS eligible, CASE WHEN starts_with(relative_path, 'en/') THEN 0 WHEN contains(relative_path, '/src1') THEN 1 END AS rule,
      CASE lower(suffix) WHEN '.pdf' THEN 1 WHEN '.jpg' THEN 2 END AS place FROM member),
    w AS (SELECT *, min(CASE WHEN eligible THEN rule END) OVER g AS ar, min(CASE WHEN eligible THEN place END) OVER g AS ae, max(CASE WHEN eligible THEN mtime_ns END) OVER g AS nm FROM e WINDOW g AS (PARTITION BY content_hash, size)),
    s AS (SELECT *, CASE WHEN eligible AND ar = 0 AND starts_with(relative_path, 'en/') THEN 5 WHEN eligible AND ar = 1 AND contains(relative_path, '/src1') THEN 5 ELSE 0 END
      + CASE WHEN eligible AND place = ae THEN 3 ELSE 0 END + CASE WHEN eligible AND mtime_ns = nm THEN 2 ELSE 0 END AS score FROM w),
    t AS (SELECT *, eligible AND score = max(CASE WHEN eligible THEN score END) OVER (PARTITION BY content_hash, size) AS top FROM s),
    k AS (SELECT *, sum(CAST(coalesce(top, false) AS INT)) OVER g AS tops, sum(CAST(eligible AS INT)) OVER g AS able, row_number() OVER (PARTITION BY content_hash, size ORDER BY coalesce(top, false) DESC, absolute_path) AS rn FROM t WINDOW g AS (PARTITION BY content_hash, size))
    SELECT id, score, rn = 1 AND coalesce(top, false) AS kept, CASE WHEN able = 0 THEN 'NO_ELIGIBLE_KEEP_CANDIDATE' WHEN NOT eligible THEN 'ineligible' WHEN rn = 1 AND top THEN CASE WHEN able = 1 THEN 'sole_eligible' WHEN tops = 1 THEN 'unique_top_score' ELSE 'deterministic_path_tie_break' END ELSE 'quarantined' END AS selection FROM k"""
)
def dedupe_weighted(spark, sf_dir):
    members = files(spark, sf_dir).withColumn("eligible", F.col("id") % 5 != 0)
    out = dedupe.scored(members, ["en/*", "*/src1*"], 5, [".pdf", ".jpg"], 3, "newest", 2)
    return out.select("id", "score", F.coalesce("kept", F.lit(False)).alias("kept"), "selection")


@query(f"WITH {DUPES}, k AS (SELECT *, row_number() OVER (PARTITION BY content_hash, size ORDER BY mtime_ns DESC, {_RANK}, absolute_path) AS rn FROM member), up AS (SELECT root_key, unnest(['', split_part(relative_path, '/', 1), directory]) AS directory, size FROM k WHERE rn > 1) SELECT root_key, directory, CAST(sum(size) AS BIGINT) AS released_bytes FROM up GROUP BY 1, 2")
def released_by_directory(spark, sf_dir):
    return dedupe.released_by_directory(dedupe.decide(files(spark, sf_dir), "keep-newest", _ROOT_ORDER))


@query(f"WITH {DUPES}, k AS (SELECT *, row_number() OVER (PARTITION BY content_hash, size ORDER BY mtime_ns DESC, {_RANK}, absolute_path) AS rn FROM member), r AS (SELECT unnest(['/data/r0', '/data/r1', '/data/r2', '/data/r3', '/data/r9']) AS root_key) SELECT r.root_key, coalesce(CAST(sum(size) AS BIGINT), 0) AS released_bytes FROM r LEFT JOIN (SELECT * FROM k WHERE rn > 1) k USING (root_key) GROUP BY 1")
def released_by_root(spark, sf_dir):
    return dedupe.released_by_root(dedupe.decide(files(spark, sf_dir), "keep-newest", _ROOT_ORDER), [*mf.ROOTS, "/data/r9"])


@query()
def dedupe_balanced_files(spark, sf_dir):
    return dedupe.balanced(files(spark, sf_dir).withColumn("directory", paths.parent(F.col("absolute_path"))), mf.ROOTS)


@query()
def dedupe_balanced_bytes(spark, sf_dir):
    return dedupe.balanced(files(spark, sf_dir).withColumn("directory", paths.parent(F.col("absolute_path"))), mf.ROOTS, by="bytes")


@query()
def dedupe_protected(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("directory", paths.parent(F.col("absolute_path")))
    counts = f.groupBy("directory").agg(F.count("*").alias("directory_files"))
    return dedupe.balanced(matching.content_members(f).join(counts, "directory"), mf.ROOTS, protect_last_file=True)


@query()
def dedupe_balanced_directories(spark, sf_dir):
    return dedupe.balanced_recursively(files(spark, sf_dir).withColumn("directory", paths.parent(F.col("relative_path"))), mf.ROOTS)


# ---------------------------------------------------------------- trees


@query(f"WITH {FILES}, listed AS (SELECT DISTINCT root_key, 'd' || id % 9 || '/e' || id % 40 AS directory FROM files UNION SELECT DISTINCT root_key, directory FROM files), e AS (SELECT * FROM listed l WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.root_key = l.root_key AND f.directory = l.directory)) SELECT root_key, directory, row_number() OVER (PARTITION BY root_key ORDER BY len(string_split(directory, '/')) DESC, directory) AS removal_order FROM e")
def empty_directories(spark, sf_dir):
    f = files(spark, sf_dir)
    made = F.concat(F.lit("d"), (F.col("id") % 9).cast("string"), F.lit("/e"), (F.col("id") % 40).cast("string"))
    listed = f.select("root_key", made.alias("directory")).union(f.select("root_key", paths.parent(F.col("relative_path")))).distinct()
    return trees.empty_directories(listed, f)


_DEEP = """deep AS (SELECT id, root_key, ext, basename, size, CASE id % 6 WHEN 0 THEN 'w' || id % 30 || '/only/' || basename WHEN 1 THEN 'v' || id % 30 || '/v' || id % 30 || '/' || basename
    WHEN 2 THEN 'u/t' || id % 30 || '/s' || id % 30 || '/' || basename WHEN 3 THEN 'u/s' || id % 30 || '/x/' || basename ELSE relative_path END AS relative_path FROM files)"""


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files some of which lie in directories with nothing else."""
    i, k = F.col("id"), (F.col("id") % 30).cast("string")
    moved = (
        F.when(i % 6 == 0, F.concat(F.lit("w"), k, F.lit("/only/"), "basename"))
        .when(i % 6 == 1, F.concat(F.lit("v"), k, F.lit("/v"), k, F.lit("/"), "basename"))
        .when(i % 6 == 2, F.concat(F.lit("u/t"), k, F.lit("/s"), k, F.lit("/"), "basename"))
        .when(i % 6 == 3, F.concat(F.lit("u/s"), k, F.lit("/x/"), "basename"))
        .otherwise(F.col("relative_path"))
    )
    return files(spark, sf_dir).withColumn("relative_path", moved)


@query(
    f"WITH {FILES}, {_DEEP}, p AS (SELECT *, string_split(relative_path, '/') AS s FROM deep), d AS (SELECT DISTINCT root_key, unnest(list_transform(range(1, len(s)), lambda n: array_to_string(s[1:n], '/'))) AS directory FROM p), "
    "e AS (SELECT root_key, regexp_extract(directory, '^(.*)/[^/]*$', 1) AS directory, directory AS child, true AS is_dir FROM d UNION ALL SELECT root_key, regexp_extract(relative_path, '^(.*)/[^/]*$', 1), relative_path, false FROM deep), "
    "o AS (SELECT root_key, directory, max(child) AS child FROM e WHERE directory <> '' GROUP BY 1, 2 HAVING count(*) = 1 AND bool_and(is_dir)), "
    "m AS (SELECT *, CASE WHEN contains(directory, '/') THEN regexp_extract(directory, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || regexp_extract(child, '[^/]*$') AS target FROM o) "
    "SELECT root_key, directory, child, target, CASE WHEN target = directory THEN 'same_name' WHEN EXISTS (SELECT 1 FROM e WHERE e.root_key = m.root_key AND e.child = m.target) THEN 'target_exists' ELSE 'movable' END AS state FROM m"
)
def single_child_wrappers(spark, sf_dir):
    f = _deep(spark, sf_dir)
    return trees.single_child_wrappers(trees.directories(f).select("root_key", "directory"), f)


@query(
    f"WITH {FILES}, d AS (SELECT id, root_key, CASE id % 4 WHEN 0 THEN 'en/src1/' || 'n' || id % 20 || '.txt' WHEN 1 THEN 'en/src2/' || 'n' || id % 20 || '.txt' WHEN 2 THEN 'en/' || 'n' || (id - 2) % 10 || '.txt' ELSE relative_path END AS relative_path FROM files), "
    "o AS (SELECT id, root_key, relative_path, 'en/' || split_part(relative_path, '/', 3) AS target FROM d WHERE starts_with(relative_path, 'en/src1/') OR starts_with(relative_path, 'en/src2/')) "
    "SELECT id, root_key, relative_path, target, CASE WHEN count(*) OVER (PARTITION BY root_key, target) > 1 THEN 'PLANNED_TARGET_COLLISION' WHEN EXISTS (SELECT 1 FROM d WHERE d.root_key = o.root_key AND d.relative_path = o.target) THEN 'TARGET_EXISTS' ELSE 'ACTIONABLE' END AS state FROM o"
)
def flatten_one_level(spark, sf_dir):
    i = F.col("id")
    n = lambda x, d: F.concat(F.lit(f"{d}/n"), x.cast("string"), F.lit(".txt"))
    moved = F.when(i % 4 == 0, n(i % 20, "en/src1")).when(i % 4 == 1, n(i % 20, "en/src2")).when(i % 4 == 2, n((i - 2) % 10, "en")).otherwise(F.col("relative_path"))
    f = files(spark, sf_dir).withColumn("relative_path", moved)
    f = f.withColumn("basename", paths.basename(F.col("relative_path"))).dropDuplicates(["id"])
    wrappers = f.select("root_key", paths.parent(F.col("relative_path")).alias("wrapper")).filter("wrapper in ('en/src1', 'en/src2')").distinct()
    return trees.flatten_one_level(f, wrappers)


@query(f"WITH {FILES} SELECT relative_path AS path, CASE split_part(relative_path, '/', 1) WHEN 'en' THEN 'english' ELSE split_part(relative_path, '/', 1) END || '/' || CASE directory WHEN 'en/src1' THEN 'first' ELSE split_part(relative_path, '/', 2) END || '/' || basename AS final FROM files")
def final_paths(spark, sf_dir):
    renames = spark.createDataFrame([("en", "english"), ("en/src1", "first")], "path string, new_name string")
    return trees.final_paths(files(spark, sf_dir).select(F.col("relative_path").alias("path")), renames)


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames that form chains of up to five, and cycles of three."""
    o = mf.table(spark, sf_dir, "orders").select((F.floor(F.col("o_orderkey")).cast("long")).alias("k")).distinct()
    step = F.when(F.col("k") % 100 < 3, F.col("k") - F.col("k") % 100 + (F.col("k") % 100 + 1) % 3).otherwise(F.col("k") + 1)
    path = lambda c: F.concat(F.lit("/p/"), c.cast("string"))
    return o.filter("k % 100 < 3 or k % 6 <> 5").select(path(F.col("k")).alias("source"), path(step).alias("target"))


@query(
    """WITH RECURSIVE i AS (SELECT DISTINCT '/p/' || o_orderkey AS source, '/p/' || CASE WHEN o_orderkey % 100 < 3 THEN o_orderkey - o_orderkey % 100 + (o_orderkey % 100 + 1) % 3 ELSE o_orderkey + 1 END AS target FROM orders WHERE o_orderkey % 100 < 3 OR o_orderkey % 6 <> 5),
    l(source, target, level) AS (SELECT source, target, CAST(1 AS BIGINT) FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.source = i.target) UNION ALL SELECT i.source, i.target, l.level + 1 FROM i JOIN l ON i.target = l.source)
    SELECT i.source, i.target, level, level IS NULL AS cyclic FROM i LEFT JOIN l ON i.source = l.source"""
)
def rename_order(spark, sf_dir):
    return trees.rename_order(_chains(spark, sf_dir))


_CLASHES = """i AS (SELECT relative_path AS source, CASE id % 5 WHEN 0 THEN directory || '/x_' || id % 40 WHEN 1 THEN directory || '/Y_' || id // 10 WHEN 2 THEN directory || '/y_' || id // 10
    WHEN 3 THEN directory || '/' || repeat('z', 200 + id % 100) || id ELSE 'en/src1/doc_' || (id - id % 7 + 1) || '.mp4' END AS target FROM files WHERE id % 7 <> 1 OR id % 3 = 0)"""


@query(
    f"WITH {FILES}, {_CLASHES}, c AS (SELECT *, regexp_extract(target, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(target, '[^/]*$') AS name FROM i), "
    "f AS (SELECT dir, lower(name) AS folded, count(DISTINCT target) AS spellings FROM c GROUP BY 1, 2) "
    "SELECT source, target, 'PLANNED_TARGET_COLLISION' AS conflict FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM i) WHERE n > 1 "
    "UNION ALL SELECT source, target, 'CASE_ONLY_COLLISION' FROM c JOIN f ON c.dir = f.dir AND lower(name) = folded WHERE spellings > 1 "
    "UNION ALL SELECT source, target, 'TARGET_OCCUPIED' FROM i WHERE target IN (SELECT relative_path FROM files) AND target NOT IN (SELECT source FROM i) "
    "UNION ALL SELECT source, target, 'NAME_TOO_LONG' FROM c WHERE strlen(name) > 255"
)
def rename_conflicts(spark, sf_dir):
    f = files(spark, sf_dir).filter("id % 7 <> 1 or id % 3 = 0").withColumn("directory", paths.parent(F.col("relative_path")))
    i, tenth = F.col("id"), F.floor(F.col("id") / 10).cast("string")
    join = lambda *parts: F.concat("directory", F.lit("/"), *parts)
    target = (
        F.when(i % 5 == 0, join(F.lit("x_"), (i % 40).cast("string")))
        .when(i % 5 == 1, join(F.lit("Y_"), tenth))
        .when(i % 5 == 2, join(F.lit("y_"), tenth))
        .when(i % 5 == 3, join(F.repeat(F.lit("z"), 200 + (i % 100).cast("int")), i.cast("string")))
        .otherwise(F.concat(F.lit("en/src1/doc_"), (i - i % 7 + 1).cast("string"), F.lit(".mp4")))
    )
    return trees.conflicts(f.select(F.col("relative_path").alias("source"), target.alias("target")), files(spark, sf_dir).select(F.col("relative_path").alias("path")))


@query(
    """WITH RECURSIVE i AS (SELECT '/p/' || doc_id AS source, '/p/' || (doc_id + 1) AS target, doc_id FROM documents WHERE doc_id % 10 <> 9), ex AS (SELECT '/p/' || doc_id AS path FROM documents),
    bad AS (SELECT source, target, doc_id FROM i WHERE EXISTS (SELECT 1 FROM ex WHERE path = target) AND NOT EXISTS (SELECT 1 FROM i j WHERE j.source = i.target)),
    stuck(source, target, doc_id) AS (SELECT source, target, doc_id FROM bad UNION SELECT i.source, i.target, i.doc_id FROM i JOIN stuck ON i.target = stuck.source)
    SELECT source, target, CASE WHEN source IN (SELECT source FROM bad) THEN 'TARGET_OCCUPIED' ELSE 'BLOCKED_OCCUPANT' END AS conflict FROM stuck"""
)
def blocked_renames(spark, sf_dir):
    d = mf.table(spark, sf_dir, "documents")
    path = lambda c: F.concat(F.lit("/p/"), c.cast("string"))
    items = d.filter("doc_id % 10 <> 9").select(path(F.col("doc_id")).alias("source"), path(F.col("doc_id") + 1).alias("target"))
    return trees.blocked(items, d.select(path(F.col("doc_id")).alias("path")))


@query("SELECT conv_id AS plan_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS step, CASE role WHEN 'user' THEN 'rename' WHEN 'assistant' THEN 'restore' ELSE 'move' END AS operation, '/b/' || conv_id || '_' || turn AS source, '/a/' || conv_id || '_' || turn AS target FROM conversations")
def undo_plan(spark, sf_dir):
    return lifecycle.undo(mf.journal(spark, sf_dir))


@query(f"WITH {FILES}, r AS (SELECT id, absolute_path AS s0, root_key || '/' || directory || '/new_' || basename AS s1 FROM files WHERE root_key = '/data/r1' AND size >= 500) SELECT id, 1 AS step, 'rename' AS operation, s0 AS source, s1 AS target, false AS conflict FROM r UNION ALL SELECT id, 2, 'move', s1, '/data/out/' || 'new_doc_' || id || '.' || ['jpg','mp4','txt','PDF','zip','mp3','dat'][id % 7 + 1], false FROM r")
def workflow_file(spark, sf_dir):
    steps = [
        {"type": "scan", "roots": ["/data/r1"]},
        {"type": "filter", "where": _leaf("size", "gte", 500)},
        {"type": "rename", "mode": "add_prefix", "value": "new_"},
        {"type": "move", "to": "/data/out"},
    ]
    return workflow.compile_workflow(files(spark, sf_dir), steps)


# ---------------------------------------------------------------- layout and names


@query(f"WITH {PACKAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY package, kind ORDER BY name) AS rn FROM pk) SELECT package, name, kind || CASE WHEN (rn - 1) // 200 = 0 THEN '' ELSE '_' || ((rn - 1) // 200) END AS bucket, (rn - 1) % 200 + 1 AS position, CASE WHEN kind = 'Other' THEN name ELSE lpad(CAST((rn - 1) % 200 + 1 AS VARCHAR), 3, '0') || '.' || string_split(name, '.')[2] END AS new_name FROM n")
def package_buckets(spark, sf_dir):
    return layout.buckets(mf.packages(spark, sf_dir), ["name"]).select("package", "name", "bucket", "position", "new_name")


@query(f"WITH {PACKAGES}, n AS (SELECT *, kind || CASE WHEN (row_number() OVER (PARTITION BY package, kind ORDER BY name, bytes) - 1) // 200 = 0 THEN '' ELSE '_' || ((row_number() OVER (PARTITION BY package, kind ORDER BY name, bytes) - 1) // 200) END AS bucket FROM pk), g AS (SELECT package, bucket, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM n GROUP BY 1, 2), t AS (SELECT *, CASE WHEN total_bytes >= 1099511627776 THEN (total_bytes * 10 + 549755813888) // 1099511627776 WHEN total_bytes >= 1073741824 THEN (total_bytes * 10 + 536870912) // 1073741824 WHEN total_bytes >= 1048576 THEN (total_bytes * 10 + 524288) // 1048576 WHEN total_bytes >= 1024 THEN (total_bytes * 10 + 512) // 1024 END AS tenths, CASE WHEN total_bytes >= 1099511627776 THEN 'TiB' WHEN total_bytes >= 1073741824 THEN 'GiB' WHEN total_bytes >= 1048576 THEN 'MiB' ELSE 'KiB' END AS unit FROM g) SELECT package, bucket, files, total_bytes, bucket || ' [' || files || ' ' || CASE WHEN total_bytes < 1024 THEN total_bytes || 'B' WHEN tenths % 10 = 0 THEN (tenths // 10) || unit ELSE (tenths // 10) || '.' || (tenths % 10) || unit END || ']' AS label FROM t")
def package_labels(spark, sf_dir):
    return layout.bucket_labels(layout.buckets(mf.packages(spark, sf_dir), ["name", "bytes"]))


@query(f"WITH {PACKAGES} SELECT package, count(*) AS files, count_if(kind = 'P') AS p, count_if(kind = 'V') AS v, count_if(kind = 'Other') AS other, CASE WHEN count(*) <= 200 AND count_if(kind = 'Other') = 0 AND (count_if(kind = 'P') = 0 OR count_if(kind = 'V') = 0) THEN 'flatten' ELSE 'buckets' END AS operation FROM pk GROUP BY 1")
def package_shape(spark, sf_dir):
    return layout.package_shape(mf.packages(spark, sf_dir))


@query(f"WITH {FILES} SELECT id, lpad(CAST(rn AS VARCHAR), CAST(greatest(4, length(CAST(rn AS VARCHAR))) AS INT), '0') || suffix AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY root_key, directory ORDER BY id) + 9 AS rn FROM files)")
def file_numbering(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("directory", paths.parent(F.col("relative_path")))
    return layout.numbering(f, ["root_key", "directory"], [paths.natural_key(F.col("basename")), "basename"], 10, 4).select("id", "new_name")


@query(f"WITH {FILES}, e AS (SELECT root_key, directory AS parent, basename, mtime_ns // 100000000000000 AS m FROM files), t AS (SELECT *, max(m) OVER (PARTITION BY root_key, parent) AS top FROM e) SELECT root_key, parent, CASE WHEN count(*) = 1 THEN min(basename) END AS child, count(*) > 1 AS conflict FROM t WHERE m = top GROUP BY 1, 2")
def latest_child(spark, sf_dir):
    f = files(spark, sf_dir)
    coarse = F.floor(F.col("mtime_ns") / F.lit(100_000_000_000_000)).cast("long")
    return layout.latest_child(f.select("root_key", paths.parent(F.col("relative_path")).alias("parent"), "basename", coarse.alias("mtime_ns")))


@query(f"WITH {FILES}, k AS (SELECT *, CASE ext WHEN 'jpg' THEN 'P' WHEN 'mp4' THEN 'V' ELSE 'Other' END AS kind FROM files), d AS (SELECT root_key, directory, count(DISTINCT kind) FILTER (kind <> 'Other') AS kinds, count_if(kind = 'Other') AS others FROM k GROUP BY 1, 2) SELECT id, CASE WHEN kinds > 1 OR others > 0 THEN 'move' ELSE 'skipped_pure' END AS status, CASE WHEN kinds > 1 OR others > 0 THEN directory || '/' || kind || '/' || basename END AS target FROM k JOIN d USING (root_key, directory) WHERE kind <> 'Other'")
def media_sort(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("directory", paths.parent(F.col("relative_path"))).withColumn("kind", md.bucket_kind(F.col("suffix")))
    others = F.count_if(F.col("kind") == "Other").over(Window.partitionBy("root_key", "directory"))
    return layout.smart_targets(f.withColumn("other_files", others)).select("id", "status", "target")


@query("SELECT event_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN ((n * 200 + 1024) // 2048) // 100 || '.' || lpad(CAST(((n * 200 + 1024) // 2048) % 100 AS VARCHAR), 2, '0') || ' KB' ELSE ((n * 200 + 1048576) // 2097152) // 100 || '.' || lpad(CAST(((n * 200 + 1048576) // 2097152) % 100 AS VARCHAR), 2, '0') || ' MB' END AS size_text FROM (SELECT event_id, (event_id * event_id * 37) % 50000000 AS n FROM events)")
def size_texts(spark, sf_dir):
    n = (F.col("event_id") * F.col("event_id") * 37) % 50_000_000
    return mf.table(spark, sf_dir, "events").select("event_id", names.size_text(n).alias("size_text"))


@query(f"WITH {FILES} SELECT id, 'z' || stem || suffix AS prefixed, stem || '_v2' || suffix AS suffixed, replace(stem, 'doc', 'file') || suffix AS replaced, CASE WHEN ends_with(stem, '1') THEN left(stem, length(stem) - 1) || 'one' ELSE stem END || suffix AS retailed FROM files")
def file_renames(spark, sf_dir):
    n = F.col("basename")
    return files(spark, sf_dir).select(
        "id",
        names.rename(n, "add_prefix", value="z").alias("prefixed"),
        names.rename(n, "add_suffix", value="_v2").alias("suffixed"),
        names.rename(n, "replace_name", "doc", "file").alias("replaced"),
        names.rename(n, "replace_suffix", "1", "one").alias("retailed"),
    )


@query(f"WITH {FILES} SELECT id, basename || '.bak' AS appended, CASE WHEN suffix <> '.txt' THEN stem || '.txt' END AS changed, CASE WHEN suffix = '.txt' THEN 'NO_CHANGE' END AS reason FROM files")
def suffix_transform(spark, sf_dir):
    n = F.col("basename")
    changed = names.suffix_transform(n, "change", "txt")
    return files(spark, sf_dir).select("id", names.suffix_transform(n, "append", ".bak").target.alias("appended"), changed.target.alias("changed"), changed.reason.alias("reason"))


_AUDIT_NAME = "CASE doc_id % 6 WHEN 0 THEN ' lead' || doc_id || '.txt' WHEN 1 THEN 'con.txt' WHEN 2 THEN 'a' || doc_id || '.pdf.exe' WHEN 3 THEN 'q?' || doc_id WHEN 4 THEN 'x.jpg.JPG' ELSE 'fine' || doc_id || '.md' END"


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'edge_whitespace' WHEN 1 THEN 'windows_reserved_device' WHEN 2 THEN 'suspicious_double_extension' WHEN 3 THEN 'windows_invalid_character' WHEN 4 THEN 'repeated_extension' ELSE '' END AS issues FROM documents")
def filename_audit(spark, sf_dir):
    docs = mf.table(spark, sf_dir, "documents").withColumn("name", F.expr(_AUDIT_NAME))
    return docs.select("doc_id", F.array_join(names.audit(F.col("name")), ",").alias("issues"))


@query("SELECT issue, count(*) AS files FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'edge_whitespace' WHEN 1 THEN 'windows_reserved_device' WHEN 2 THEN 'suspicious_double_extension' WHEN 3 THEN 'windows_invalid_character' WHEN 4 THEN 'repeated_extension' END AS issue FROM documents) WHERE issue IS NOT NULL GROUP BY 1")
def filename_audit_counts(spark, sf_dir):
    docs = mf.table(spark, sf_dir, "documents").withColumn("name", F.expr(_AUDIT_NAME))
    return docs.select(F.explode(names.audit(F.col("name"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("files"))


@query("SELECT doc_id, lang || ' (' || source || ')' || CASE WHEN doc_id % 2 = 1 THEN ' odd ' || doc_id ELSE '' END AS rendered FROM documents")
def template_names(spark, sf_dir):
    odd = F.when(F.col("doc_id") % 2 == 1, F.col("doc_id").cast("string")).otherwise("")
    values = {"lang": F.col("lang"), "source": F.col("source"), "odd": odd}
    return mf.table(spark, sf_dir, "documents").select("doc_id", names.render("{lang} ({source}){?odd: odd {odd}}", values).alias("rendered"))


@query("SELECT doc_id, lang || '/' || source AS normalized FROM documents")
def normalized_paths(spark, sf_dir):
    raw = F.concat(F.lit("./"), "lang", F.lit("//x/../"), "source", F.lit("/."))
    return mf.table(spark, sf_dir, "documents").select("doc_id", paths.normalized(raw).alias("normalized"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 30000.0 / 1001.0 ELSE NULL END AS rate FROM events")
def frame_rates(spark, sf_dir):
    text = F.element_at(F.array(F.lit("25"), F.lit("30000/1001"), F.lit("N/A"), F.lit("1/0")), (F.col("event_id") % 4 + 1).cast("int"))
    return mf.table(spark, sf_dir, "events").select("event_id", md.rational(text).alias("rate"))


@query("SELECT page_id, regexp_replace(url, '(?i)(token|secret)(=)\\S+', '\\1\\2***', 'g') AS shown FROM (SELECT page_id, url || ' token=abc' || page_id AS url FROM pages)")
def redacted_logs(spark, sf_dir):
    text = F.concat("url", F.lit(" token=abc"), F.col("page_id").cast("string"))
    return mf.table(spark, sf_dir, "pages").select("page_id", names.redacted(text).alias("shown"))


# ---------------------------------------------------------------- lists, schedules, states


@query("SELECT event_id, event_type FROM events WHERE event_type ILIKE '%c_i%' ORDER BY event_id DESC LIMIT 50")
def audit_list(spark, sf_dir):
    e = mf.table(spark, sf_dir, "events")
    return lifecycle.listed(e, [F.col("event_id").desc()], 1, 50, lifecycle.search("event_type", "c_i")).select("event_id", "event_type")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 30 OFFSET 30")
def journal_list(spark, sf_dir):
    rows = mf.table(spark, sf_dir, "conversations")
    return lifecycle.listed(rows, [F.col("conv_id").desc(), F.col("turn").desc()], 2, 30, F.col("role") == "user").select("conv_id", "turn")


@query("SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.k'), '0') <> '1' ORDER BY event_id DESC LIMIT 40")
def job_list(spark, sf_dir):
    shown = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")) != "1"
    return lifecycle.listed(mf.table(spark, sf_dir, "events"), [F.col("event_id").desc()], 1, 40, shown).select("event_id")


@query("WITH l AS (SELECT user_id, event_type AS path, max(ts) AS last_used_at FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used_at DESC, path) AS rn FROM l) SELECT user_id, path, last_used_at, rn FROM r WHERE rn <= 2")
def recent_paths(spark, sf_dir):
    e = mf.table(spark, sf_dir, "events")
    return lifecycle.recent_paths(e.select("user_id", F.col("event_type").alias("path"), "ts"), 2)


@query("SELECT event_id, CASE WHEN event_id % 200 <= 15 THEN 'online' WHEN event_id % 200 <= 60 THEN 'stale' ELSE 'offline' END AS status FROM events")
def worker_status(spark, sf_dir):
    return mf.table(spark, sf_dir, "events").select("event_id", lifecycle.worker_status(F.col("event_id") % 200).alias("status"))


_STATES = "['queued','running','paused','completed','failed'][event_id % 5 + 1]"


@query(
    f"WITH h AS (SELECT user_id AS job, event_id AS seq, {_STATES} AS state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY seq) AS before FROM h) "
    "SELECT job, seq, CASE before WHEN 'queued' THEN state IN ('running', 'paused') WHEN 'running' THEN state IN ('paused', 'completed', 'failed') WHEN 'paused' THEN state = 'queued' WHEN 'completed' THEN false WHEN 'failed' THEN false ELSE state = 'queued' END AS valid FROM b"
)
def job_transitions(spark, sf_dir):
    states = F.array(*map(F.lit, ["queued", "running", "paused", "completed", "failed"]))
    history = mf.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"), F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("state"))
    return lifecycle.transitions(history).select("job", "seq", "valid")


@query(
    "WITH due AS (SELECT DISTINCT user_id AS schedule_id, event_id % 20 AS slot, user_id % 7 <> 0 AS enabled, event_id % 20 < 3 AS late FROM events), runs AS (SELECT user_id AS schedule_id, event_id % 20 AS slot, event_id % 11 = 0 AS active FROM events WHERE event_id % 3 = 0) "
    "SELECT schedule_id, slot, CASE WHEN NOT enabled THEN 'not_due' WHEN EXISTS (SELECT 1 FROM runs r WHERE r.schedule_id = d.schedule_id AND r.slot = d.slot) THEN 'duplicate_slot' WHEN late THEN 'missed_skipped' WHEN EXISTS (SELECT 1 FROM runs r WHERE r.schedule_id = d.schedule_id AND active) THEN 'skipped_overlap' ELSE 'dispatched' END AS outcome FROM due d"
)
def schedule_slots(spark, sf_dir):
    e = mf.table(spark, sf_dir, "events").select(F.col("user_id").alias("schedule_id"), (F.col("event_id") % 20).alias("slot"), "event_id")
    due = e.select("schedule_id", "slot", (F.col("schedule_id") % 7 != 0).alias("enabled"), (F.col("slot") < 3).alias("late"))
    runs = e.filter("event_id % 3 = 0").select("schedule_id", "slot", (F.col("event_id") % 11 == 0).alias("active"))
    return lifecycle.slots(due, runs)


@query("SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS inside FROM events")
def active_window(spark, sf_dir):
    inside = schedules.inside_window(F.col("ts").cast("timestamp"), "UTC", "22:00", "06:00")
    return mf.table(spark, sf_dir, "events").select("event_id", inside.alias("inside"))


@query("SELECT event_id, least(8, CASE WHEN event_id % 3 = 0 THEN event_id % 10 END, CASE WHEN event_id % 5 = 0 THEN event_id % 4 END) AS cap FROM events")
def thread_caps(spark, sf_dir):
    a = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 10)
    b = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 4)
    return mf.table(spark, sf_dir, "events").select("event_id", schedules.thread_cap(F.lit(8).cast("long"), a, b).alias("cap"))


@query(f"WITH {FILES} SELECT id AS item_id, CASE WHEN id % 11 = 0 THEN 'SOURCE_MISSING' WHEN id % 7 = 0 THEN 'IDENTITY_CHANGED' WHEN id % 5 = 0 THEN 'SIZE_CHANGED' WHEN id % 3 = 0 THEN 'MTIME_CHANGED' END AS reason FROM files")
def plan_freshness(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("path", F.col("absolute_path"))
    now = f.filter("id % 11 <> 0").withColumn("inode", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("inode")))
    now = now.withColumn("size", F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    now = now.withColumn("mtime_ns", F.when(F.col("id") % 3 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")))
    return lifecycle.freshness(f.withColumn("item_id", F.col("id")), now)


@query(f"WITH {FILES} SELECT absolute_path AS path, CASE WHEN id % 13 = 0 THEN 'unknown' WHEN id % 4 = 0 THEN 'established' WHEN id % 9 = 0 THEN 'changed' ELSE 'verified' END AS status FROM files")
def media_integrity(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("path", F.col("absolute_path")).withColumn("readable", F.col("id") % 13 != 0)
    base = f.filter("id % 4 <> 0").withColumn("content_hash", F.when(F.col("id") % 9 == 0, "stale").otherwise(F.col("content_hash")))
    return lifecycle.integrity(f, base)


@query("SELECT o_orderkey AS plan_id, o_orderstatus AS status FROM orders WHERE NOT (o_orderstatus IN ('F') AND NOT EXISTS (SELECT 1 FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = o_orderkey))")
def plan_history(spark, sf_dir):
    plans = mf.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.col("o_orderstatus").alias("status"))
    active = mf.table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("plan_id"))
    return lifecycle.without(plans, active, "plan_id", ["F"])
