"""Queries of whole plans: the order of operations, and runs in which decisions depend on one another; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import dedupe, dedupe_run, flatten, ordering
from cairn.registry import query
from cairn.sources import manifest as mf

#: Chains, moves that wait for moves of later steps, three-step swaps, cycles, and files that pass through a path.
OPERATIONS = """ops AS (
  SELECT id, step, operation, source, target, row_number() OVER (PARTITION BY id ORDER BY step) - 1 AS op FROM (
    SELECT doc_id AS id, 1 AS step, 'rename' AS operation, '/p/' || doc_id AS source, '/p/' || (doc_id + 1) AS target FROM documents WHERE doc_id % 10 < 6
    UNION ALL SELECT doc_id, 2, 'move', '/p/' || doc_id, '/q/' || doc_id FROM documents WHERE doc_id % 10 = 6
    UNION ALL SELECT doc_id, 1, 'rename', '/p/' || doc_id, CASE WHEN doc_id % 40 = 7 THEN '/p/' || (doc_id + 1) ELSE '/t/' || doc_id END FROM documents WHERE doc_id % 10 = 7
    UNION ALL SELECT doc_id, 2, 'rename', '/t/' || doc_id, '/p/' || (doc_id + 1) FROM documents WHERE doc_id % 10 = 7 AND doc_id % 40 <> 7
    UNION ALL SELECT doc_id, 1, 'rename', '/p/' || doc_id, '/p/' || (doc_id - 1) FROM documents WHERE doc_id % 10 = 8
    UNION ALL SELECT doc_id, 1, 'touch', '/p/' || doc_id, NULL FROM documents WHERE doc_id % 10 = 9
    UNION ALL SELECT doc_id, 3, 'move', '/p/' || doc_id, '/hub/' || (doc_id // 100) FROM documents WHERE doc_id % 10 = 9 AND doc_id % 50 <> 9
    UNION ALL SELECT doc_id, 4, 'quarantine', CASE WHEN doc_id % 50 <> 9 THEN '/hub/' || (doc_id // 100) ELSE '/p/' || doc_id END, NULL FROM documents WHERE doc_id % 10 = 9 AND doc_id % 50 <> 19
    UNION ALL SELECT doc_id, 3, 'move', '/p/' || (doc_id + 1), '/p/' || (doc_id + 5) FROM documents WHERE doc_id % 10 = 4
    UNION ALL SELECT doc_id, 4, 'move', '/p/' || (doc_id + 5), '/s/' || doc_id FROM documents WHERE doc_id % 20 = 4))"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files of a workflow of four steps."""
    d, r = F.col("doc_id"), F.col("doc_id") % 10
    at = lambda folder, number: F.concat(F.lit(f"/{folder}/"), number.cast("string"))
    op = lambda when, step, kind, source, target: F.when(when, F.struct(F.lit(step).alias("step"), F.lit(kind).alias("operation"), source.alias("source"), target.alias("target")))
    own, none, hub = at("p", d), F.lit(None).cast("string"), at("hub", F.floor(d / 100))
    made = [
        op(r < 6, 1, "rename", own, at("p", d + 1)),
        op(r == 6, 2, "move", own, at("q", d)),
        op(r == 7, 1, "rename", own, F.when(d % 40 == 7, at("p", d + 1)).otherwise(at("t", d))),
        op((r == 7) & (d % 40 != 7), 2, "rename", at("t", d), at("p", d + 1)),
        op(r == 8, 1, "rename", own, at("p", d - 1)),
        op(r == 9, 1, "touch", own, none),
        op((r == 9) & (d % 50 != 9), 3, "move", own, hub),
        op((r == 9) & (d % 50 != 19), 4, "quarantine", F.when(d % 50 != 9, hub).otherwise(own), none),
        op(r == 4, 3, "move", at("p", d + 1), at("p", d + 5)),
        op(d % 20 == 4, 4, "move", at("p", d + 5), at("s", d)),
    ]
    docs = mf.table(spark, sf_dir, "documents").select("doc_id")
    return docs.select(d.alias("id"), F.explode(F.array_compact(F.array(*made))).alias("o")).select("id", "o.*")


@query(
    f"""WITH RECURSIVE {OPERATIONS},
    m AS (SELECT * FROM ops WHERE target <> source),
    e AS (SELECT a.id AS ai, a.step AS ast, b.id AS bi, b.step AS bst FROM ops a JOIN ops b ON a.id = b.id AND b.op = a.op + 1
      UNION SELECT y.id, y.step, x.id, x.step FROM m x JOIN m y ON y.source = x.target AND y.id <> x.id),
    r(ai, ast, bi, bst) AS (SELECT * FROM e UNION SELECT r.ai, r.ast, e.bi, e.bst FROM r JOIN e ON r.bi = e.ai AND r.bst = e.ast),
    round AS (SELECT ai, ast FROM r WHERE ai = bi AND ast = bst),
    bad AS (SELECT ai AS id, ast AS step FROM round UNION SELECT r.bi, r.bst FROM r JOIN round USING (ai, ast)),
    good AS (SELECT * FROM ops ANTI JOIN bad USING (id, step)),
    l(id, step, level) AS (SELECT id, step, CAST(1 AS BIGINT) FROM good UNION SELECT good.id, good.step, level + 1 FROM l JOIN e ON l.id = ai AND l.step = ast JOIN good ON good.id = bi AND good.step = bst),
    g AS (SELECT id, step, max(level) AS level FROM l GROUP BY ALL)
    SELECT ops.*, level, CASE WHEN level IS NOT NULL THEN row_number() OVER (ORDER BY level, ops.step, op, ops.id, source) END AS sequence, level IS NULL AS cyclic
    FROM ops LEFT JOIN g ON ops.id = g.id AND ops.step = g.step"""
)
def operation_order(spark, sf_dir):
    return ordering.operation_order(operations(spark, sf_dir))


@query(
    f"""WITH {OPERATIONS}, m AS (SELECT * FROM ops WHERE target <> source),
    x AS (SELECT '/p/' || doc_id AS path FROM documents UNION ALL SELECT '/s/' || doc_id FROM documents WHERE doc_id % 100 = 4),
    z AS (SELECT id, step, target, coalesce(target, source) AS path, operation FROM ops QUALIFY step = max(step) OVER (PARTITION BY id))
    SELECT id, step, 'STEP_COLLISION' AS problem FROM (SELECT *, count(*) OVER (PARTITION BY step, target) AS n FROM m) WHERE n > 1
    UNION ALL SELECT id, step, 'FINAL_COLLISION' FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM z WHERE operation <> 'quarantine') WHERE n > 1 AND target IS NOT NULL
    UNION ALL SELECT id, step, CASE WHEN target NOT IN (SELECT source FROM ops WHERE op = 0) THEN 'TARGET_EXISTS' ELSE 'TARGET_NOT_VACATED' END FROM m
      WHERE target IN (SELECT path FROM x) AND (target NOT IN (SELECT source FROM ops WHERE op = 0) OR target NOT IN (SELECT source FROM m))"""
)
def operation_problems(spark, sf_dir):
    d = mf.table(spark, sf_dir, "documents")
    path = lambda folder: F.concat(F.lit(f"/{folder}/"), F.col("doc_id").cast("string")).alias("path")
    return ordering.operation_problems(operations(spark, sf_dir), d.select(path("p")).union(d.filter("doc_id % 100 = 4").select(path("s"))))


def _shelved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files in many small directories, three deep, some of them full of copies; one file in nine may not be kept."""
    f = mf.files(spark, sf_dir).drop("relative_path", "absolute_path")
    shelf = F.concat("lang", F.lit("/"), "source", F.lit("/b"), F.pmod(F.crc32(F.substring("content_hash", 1, 12).cast("binary")), F.lit(40)).cast("string"))
    deep = F.concat(shelf, F.when(F.col("id") % 3 == 0, F.lit("/c")).otherwise(F.lit("")))
    f = f.withColumn("directory", deep).withColumn("relative_path", F.concat("directory", F.lit("/"), "basename"))
    return f.withColumn("absolute_path", F.concat("root_key", F.lit("/"), "relative_path")).withColumn("eligible", F.col("id") % 9 != 4)


@query()
def dedupe_run_protected(spark, sf_dir):
    """Scores, ties, balance over directories and protection of last files at every height, in one run."""
    f = _shelved(spark, sf_dir)
    scored = dedupe.scored(f, ["en/*", "*/src1*"], 5, [".pdf", ".jpg"], 3, "none", 0)
    below = f.select("root_key", F.explode(paths.ancestors(F.col("relative_path"))).alias("directory"))
    counts = below.groupBy("root_key", "directory").agg(F.count("*").alias("files"))
    return dedupe_run.run(scored, mf.ROOTS, counts)


# ---------------------------------------------------------------- flattening

#: Shelves of sixteen documents, each document one kind of move out of the shelf's wrapper; some shelves differ as a whole.
_SHELVES = """d AS (SELECT doc_id AS id, doc_id // 16 AS k, doc_id % 16 AS r, '/data/r' || ((doc_id // 16) % 4) || '/s' || (doc_id // 16) AS shelf FROM documents),
  i AS (SELECT id, k, r, shelf || '/w/' || id || '.txt' AS source, shelf || '/w' AS wrapper, CASE
      WHEN r = 0 AND k % 3 = 1 THEN shelf || '/w/' || (id + 15) || '.txt' WHEN r = 0 AND k % 7 = 3 THEN '/data/r' || ((k + 1) % 4) || '/' || id || '.txt' WHEN r = 0 AND k % 7 = 5 THEN '/other/' || id || '.txt'
      WHEN r IN (8, 9) THEN shelf || '/same.txt' WHEN r = 10 THEN shelf || '/Ab.txt' WHEN r = 11 THEN shelf || '/aB.txt' WHEN r = 12 THEN '/data/r0/trash/' || id WHEN r = 13 THEN shelf || '/' || repeat('n', 300)
      WHEN r = 14 THEN shelf || '/w/' || (id - 8) || '.txt' WHEN r = 15 AND k % 11 = 4 AND k % 3 <> 1 THEN shelf || '/' || (id - 15) || '.txt/in.txt' WHEN r = 15 THEN shelf || '/w/' || (id - 15) || '.txt'
      ELSE shelf || '/' || id || '.txt' END AS target, shelf FROM d),
  e AS (SELECT source AS path, CASE r WHEN 2 THEN 'symlink' WHEN 3 THEN 'other' WHEN 4 THEN 'directory' ELSE 'file' END AS kind, id AS inode, CASE r WHEN 5 THEN 2 ELSE 1 END AS mtime_ns FROM i WHERE r <> 1
    UNION ALL SELECT DISTINCT wrapper, CASE WHEN k % 10 = 7 THEN 'symlink' ELSE 'directory' END, -k - 1, CASE WHEN k % 10 = 2 THEN 2 ELSE 1 END FROM i
    UNION ALL SELECT target, CASE r WHEN 7 THEN 'symlink' ELSE 'file' END, id + 1000000000, 1 FROM i WHERE r IN (6, 7)
    UNION ALL SELECT shelf || '/' || id || '.TXT', 'file', id + 2000000000, 1 FROM i WHERE r = 0 AND k % 5 = 1)"""


def _shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mf.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 16).alias("k"), (F.col("doc_id") % 16).alias("r"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    i, k, r, shelf = F.col("id"), F.col("k"), F.col("r"), F.col("shelf")
    d = d.withColumn("shelf", text("/data/r", k % 4, "/s", k))
    target = (
        F.when((r == 0) & (k % 3 == 1), text(shelf, "/w/", i + 15, ".txt"))
        .when((r == 0) & (k % 7 == 3), text("/data/r", (k + 1) % 4, "/", i, ".txt"))
        .when((r == 0) & (k % 7 == 5), text("/other/", i, ".txt"))
        .when(r.isin(8, 9), text(shelf, "/same.txt"))
        .when(r == 10, text(shelf, "/Ab.txt"))
        .when(r == 11, text(shelf, "/aB.txt"))
        .when(r == 12, text("/data/r0/trash/", i))
        .when(r == 13, text(shelf, "/", F.repeat(F.lit("n"), 300)))
        .when(r == 14, text(shelf, "/w/", i - 8, ".txt"))
        .when((r == 15) & (k % 11 == 4) & (k % 3 != 1), text(shelf, "/", i - 15, ".txt/in.txt"))
        .when(r == 15, text(shelf, "/w/", i - 15, ".txt"))
        .otherwise(text(shelf, "/", i, ".txt"))
    )
    return d.withColumn("source", text(shelf, "/w/", i, ".txt")).withColumn("wrapper", text(shelf, "/w")).withColumn("target", target)


def _shelf_entries(moves: DataFrame) -> DataFrame:
    i, k, r = F.col("id"), F.col("k"), F.col("r")
    row = lambda df, path, kind, inode, mtime: df.select(path.alias("path"), kind.alias("kind"), F.lit(1).cast("long").alias("device"), inode.cast("long").alias("inode"), mtime.cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size"))
    one, file = F.lit(1), F.lit("file")
    kinds = F.when(r == 2, "symlink").when(r == 3, "other").when(r == 4, "directory").otherwise("file")
    out = row(moves.filter("r <> 1"), F.col("source"), kinds, i, F.when(r == 5, 2).otherwise(1))
    out = out.unionByName(row(moves.select("wrapper", "k").distinct(), F.col("wrapper"), F.when(k % 10 == 7, "symlink").otherwise("directory"), -k - 1, F.when(k % 10 == 2, 2).otherwise(1)))
    out = out.unionByName(row(moves.filter("r IN (6, 7)"), F.col("target"), F.when(r == 7, "symlink").otherwise("file"), i + 1_000_000_000, one))
    return out.unionByName(row(moves.filter("r = 0 AND k % 5 = 1"), F.concat("shelf", F.lit("/"), i.cast("string"), F.lit(".TXT")), file, i + 2_000_000_000, one))


@query(
    f"""WITH RECURSIVE {_SHELVES},
  s AS (SELECT i.*, e.kind, CASE WHEN w.kind <> 'directory' THEN 'WRAPPER_IDENTITY_CHANGED' WHEN e.kind IS NULL THEN 'SOURCE_MISSING' WHEN e.kind = 'symlink' THEN 'WRAPPER_CHILD_SYMLINK' WHEN e.kind = 'other' THEN 'UNSUPPORTED_OBJECT'
      WHEN e.kind = 'directory' THEN 'SOURCE_TYPE_CHANGED' WHEN e.mtime_ns <> 1 THEN 'SOURCE_IDENTITY_CHANGED' WHEN w.mtime_ns <> 1 THEN 'WRAPPER_IDENTITY_CHANGED' END AS problem
      FROM i LEFT JOIN e ON e.path = source JOIN e w ON w.path = wrapper),
  t AS (SELECT s.*, h.kind AS held, regexp_extract(target, '^(.*)/[^/]*$', 1) AS home, regexp_extract(target, '[^/]*$') AS name FROM s LEFT JOIN e h ON h.path = target WHERE problem IS NULL),
  c AS (SELECT source, target, held, list_filter([
      CASE WHEN held = 'symlink' THEN 'TARGET_SYMLINK' WHEN starts_with(target, '/data/r0/trash/') THEN 'RESERVED_TARGET' WHEN NOT regexp_matches(target, '^/data/r[0-3]/') THEN 'TARGET_OUTSIDE_ALLOWED_ROOT'
        WHEN strlen(name) > 255 THEN 'NAME_TOO_LONG' WHEN target[:8] <> source[:8] THEN 'TARGET_OUTSIDE_ALLOWED_ROOT' END,
      CASE WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'PLANNED_TARGET_COLLISION' END,
      CASE WHEN min(target) OVER f <> max(target) OVER f OR EXISTS (SELECT 1 FROM e WHERE e.path <> target AND lower(e.path) = lower(target)) THEN 'CASE_ONLY_COLLISION' END], lambda x: x IS NOT NULL) AS own
      FROM t WINDOW f AS (PARTITION BY home, lower(name))),
  x AS (SELECT source, target, CASE WHEN len(own) = 0 AND held IS NOT NULL AND target NOT IN (SELECT source FROM c) THEN ['TARGET_EXISTS'] ELSE own END AS own, held FROM c),
  v AS (SELECT y.source AS before, x.source AS after FROM x JOIN x y ON (y.source = x.target AND x.held IS NOT NULL) OR starts_with(y.source, x.target || '/')),
  b(source) AS (SELECT source FROM x WHERE len(own) > 0 UNION SELECT after FROM b JOIN v ON b.source = v.before),
  g AS (SELECT * FROM x ANTI JOIN b USING (source)),
  a AS (SELECT v.* FROM v JOIN g ON g.source = v.after WHERE v.before <> v.after UNION SELECT y.source, z.source FROM g y JOIN g z ON starts_with(z.target, y.target || '/')),
  q(before, after) AS (SELECT * FROM a UNION SELECT q.before, a.after FROM q JOIN a ON q.after = a.before),
  o AS (SELECT before AS source FROM q WHERE before = after UNION SELECT p.after FROM q p JOIN q ON p.before = q.before AND q.before = q.after),
  l(source, level) AS (SELECT source, CAST(1 AS BIGINT) FROM g WHERE source NOT IN (SELECT source FROM o) UNION SELECT a.after, level + 1 FROM l JOIN a ON l.source = a.before WHERE a.after NOT IN (SELECT source FROM o)),
  m AS (SELECT source, max(level) AS level FROM l GROUP BY 1)
  SELECT s.source, s.target, array_to_string(CASE WHEN problem IS NOT NULL THEN [problem] WHEN len(own) > 0 THEN list_sort(own) WHEN b.source IS NOT NULL THEN ['TARGET_EXISTS'] WHEN o.source IS NOT NULL THEN ['RENAME_CYCLE'] ELSE [] END, ',') AS conflicts,
    level, CASE WHEN level IS NOT NULL THEN row_number() OVER (ORDER BY level, s.source) END AS sequence
  FROM s LEFT JOIN x USING (source) LEFT JOIN (SELECT DISTINCT source FROM b) b USING (source) LEFT JOIN (SELECT DISTINCT source FROM o) o USING (source) LEFT JOIN m USING (source)"""
)
def flatten_resolution(spark, sf_dir):
    moves = _shelves(spark, sf_dir)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    items = moves.select("source", "target", "wrapper", F.lit(False).alias("is_dir"), one.alias("device"), F.col("id").alias("inode"), one.alias("mtime_ns"), zero.alias("size"))
    wrappers = moves.select("wrapper", "k").distinct().select(F.col("wrapper").alias("path"), one.alias("device"), (-F.col("k") - 1).alias("inode"), one.alias("mtime_ns"))
    found = flatten.resolve(items, _shelf_entries(moves), wrappers, mf.ROOTS, "/data/r0/trash")
    return found.withColumn("conflicts", F.array_join("conflicts", ","))


@query(
    f"""WITH {_SHELVES},
  w AS (SELECT CASE k % 8 WHEN 0 THEN wrapper || '/' WHEN 1 THEN source WHEN 2 THEN 'w' || id WHEN 3 THEN '/else/' || id ELSE wrapper END AS path FROM i WHERE r = 0 OR (r = 1 AND k % 8 NOT IN (4, 6))
    UNION ALL SELECT wrapper || '/' || id || '.txt' FROM i WHERE r = 4 AND k % 8 = 7 UNION ALL SELECT '/data/r' || k FROM i WHERE r = 0 AND k = 3),
  n AS (SELECT CASE WHEN ends_with(path, '/') THEN path[:-2] ELSE path END AS path, count(*) AS named FROM w GROUP BY 1),
  a AS (SELECT * FROM e UNION ALL SELECT '/data/r' || range, 'directory', -1000000000 - range, 1 FROM range(4) UNION ALL SELECT '/else/' || id, 'directory', -2000000000 - id, 1 FROM i WHERE r = 0 AND k % 8 = 3)
  SELECT n.path, CASE WHEN NOT starts_with(n.path, '/') THEN 'INVALID_CONFIG' WHEN kind IS NULL THEN 'SCOPE_NOT_FOUND' WHEN kind = 'symlink' THEN 'SYMLINK_BLOCKED' WHEN kind <> 'directory' THEN 'INVALID_CONFIG'
    WHEN NOT regexp_matches(n.path, '^/data/r[0-3]') THEN 'CROSS_ROOT' WHEN regexp_full_match(n.path, '/data/r[0-3]') THEN 'INVALID_CONFIG'
    WHEN named > 1 OR EXISTS (SELECT 1 FROM n m WHERE starts_with(m.path, n.path || '/') OR starts_with(n.path, m.path || '/')) THEN 'SCOPE_OVERLAP' END AS problem
  FROM n LEFT JOIN a ON a.path = n.path"""
)
def flatten_preflight(spark, sf_dir):
    moves = _shelves(spark, sf_dir)
    named = F.element_at(F.array(F.concat("wrapper", F.lit("/")), F.col("source"), F.concat(F.lit("w"), F.col("id").cast("string")), F.concat(F.lit("/else/"), F.col("id").cast("string")), *[F.col("wrapper")] * 4), (F.col("k") % 8 + 1).cast("int"))
    wrappers = moves.filter("r = 0 OR (r = 1 AND k % 8 NOT IN (4, 6))").select(named.alias("path")).union(moves.filter("r = 4 AND k % 8 = 7").select("source")).union(moves.filter("r = 0 AND k = 3").select(F.concat(F.lit("/data/r"), F.col("k").cast("string"))))
    roots = spark.range(4).select(F.concat(F.lit("/data/r"), F.col("id").cast("string")).alias("path"), F.lit("directory").alias("kind"), F.lit(1).cast("long").alias("device"), (-1_000_000_000 - F.col("id")).alias("inode"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size"))
    others = moves.filter("r = 0 AND k % 8 = 3").select(F.concat(F.lit("/else/"), F.col("id").cast("string")).alias("path"), F.lit("directory").alias("kind"), F.lit(1).cast("long").alias("device"), (-2_000_000_000 - F.col("id")).alias("inode"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size"))
    return flatten.preflight(wrappers, _shelf_entries(moves).unionByName(roots).unionByName(others), mf.ROOTS, "/data/r0/trash")
