"""Registered queries over lists and their pages, plans, jobs, media and histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import lifecycle, matching, plans, trees
from cairn.queries import DUPES, FILES, PACKAGES, files, packages
from cairn.registry import ORACLE_SQL, QUERIES, query
from cairn.sources import manifest as mf

# ---------------------------------------------------------------- pages of lists


def _page(name: str, table: str, sql: str, order: list[tuple[str, bool]], columns: list[str], where: Callable | None = None, condition: str = "true", number: int = 1, size: int = 25) -> None:
    """A query for one page of a list: a limit is the feature here."""

    def run(spark, sf_dir) -> DataFrame:  # noqa: ANN001
        rows = _LISTS[table](spark, sf_dir)
        keys = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
        return lifecycle.listed(rows, keys, number, size, where and where()).select(*columns)

    QUERIES[name] = run
    by = ", ".join(f"{c} {'DESC' if down else 'ASC'}" for c, down in order)
    ORACLE_SQL[name] = f"WITH {sql} SELECT {', '.join(columns)} FROM t WHERE {condition} ORDER BY {by} LIMIT {size} OFFSET {(number - 1) * size}"


_EVENTS = "t AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS flag, (event_id * 7919) % 1000 AS position FROM events)"
_ORDERS = "t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders)"


def _events(spark, sf_dir) -> DataFrame:
    e = mf.table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_id") % 3 == 0).alias("flag"), ((F.col("event_id") * 7919) % 1000).alias("position"))


def _orders(spark, sf_dir) -> DataFrame:
    return mf.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


_LISTS = {"events": _events, "orders": _orders, "groups": lambda s, d: matching.content_groups(files(s, d)).withColumn("id", F.col("content_hash"))}

_page("group_page", "groups", f"{DUPES}, t AS (SELECT content_hash, size, members FROM dup)", [("size", True), ("content_hash", False)], ["content_hash", "size", "members"], size=5)
_page("quarantine_page", "events", _EVENTS, [("event_id", True)], ["event_id", "event_type"], lambda: (F.col("event_type") == "click") & lifecycle.search("event_type", "LIC") & F.col("flag"), "event_type = 'click' AND event_type ILIKE '%LIC%' AND flag")
_page("task_page", "events", _EVENTS, [("event_id", True)], ["event_id", "event_type"], lambda: F.col("event_type").isin("purchase", "click"), "event_type IN ('purchase', 'click')", number=2)
_page("task_log_page", "events", _EVENTS, [("event_id", False)], ["event_id", "ts"], lambda: (F.col("user_id") == 7) & (F.col("event_type") == "click"), "user_id = 7 AND event_type = 'click'", size=50)
_page("plan_items_page", "orders", _ORDERS, [("o_orderkey", False)], ["o_orderkey", "o_orderstatus"], lambda: F.col("o_custkey") == 1, "o_custkey = 1", size=100)
_page("favourites_page", "events", _EVENTS, [("position", False), ("event_id", False)], ["event_id", "position"], lambda: F.col("user_id") == 3, "user_id = 3", size=500)
_page("verification_runs_page", "orders", _ORDERS, [("o_orderdate", True), ("o_orderkey", True)], ["o_orderkey", "o_orderdate"], number=3)
_page("verification_items_page", "orders", _ORDERS, [("o_orderkey", False)], ["o_orderkey", "o_orderstatus"], lambda: F.col("o_orderstatus") != "F", "o_orderstatus <> 'F'", size=200)
_page("schedules_page", "events", _EVENTS, [("event_id", False)], ["event_id", "flag"], lambda: F.col("flag"), "flag", number=2, size=40)
_page("schedule_runs_page", "events", _EVENTS, [("ts", True), ("event_id", True)], ["event_id", "ts"], lambda: F.col("user_id") == 5, "user_id = 5", size=20)
_page("due_schedules_page", "events", _EVENTS, [("ts", False), ("event_id", False)], ["event_id", "ts"], lambda: F.col("flag") & (F.col("ts") <= F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")), "flag AND ts <= TIMESTAMP '2024-01-03 00:00:00'", size=100)
_page("workflows_page", "orders", _ORDERS, [("o_orderkey", True)], ["o_orderkey"], lambda: F.col("o_orderstatus") != "P", "o_orderstatus <> 'P'", size=30)
_page("revisions_page", "orders", _ORDERS, [("o_orderdate", True), ("o_orderkey", False)], ["o_orderkey", "o_orderdate"], lambda: F.col("o_custkey") == 2, "o_custkey = 2", size=100)
_page("profiles_page", "events", _EVENTS, [("flag", True), ("ts", True), ("event_id", False)], ["event_id", "flag"], lambda: (F.col("flag") | (F.col("user_id") == 3)) & lifecycle.search("event_type", "c"), "(flag OR user_id = 3) AND event_type ILIKE '%c%'")


@query(
    f"WITH {FILES}, e AS (SELECT DISTINCT 0 AS type_rank, split_part(relative_path, '/', 2) AS name FROM files WHERE root_key = '/data/r1' AND starts_with(relative_path, 'en/') UNION SELECT 1, 'note' || (id % 40) || '.txt' FROM files) "
    "SELECT type_rank, name FROM e WHERE contains(lower(name), 'o') OR type_rank = 0 ORDER BY type_rank, regexp_extract(name, '^[^0-9]*'), CAST(regexp_extract(name, '[0-9]+') AS INTEGER), name LIMIT 20 OFFSET 5"
)
def browse_page(spark, sf_dir):
    f = files(spark, sf_dir)
    here = f.filter("root_key = '/data/r1' and relative_path like 'en/%'").select(F.lit(0).alias("type_rank"), F.split("relative_path", "/")[1].alias("name"))
    notes = f.select(F.lit(1).alias("type_rank"), F.concat(F.lit("note"), (F.col("id") % 40).cast("string"), F.lit(".txt")).alias("name"))
    entries = here.union(notes).distinct().filter((F.col("type_rank") == 0) | F.lower("name").contains("o"))
    return trees.browsed(entries, 5, 20)


# ---------------------------------------------------------------- joins and groups


@query(f"WITH {DUPES} SELECT content_hash, size, string_agg(root_key || '|' || relative_path, ',' ORDER BY root_key, relative_path) AS members FROM member GROUP BY 1, 2")
def group_members(spark, sf_dir):
    found = matching.grouped_members(matching.content_members(files(spark, sf_dir)), ["content_hash", "size"])
    return found.select("content_hash", "size", F.array_join(F.transform("members", lambda m: F.concat_ws("|", m.root_key, m.relative_path)), ",").alias("members"))


@query("WITH j AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS plan_id, event_id, event_type, row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY event_id DESC) AS rn FROM events) SELECT o_orderkey AS plan_id, event_id AS job, event_type AS kind FROM orders LEFT JOIN j ON plan_id = o_orderkey AND rn = 1")
def plans_with_jobs(spark, sf_dir):
    jobs = _events(spark, sf_dir).select(F.col("k").alias("plan_id"), F.col("event_id").alias("job"), F.col("event_type").alias("kind"))
    newest = matching.latest(jobs, ["plan_id"], [F.col("job").desc()])
    return mf.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id")).join(newest, "plan_id", "left").select("plan_id", "job", "kind")


@query(f"WITH {FILES} SELECT root_key, count(*) AS files, count(DISTINCT directory) AS folders FROM files GROUP BY 1")
def files_and_folders(spark, sf_dir):
    f = files(spark, sf_dir)
    entries = f.select("root_key", F.lit(False).alias("is_dir")).union(f.select("root_key", paths.parent(F.col("relative_path")).alias("d")).distinct().select("root_key", F.lit(True)))
    return entries.groupBy("root_key").agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders"))


@query(f"WITH {FILES} SELECT count(*) AS files, count_if(ext = 'jpg') AS images, count_if(ext = 'mp4') AS videos, count(DISTINCT directory) FILTER (directory <> 'en') AS folders, CAST(sum(size) AS BIGINT) AS total_bytes FROM files WHERE root_key = '/data/r2' AND starts_with(relative_path, 'en/')")
def tree_stats(spark, sf_dir):
    return trees.stats_below(files(spark, sf_dir).filter("root_key = '/data/r2'"), "en")


@query("SELECT count(DISTINCT o_custkey) AS plans, count(*) AS items, count(DISTINCT o_orderdate) AS scans FROM orders")
def legacy_plans(spark, sf_dir):
    o = mf.table(spark, sf_dir, "orders")
    return o.agg(F.countDistinct("o_custkey").alias("plans"), F.count("*").alias("items"), F.countDistinct("o_orderdate").alias("scans"))


@query("SELECT id FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events) WHERE id IS NOT NULL")
def dependency_ids(spark, sf_dir):
    old = mf.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return old.union(_events(spark, sf_dir).select("k")).distinct().filter("id is not null")


@query("SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS ids FROM (SELECT DISTINCT user_id, event_id % 50 AS k FROM events) GROUP BY 1")
def canonical_ids(spark, sf_dir):
    ids = _events(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("event_id") % 50)).alias("ids"))
    return ids.select("user_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {DUPES} SELECT content_hash, size, string_agg(DISTINCT root_key, ',' ORDER BY root_key) AS roots FROM member GROUP BY 1, 2")
def group_roots(spark, sf_dir):
    found = matching.content_members(files(spark, sf_dir)).groupBy("content_hash", "size").agg(F.sort_array(F.collect_set("root_key")).alias("roots"))
    return found.withColumn("roots", F.array_join("roots", ","))


@query("SELECT user_id AS source, event_type AS kind, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def distinct_conflicts(spark, sf_dir):
    found = _events(spark, sf_dir).select(F.col("user_id").alias("source"), F.col("event_type").alias("kind"), "event_id")
    return matching.first_of(found, ["source", "kind"], "event_id").select("source", "kind", F.col("event_id").alias("first_id"))


# ---------------------------------------------------------------- plans and digests


@query(f"WITH {FILES} SELECT root_key, sha256(string_agg(id || '|' || relative_path || '|' || size || '|' || mtime_ns, chr(10) ORDER BY relative_path)) AS digest, count(*) AS items FROM files GROUP BY 1")
def snapshot_digests(spark, sf_dir):
    return plans.digests(files(spark, sf_dir), ["root_key"], ["relative_path"], ["id", "relative_path", "size", "mtime_ns"])


@query(f"WITH {PACKAGES} SELECT package, sha256(string_agg(kind || '|' || name || '|' || bytes, chr(10) ORDER BY name, kind || '|' || name || '|' || bytes)) AS digest, count(*) AS items FROM pk GROUP BY 1")
def package_fingerprints(spark, sf_dir):
    return plans.digests(packages(spark, sf_dir), ["package"], ["name"], ["kind", "name", "bytes"])


@query(f"WITH {FILES}, up AS (SELECT root_key, unnest([root_key, root_key || '/' || split_part(relative_path, '/', 1), root_key || '/' || directory]) AS directory, relative_path, size FROM files) SELECT directory, count(*) AS items, sha256(string_agg(relative_path || '|' || size, chr(10) ORDER BY relative_path)) AS digest FROM up GROUP BY 1")
def protection_snapshots(spark, sf_dir):
    f = files(spark, sf_dir)
    inside = f.select(F.explode(paths.ancestors(F.col("relative_path"))).alias("below"), "root_key", "relative_path", "size")
    inside = inside.withColumn("directory", F.concat_ws("/", "root_key", F.nullif(F.col("below"), F.lit(""))))
    return plans.digests(inside, ["directory"], ["relative_path"], ["relative_path", "size"])


@query(f"WITH {FILES}, going AS (SELECT directory, root_key, count(*) AS n FROM files WHERE ext = 'dat' GROUP BY 1, 2) SELECT root_key, directory, count(*) AS files, coalesce(any_value(n), 0) AS scheduled, count(*) - coalesce(any_value(n), 0) >= 1 AS safe FROM files LEFT JOIN going USING (root_key, directory) GROUP BY 1, 2")
def protection_checks(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("directory", paths.parent(F.col("relative_path")))
    return plans.protection(f, f.filter("suffix = '.dat'"), ["root_key", "directory"])


@query(f"WITH {FILES} SELECT id, CASE WHEN id % 11 = 0 THEN 'SIZE' WHEN id % 7 = 0 THEN 'OWNER' WHEN id % 5 = 0 THEN 'MODE' END AS mismatch, CASE WHEN id % 11 = 0 OR id % 7 = 0 OR id % 5 = 0 THEN 0 ELSE size END AS reclaimed FROM files")
def hardlink_checks(spark, sf_dir):
    f = files(spark, sf_dir).select("id", "size", F.lit(33188).alias("mode"), F.lit(1000).alias("uid"), F.lit(1000).alias("gid"))
    other = f.select(F.col("id").alias("keep_id"), F.when(F.col("id") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("keep_size"), F.when(F.col("id") % 5 == 0, 33152).otherwise(33188).alias("keep_mode"), F.when(F.col("id") % 7 == 0, 0).otherwise(1000).alias("keep_uid"), F.lit(1000).alias("keep_gid"))
    return plans.linkable(f.join(other, F.col("id") == F.col("keep_id"))).select("id", "mismatch", "reclaimed")


@query(f"WITH {FILES} SELECT count_if(id % 11 <> 0 AND id % 7 <> 0) AS actionable, CAST(coalesce(sum(size) FILTER (id % 11 <> 0 AND id % 7 <> 0), 0) AS BIGINT) AS reclaim_bytes FROM files")
def storage_reclaim(spark, sf_dir):
    ok = (F.col("id") % 11 != 0) & (F.col("id") % 7 != 0)
    return files(spark, sf_dir).agg(F.count_if(ok).alias("actionable"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("reclaim_bytes"))


@query(f"WITH {FILES} SELECT id, '/data/.trash/' || (id % 4) || '/' || id || '/' || basename AS trash_path, root_key || '/' || directory || '/' || stem || '.restored-' || id || suffix AS restore_path, basename AS name FROM files")
def quarantine_paths(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("id", plans.trash_path(F.lit("/data/.trash"), F.col("id") % 4, F.col("id"), F.col("absolute_path")).alias("trash_path"), plans.restore_path(F.col("absolute_path"), F.col("id")).alias("restore_path"), F.col("basename").alias("name"))


@query(
    f"WITH {FILES}, a AS (SELECT id, id % 2 = 0 AS corrupt, id % 3 = 0 AS hashed, CASE WHEN id % 5 = 0 THEN size + 1 ELSE size END AS seen FROM files WHERE id % 7 <> 0) "
    "SELECT f.id, CASE WHEN a.id IS NULL THEN 'MEDIA_ASSET_NOT_FOUND' ELSE concat_ws(',', CASE WHEN NOT corrupt THEN 'MEDIA_NOT_CORRUPT' END, CASE WHEN NOT hashed THEN 'CORRUPT_SHA256_MISSING' END, CASE WHEN seen <> f.size THEN 'INDEX_EVIDENCE_CHANGED' END) END AS blockers, "
    "a.id IS NOT NULL AND corrupt AND hashed AND seen = f.size AS eligible FROM files f LEFT JOIN a ON f.id = a.id"
)
def corrupt_delete_preview(spark, sf_dir):
    f = files(spark, sf_dir).select("id", "size")
    assets = f.filter("id % 7 <> 0").select(
        "id",
        F.when(F.col("id") % 2 == 0, "corrupt").otherwise("healthy").alias("integrity"),
        F.when(F.col("id") % 3 == 0, F.sha2(F.col("id").cast("string"), 256)).alias("corrupt_sha256"),
        F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("observed_size"),
    )
    out = plans.corrupt_preview(f.select("id"), assets, f)
    return out.select("id", F.array_join("blockers", ",").alias("blockers"), "eligible")


# ---------------------------------------------------------------- jobs and histories

_JOBS = "j AS (SELECT event_id AS id, ['queued','running','completed','failed','cancel_requested'][event_id % 5 + 1] AS status, event_type AS kind, event_id % 2 = 0 AS resumable FROM events)"


def _jobs(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["queued", "running", "completed", "failed", "cancel_requested"])), (F.col("event_id") % 5 + 1).cast("int"))
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), status.alias("status"), F.col("event_type").alias("kind"), (F.col("event_id") % 2 == 0).alias("resumable"))


@query(f"WITH {_JOBS} SELECT id, CASE WHEN status = 'cancel_requested' THEN 'cancelled' WHEN status = 'running' AND resumable THEN 'queued' WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND NOT resumable THEN 'WORKER_INTERRUPTED' END AS error FROM j")
def recovered_jobs(spark, sf_dir):
    return lifecycle.recovered(_jobs(spark, sf_dir)).select("id", "status", "error")


@query(f"WITH {_JOBS} SELECT id, kind = 'purchase' AND status IN ('completed', 'failed') AS dismissed FROM j WHERE NOT (status IN ('completed', 'failed') AND kind <> 'purchase' AND NOT (kind = 'signup' AND status = 'failed'))")
def cleared_tasks(spark, sf_dir):
    return lifecycle.cleared(_jobs(spark, sf_dir), ["completed", "failed"], kept=["purchase"], kept_failed="signup").select("id", "dismissed")


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE false UNION ALL SELECT CAST(-1 AS BIGINT), 'AUDIT_CLEARED'")
def cleared_audit(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return lifecycle.cleared_audit(rows, {"id": -1, "kind": "AUDIT_CLEARED"})


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45))")
def scans_after_delete(spark, sf_dir):
    o = mf.table(spark, sf_dir, "orders")
    dependents = mf.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return lifecycle.deleted_unless(o, F.col("o_orderstatus") == "F", dependents, "o_orderkey").select("o_orderkey")


@query(f"WITH {FILES} SELECT id FROM files WHERE root_key <> '/data/r2'")
def index_after_root_delete(spark, sf_dir):
    f = files(spark, sf_dir)
    gone = spark.createDataFrame([("/data/r2",)], "root_key string")
    return f.join(F.broadcast(gone), "root_key", "left_anti").select("id")


@query("SELECT event_id AS entry, CASE WHEN event_id % 4 = 0 THEN 'NOT_PURGING' WHEN event_id % 3 = 0 THEN 'JOB_MISSING' WHEN event_id % 5 = 0 THEN 'PLAN_MISSING' ELSE 'RECOVERABLE' END AS diagnosis FROM events")
def recovery_diagnosis(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("entry"), F.when(F.col("event_id") % 4 == 0, "stored").otherwise("purging").alias("state"))
    jobs = e.filter("entry % 3 <> 0").select("entry", (F.col("entry") + 1_000_000).alias("job"))
    held = jobs.filter("entry % 5 <> 0").select("job", F.lit("plan").alias("plan"))
    return lifecycle.diagnosed(e, jobs, held)


@query("SELECT event_id AS entry, concat_ws(',', CASE WHEN event_id % 2 = 1 THEN 'NOT_QUARANTINED' END, CASE WHEN event_id % 5 = 0 THEN 'FILE_MISSING' END, CASE WHEN event_id % 7 = 0 THEN 'TARGET_OCCUPIED' END) AS problems FROM events")
def restore_checks(spark, sf_dir):
    e = _events(spark, sf_dir).select(
        F.col("event_id").alias("entry"), F.when(F.col("event_id") % 2 == 1, "restored").otherwise("quarantined").alias("state"), (F.col("event_id") % 5 != 0).alias("present"), (F.col("event_id") % 7 == 0).alias("occupied")
    )
    return e.select("entry", F.array_join(lifecycle.restore_problems(F.col("state"), F.col("present"), F.col("occupied")), ",").alias("problems"))


@query("SELECT o_orderkey AS plan_id, count(*) AS items, sha256(string_agg(l_linenumber || '|' || l_quantity::BIGINT || '|' || l_returnflag, chr(10) ORDER BY l_linenumber, l_linenumber || '|' || l_quantity::BIGINT || '|' || l_returnflag)) AS digest FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def frozen_plans(spark, sf_dir):
    items = mf.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"), "l_returnflag")
    known = mf.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"))
    return plans.digests(items.join(known, "plan_id", "left_semi"), ["plan_id"], ["l_linenumber"], ["l_linenumber", "quantity", "l_returnflag"])


# ---------------------------------------------------------------- chains, inventories and decisions


@query(
    "WITH RECURSIVE i AS (SELECT '/p/' || doc_id AS source, '/p/' || (doc_id + 1) AS target FROM documents WHERE doc_id % 10 <> 9), o(source, target, origin, hops) AS (SELECT source, target, source, CAST(0 AS BIGINT) FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.target = i.source) "
    "UNION ALL SELECT i.source, i.target, o.origin, o.hops + 1 FROM i JOIN o ON i.source = o.target) SELECT * FROM o"
)
def move_origins(spark, sf_dir):
    d = mf.table(spark, sf_dir, "documents").filter("doc_id % 10 <> 9")
    path = lambda c: F.concat(F.lit("/p/"), c.cast("string"))
    return trees.origins(d.select(path(F.col("doc_id")).alias("source"), path(F.col("doc_id") + 1).alias("target")))


@query(f"WITH {FILES}, p AS (SELECT id, directory || '/' || CASE WHEN id % 2 = 0 THEN 'N' ELSE 'n' END || id % 60 AS target FROM files) SELECT id, count(*) OVER (PARTITION BY lower(target)) > 1 AS collides FROM p")
def proposal_collisions(spark, sf_dir):
    target = F.concat(paths.parent(F.col("relative_path")), F.lit("/"), F.when(F.col("id") % 2 == 0, "N").otherwise("n"), (F.col("id") % 60).cast("string"))
    return trees.colliding(files(spark, sf_dir).select("id", target.alias("target"))).select("id", "collides")


@query(
    f"WITH {PACKAGES}, d AS (SELECT DISTINCT CASE length(package) % 3 WHEN 0 THEN package || '/p' WHEN 1 THEN package || '/..' ELSE replace(package, '/', '-') END AS path FROM pk) "
    "SELECT path, regexp_full_match(path, '[0-9]{2}(0[1-9]|1[0-2])/[0-9]{4}(0[1-9]|[12][0-9]|3[01])/[^/]+/[^/]+') AND left(path, 4) = substr(path, 6, 4) AND NOT ends_with(path, '/..') AS valid FROM d"
)
def package_path_checks(spark, sf_dir):
    p, n = F.col("package"), F.length("package") % 3
    path = F.when(n == 0, F.concat(p, F.lit("/p"))).when(n == 1, F.concat(p, F.lit("/.."))).otherwise(F.replace(p, F.lit("/"), F.lit("-")))
    return trees.package_paths(packages(spark, sf_dir).select(path.alias("path")).distinct())


@query(f"WITH {FILES} SELECT relative_path AS path, CASE WHEN id % 6 = 0 THEN 'removed' WHEN id % 6 = 1 THEN 'added' ELSE 'changed' END AS change FROM files WHERE id % 6 < 3")
def inventory_changes(spark, sf_dir):
    f = files(spark, sf_dir).select("id", F.col("relative_path").alias("path"), "size", "mtime_ns")
    before = f.filter("id % 6 <> 1").select("path", "size", "mtime_ns")
    after = f.filter("id % 6 <> 0").select("path", F.when(F.col("id") % 6 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime_ns")
    return plans.changed_entries(before, after, "path")


@query(f"WITH {FILES}, n AS (SELECT relative_path AS path FROM files WHERE id % 3 <> 0), p AS (SELECT CASE WHEN id % 2 = 0 THEN relative_path ELSE 'new/' || basename END AS path FROM files) SELECT path, CASE WHEN n.path IS NULL THEN 'created' WHEN p.path IS NULL THEN 'retired' ELSE 'kept' END AS role FROM n FULL JOIN p USING (path)")
def planned_path_roles(spark, sf_dir):
    f = files(spark, sf_dir)
    now = f.filter("id % 3 <> 0").select(F.col("relative_path").alias("path"))
    planned = f.select(F.when(F.col("id") % 2 == 0, F.col("relative_path")).otherwise(F.concat(F.lit("new/"), "basename")).alias("path"))
    return plans.path_roles(now, planned)


@query("SELECT event_id // 3 AS inode, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS entries, bool_or(event_id % 7 = 0) AS blocked FROM events GROUP BY 1 HAVING count(*) > 1")
def purge_aliases(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("entry"), F.lit(1).alias("device"), F.floor(F.col("event_id") / 3).alias("inode"), F.when(F.col("event_id") % 7 == 0, "purging").otherwise("quarantined").alias("state"))
    return plans.aliases(e).select("inode", F.array_join(F.col("entries").cast("array<string>"), ",").alias("entries"), "blocked")


@query(f"WITH {DUPES}, k AS (SELECT *, row_number() OVER (PARTITION BY content_hash, size ORDER BY mtime_ns DESC, absolute_path) AS rn FROM member) SELECT id, 'quarantine' AS operation, absolute_path AS source, 'DUPLICATE' AS reason FROM k WHERE rn > 1")
def draft_intents(spark, sf_dir):
    decided = matching.ranked_members(matching.content_members(files(spark, sf_dir)), ["content_hash", "size"], [F.col("mtime_ns").desc(), F.col("absolute_path")])
    return plans.intents(decided)


@query(f"WITH {DUPES}, k AS (SELECT *, row_number() OVER (PARTITION BY content_hash, size ORDER BY mtime_ns DESC, absolute_path) = 1 AS kept FROM member) SELECT content_hash, count(*) AS items, sha256(string_agg(absolute_path || '|' || kept || '|' || size, chr(10) ORDER BY absolute_path)) AS digest FROM k GROUP BY 1")
def decision_digests(spark, sf_dir):
    decided = matching.ranked_members(matching.content_members(files(spark, sf_dir)), ["content_hash", "size"], [F.col("mtime_ns").desc(), F.col("absolute_path")])
    return plans.digests(decided, ["content_hash"], ["absolute_path"], ["absolute_path", "kept", "size"])


@query(f"WITH {FILES} SELECT id, CASE WHEN id % 5 = 0 THEN 'OTHER_DEVICE' WHEN id % 7 = 0 THEN 'ALREADY_LINKED' WHEN id % 11 = 0 THEN 'SPECIAL_MODE' END AS against, id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0 AS actionable FROM files")
def storage_actions(spark, sf_dir):
    i = F.col("id")
    f = files(spark, sf_dir).select("id", F.lit(1).alias("device"), F.when(i % 5 == 0, 2).otherwise(1).alias("keep_device"), F.when(i % 7 == 0, 2).otherwise(1).alias("links"), F.when(i % 11 == 0, 0o104644).otherwise(0o100644).alias("mode"))
    return plans.eligible(f).select("id", "against", "actionable")


@query("SELECT event_id AS entry, CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_id % 5 = 0 THEN 'missing' ELSE 'quarantined' END WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN 'quarantined' WHEN event_id % 5 = 0 AND event_id % 3 <> 0 THEN 'failed' ELSE 'needs_review' END AS outcome FROM events")
def quarantine_outcomes(spark, sf_dir):
    e = F.col("event_id")
    state = F.when(e % 2 == 1, "quarantined").otherwise("moving")
    return _events(spark, sf_dir).select(e.alias("entry"), plans.reconciled(state, e % 3 != 0, e % 5 != 0).alias("outcome"))


@query("""SELECT event_id AS id, '{"limit":"' || event_id % 9 || '","root":"r' || event_id % 3 || '"}' AS payload FROM events""")
def retry_payloads(spark, sf_dir):
    e = F.col("event_id")
    payload = F.format_string('{"limit":"%d","checkpoint":"c%d","root":"r%d","lease":"x"}', e % 9, e, e % 3)
    return _events(spark, sf_dir).select(e.alias("id"), plans.retry_payload(payload, ["limit", "root"]).alias("payload"))


_page("plan_changes_page", "events", _EVENTS, [("event_id", False)], ["event_id", "event_type"], lambda: F.col("event_type").isin("click", "purchase") & ~F.col("flag"), "event_type IN ('click', 'purchase') AND NOT flag", number=2, size=60)


@query("SELECT event_type, count(*) AS entries, count_if(k % 2 = 0) AS done, CAST(coalesce(sum(k) FILTER (k % 2 = 1), 0) AS BIGINT) AS open_bytes FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def cleanup_audit(spark, sf_dir):
    odd = F.col("k") % 2 == 1
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("entries"), F.count_if(F.col("k") % 2 == 0).alias("done"), F.coalesce(F.sum(F.when(odd, F.col("k"))), F.lit(0)).alias("open_bytes"))
