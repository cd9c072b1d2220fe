"""Plans, jobs, journals and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Which state may follow which.
TRANSITIONS = {
    "queued": ["running", "paused", "cancelled"],
    "running": ["paused", "cancel_requested", "completed", "failed"],
    "cancel_requested": ["cancelled", "failed"],
    "paused": ["queued", "cancelled"],
    "cancelled": [],
    "failed": [],
    "completed": [],
}
#: How an operation is undone.
INVERSE = {"rename": "rename", "move": "move", "quarantine": "restore", "touch": "touch"}
ONLINE_SECONDS, STALE_SECONDS = 15, 60


def may_follow(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for state, allowed in TRANSITIONS.items():
        out = F.when(before == state, after.isin(allowed) if allowed else F.lit(False)).otherwise(out)
    return out


def transitions(history: DataFrame) -> DataFrame:
    """``history`` (job, at, state) with the state before and whether the step is allowed; a job starts queued."""
    before = F.lag("state").over(Window.partitionBy("job").orderBy("at", "seq"))
    checked = history.withColumn("before", before)
    return checked.withColumn("valid", F.when(F.col("before").isNull(), F.col("state") == "queued").otherwise(may_follow(F.col("before"), F.col("state"))))


def plan_status(items: DataFrame, outcome: Column) -> DataFrame:
    """A plan's status from its items' states and how its job ended."""
    some = F.bool_or(F.col("state").isin("completed", "failed"))
    grouped = items.groupBy("plan_id").agg(
        F.bool_and(F.col("state") == "completed").alias("all_done"), some.alias("some"), F.bool_and(F.col("state") == "pending").alias("untouched"), F.first(outcome).alias("outcome")
    )
    status = (
        F.when(F.col("all_done"), "completed")
        .when(F.col("some"), "partial")
        .when((F.col("outcome") == "cancelled") & F.col("untouched"), "ready")
        .when(F.col("outcome") == "completed", "partial")
        .otherwise("failed")
    )
    return grouped.select("plan_id", status.alias("status"))


def undo(journal: DataFrame) -> DataFrame:
    """The journal (plan_id, sequence, operation, source, target) backwards with every operation inverted."""
    inverse = F.lit(None).cast("string")
    for operation, opposite in INVERSE.items():
        inverse = F.when(F.col("operation") == operation, opposite).otherwise(inverse)
    step = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("sequence").desc()))
    return journal.select("plan_id", step.alias("step"), inverse.alias("operation"), F.col("target").alias("source"), F.col("source").alias("target"))


def retention_preview(audit: DataFrame, cutoff: Column) -> DataFrame:
    return audit.agg(F.count("*").alias("total"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count_if(F.col("ts") < cutoff).alias("expired"))


def retained(audit: DataFrame, cutoff: Column | None) -> DataFrame:
    """Rows not older than the cutoff; everything where none is set."""
    return audit if cutoff is None else audit.filter(F.col("ts") >= cutoff)


def worker_status(age_seconds: Column) -> Column:
    return F.when(age_seconds.isNull(), "offline").when(age_seconds <= ONLINE_SECONDS, "online").when(age_seconds <= STALE_SECONDS, "stale").otherwise("offline")


def freshness(items: DataFrame, files: DataFrame) -> DataFrame:
    """What changed under a plan's items (item_id, path and expected values) since it was frozen; null where nothing did."""
    now = files.select("path", *(F.col(c).alias(f"now_{c}") for c in ("device", "inode", "size", "mtime_ns", "content_hash")))
    joined = items.join(now, "path", "left")
    reason = (
        F.when(F.col("now_inode").isNull(), "SOURCE_MISSING")
        .when((F.col("device") != F.col("now_device")) | (F.col("inode") != F.col("now_inode")), "IDENTITY_CHANGED")
        .when(F.col("size") != F.col("now_size"), "SIZE_CHANGED")
        .when(F.col("mtime_ns") != F.col("now_mtime_ns"), "MTIME_CHANGED")
        .when(F.col("content_hash") != F.col("now_content_hash"), "HASH_CHANGED")
    )
    return joined.select("item_id", reason.alias("reason"))


def integrity(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """verified, changed, unknown or established for each file against its baseline, if there is one."""
    base = baseline.select("path", *(F.col(c).alias(f"base_{c}") for c in ("inode", "size", "mtime_ns", "content_hash")))
    same = (F.col("inode") == F.col("base_inode")) & (F.col("size") == F.col("base_size")) & (F.col("mtime_ns") == F.col("base_mtime_ns"))
    status = (
        F.when(~F.col("readable"), "unknown")
        .when(F.col("base_content_hash").isNull(), "established")
        .when(same & (F.col("content_hash") == F.col("base_content_hash")), "verified")
        .otherwise("changed")
    )
    return files.join(base, "path", "left").select("path", status.alias("status"))


def recent_paths(uses: DataFrame, keep: int = 20) -> DataFrame:
    """Each user's latest distinct paths."""
    last = uses.groupBy("user_id", "path").agg(F.max("ts").alias("last_used_at"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last_used_at").desc(), "path"))
    return last.withColumn("rn", rn).filter(F.col("rn") <= keep)


def slots(due: DataFrame, runs: DataFrame) -> DataFrame:
    """What happens to each due slot (schedule_id, slot, enabled, late): one dispatch at most for each slot."""
    taken = runs.select("schedule_id", "slot").distinct().withColumn("taken", F.lit(True))
    active = runs.filter("active").select("schedule_id").distinct().withColumn("busy", F.lit(True))
    joined = due.dropDuplicates(["schedule_id", "slot"]).join(taken, ["schedule_id", "slot"], "left").join(active, "schedule_id", "left")
    outcome = (
        F.when(~F.col("enabled"), "not_due")
        .when(F.col("taken"), "duplicate_slot")
        .when(F.col("late"), "missed_skipped")
        .when(F.col("busy"), "skipped_overlap")
        .otherwise("dispatched")
    )
    return joined.select("schedule_id", "slot", outcome.alias("outcome"))


def listed(rows: DataFrame, order: list[Column], number: int, size: int, where: Column | None = None) -> DataFrame:
    """One page of a list; sizes are held between 1 and 500, pages start at 1."""
    size, number = max(1, min(size, 500)), max(1, number)
    rows = rows if where is None else rows.filter(where)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def search(column: str, text: str) -> Column:
    """A case-insensitive LIKE in which ``%`` and ``_`` of the text keep their meaning."""
    return F.ilike(F.col(column), F.lit(f"%{text}%"), F.lit("\x01"))


def without(rows: DataFrame, active: DataFrame, key: str, terminal: list[str]) -> DataFrame:
    """History cleanup: terminal rows that no active job refers to go."""
    gone = rows.filter(F.col("status").isin(terminal)).join(active.select(key).distinct(), key, "left_anti")
    return rows.join(gone.select(key), key, "left_anti")


def recovered(jobs: DataFrame) -> DataFrame:
    """``jobs`` as they stand after their worker was lost: a requested cancel is done, what can resume queues again, the rest fails."""
    running = F.col("status") == "running"
    status = F.when(F.col("status") == "cancel_requested", "cancelled").when(running & F.col("resumable"), "queued").when(running, "failed").otherwise(F.col("status"))
    return jobs.withColumn("error", F.when(running & ~F.col("resumable"), "WORKER_INTERRUPTED")).withColumn("status", status)


def cleared(jobs: DataFrame, statuses: list[str], kept: list[str], kept_failed: str) -> DataFrame:
    """Task history without jobs of terminal ``statuses``: those of ``kept`` kinds are only dismissed, failed ones of ``kept_failed`` stay."""
    if not statuses or any(TRANSITIONS.get(s, ["?"]) for s in statuses):
        raise ValueError("only terminal statuses can be cleared")
    ended = F.col("status").isin(statuses)
    stays = F.col("kind").isin(kept) | ((F.col("kind") == kept_failed) & (F.col("status") == "failed"))
    return jobs.filter(~ended | stays).withColumn("dismissed", ended & F.col("kind").isin(kept))


def cleared_audit(audit: DataFrame, note: dict) -> DataFrame:
    """An audit history after it was cleared: the one row that says so."""
    return audit.sparkSession.createDataFrame([tuple(note[c] for c in audit.columns)], audit.schema)


def deleted_unless(rows: DataFrame, chosen: Column, dependents: DataFrame, key: str) -> DataFrame:
    """``rows`` without the chosen ones that nothing depends on."""
    gone = rows.filter(chosen).join(dependents.select(key).distinct(), key, "left_anti").select(key)
    return rows.join(gone, key, "left_anti")


def diagnosed(entries: DataFrame, jobs: DataFrame, plans: DataFrame) -> DataFrame:
    """Why a purge of each entry (entry, state) can or cannot be taken up again."""
    joined = entries.join(jobs, "entry", "left").join(plans, "job", "left")
    why = F.when(F.col("state") != "purging", "NOT_PURGING").when(F.col("job").isNull(), "JOB_MISSING").when(F.col("plan").isNull(), "PLAN_MISSING").otherwise("RECOVERABLE")
    return joined.select("entry", why.alias("diagnosis"))


def restore_problems(state: Column, present: Column, occupied: Column) -> Column:
    """What stands against a restore, in order."""
    return F.array_compact(F.array(F.when(state != "quarantined", "NOT_QUARANTINED"), F.when(~present, "FILE_MISSING"), F.when(occupied, "TARGET_OCCUPIED")))
