"""What plans rest on: digests of their sources, protections, and who may act on what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import basename, parent, stem, suffix


def digests(rows: DataFrame, by: list[str], order: list[str], record: list[str]) -> DataFrame:
    """items and digest of each group: SHA-256 over its records in order, fields joined by ``|`` and records by line breaks.

    ``order`` must not have ties. A digest depends on the order of all records, so a group is one row of text.
    """
    line = F.concat_ws("|", *(F.col(c).cast("string") for c in record))
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    grouped = rows.groupBy(*by).agg(ordered.alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x.line), "\n")
    return grouped.select(*by, F.size("lines").cast("long").alias("items"), F.sha2(body, 256).alias("digest"))


def protection(files: DataFrame, scheduled: DataFrame, by: list[str]) -> DataFrame:
    """files, scheduled and safe of each directory: whether a file stays once all that is scheduled has gone."""
    held = files.groupBy(*by).agg(F.count("*").alias("files"))
    going = scheduled.groupBy(*by).agg(F.count("*").alias("scheduled"))
    joined = held.join(going, by, "left").withColumn("scheduled", F.coalesce("scheduled", F.lit(0)))
    return joined.withColumn("safe", F.col("files") - F.col("scheduled") >= 1)


def linkable(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a file and the one it would link to (``keep_`` columns) with the first mismatch and the bytes a link frees."""
    mismatch = (
        F.when(F.col("size") != F.col("keep_size"), "SIZE")
        .when((F.col("uid") != F.col("keep_uid")) | (F.col("gid") != F.col("keep_gid")), "OWNER")
        .when(F.col("mode") != F.col("keep_mode"), "MODE")
    )
    judged = pairs.withColumn("mismatch", mismatch)
    return judged.withColumn("reclaimed", F.when(F.col("mismatch").isNull(), F.col("size")).otherwise(0))


def trash_path(trash: Column, plan: Column, entry: Column, path: Column) -> Column:
    return F.concat_ws("/", trash, plan.cast("string"), entry.cast("string"), basename(path))


def restore_path(path: Column, entry: Column) -> Column:
    """Where an entry goes back to if its old place is taken."""
    name = basename(path)
    return F.concat(parent(path), F.lit("/"), stem(name), F.lit(".restored-"), entry.cast("string"), suffix(name))


def corrupt_preview(requested: DataFrame, assets: DataFrame, index: DataFrame) -> DataFrame:
    """blockers in order and eligible for each requested id: only what is known corrupt, by hash, and unchanged may go."""
    now = index.select("id", F.col("size").alias("now_size"))
    joined = requested.join(assets.join(now, "id"), "id", "left")
    missing = F.col("integrity").isNull()
    blockers = F.array_compact(
        F.array(
            F.when(missing, "MEDIA_ASSET_NOT_FOUND"),
            F.when(~missing & (F.col("integrity") != "corrupt"), "MEDIA_NOT_CORRUPT"),
            F.when(~missing & F.col("corrupt_sha256").isNull(), "CORRUPT_SHA256_MISSING"),
            F.when(F.col("observed_size") != F.col("now_size"), "INDEX_EVIDENCE_CHANGED"),
        )
    )
    return joined.select("id", blockers.alias("blockers")).withColumn("eligible", F.size("blockers") == 0)


def changed_entries(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """added, removed and changed of two inventories, which have one row for each key."""
    rest = [c for c in before.columns if c != key]
    old = before.select(key, F.struct(*rest).alias("old"))
    new = after.select(key, F.struct(*rest).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, key, "full").select(key, change.alias("change")).filter("change is not null")


def path_roles(current: DataFrame, planned: DataFrame) -> DataFrame:
    """What becomes of every path: kept, created or retired by a plan."""
    joined = current.select("path", F.lit(True).alias("is_now")).join(planned.select("path", F.lit(True).alias("will_be")), "path", "full")
    return joined.select("path", F.when(F.col("is_now").isNull(), "created").when(F.col("will_be").isNull(), "retired").otherwise("kept").alias("role"))


def aliases(entries: DataFrame) -> DataFrame:
    """Entries (entry, device, inode, state) that share an inode: how many, the ids in order, and whether one of them stands in the way."""
    grouped = entries.groupBy("device", "inode").agg(F.sort_array(F.collect_list("entry")).alias("entries"), F.bool_or(F.col("state") != "quarantined").alias("blocked"))
    return grouped.filter(F.size("entries") > 1)


def intents(decided: DataFrame) -> DataFrame:
    """What a keep decision asks for: every copy that is not kept goes, and why."""
    return decided.filter(~F.col("kept")).select("id", F.lit("quarantine").alias("operation"), F.col("absolute_path").alias("source"), F.lit("DUPLICATE").alias("reason"))


def eligible(rows: DataFrame) -> DataFrame:
    """Whether a copy may be replaced by a link (device, keep_device, links, mode), and the first thing against it."""
    against = (
        F.when(F.col("device") != F.col("keep_device"), "OTHER_DEVICE")
        .when(F.col("links") > 1, "ALREADY_LINKED")
        .when(F.col("mode").bitwiseAND(F.lit(0o7000)) != 0, "SPECIAL_MODE")
    )
    return rows.withColumn("against", against).withColumn("actionable", F.col("against").isNull())


def reconciled(state: Column, at_source: Column, at_target: Column) -> Column:
    """What an interrupted quarantine comes to, by where the file is found."""
    moving = state == "moving"
    return (
        F.when(moving & at_target & ~at_source, "quarantined")
        .when(moving & at_source & ~at_target, "failed")
        .when(moving, "needs_review")
        .when((state == "quarantined") & ~at_target, "missing")
        .otherwise(state)
    )


def retry_payload(payload: Column, allowed: list[str]) -> Column:
    """The JSON object of a task with the fields that a retry may carry over."""
    held = F.from_json(payload, "map<string,string>")
    return F.to_json(F.map_filter(held, lambda k, _: k.isin(allowed)))
