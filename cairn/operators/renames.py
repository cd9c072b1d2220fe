"""Previews of renames: new names, and the conflicts that would stop them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.names import audit, breaks_normal_form, rename
from cairn.functions.paths import basename, parent, stem, suffix
from cairn.operators.numbering import numbered

#: Fixed value: bytes a file system takes for a name.
NAME_BYTES = 255


def invalid_name(name: Column) -> Column:
    return name.isin("", ".", "..") | name.rlike(r"[/\\\x00]") | (F.octet_length(name) > NAME_BYTES)


def _taken(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` (directory, folded) with whether an entry of the directory has that case-folded name."""
    held = entries.select("directory", F.lower("name").alias("folded")).distinct().withColumn("taken", F.lit(True))
    return rows.join(held, ["directory", "folded"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def preview(entries: DataFrame, kind: str, mode: str, find: str = "", value: str = "", keep_extension: bool = True) -> DataFrame:
    """directory, name, new_name, conflict of the entries (directory, name, kind) of one kind whose name changes.

    A target conflicts if any entry of the directory, of whatever kind, has its case-folded name, or if an earlier
    entry by name takes it. Invalid targets take nothing.
    """
    if mode.startswith("replace") and not find or mode.startswith("add") and not value:
        raise ValueError("nothing to look for or to add")
    changed = entries.filter(F.col("kind") == kind).select("directory", "name", rename(F.col("name"), mode, find, value, keep_extension).alias("new_name"))
    changed = changed.filter("name <> new_name").withColumn("folded", F.lower("new_name")).withColumn("invalid", invalid_name(F.col("new_name")))
    rank = F.row_number().over(Window.partitionBy("directory", "folded", "invalid").orderBy("name"))
    conflict = F.when(F.col("invalid"), "INVALID_NAME").when(F.col("taken"), "NAME_TAKEN").when(rank > 1, "NAME_PROPOSED")
    return _taken(changed, entries).select("directory", "name", "new_name", conflict.alias("conflict"))


def trims(entries: DataFrame) -> DataFrame:
    """directory, name, suggestion, reason of the entries with spaces at an edge: the trimmed name where that mends everything."""
    name = F.col("name")
    trimmed = entries.select("directory", "name", F.trim(name).alias("clean")).filter("name <> clean").withColumn("folded", F.lower("clean"))
    broken = F.size(audit(F.col("clean"))) > 0
    trimmed = trimmed.withColumn("broken", broken | breaks_normal_form(F.col("clean"))).withColumn("empty", F.col("clean").isin("", ".", ".."))
    rank = F.row_number().over(Window.partitionBy("directory", "folded", "broken", "taken").orderBy("name"))
    reason = F.when(F.col("empty"), "EMPTY").when(F.col("taken") | (rank > 1), "NAME_TAKEN").when(F.col("broken"), "OTHER_ISSUES")
    judged = _taken(trimmed, entries).withColumn("reason", reason)
    return judged.select("directory", "name", F.when(F.col("reason").isNull(), F.col("clean")).alias("suggestion"), "reason")


@dataclass(frozen=True)
class Rule:
    """One rule for a whole batch; ``extension`` is the pair (from, to) and restricts the batch to files of the first."""

    pattern: str = ""
    replacement: str = ""
    prefix: str = ""
    suffix: str = ""
    with_parent: bool = False
    number_from: int | None = None
    number_width: int = 1
    extension: tuple[str, str] | None = None


def batch(files: DataFrame, rule: Rule) -> DataFrame:
    """source, target, conflict of the files (path) under a rule; numbers follow the order of all paths.

    A target conflicts if an earlier path has it too, or if a path outside the batch holds it.
    """
    name = basename(F.col("path"))
    chosen = files.select("path")
    if rule.extension:
        chosen = chosen.filter(F.lower(suffix(name)) == rule.extension[0].lower())
    ending = F.lit(rule.extension[1]) if rule.extension and rule.extension[1] else suffix(name)
    body = F.regexp_replace(stem(name), rule.pattern, rule.replacement) if rule.pattern else stem(name)
    body = F.concat(F.lit(rule.prefix), body, F.lit(rule.suffix))
    if rule.with_parent:
        body = F.concat(basename(parent(F.col("path"))), F.lit("-"), body)
    if rule.number_from is not None:
        chosen = numbered(chosen, [F.col("path")])
        body = F.concat(F.format_string(f"%0{rule.number_width}d", F.col("number") + rule.number_from), F.lit("-"), body)
    planned = chosen.select(F.col("path").alias("source"), F.concat(parent(F.col("path")), F.lit("/"), body, ending).alias("target"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    outside = files.join(chosen.select("path"), "path", "left_anti").select(F.col("path").alias("target")).withColumn("held", F.lit(True))
    judged = planned.withColumn("rank", rank).join(outside, "target", "left")
    conflict = F.when(F.col("rank") > 1, "TARGET_REPEATED").when(F.col("held"), "TARGET_EXISTS")
    return judged.filter("source <> target").select("source", "target", conflict.alias("conflict"))
