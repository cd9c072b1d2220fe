"""Works in a tree of media: where each begins, and how its files are laid out in numbered folders.

``entries`` is what a scan of some roots lists: root_key, path (relative to the root), kind (file, directory, symlink or other), size,
device, and root_device, the one of the root. A scan goes into no symlink and no other device, so nothing lies below these.

A directory is visited if its parent is and its own name is plain; one that holds files or old media folders ("wrappers": P, V_2,
``P_1 [200 1.5MiB]``, photos ...) is a unit. A unit's files are its own and those in wrappers, at any depth. A wrapper that
holds something else blocks its unit; a clear work (``NO.7``, ``A1-2``) right inside a wrapper of a unit is visited in its own right.

Whether a directory is visited follows from the names on its path alone, so no level waits for another: the names become one
letter each, and one expression finds the unit. Files are numbered by ranges; no unit is ever one task's work. Excluded roots count like
excluded names, for units as well as for what lies in them. Of several reasons to block a unit the first of ``REASONS`` is given; a blocked unit counts nothing.
Nulls: entries without root_key or path are in no tree; a size that is null counts 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.media import bucket_kind
from cairn.functions.names import size_label
from cairn.functions.paths import basename, parent, suffix, under_any
from cairn.lineage import settled
from cairn.operators.flatten import folded
from cairn.operators.layout import FILES_PER_BUCKET, allocate_names, numbered
from cairn.operators.numbering import numbered_within

#: Names of old media folders, works and folders that only a person can judge, and how deep each may nest.
IMAGE_FOLDERS = ["图片", "图", "照片", "photo", "photos", "image", "images", "picture", "pictures", "pic"]
VIDEO_FOLDERS = ["视频", "video", "videos"]
OTHER_FOLDERS = ["other"]
SHORT_FOLDER = r"(?i)[pv](_?[1-9]\d*)?"
SIZED_FOLDER = r"(?i)([pv])(?:_([1-9]\d*))? (\[\d+ [^/]+\])"
SIZED_OTHER = r"(?i)other \[\d+ [^/]+\]"
CLEAR_WORK = r"(?i)(NO[. _-]?\d+|A\d+-\d+)"
UNCLEAR_FOLDER = r"(?i)(\d{1,3}|新建文件夹(\s*\(\d+\))?)"
RESERVED = ".nfc-"
LEVELS, WRAPPER_LEVELS = 64, 32

#: Why a unit is blocked, what counts first.
REASONS = ["WRAPPER_DEPTH", "RESERVED_WORKSPACE", "EXCLUDED_IN_WRAPPER", "CROSS_DEVICE", "INDEPENDENT_WORK", "SPECIAL_FILE"]
#: The same for where its files would go: the first file in order with a problem counts.
PLACES = ["TARGET_OCCUPIED", "FOLDER_NOT_DIRECTORY", "FOLDER_NOT_AN_INPUT"]

UNIT = ["root_key", "unit"]


@dataclass(frozen=True)
class Rules:
    excluded_names: tuple[str, ...] = ()
    excluded_roots: tuple[str, ...] = ()
    per_bucket: int = FILES_PER_BUCKET

    def __post_init__(self) -> None:
        if any(not n.strip() or n in (".", "..") or set(n) & set("/\\\0") for n in self.excluded_names):
            raise ValueError("an excluded name is one safe name")
        if any(not r.startswith("/") for r in self.excluded_roots):
            raise ValueError("excluded roots are absolute")
        if self.per_bucket < 1:
            raise ValueError("a folder takes at least one file")


@dataclass(frozen=True)
class Layout:
    """``units``: one row each with status and counts; ``items``: source and target of each file of units that are not blocked; ``groups``: the
    folders these fill; ``cleanup``: wrappers left empty, in the order to remove them; ``held``: entries that a person must look at."""

    units: DataFrame
    items: DataFrame
    groups: DataFrame
    cleanup: DataFrame
    held: DataFrame


def _whole(name: Column, pattern: str) -> Column:
    return name.rlike(f"^(?:{pattern})\\z")


def is_wrapper(name: Column) -> Column:
    """Whether a directory of this name is an old media folder."""
    known = folded(name).isin(IMAGE_FOLDERS + VIDEO_FOLDERS + OTHER_FOLDERS)
    return known | _whole(name, SHORT_FOLDER) | _whole(name, SIZED_FOLDER) | _whole(name, SIZED_OTHER)


def _excluded_name(name: Column, rules: Rules) -> Column:
    return folded(name).isin([n.casefold() for n in rules.excluded_names]) if rules.excluded_names else F.lit(False)


def _role(name: Column, rules: Rules) -> Column:
    """One letter for what the name of a directory says."""
    return (
        F.when(_excluded_name(name, rules), "x").when(folded(name).startswith(RESERVED), "r").when(is_wrapper(name), "w")
        .when(_whole(name, UNCLEAR_FOLDER), "u").when(name.rlike(f"^{CLEAR_WORK}"), "c").otherwise("p")
    )


def source_order(relative: Column) -> Column:
    """Sort key of a path in its unit: folders in lower case, but sized ones by number."""
    parts = F.split(relative, "/")

    def key(name: Column, i: Column) -> Column:
        number = F.regexp_extract(name, f"^{SIZED_FOLDER}\\z", 2)
        last = i == F.size(parts) - 1
        sized = ~last & (number != "")
        text = F.when(last, folded(name)).when(sized, F.concat(F.lower(F.left(name, F.lit(1))), F.lit("_"))).otherwise(F.concat(folded(name), F.lit("/")))
        label = F.concat(folded(F.regexp_extract(name, f"^{SIZED_FOLDER}\\z", 3)), F.lit("/"))
        return F.struct(text.alias("text"), F.when(sized, F.length(number)).otherwise(0).alias("digits"), F.when(sized, number).otherwise("").alias("number"), F.when(sized, label).otherwise("").alias("label"))

    return F.transform(parts, key)


def _named(names: list[str], code: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), code)


def discovered(entries: DataFrame, rules: Rules) -> DataFrame:
    """Entries right below a visited directory or in wrappers of one, with ``unit``, the number of ``wrappers`` between, their role and ``problem``."""
    absolute, up, name = F.concat("root_key", F.lit("/"), "path"), parent(F.col("path")), basename(F.col("path"))
    parts = F.when(up == "", F.array().cast("array<string>")).otherwise(F.split(up, "/"))
    letters = F.array_join(F.transform(parts, lambda n: _role(n, rules)), "")
    rows = entries.filter("path <> ''").select("*", name.alias("name"), parts.alias("__parts"), letters.alias("__letters"), absolute.alias("__absolute"))
    rows = rows.filter(F.col("__letters").rlike("^(?:[pc]|wc)*w*$") & ~F.exists(F.split("root_key", "/"), lambda n: _excluded_name(n, rules)))
    above = F.concat("root_key", F.when(up == "", "").otherwise(F.concat(F.lit("/"), up)))
    rows = rows.filter(~under_any(above, list(rules.excluded_roots)))
    visited = F.regexp_extract("__letters", "^((?:[pc]|wc)*)", 1)
    rows = rows.withColumn("wrappers", F.length("__letters") - F.length(visited)).withColumn("level", F.length(F.translate(visited, "w", "")))
    rows = rows.filter((F.col("wrappers") <= WRAPPER_LEVELS) & (F.col("level") <= LEVELS)).withColumn("unit", F.array_join(F.slice("__parts", F.lit(1), F.length(visited)), "/"))

    directory, foreign, inside = F.col("kind") == "directory", F.col("device") != F.col("root_device"), F.col("wrappers") > 0
    role = F.when(~directory, F.lit("f")).when(under_any(F.col("__absolute"), list(rules.excluded_roots)), "x").otherwise(_role(F.col("name"), rules))
    rows = rows.withColumn("role", role)
    own = F.col("role")
    code = (
        F.when((own == "w") & (F.col("wrappers") == WRAPPER_LEVELS), 0)
        .when(folded(F.col("name")).startswith(RESERVED), 1)
        .when(own == "x", F.when(inside, 2))
        .when(foreign, 3)
        .when(directory & (own != "w"), F.when(inside, 4))
        .when(~directory & (F.col("kind") != "file"), 5)
    )
    return rows.withColumn("problem", code).select("root_key", "path", "kind", "size", "name", "unit", "wrappers", "level", "role", "problem")


def held(found: DataFrame) -> DataFrame:
    """root_key, path, reason of what the search for units leaves to a person."""
    rows = found.filter("wrappers = 0 AND role <> 'x'")
    deep = (F.col("role").isin("p", "c")) & (F.col("level") == LEVELS)
    reason = F.when(F.col("problem").isin(1, 3, 5), _named(REASONS, F.col("problem"))).when(F.col("role") == "u", "UNCLEAR_FOLDER").when(deep, "TOO_DEEP")
    return rows.select("root_key", "path", reason.alias("reason")).filter("reason IS NOT NULL")


def _joined(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def layout(entries: DataFrame, rules: Rules = Rules()) -> Layout:
    """All units of ``entries`` with their layouts."""
    found = settled(discovered(entries, rules))
    is_file = (F.col("kind") == "file") & F.col("problem").isNull()
    kind = bucket_kind(suffix(F.col("name")))
    count = lambda c: F.count_if(c).cast("long")
    units = found.groupBy(*UNIT).agg(
        F.min("problem").alias("problem"),
        *(count(is_file & (kind == k)).alias(k.lower()) for k in ("P", "V", "Other")),
        count((F.col("role").isin("p", "c", "u", "x")) & (F.col("wrappers") == 0)).alias("protected"),
        count(F.col("role") == "w").alias("folders"),
        F.bool_or((F.col("wrappers") == 0) & F.when(F.col("kind") == "file", ~F.col("problem").eqNullSafe(1)).otherwise((F.col("role") == "w") & F.col("problem").isNull())).alias("begins"),
    )
    units = units.filter("begins").drop("begins")
    flat = (F.col("other") == 0) & ((F.col("p") == 0) | (F.col("v") == 0))
    small = F.col("p") + F.col("v") <= rules.per_bucket
    operation = F.when(flat & small, "flatten").when(flat, "buckets").otherwise("sort")
    units = settled(units.withColumn("operation", F.when(F.col("p") + F.col("v") + F.col("other") > 0, operation)))

    relative = F.when(F.col("unit") == "", F.col("path")).otherwise(F.substr("path", F.length("unit") + 2))
    open_ = units.filter("problem IS NULL AND operation IS NOT NULL").select(*UNIT, "operation")
    files = found.filter(is_file).select(*UNIT, "path", "name", kind.alias("kind"), F.coalesce("size", F.lit(0).cast("long")).alias("bytes"), source_order(relative).alias("__key"))
    placed = numbered_within(files.join(open_, UNIT), [*UNIT, "kind"], [F.col("__key"), F.col("path")], "place").drop("__key")
    bucket = F.when((F.col("operation") == "flatten") | (F.col("kind") == "Other"), 0).otherwise(F.floor(F.col("place") / rules.per_bucket)).cast("long")
    placed = placed.withColumn("bucket", bucket)
    by = [*UNIT, "kind", "bucket"]
    stem = F.when(F.col("bucket") == 0, F.col("kind")).otherwise(F.concat("kind", F.lit("_"), F.col("bucket").cast("string")))
    groups = placed.filter("operation <> 'flatten'").groupBy(*by).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min("place").alias("place"))
    groups = groups.withColumn("name", F.concat(stem, F.lit(" ["), F.col("files").cast("string"), F.lit(" "), size_label(F.col("bytes")), F.lit("]")))
    groups = settled(groups.withColumn("path", _joined(F.col("unit"), F.col("name"))))

    others = allocate_names(placed.filter("kind = 'Other'").withColumnRenamed("place", "position"), UNIT).withColumnRenamed("position", "place")
    media = placed.filter("kind <> 'Other'").withColumn("new_name", numbered(F.col("place") - F.col("bucket") * rules.per_bucket + 1, F.col("name")))
    named = media.unionByName(others).join(groups.select(*by, F.col("path").alias("folder")), by, "left")
    items = settled(named.withColumn("target", _joined(F.coalesce("folder", "unit"), F.col("new_name"))).withColumnRenamed("path", "source"))

    units = _checked(entries, found, units, items, groups)
    fine = units.filter("reason IS NULL").select(*UNIT)
    items, groups = items.join(fine, UNIT), groups.join(fine, UNIT)
    stale = found.filter("role = 'w'").select(*UNIT, "path").join(fine.join(open_, UNIT, "left_semi"), UNIT, "left_semi").join(groups.select("root_key", "path"), ["root_key", "path"], "left_anti")
    deepest = [F.desc(F.size(F.split("path", "/"))), F.col("path")]
    cleanup = settled(numbered_within(stale, UNIT, deepest, "sequence").withColumn("sequence", F.col("sequence") + 1))

    moved = items.groupBy(*UNIT).agg(count(F.col("source") != F.col("target")).alias("moves"), count(F.col("name") != F.col("new_name")).alias("renamed"))
    units = units.join(moved, UNIT, "left").join(cleanup.groupBy(*UNIT).agg(F.count("*").alias("stale")), UNIT, "left").na.fill(0, ["moves", "renamed", "stale"])
    done = F.when(F.col("moves") + F.col("stale") > 0, "ready").otherwise("already_organized")
    status = F.when(F.col("reason").isNotNull(), "blocked").when(F.col("operation").isNull(), "skipped").otherwise(done)
    shown = [F.when(F.col("reason").isNull(), F.col(c)).otherwise(0).alias(c) for c in ("p", "v", "other", "protected", "folders", "moves", "renamed", "stale")]
    units = units.select(*UNIT, status.alias("status"), "reason", F.when(F.col("reason").isNull(), F.col("operation")).alias("operation"), *shown)
    return Layout(units, items.select(*UNIT, "source", "target", "kind", "bucket", "place", "bytes"), groups.select(*by, "name", "files", "bytes"), cleanup, held(found))


def _checked(entries: DataFrame, found: DataFrame, units: DataFrame, items: DataFrame, groups: DataFrame) -> DataFrame:
    """``units`` with ``reason``: the problem found in them, or the first of their files that cannot go where it should."""
    order = F.when(F.col("kind") == "P", 0).when(F.col("kind") == "V", 1).otherwise(2)
    taken = entries.select("root_key", F.col("path").alias("target"), F.col("kind").alias("held"))
    sources = items.select("root_key", F.col("source").alias("target"), F.col("unit").alias("of"))
    wrong = items.join(taken, ["root_key", "target"]).join(sources, ["root_key", "target"], "left").filter("of IS NULL OR of <> unit")
    wrong = wrong.select(*UNIT, F.struct(order.alias("kind"), "bucket", "place", F.lit(0).alias("code")).alias("worst"))

    relative = F.when(F.col("unit") == "", F.col("path")).otherwise(F.substr("path", F.length("unit") + 2))
    inputs = found.filter("kind = 'file' AND wrappers > 0").select("root_key", _joined(F.col("unit"), F.substring_index(relative, "/", 1)).alias("path"), F.lit(True).alias("input")).distinct()
    first = groups.join(taken.withColumnRenamed("target", "path"), ["root_key", "path"]).join(inputs, ["root_key", "path"], "left")
    code = F.when(F.col("held") != "directory", 1).when(F.col("input").isNull(), 2)
    first = first.filter(code.isNotNull()).select(*UNIT, F.struct(order.alias("kind"), "bucket", "place", code.alias("code")).alias("worst"))
    worst = wrong.unionByName(first).groupBy(*UNIT).agg(F.min("worst").alias("worst"))
    reason = F.coalesce(_named(REASONS, F.col("problem")), _named(PLACES, F.col("worst.code")))
    return settled(units.join(worst, UNIT, "left").withColumn("reason", reason).drop("worst", "problem"))
