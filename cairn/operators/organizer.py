"""Previews of organized trees: new directory names from what lies below, numbered files, collapsed wrappers, every conflict, and the order of the work.

``entries`` is what a scan of the roots lists: root_key, path (relative to the root), kind (file, directory, symlink or
other), size, mtime_ns, device, inode. A scan goes into no symlink, so nothing lies below one. A proposal keeps an object in its directory
(or, for a collapsed wrapper, moves its one child to where the wrapper is); source and target are relative to the root.

Every step is an aggregate, a join on paths or a sort by ranges, so that neither a root, nor a directory, nor a crowd of equal targets
is ever one task's work.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import EDGE, cleaned_base, render, size_text
from cairn.functions.paths import ancestors, basename, depth, natural_key, parent, suffix, under_any
from cairn.lineage import settled
from cairn.operators.flatten import folded
from cairn.operators.numbering import numbered_within
from cairn.operators.trees import final_paths, rename_order

#: Bytes that a file system takes for a name and for a path, and what a template may name.
NAME_BYTES, PATH_BYTES = 255, 4096
STATISTICS = ["images", "videos", "files", "files_count", "folders", "size", "name"]
NAMES = [*STATISTICS, "index", "statistics", "parent", "extension"]
#: Fixed value: a repeated group with a repeat inside, which may never end on some texts.
NESTED = r"\([^)]*([+*]|\{\d+,?\d*\})[^)]*\)([+*]|\{\d+,?\d*\})"

COUNTS = ["images", "videos", "files", "folders", "total_bytes"]


def template_problems(template: str, known: list[str]) -> list[str]:
    """What is wrong with a template: empty, braces that do not match, names that it may not use (sorted)."""
    if not template.strip():
        return ["empty"]
    if template.count("{") != template.count("}"):
        return ["unbalanced"]
    used = set(re.findall(r"\{\??\s*([^{}:]*?)\s*(?=[:}])", template))
    return [f"unknown: {name}" for name in sorted(used - set(known))]


def pattern_problems(patterns: list[str]) -> list[str]:
    """What is wrong with cleaning patterns, by number from 1: more than 10, blank, over 200 characters, nested repeats, no expression."""

    def one(pattern: str) -> str | None:
        if not pattern.strip():
            return "blank"
        if len(pattern) > 200:
            return "too long"
        if re.search(NESTED, pattern):
            return "nested repeats"
        try:
            re.compile(pattern)
        except re.error:
            return "not a regular expression"
        return None

    found = [f"{i}: {problem}" for i, p in enumerate(patterns, 1) if (problem := one(p))]
    return (["more than 10"] if len(patterns) > 10 else []) + found


@dataclass(frozen=True)
class Rules:
    """What a profile asks for. Any of ``from_depth``, ``file_numbers_from``, ``latest_prefix`` and ``collapse_wrappers`` makes it advanced."""

    images: tuple[str, ...]
    videos: tuple[str, ...]
    name: str = "{name} {statistics}"
    statistics: str = "[{images}P{?videos: {videos}V} {size}]"
    tags: tuple[str, ...] = ()
    cleanup: tuple[str, ...] = ()
    number_from: int | None = None
    number_width: int = 3
    touch_in_order: bool = False
    recursive: bool = True
    from_depth: int | None = None
    file_numbers_from: int | None = None
    file_number_width: int = 3
    latest_prefix: str | None = None
    collapse_wrappers: bool = False
    excluded_names: tuple[str, ...] = ()
    excluded_roots: tuple[str, ...] = ()
    reserved: str | None = None

    def __post_init__(self) -> None:
        problems = template_problems(self.name, NAMES) + template_problems(self.statistics, STATISTICS) + pattern_problems(list(self.cleanup))
        if self.advanced and not self.recursive:
            problems.append("advanced rules need all levels")
        if self.latest_prefix is not None and (self.touch_in_order or not self.latest_prefix.strip() or len(self.latest_prefix) > 64 or re.search(r"[/\0]", self.latest_prefix)):
            problems.append("prefix of the latest child")
        if self.from_depth is not None and not 2 <= self.from_depth <= 64:
            problems.append("depth below 2 or above 64")
        if self.file_numbers_from is not None and (self.file_numbers_from < 0 or not 1 <= self.file_number_width <= 10):
            problems.append("numbers of files")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def advanced(self) -> bool:
        return self.from_depth is not None or self.file_numbers_from is not None or self.latest_prefix is not None or self.collapse_wrappers


def _absolute(path: str) -> Column:
    return F.concat("root_key", F.lit("/"), path)


def _beside(path: Column, name: Column) -> Column:
    """The path of ``name`` in the directory of ``path``."""
    up = parent(path)
    return F.when(up == "", name).otherwise(F.concat(up, F.lit("/"), name))


def _included(rules: Rules) -> Column:
    named = F.arrays_overlap(F.split(_absolute("path"), "/"), F.array(*map(F.lit, rules.excluded_names)).cast("array<string>"))
    return ~named & ~under_any(_absolute("path"), list(rules.excluded_roots))


def _chosen(rules: Rules) -> Column:
    """Whether an entry is a directory that gets a proposal."""
    below = (F.col("kind") == "directory") & (F.col("path") != "") & _included(rules)
    return below if rules.recursive else below & ~F.col("path").contains("/")


def _padded(number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def statistics(entries: DataFrame, rules: Rules) -> DataFrame:
    """root_key, path, images, videos, files, folders, total_bytes of everything below each directory (symlinks and what is excluded left out)."""
    kept = entries.filter(_included(rules) & (F.col("kind") != "symlink") & (F.col("path") != ""))
    leaf = F.col("kind") != "directory"
    ext = F.lower(F.ltrim(suffix(basename(F.col("path"))), F.lit(".")))
    one = lambda hit: F.when(hit, 1).otherwise(0).cast("long")
    rows = kept.select(
        "root_key", F.explode(ancestors(F.col("path"))).alias("up"),
        one(leaf & ext.isin(*(e.lstrip(".").lower() for e in rules.images))).alias("images"),
        one(leaf & ext.isin(*(e.lstrip(".").lower() for e in rules.videos))).alias("videos"),
        one(leaf).alias("files"), one(~leaf).alias("folders"), F.when(leaf, F.col("size")).otherwise(0).cast("long").alias("total_bytes"),
    )
    return rows.filter("up <> ''").groupBy("root_key", F.col("up").alias("path")).agg(*(F.sum(c).alias(c) for c in COUNTS))


def _titled(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` with ``tags`` (those in the name) and ``title``, the new name: cleaned, rendered, and with no tag lost."""
    ends = f"^{EDGE}+|{EDGE}+$"
    counts = {c: F.col(c) for c in ("images", "videos", "files", "folders")} | {"files_count": F.col("files"), "size": size_text(F.col("total_bytes"))}
    index = _padded(F.col("place") + (rules.number_from - 1), rules.number_width) if rules.number_from is not None else F.lit("")
    own = basename(F.col("path"))
    known = F.filter(F.array(*map(F.lit, rules.tags)).cast("array<string>"), lambda t: (t != "") & own.contains(t))
    rows = rows.withColumn("tags", known).withColumn("__base", cleaned_base(own, list(rules.cleanup)))
    rows = rows.withColumn("__stat", F.regexp_replace(render(rules.statistics, counts | {"name": F.col("__base")}), ends, ""))
    values = counts | {"name": F.col("__base"), "index": index, "statistics": F.col("__stat"), "parent": basename(parent(_absolute("path"))), "extension": F.lit("")}
    made = F.regexp_replace(render(rules.name, values), ends, "")
    stat = F.col("__stat")

    def with_tag(title: Column, tag: Column) -> Column:
        put = F.when((stat != "") & title.contains(stat), F.replace(title, stat, F.concat(tag, F.lit(" "), stat))).otherwise(F.concat(title, F.lit(" "), tag))
        return F.when(title.contains(tag), title).otherwise(F.regexp_replace(put, ends, ""))

    return rows.withColumn("title", F.aggregate("tags", made, with_tag)).drop("__base", "__stat")


def _unfit(target: str = "target") -> Column:
    """Why a target cannot be a path at all."""
    name = basename(F.col(target))
    return (
        F.when(name.isin("", ".", "..") | F.col(target).contains("\0"), "INVALID_TARGET_NAME")
        .when(F.octet_length(name) > NAME_BYTES, "NAME_TOO_LONG")
        .when(F.octet_length(_absolute(target)) > PATH_BYTES, "PATH_TOO_LONG")
    )


def _with_cycles(rows: DataFrame) -> DataFrame:
    """``rows`` with RENAME_CYCLE where nothing else speaks against a change, but it lies on a circle or waits for one."""
    rows = settled(rows)
    items = rows.filter("changed AND conflict IS NULL AND type <> 'wrapper_collapse'").select(_absolute("source").alias("source"), _absolute("target").alias("target"))
    waiting = items.join(items.select(F.col("source").alias("target")), "target", "left_semi").select("source", "target")  # no other one can be on a circle
    stuck = rename_order(waiting).filter("cyclic").select(F.col("source").alias("__at"), F.lit("RENAME_CYCLE").alias("__round"))
    out = rows.withColumn("__at", _absolute("source")).join(stuck, "__at", "left")
    return out.withColumn("conflict", F.coalesce("conflict", "__round")).drop("__at", "__round")


def directory_proposals(entries: DataFrame, rules: Rules) -> DataFrame:
    """A proposal for each directory, in order of depth and natural name (``place`` from 1), with the first reason against it.

    Of several with one target the first in order has it. A target that a directory with a proposal of its own holds counts as free. Names of
    equal natural order are taken by spelling, then by path. A name that comes out empty, as ``.`` or with a ``/`` is INVALID_TARGET_NAME.
    """
    found = entries.filter(_chosen(rules)).select("root_key", "path", "mtime_ns")
    counted = found.join(statistics(entries, rules), ["root_key", "path"], "left").fillna(0, COUNTS)
    keyed = counted.withColumn("__depth", depth(F.col("path"))).withColumn("__name", basename(F.col("path"))).withColumn("__key", natural_key(F.col("__name")))
    placed = numbered_within(keyed, ["root_key"], [F.col("__depth"), F.col("__key"), F.col("__name"), F.col("path")], "place")
    placed = placed.withColumn("place", F.col("place") + 1).drop("__depth", "__key", "__name")
    titled = settled(_titled(placed, rules))
    bad = F.col("title").contains("/") | F.col("title").isin("", ".", "..") | F.col("title").contains("\0")
    drafted = titled.withColumn("bad", bad).withColumn("target", _beside(F.col("path"), F.col("title"))).withColumnRenamed("path", "source").drop("title")
    firsts = drafted.groupBy("root_key", "target").agg(F.min("place").alias("first"))
    held = entries.select("root_key", F.col("path").alias("target"), F.col("kind").alias("held"), _chosen(rules).alias("ours"))
    judged = drafted.join(firsts, ["root_key", "target"], "left").join(held, ["root_key", "target"], "left")
    conflict = F.coalesce(
        F.when(F.col("bad"), "INVALID_TARGET_NAME"),
        _unfit(),
        F.when(F.col("held") == "symlink", "SYMLINK_BLOCKED").when(F.col("held").isNotNull() & ~F.col("ours"), "TARGET_EXISTS").when(F.col("place") > F.col("first"), "PLANNED_TARGET_COLLISION"),
    )
    out = judged.select(
        "root_key", "source", "target", F.lit("directory_rename").alias("type"), F.lit("directory").alias("object"), *COUNTS, "tags",
        (F.col("target") != F.col("source")).alias("changed"), conflict.alias("conflict"), "place", "mtime_ns",
    )
    return _with_cycles(out)


def _deep_enough(rows: DataFrame, rules: Rules) -> DataFrame:
    """Directories above the depth keep their names, whatever speaks against the new ones."""
    high = depth(F.col("source")) < (rules.from_depth or 2)
    return rows.withColumn("target", F.when(high, F.col("source")).otherwise(F.col("target"))).withColumn("changed", F.col("changed") & ~high).withColumn("conflict", F.when(~high, F.col("conflict")))


def _latest_marked(rows: DataFrame, prefix: str) -> DataFrame:
    """The newest directory of each below the roots' own gets the prefix; where several are newest, each is a LATEST_CHILD_TIE."""
    rows = rows.withColumn("up", parent(F.col("source")))
    per = rows.filter("up <> ''").groupBy("root_key", "up")
    newest = per.agg(F.max("mtime_ns").alias("newest"))
    top = rows.join(newest, ["root_key", "up"]).filter("mtime_ns = newest").groupBy("root_key", "up", "newest").agg(F.count("*").alias("tops"))
    marked = rows.join(top, ["root_key", "up"], "left").withColumn("top", F.coalesce(F.col("mtime_ns") == F.col("newest"), F.lit(False)))
    name, lone, tied = basename(F.col("target")), F.col("top") & (F.col("tops") == 1), F.col("top") & (F.col("tops") > 1)
    marked = marked.withColumn("target", F.when(lone & ~name.startswith(prefix), _beside(F.col("target"), F.concat(F.lit(prefix), name))).otherwise(F.col("target")))
    changed = F.when(lone, F.col("target") != F.col("source")).otherwise(F.col("changed"))
    marked = marked.withColumn("changed", changed).withColumn("type", F.when(lone, "latest_child_prefix").otherwise(F.col("type")))
    return marked.withColumn("conflict", F.when(tied, "LATEST_CHILD_TIE").otherwise(F.col("conflict"))).drop("up", "newest", "tops", "top")


def file_proposals(entries: DataFrame, rules: Rules) -> DataFrame:
    """Every regular file below the roots' own directories with its number in natural order of names within its directory."""
    own = entries.filter(_included(rules) & (F.col("kind") == "file") & F.col("path").contains("/")).select("root_key", F.col("path").alias("source"), "size", "mtime_ns")
    own = own.withColumn("up", parent(F.col("source"))).withColumn("__name", basename(F.col("source"))).withColumn("__key", natural_key(F.col("__name")))
    placed = numbered_within(own, ["root_key", "up"], [F.col("__key"), F.col("__name")], "place")
    title = F.concat(_padded(F.col("place") + rules.file_numbers_from, rules.file_number_width), suffix(F.col("__name")))
    placed = placed.withColumn("target", _beside(F.col("source"), title))
    zero = F.lit(0).cast("long")
    return placed.select(
        "root_key", "source", "target", F.lit("file_rename").alias("type"), F.lit("file").alias("object"), zero.alias("images"), zero.alias("videos"), F.lit(1).cast("long").alias("files"), zero.alias("folders"),
        F.col("size").cast("long").alias("total_bytes"), F.array().cast("array<string>").alias("tags"), (F.col("target") != F.col("source")).alias("changed"), F.lit(None).cast("string").alias("conflict"),
        F.lit(None).cast("long").alias("place"), "mtime_ns",
    )


def wrappers(entries: DataFrame, rules: Rules) -> DataFrame:
    """root_key, wrapper, child, target, conflict and identities of directories at depth 2 that hold one entry of whatever kind."""
    inner = entries.filter(F.size(F.split("path", "/")) == 3)
    single = inner.groupBy("root_key", parent(F.col("path")).alias("wrapper")).agg(
        F.count("*").alias("n"), F.max("path").alias("child"), F.max("kind").alias("kind"), F.max("device").alias("device"), F.max("inode").alias("inode")
    )
    own = entries.filter(_included(rules) & (F.col("kind") == "directory") & (F.size(F.split("path", "/")) == 2))
    own = own.select("root_key", F.col("path").alias("wrapper"), F.col("device").alias("wrapper_device"), F.col("inode").alias("wrapper_inode"))
    shaped = single.filter("n = 1").join(own, ["root_key", "wrapper"]).withColumn("target", F.concat(parent(F.col("wrapper")), F.lit("/"), basename(F.col("child"))))
    held = entries.select("root_key", F.col("path").alias("target"), F.lit(True).alias("held"))
    conflict = F.when(F.col("kind") == "symlink", "WRAPPER_CHILD_SYMLINK").when(F.col("kind") != "directory", "WRAPPER_CHILD_NOT_DIRECTORY").when(F.col("held"), "WRAPPER_TARGET_EXISTS")
    shaped = shaped.join(held, ["root_key", "target"], "left")
    return shaped.select("root_key", "wrapper", "child", "target", conflict.alias("conflict"), "wrapper_device", "wrapper_inode", "device", "inode")


def _crossed(rows: DataFrame, entries: DataFrame, rules: Rules) -> DataFrame:
    """Conflicts between proposals of all kinds. Targets that differ by case alone exclude one another.

    A target that something holds is free if that is an object of the same kind with a change of its own, sound or not.
    """
    rows = settled(rows)
    moving = F.col("changed") & (F.col("type") != "wrapper_collapse")
    held = entries.select("root_key", F.col("path").alias("target"), F.col("kind").alias("held"))
    owners = rows.filter(moving).select("root_key", F.col("source").alias("target"), F.col("object").alias("owner"))
    reserved = under_any(parent(_absolute("target")), [rules.reserved]) if rules.reserved else F.lit(False)
    seen = rows.join(held, ["root_key", "target"], "left").join(owners, ["root_key", "target"], "left")
    first = F.coalesce("conflict", F.when(moving, F.coalesce(_unfit(), F.when(reserved, "OUTSIDE_ALLOWED_ROOT").when(F.col("held") == "symlink", "SYMLINK_BLOCKED"))))
    seen = settled(seen.withColumn("conflict", first).withColumn("home", parent(F.col("target"))).withColumn("fold", folded(basename(F.col("target")))))
    open_ = moving & F.col("conflict").isNull()
    claims = seen.filter(open_).groupBy("root_key", "home", "fold").agg(F.count("*").alias("claims"))
    seen = seen.join(claims, ["root_key", "home", "fold"], "left")
    foreign = F.col("held").isNotNull() & ~F.col("owner").eqNullSafe(F.col("object"))
    conflict = F.coalesce("conflict", F.when(open_, F.when(F.col("claims") > 1, "PLANNED_TARGET_COLLISION").when(foreign, "TARGET_EXISTS")))
    return _with_cycles(seen.withColumn("conflict", conflict).select(*rows.columns))


def preview(entries: DataFrame, rules: Rules) -> DataFrame:
    """All proposals of a profile: root_key, source, target, type, object, counts, tags, changed, conflict (the reason or null), place.

    ``type`` is directory_rename, latest_child_prefix, file_rename or wrapper_collapse. An advanced profile keeps the names of directories
    right below a root, and holds proposals of all kinds against one another.
    """
    rows = directory_proposals(entries, rules)
    if not rules.advanced:
        return rows.drop("mtime_ns")
    rows = _deep_enough(rows, rules)
    if rules.latest_prefix is not None:
        rows = _latest_marked(rows, rules.latest_prefix)
    if rules.file_numbers_from is not None:
        rows = rows.unionByName(file_proposals(entries, rules))
    if rules.collapse_wrappers:
        zero = F.lit(0).cast("long")
        shapes = wrappers(entries, rules).select(
            "root_key", F.col("child").alias("source"), "target", F.lit("wrapper_collapse").alias("type"), F.lit("directory").alias("object"), zero.alias("images"), zero.alias("videos"), zero.alias("files"),
            F.lit(1).cast("long").alias("folders"), zero.alias("total_bytes"), F.array().cast("array<string>").alias("tags"), F.col("conflict").isNull().alias("changed"), "conflict",
            F.lit(None).cast("long").alias("place"), zero.alias("mtime_ns"),
        )
        rows = rows.unionByName(shapes)
    return _crossed(rows, entries, rules).drop("mtime_ns")


def summary(proposals: DataFrame, entries: DataFrame, rules: Rules) -> DataFrame:
    """One row a root with proposals: directories, changed_directories, changes, conflicts, files, wrappers, structural, total_bytes (of all files not directly in the root)."""
    sound = F.col("changed") & F.col("conflict").isNull()
    of = lambda kind: F.col("type") == kind
    dirs = of("directory_rename") | of("latest_child_prefix")
    counted = proposals.groupBy("root_key").agg(
        F.count_if(dirs).alias("directories"), F.count_if(dirs & sound).alias("changed_directories"), F.count_if(sound).alias("changes"), F.count_if(F.col("conflict").isNotNull()).alias("conflicts"),
        F.count_if(of("file_rename")).alias("files"), F.count_if(of("wrapper_collapse")).alias("wrappers"), F.coalesce(F.max(of("wrapper_collapse") & sound), F.lit(False)).alias("structural"),
    )
    deep = entries.filter(_included(rules) & F.col("kind").isin("file", "other") & F.col("path").contains("/"))
    return counted.join(deep.groupBy("root_key").agg(F.sum("size").alias("total_bytes")), "root_key", "left").fillna(0, ["total_bytes"])


def operations(proposals: DataFrame, rules: Rules) -> DataFrame:
    """root_key, sequence (from 1 in each root), operation, source, target: all sound renames, what lies deepest first, then touches in order.

    At one depth a rename comes after the one that frees its target. Touches name the paths that directories have when all is renamed;
    a directory whose rename is not sound keeps its name.
    """
    sound = settled(proposals.filter("changed AND conflict IS NULL AND type <> 'wrapper_collapse'").select("root_key", "source", "target", "place"))
    order = rename_order(sound.select(_absolute("source").alias("source"), _absolute("target").alias("target"))).select(F.col("source").alias("at"), "level")
    renames = sound.withColumn("at", _absolute("source")).join(order, "at").select("root_key", F.lit("rename").alias("operation"), "source", "target", F.lit(0).alias("phase"), (-depth(F.col("source"))).cast("long").alias("major"), "level")
    rows = renames
    if rules.touch_in_order:
        dirs = proposals.filter("object = 'directory' AND type <> 'wrapper_collapse'").select("root_key", "source", "place", _absolute("source").alias("path"))
        named = sound.select(_absolute("source").alias("path"), basename(F.col("target")).alias("new_name"))
        ends = dirs.join(final_paths(dirs.select("path"), named), "path").select("root_key", F.expr("substring(final, length(root_key) + 2)").alias("source"), "place")
        touches = ends.select("root_key", F.lit("touch").alias("operation"), "source", F.lit(None).cast("string").alias("target"), F.lit(1).alias("phase"), F.col("place").alias("major"), F.lit(0).cast("long").alias("level"))
        rows = rows.unionByName(touches)
    run = numbered_within(rows, ["root_key"], [F.col("phase"), F.col("major"), F.col("level"), F.col("source")], "sequence")
    return run.select("root_key", (F.col("sequence") + 1).alias("sequence"), "operation", "source", "target")


def structural(planned: DataFrame, entries: DataFrame, rules: Rules) -> DataFrame:
    """``planned`` (sound rows of ``wrappers``) against the entries of now: root_key, wrapper, child, target, problem, sequence.

    WRAPPER_GONE: it is no longer a directory with one entry. NOT_READY: something now stands against it. CHANGED: it, its child or the target is
    another one. Those without a problem get the number of their move (in order of wrappers, over all roots); the removal of the
    empty wrapper is the next number.
    """
    same = ["child", "target", "wrapper_device", "wrapper_inode", "device", "inode"]
    now = wrappers(entries, rules).select("root_key", "wrapper", F.col("conflict").alias("against"), F.struct(*same).alias("now"))
    seen = planned.filter("conflict IS NULL").join(now, ["root_key", "wrapper"], "left")
    problem = F.when(F.col("now").isNull(), "WRAPPER_GONE").when(F.col("against").isNotNull(), "NOT_READY").when(F.col("now") != F.struct(*same), "CHANGED")
    seen = settled(seen.select("root_key", "wrapper", "child", "target", problem.alias("problem")))
    ready = numbered_within(seen.filter("problem IS NULL"), [], [F.col("root_key"), F.col("wrapper")], "place")
    return ready.withColumn("sequence", F.col("place") * 2 + 1).drop("place").unionByName(seen.filter("problem IS NOT NULL").withColumn("sequence", F.lit(None).cast("long")))
