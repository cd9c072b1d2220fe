"""Lexical path functions. Paths are text with ``/``; nothing touches a file system."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z and nothing else: what case-insensitive filters compare."""
    return F.translate(text, UPPER, LOWER)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory part; empty for a name without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def suffix(name: Column) -> Column:
    """The last extension with its dot; none for leading-dot names and for names that end in a dot."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^./]+)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def depth(relative: Column) -> Column:
    return F.size(F.split(relative, "/"))


def under(path: Column, root: Column | str) -> Column:
    """Whether ``path`` is ``root`` or lies below it."""
    base = F.lit(root) if isinstance(root, str) else root
    return (path == base) | path.startswith(F.concat(base, F.lit("/")))


def under_any(path: Column, roots: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (under(path, r) for r in roots), F.lit(False))


def normalized(path: Column) -> Column:
    """The path without empty and ``.`` segments, with ``..`` resolved; an absolute path stays absolute."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, part: Column) -> Column:
        top = F.element_at(done, -1)
        climbs = F.size(done) > 0
        up = F.when(climbs & (top != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.when(absolute, done).otherwise(F.array_append(done, part))
        )
        return F.when(part == "..", up).otherwise(F.array_append(done, part))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    joined = F.array_join(folded, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def ancestors(relative: Column) -> Column:
    """All directories above a relative path, the root as the empty string first."""
    parts = F.split(relative, "/")
    deeper = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return F.concat(F.array(F.lit("")), F.coalesce(deeper, F.array().cast("array<string>")))


def common_prefix(low: Column, high: Column) -> Column:
    """The common leading segments of two relative paths."""
    pairs = F.zip_with(F.split(low, "/"), F.split(high, "/"), lambda a, b: F.struct(a.alias("a"), b.eqNullSafe(a).alias("same")))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        on = s.open & x.same & x.a.isNotNull()
        return F.struct(F.when(on, F.array_append(s.parts, x.a)).otherwise(s.parts).alias("parts"), on.alias("open"))

    return F.array_join(F.aggregate(pairs, start, step, lambda s: s.parts), "/")


def relative_to(path: Column, root: Column | str) -> Column:
    """``path`` below ``root``: empty for the root itself, null outside it."""
    base = F.lit(root) if isinstance(root, str) else root
    return F.when(path == base, "").when(under(path, base), F.substring(path, F.length(base) + 2, F.length(path)))


def top_directory(root: Column, relative: Column) -> Column:
    """The first directory below the root that holds a relative path, or the root."""
    return F.when(relative.contains("/"), F.concat(root, F.lit("/"), F.substring_index(relative, "/", 1))).otherwise(root)


def balance_bucket(directory: Column, common: Column) -> Column:
    """The first directory below ``common`` on the way to ``directory`` (both relative), or LCA_DIRECT for ``common`` itself."""
    below = F.when(common == "", directory).otherwise(relative_to(directory, common))
    first = F.substring_index(below, "/", 1)
    return F.when(directory == common, "LCA_DIRECT").when(common == "", first).otherwise(F.concat(common, F.lit("/"), first))


def natural_key(text: Column) -> Column:
    """Sort key under which digit runs compare as numbers of any length and text as lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)

    def part(run: Column) -> Column:
        digits = run.rlike(r"^\d")
        bare = F.regexp_replace(run, "^0+(?=.)", "")
        return F.struct(
            F.when(digits, 0).otherwise(1).alias("kind"),
            F.when(digits, F.length(bare)).otherwise(0).alias("length"),
            F.when(digits, bare).otherwise(run).alias("body"),
        )

    return F.transform(runs, part)


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern as an anchored Java regular expression; ``*`` crosses separators."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"
