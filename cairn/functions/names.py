"""Names: sizes in words, renaming, templates and the quality audit."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.paths import stem, suffix

#: Units of the two size notations.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
BINARY_UNITS = ["KiB", "MiB", "GiB", "TiB"]

#: The audit's characters, names and extensions.
EDGE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WINDOWS_INVALID = r'[<>:"/\\|?*]'
WINDOWS_DEVICE = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
INVISIBLE = r"[\p{Cc}\p{Cf}\p{Cs}]"
LONG_NAME_BYTES = 240
DOCUMENTS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".txt", ".jpg", ".jpeg", ".png", ".gif", ".mp4", ".mkv", ".zip", ".rar"]
EXECUTABLES = [".exe", ".bat", ".cmd", ".scr", ".com", ".ps1", ".vbs", ".js"]
STAT_SUFFIX = r"(?i)(\s+\[((\d+P(\s+\d+V)?)|(\d+V))?\s*\d+(\.\d+)?\s*(B|KB|MB|GB|TB|PB)\])+\s*$"


def size_text(size: Column) -> Column:
    """``4.13 KB``: base 1024, two decimals rounded half up by integers alone; the unit is chosen before rounding."""
    n = F.coalesce(size, F.lit(0)).cast("decimal(38,0)")
    out = None
    for power in range(len(UNITS) - 1, 0, -1):
        unit = 1024**power
        hundredths = F.call_function("div", n * 200 + F.lit(unit), F.lit(2 * unit).cast("decimal(38,0)"))
        text = F.concat(F.call_function("div", hundredths, F.lit(100).cast("long")).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("int").cast("string"), 2, "0"), F.lit(f" {UNITS[power]}"))
        out = F.when(n >= unit, text) if out is None else out.when(n >= unit, text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def size_label(size: Column) -> Column:
    """``1.5MiB``: whole tenths, a zero tenth dropped, bytes below 1024."""
    n = size.cast("long")
    out = None
    for power in range(len(BINARY_UNITS), 0, -1):
        unit = 1024**power
        tenths = F.floor((n * 10 + unit // 2) / F.lit(unit)).cast("long")
        whole, rest = F.floor(tenths / 10).cast("long").cast("string"), (tenths % 10).cast("string")
        text = F.concat(whole, F.when(rest == "0", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit(BINARY_UNITS[power - 1]))
        out = F.when(n >= unit, text) if out is None else out.when(n >= unit, text)
    return out.otherwise(F.concat(n.cast("string"), F.lit("B")))


def without_stat_suffixes(name: Column) -> Column:
    """The name without all ``[12P 3V 1.2 GB]`` at its end, and without white space there."""
    return F.regexp_replace(F.regexp_replace(name, STAT_SUFFIX, ""), f"{EDGE}+$", "")


def stat_name(name: Column, template: str, **counts: Column) -> Column:
    """A directory's name with counts: ``template`` knows ``{name}``, ``{size}`` and every one of ``counts`` but ``total_bytes``."""
    values = {"name": without_stat_suffixes(name), "size": size_text(counts["total_bytes"])}
    return render(template, values | {k: v for k, v in counts.items() if k != "total_bytes"})


def cleaned_base(name: Column, patterns: list[str]) -> Column:
    """The name without what any of the patterns matches (case aside), over and over until nothing changes; spaces at the end go each time.

    Every round but the last takes a character at least, so there are as many as the name has characters; once nothing
    changes, the rest of them cost nothing.
    """
    for pattern in patterns:
        re.compile(pattern)
    bare = lambda text: F.regexp_replace(text, f"{EDGE}+$", "")
    start = F.struct(bare(name).alias("text"), F.lit(bool(patterns)).alias("open"))

    def again(s: Column, _: Column) -> Column:
        less = reduce(lambda t, p: bare(F.regexp_replace(t, f"(?i){p}", "")), patterns, s["text"])
        return F.when(s["open"], F.struct(less.alias("text"), (less != s["text"]).alias("open"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.length(name)), start, again, lambda s: s["text"])


def rename(name: Column, mode: str, find: str = "", value: str = "", keep_extension: bool = True) -> Column:
    """One of ``replace_name``, ``replace_suffix``, ``add_prefix`` and ``add_suffix``, on the part before the extension."""
    tail = suffix(name) if keep_extension else F.lit("")
    body = stem(name) if keep_extension else name
    if mode == "replace_name":
        body = F.replace(body, F.lit(find), F.lit(value))
    elif mode == "replace_suffix":
        body = F.when(body.endswith(find), F.concat(F.left(body, F.length(body) - F.lit(len(find))), F.lit(value))).otherwise(body)
    elif mode == "add_prefix":
        body = F.concat(F.lit(value), body)
    elif mode == "add_suffix":
        body = F.concat(body, F.lit(value))
    else:
        raise ValueError(f"unknown rename mode: {mode}")
    return F.concat(body, tail)


def canonical_suffix(text: str) -> str:
    raw = text.strip()
    body = raw.removeprefix(".")
    if not body or "\0" in raw or "/" in raw or "\\" in raw or "" in body.split("."):
        raise ValueError(f"not a suffix: {text!r}")
    return "." + body


def suffix_transform(name: Column, mode: str, target: str) -> Column:
    """struct(target, reason): the new name, or why the file is skipped."""
    wanted, now = canonical_suffix(target), suffix(name)
    if mode == "append":
        return F.struct(F.concat(name, F.lit(wanted)).alias("target"), F.lit(None).cast("string").alias("reason"))
    if mode != "change":
        raise ValueError(f"unknown suffix mode: {mode}")
    reason = F.when(now == "", "NO_EXISTING_SUFFIX").when(now == wanted, "NO_CHANGE")
    return F.struct(F.when(reason.isNull(), F.concat(stem(name), F.lit(wanted))).alias("target"), reason.alias("reason"))


def audit(name: Column) -> Column:
    """The names of all rules that a file name breaks, in a fixed order, but for the normal form (``breaks_normal_form``)."""
    ext, bare = suffix(name), stem(name)
    second = suffix(bare)
    rules = {
        "edge_whitespace": name.rlike(f"^{EDGE}|{EDGE}$"),
        "windows_trailing_dot_space": name.endswith(".") | name.endswith(" "),
        "windows_invalid_character": name.rlike(WINDOWS_INVALID),
        "windows_reserved_device": F.split(name, r"\.")[0].rlike(WINDOWS_DEVICE),
        "invisible_or_control": name.rlike(INVISIBLE),
        "long_name": F.octet_length(name) > LONG_NAME_BYTES,
        "repeated_extension": (ext != "") & F.lower(bare).endswith(F.lower(ext)),
        "suspicious_double_extension": F.lower(ext).isin(EXECUTABLES) & F.lower(second).isin(DOCUMENTS),
    }
    return F.array_compact(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules.items())))


@F.pandas_udf(T.BooleanType())
def breaks_normal_form(name: pd.Series) -> pd.Series:
    """Whether a name is not in Unicode's composed normal form; no built-in function knows normal forms."""
    return name.map(lambda x: x is not None and not unicodedata.is_normalized("NFC", x))


def render(template: str, values: dict[str, Column]) -> Column:
    """``{var}`` and ``{?var: text with {var}}`` (text only where var is not empty) as one expression."""

    def tokens(body: str) -> list[Column]:
        depth = list(accumulate(({"{": 1, "}": -1}.get(c, 0) for c in body), initial=0))
        if min(depth) < 0 or depth[-1]:
            raise ValueError(f"unbalanced braces: {body!r}")
        edges = [i for i, c in enumerate(body) if (c == "{" and depth[i] == 0) or (c == "}" and depth[i + 1] == 0)]
        cuts = [0, *(i + (body[i] == "}") for i in edges), len(body)]
        parts = [body[i:j] for i, j in pairwise(cuts) if i < j]
        return [one(part[1:-1]) if part.startswith("{") else F.lit(part) for part in parts]

    def one(token: str) -> Column:
        if optional := re.fullmatch(r"\?(\w+):(.*)", token, re.DOTALL):
            held = values[optional[1]].cast("string")
            return F.when(held.isNotNull() & (held != "") & (held != "0"), F.concat(F.lit(""), *tokens(optional[2]))).otherwise(F.lit(""))
        return F.coalesce(values[token].cast("string"), F.lit(""))

    return F.concat(F.lit(""), *tokens(template))


#: What log lines must not show.
SECRETS = [
    (r"(?i)(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)\S+", "$1$2***"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/-]+=*", "$1***"),
]


def redacted(text: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), SECRETS, text)
