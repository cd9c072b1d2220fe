"""A filter language over manifest rows: an expression tree, checked on the driver and compiled to one Column.

A leaf is ``{"field", "operator", "value", "case_sensitive"}``, a node ``{"op": "and" | "or", "children"}`` or
``{"op": "not", "child"}``. Data is compared with A-Z as a-z only, literals are lowered by Python.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.media import EXTENSIONS
from cairn.functions.paths import ascii_lower, under

MAX_DEPTH, MAX_CHILDREN, MAX_LEAVES = 5, 50, 200
ORDER = {"eq", "neq", "gt", "gte", "lt", "lte"}
#: The operators of each field.
OPERATORS = {
    "size": ORDER,
    "mtime": ORDER,
    "extension": {"eq", "neq", "in", "nin"},
    "media_type": {"eq", "neq", "in", "nin"},
    "path": {"eq", "neq", "contains", "startswith", "endswith", "in", "nin"},
    "name": {"eq", "neq", "contains", "startswith", "endswith", "in", "nin"},
}
#: Directories left out by default.
DEFAULT_EXCLUDES = [".git", ".recycle", "@eaDir"]
MAX_EXCLUDES, MAX_EXCLUDE_LENGTH = 64, 128

COMPARE = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def mtime_ns(value: Any) -> int:
    """An aware ISO time or whole epoch seconds as nanoseconds."""
    if isinstance(value, bool) or isinstance(value, float):
        raise ValueError("times are ISO strings or whole seconds")
    if isinstance(value, int):
        out = value * 10**9
    else:
        at = datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
        if at.tzinfo is None:
            raise ValueError("times need a zone")
        out = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) * 1000
    if not 0 <= out < 2**63:
        raise ValueError("time out of range")
    return out


def _literal(field: str, operator: str, value: Any) -> Any:
    """The value of a leaf in its final form."""
    many = operator in ("in", "nin")
    if many and (not isinstance(value, list) or not value):
        raise ValueError("in and nin take a list")
    if field == "mtime":
        return mtime_ns(value)
    if field == "size":
        if type(value) is not int or value < 0:
            raise ValueError("sizes are whole numbers")
        return value
    texts = value if many else [value]
    if not all(isinstance(x, str) for x in texts):
        raise ValueError(f"{field} takes text")
    if field in ("extension", "media_type"):
        texts = [x.strip().lower().removeprefix(".") for x in texts]
    if not all(texts) and (many or field in ("extension", "media_type")):
        raise ValueError("blank items")
    if field == "media_type" and not {*EXTENSIONS, "other"}.issuperset(texts):
        raise ValueError("unknown media type")
    return texts if many else texts[0]


def checked(node: dict) -> dict:
    """The tree with literals in their final form; raises ValueError for anything the language does not have.

    The tree is walked level by level, so its depth and its leaves are counted by the walk itself.
    """
    top: dict = {}
    level, leaves = [(node, top)], 0
    for _ in range(MAX_DEPTH):
        below = []
        for given, out in level:
            if given.get("op") in ("and", "or", "not"):
                children = [given["child"]] if given["op"] == "not" else given.get("children") or []
                if not 1 <= len(children) <= MAX_CHILDREN:
                    raise ValueError("and/or take 1 to 50 children")
                made: list[dict] = [{} for _ in children]
                out.update({"op": "not", "child": made[0]} if given["op"] == "not" else {"op": given["op"], "children": made})
                below += zip(children, made, strict=True)
                continue
            leaves += 1
            field, operator = (str(given.get(k)).strip().lower() for k in ("field", "operator"))
            if leaves > MAX_LEAVES or operator not in OPERATORS.get(field, ()):
                raise ValueError("too many leaves" if leaves > MAX_LEAVES else f"{field} has no operator {operator}")
            out.update({"field": field, "operator": operator, "value": _literal(field, operator, given.get("value")), "case_sensitive": bool(given.get("case_sensitive"))})
        level = below
        if not level:
            return top
    raise ValueError("filter too deep")


def _has_extension(extensions: list[str]) -> Column:
    return F.lower("suffix").isin([x for e in extensions for x in (f".{e}", e)])


def _has_media_type(kind: str) -> Column:
    kind = kind.strip().lower()
    if kind == "other":
        return ~_has_extension([e for known in EXTENSIONS.values() for e in known])
    return _has_extension(EXTENSIONS[kind])


def _text(column: Column, operator: str, value: Any, exact: bool) -> Column:
    data = column if exact else ascii_lower(column)
    value = [v if exact else v.lower() for v in value] if isinstance(value, list) else value if exact else value.lower()
    if operator in ("in", "nin"):
        return data.isin(value) if operator == "in" else ~data.isin(value)
    if operator == "contains":
        return data.contains(value)
    if operator == "startswith":
        return data.startswith(value)
    if operator == "endswith":
        return data == "" if exact and value == "" else data.endswith(value)
    return COMPARE[operator](data, F.lit(value))


def compile_filter(node: dict) -> Column:
    """The predicate of a checked tree."""
    if node.get("op") in ("and", "or"):
        join = (lambda a, b: a & b) if node["op"] == "and" else (lambda a, b: a | b)
        return reduce(join, map(compile_filter, node["children"]))
    if node.get("op") == "not":
        return ~compile_filter(node["child"])
    field, operator, value = node["field"], node["operator"], node["value"]
    if field == "size":
        return COMPARE[operator](F.col("size"), F.lit(value))
    if field == "mtime":
        return COMPARE[operator](F.col("mtime_ns"), F.lit(value))
    if field in ("path", "name"):
        return _text(F.col("relative_path" if field == "path" else "basename"), operator, value, node["case_sensitive"])
    values = value if isinstance(value, list) else [value]
    if field == "extension":
        found = _has_extension([v.lower() for v in values])
    else:
        found = reduce(lambda a, b: a | b, map(_has_media_type, values))
    return found if operator in ("eq", "in") else ~found


def checked_excludes(rules: list[str]) -> list[str]:
    """Directory names, each once, in their order."""
    out = list(dict.fromkeys(rules))
    for rule in out:
        if not isinstance(rule, str) or rule != rule.strip() or rule in ("", ".", "..") or set("/\\\0") & set(rule) or len(rule) > MAX_EXCLUDE_LENGTH:
            raise ValueError(f"not a directory name: {rule!r}")
    if len(out) > MAX_EXCLUDES:
        raise ValueError("too many exclude rules")
    return out


def not_excluded(rules: list[str], reserved: str | None = None) -> Column:
    """That no segment of the path is an excluded name, and the path is not in the reserved tree."""
    out = F.lit(True)
    if rules := [r.lower() for r in checked_excludes(rules)]:
        out = ~F.arrays_overlap(F.split(ascii_lower(F.col("relative_path")), "/"), F.array(*map(F.lit, rules)))
    if reserved and reserved.strip():
        out &= ~under(ascii_lower(F.col("absolute_path")), reserved.strip().lower())
    return out


def select(files: DataFrame, roots: list[str], node: dict | None = None, excludes: list[str] | None = None, reserved: str | None = None) -> DataFrame:
    """Files of the roots that pass the filter and the exclusions."""
    out = files.filter(F.col("root_key").isin(roots) & ~F.col("is_dir"))
    if node is not None:
        out = out.filter(compile_filter(checked(node)))
    return out.filter(not_excluded(DEFAULT_EXCLUDES if excludes is None else excludes, reserved))


def totals(selected: DataFrame) -> DataFrame:
    return selected.agg(F.count("*").alias("matched_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("matched_bytes"))


def page(rows: DataFrame, sort_by: str, descending: bool, number: int, size: int) -> DataFrame:
    """One page of rows; ties go by id in the same direction."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("pages start at 1 and hold 1 to 200 rows")
    column = {"size": "size", "mtime": "mtime_ns", "name": "basename", "path": "relative_path"}[sort_by]
    keys = [F.col(column), F.col("id")]
    return rows.orderBy(*(k.desc() if descending else k.asc() for k in keys)).offset((number - 1) * size).limit(size)


def target_problem(root: str, reserved: str) -> Column:
    """Why ``target`` may not be written, or null."""
    name = F.substring_index("target", "/", -1)
    return (
        F.when(F.octet_length(name) > 255, "NAME_TOO_LONG")
        .when(name.isin("", ".", ".."), "RESERVED_NAME")
        .when(~under(F.col("target"), root), "OUTSIDE_ROOTS")
        .when(under(F.col("target"), reserved), "RESERVED_TREE")
    )
