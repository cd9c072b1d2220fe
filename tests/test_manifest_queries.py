"""Every manifest query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from cairn import queries as manifest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(manifest.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    found = manifest.QUERIES[name](spark, SF)
    wanted = duck.execute(manifest.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert table([tuple(r) for r in found.collect()], found.columns) == table(wanted.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(manifest.QUERIES) - set(manifest.ORACLE_SQL)))
def test_without_sql_runs_the_same_twice(spark, name):
    one, two = (sorted(map(str, manifest.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert one == two


BRANCHES = {
    "snapshot_tree": {"leaf": {True, False}, "level": {0, 1}},
    "snapshot_changes": {"before": {0, 1}, "after": {0, 1, 2}},
    "media_units": {
        "status": {"ready", "already_organized", "skipped", "blocked"},
        "operation": {None, "flatten", "buckets", "sort"},
        "reason": {None, "WRAPPER_DEPTH", "RESERVED_WORKSPACE", "EXCLUDED_IN_WRAPPER", "CROSS_DEVICE", "INDEPENDENT_WORK", "SPECIAL_FILE", "TARGET_OCCUPIED", "FOLDER_NOT_DIRECTORY", "FOLDER_NOT_AN_INPUT"},
    },
    "media_unit_held": {"reason": {"RESERVED_WORKSPACE", "CROSS_DEVICE", "SPECIAL_FILE", "UNCLEAR_FOLDER"}},
    "media_unit_groups": {"kind": {"P", "V", "Other"}, "bucket": {0, 1, 2}},
    "operation_order": {"cyclic": {True, False}, "level": {None, *range(1, 8)}},
    "operation_problems": {"problem": {"STEP_COLLISION", "FINAL_COLLISION", "TARGET_EXISTS", "TARGET_NOT_VACATED"}},
    "flatten_preflight": {"problem": {None, "INVALID_CONFIG", "SCOPE_NOT_FOUND", "SYMLINK_BLOCKED", "CROSS_ROOT", "SCOPE_OVERLAP"}},
    "flatten_resolution": {
        "unnest(string_split(conflicts, ','))": {
            "", "WRAPPER_IDENTITY_CHANGED", "SOURCE_MISSING", "WRAPPER_CHILD_SYMLINK", "UNSUPPORTED_OBJECT", "SOURCE_TYPE_CHANGED", "SOURCE_IDENTITY_CHANGED", "TARGET_SYMLINK",
            "RESERVED_TARGET", "TARGET_OUTSIDE_ALLOWED_ROOT", "NAME_TOO_LONG", "PLANNED_TARGET_COLLISION", "CASE_ONLY_COLLISION", "TARGET_EXISTS", "RENAME_CYCLE",
        },
        "level": {None, 1, 2},
    },
    "organizer_preview": {
        "conflict": {None, "PLANNED_TARGET_COLLISION", "TARGET_EXISTS", "SYMLINK_BLOCKED", "NAME_TOO_LONG", "OUTSIDE_ALLOWED_ROOT", "LATEST_CHILD_TIE", "WRAPPER_CHILD_SYMLINK", "WRAPPER_CHILD_NOT_DIRECTORY", "WRAPPER_TARGET_EXISTS"},
        "type": {"directory_rename", "latest_child_prefix", "file_rename", "wrapper_collapse"}, "tags": {"", "KEEP"}, "changed": {True, False},
    },
    "organizer_renames": {"conflict": {None, "INVALID_TARGET_NAME", "PLANNED_TARGET_COLLISION", "RENAME_CYCLE"}},
    "organizer_operations": {"operation": {"rename", "touch"}},
    "organizer_structural": {"problem": {None, "WRAPPER_GONE", "NOT_READY", "CHANGED"}},
}


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_every_branch_has_rows(duck, name):
    for column, values in BRANCHES[name].items():
        assert {r[0] for r in duck.execute(f"SELECT DISTINCT {column} FROM ({manifest.ORACLE_SQL[name]})").fetchall()} == values


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
