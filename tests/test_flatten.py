"""Blocked moves and the order of the others, in cases that are small enough to see."""

import pytest

from cairn.operators import flatten

ENTRY = "path string, kind string, device long, inode long, mtime_ns long, size long"
ITEM = "source string, target string, wrapper string, is_dir boolean, device long, inode long, mtime_ns long, size long"


def resolved(spark, moves, more=(), directories=()):
    kinds = {s: "directory" if s in directories else "file" for s, _ in moves}
    rows = [(p, k, 1, i, 1, 0) for i, (p, k) in enumerate({**kinds, **dict.fromkeys(more, "file"), "/r/w": "directory"}.items())]
    numbers = {p: i for p, _, _, i, _, _ in rows}
    items = [(s, t, "/r/w", s in directories, 1, numbers[s], 1, 0) for s, t in moves]
    wrappers = spark.createDataFrame([("/r/w", 1, numbers["/r/w"], 1)], "path string, device long, inode long, mtime_ns long")
    found = flatten.resolve(spark.createDataFrame(items, ITEM), spark.createDataFrame(rows, ENTRY), wrappers, ["/r"], "/r/trash")
    return {r.source: (r.conflicts, r.level) for r in found.collect()}


def test_a_blocked_move_blocks_all_that_wait(spark):
    chain = [(f"/r/w/{i}", f"/r/w/{i + 1}") for i in range(5)] + [("/r/w/5", "/r/taken")]
    free = [("/r/w/a", "/r/w/b"), ("/r/w/b", "/r/b")]
    found = resolved(spark, chain + free, more=["/r/taken"])
    assert all(found[f"/r/w/{i}"] == (["TARGET_EXISTS"], None) for i in range(6))
    assert found["/r/w/b"] == ([], 1) and found["/r/w/a"] == ([], 2)


def test_what_lies_below_a_target_must_leave_first(spark):
    moves = [("/r/w/x", "/r/w/d"), ("/r/w/d/1", "/r/1"), ("/r/w/d", "/r/d")]
    found = resolved(spark, moves, directories={"/r/w/d"})
    assert found == {"/r/w/d/1": ([], 1), "/r/w/d": ([], 1), "/r/w/x": ([], 2)}
    stuck = resolved(spark, [*moves, ("/r/w/d/2", "/r/held")], more=["/r/held"], directories={"/r/w/d"})
    assert stuck["/r/w/x"] == (["TARGET_EXISTS"], None) and stuck["/r/w/d"] == ([], 1)


def test_a_new_directory_comes_before_what_goes_into_it(spark):
    assert resolved(spark, [("/r/w/in", "/r/new/in"), ("/r/w/new", "/r/new")], directories={"/r/w/new"}) == {"/r/w/new": ([], 1), "/r/w/in": ([], 2)}


def test_cycles_and_equal_sources(spark):
    found = resolved(spark, [("/r/w/a", "/r/w/b"), ("/r/w/b", "/r/w/a"), ("/r/w/c", "/r/c")])
    assert found == {"/r/w/a": (["RENAME_CYCLE"], None), "/r/w/b": (["RENAME_CYCLE"], None), "/r/w/c": ([], 1)}
    assert resolved(spark, [("/r/w/a", "/r/a"), ("/r/w/a", "/r/b")]) == {"/r/w/a": (["PLANNED_TARGET_COLLISION"], None)}


@pytest.mark.parametrize(("one", "two"), [("Straße", "STRASSE"), ("É", "é")])
def test_names_that_differ_by_case_alone(spark, one, two):
    found = resolved(spark, [("/r/w/a", f"/r/{one}"), ("/r/w/b", f"/r/{two}")])
    assert {c for c, _ in map(lambda v: (tuple(v[0]), v[1]), found.values())} == {("CASE_ONLY_COLLISION",)}
    assert resolved(spark, [("/r/w/a", f"/r/{one}")], more=[f"/r/{two}"])["/r/w/a"][0] == ["CASE_ONLY_COLLISION"]
