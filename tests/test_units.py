"""Works in a tree of media in cases that are small enough to see."""

import random

import pytest

from cairn.operators import layout, units
from cairn.operators.units import Rules

ENTRY = "root_key string, path string, kind string, size long, device long, root_device long"


def listed(spark, paths, kinds=None, root="/r", extra=()):
    """Entries of one root: what ends with / is a directory, and so is all above a path."""
    above = {"/".join(p.rstrip("/").split("/")[:i]) for p in paths for i in range(1, p.rstrip("/").count("/") + 1)}
    every = {p: "file" for p in paths if not p.endswith("/")} | dict.fromkeys(above | {p.rstrip("/") for p in paths if p.endswith("/")}, "directory") | (kinds or {})
    return spark.createDataFrame([(root, p, k, 10, 1, 1) for p, k in sorted(every.items())] + list(extra), ENTRY)


def states(made):
    return {r.unit: (r.status, r.reason or r.operation) for r in made.units.collect()}


def test_names_of_old_folders(spark):
    names = {"P": True, "v_2": True, "P12": True, "P_0": False, "p_1 [3 4B]": True, "P [3 ]": False, "PP": False, "other": True, "Other [2 1KiB]": True, "other [x]": False, "Photos": True, "图片": True, "视频": True, "others": False, "P\n": False}
    rows = spark.createDataFrame(list(names.items()), "name string, wanted boolean")
    assert rows.filter(units.is_wrapper(units.F.col("name")) != units.F.col("wanted")).collect() == []


def test_sized_folders_are_ordered_by_number(spark):
    paths = ["P_2 [1 1B]/a", "P_10 [1 1B]/a", "p_10 [1 1B]/A", "P_1 [9 9B]/b", "P [1 1B]/a", "P/z", "P.jpg", "b/P_3", "P_100000000000000000000 [1 1B]/a"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(units.source_order(units.F.col("p")), "p").collect()
    assert [r.p for r in rows] == ["b/P_3", "P [1 1B]/a", "P.jpg", "P/z", "P_1 [9 9B]/b", "P_2 [1 1B]/a", "P_10 [1 1B]/a", "p_10 [1 1B]/A", "P_100000000000000000000 [1 1B]/a"]


def test_units_begin_where_files_or_old_folders_are(spark):
    made = units.layout(listed(spark, ["1.jpg", "a/b/2.mp4", "a/V/3.jpg", "c/", "d/7/4.jpg", "d/8.txt", "e/P/P/5.jpg", "e/P/NO.5 x/6.jpg", "e/P/P/A1-2/7.jpg", "e/P/plain/8.jpg"]))
    assert states(made) == {"": ("ready", "flatten"), "a": ("ready", "flatten"), "a/b": ("ready", "flatten"), "d": ("ready", "sort"), "e": ("blocked", "INDEPENDENT_WORK"), "e/P/NO.5 x": ("ready", "flatten")}
    assert {(r.source, r.target) for r in made.items.collect()} == {
        ("1.jpg", "001.jpg"), ("a/V/3.jpg", "a/001.jpg"), ("a/b/2.mp4", "a/b/001.mp4"), ("d/8.txt", "d/Other [1 10B]/8.txt"), ("e/P/NO.5 x/6.jpg", "e/P/NO.5 x/001.jpg"),
    }
    assert [tuple(r) for r in made.cleanup.collect()] == [("/r", "a", "a/V", 1)]
    assert [tuple(r) for r in made.held.collect()] == [("/r", "d/7", "UNCLEAR_FOLDER")]


def test_a_second_run_finds_nothing_to_do(spark):
    rules = Rules(per_bucket=3)
    first = units.layout(listed(spark, [f"w/{i}.jpg" for i in range(10)] + ["w/x.txt", "w/P/x.txt", "w/V/X.TXT"]), rules).items.collect()
    again = units.layout(listed(spark, [r.target for r in first]), rules)
    assert states(again) == {"w": ("already_organized", "sort")} and again.cleanup.count() == 0
    assert {r.target for r in first if r.kind == "Other"} == {"w/Other [3 30B]/x.txt", "w/Other [3 30B]/X__dup002.TXT", "w/Other [3 30B]/x__dup003.txt"}


def test_places_that_are_taken(spark):
    paths = ["a/x.jpg", "a/001.jpg/y.jpg", "b/x.jpg", "b/x.txt", "b/P [1 10B]/", "c/x.jpg", "c/P [1 10B]", "d/x.jpg", "d/x.txt", "d/P [1 10B]/y.txt", "f/y.jpg", "f/001.jpg"]
    found = states(units.layout(listed(spark, paths)))
    assert {u: r for u, (_, r) in found.items()} == {"a": "TARGET_OCCUPIED", "a/001.jpg": "flatten", "b": "FOLDER_NOT_AN_INPUT", "c": "FOLDER_NOT_DIRECTORY", "d": "sort", "f": "flatten"}


def test_limits_and_what_is_left_out(spark):
    deep, wrapped = "/".join(["d"] * 64), "w" + "/P" * 32
    made = units.layout(listed(spark, [f"{deep}/1.jpg", f"{deep}/e/2.jpg", f"{wrapped}/1.jpg", "x/no/1.jpg", "x/1.jpg", "y/P/NO/1.jpg", "z/1.jpg"]), Rules(excluded_names=("No",), excluded_roots=("/r/z",)))
    assert states(made) == {deep: ("ready", "flatten"), "w": ("ready", "flatten"), "x": ("ready", "flatten"), "y": ("blocked", "EXCLUDED_IN_WRAPPER")}
    assert [(r.path, r.reason) for r in made.held.collect()] == [(f"{deep}/e", "TOO_DEEP")]
    assert states(units.layout(listed(spark, ["1.jpg"], root="/a/no/r"), Rules(excluded_names=("no",)))) == {}


def test_nothing_and_nulls(spark):
    made = units.layout(listed(spark, []))
    assert made.units.count() == made.items.count() == made.groups.count() == made.cleanup.count() == made.held.count() == 0
    made = units.layout(listed(spark, ["a/1.jpg"], extra=[(None, "a", "file", 1, 1, 1), ("/r", None, "file", 1, 1, 1), ("/r", "a/2.jpg", "file", None, 1, 1)]))
    assert {r.source: r.bytes for r in made.items.collect()} == {"a/1.jpg": 10, "a/2.jpg": 0}


@pytest.mark.parametrize("bad", [{"excluded_names": ("a/b",)}, {"excluded_names": (" ",)}, {"excluded_names": ("..",)}, {"excluded_roots": ("r",)}, {"per_bucket": 0}])
def test_rules_that_are_refused(bad):
    with pytest.raises(ValueError):
        Rules(**bad)


def test_free_numbers_of_groups_of_any_size(spark):
    rng = random.Random(3)
    taken = {(g, k) for g in ("hot", "b") for k in rng.sample(range(1, 400), 150)}
    wanted = [("hot" if i % 5 else "b", i) for i in range(900)] + [("none", 0)]
    found = layout.free_numbers(spark.createDataFrame(wanted, "g string, i int").repartition(5), spark.createDataFrame(list(taken), "g string, k long"), ["g"], [layout.F.col("i")], 2)
    for g in ("hot", "b", "none"):
        free = (k for k in range(2, 2000) if (g, k) not in taken)
        assert [r.free for r in sorted(found.filter(units.F.col("g") == g).collect(), key=lambda r: r.i)] == [next(free) for h, _ in wanted if h == g]


def test_names_that_grow_too_long(spark):
    long, edge = "é" * 124 + ".txt", "e" * 243 + ".txt"
    rows = spark.createDataFrame([("g", n, i) for i, n in enumerate([long, long, edge, edge, "file_000002__dup002.txt", long])], "g string, name string, position int")
    found = [r.new_name for r in layout.allocate_names(rows, ["g"]).orderBy("position").collect()]
    assert found == [long, "file_000002__dup003.txt", edge, "e" * 243 + "__dup002.txt", "file_000002__dup002.txt", "file_000006__dup002.txt"]
