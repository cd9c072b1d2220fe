"""Previews of organized trees in cases that are small enough to see."""

import random

import pytest

from cairn.operators import organizer
from cairn.operators.numbering import numbered_within
from cairn.operators.organizer import Rules

ENTRY = "root_key string, path string, kind string, size long, mtime_ns long, device long, inode long"
MEDIA = (("jpg",), ("mp4",))


def listed(spark, paths, kinds=None, times=None):
    """Entries of one root: what ends with / is a directory, and so is all above a path."""
    kinds, times = kinds or {}, times or {}
    above = {"/".join(p.rstrip("/").split("/")[:i]) for p in paths for i in range(1, p.rstrip("/").count("/") + 1)}
    every = {p: "file" for p in paths if not p.endswith("/")} | dict.fromkeys(above | {p.rstrip("/") for p in paths if p.endswith("/")}, "directory") | kinds
    rows = [("/r", p, k, 10 if k == "file" else 0, times.get(p, 0), 1, i) for i, (p, k) in enumerate(sorted(every.items()))]
    return spark.createDataFrame(rows, ENTRY)


def proposals(spark, rules, *args, **kw):
    return {r.source: (r.target, r.type, r.conflict) for r in organizer.preview(listed(spark, *args, **kw), rules).collect()}


def test_names_and_tags(spark):
    rules = Rules(*MEDIA, name="{index} {name} {statistics}", number_from=9, number_width=2, tags=("KEEP", "X1"), cleanup=(r"\[.*\]$", "keep"))
    found = proposals(spark, rules, ["a10 KEEP [old] /1.jpg", "a9 X1/2.MP4", "a9 X1/sub/", "a9 X1/3.jpg"])
    assert found["a9 X1"][0] == "09 a9 X1 [1P 1V 20 B]"
    assert found["a10 KEEP [old] "][0] == "10 a10 KEEP [1P 10 B]"  # the tag was cleaned away and comes back before the counts
    assert found["a9 X1/sub"][0] == "a9 X1/11 sub [0P 0 B]"


def test_one_level_and_what_is_left_out(spark):
    rules = Rules(*MEDIA, name="{name} {files}", recursive=False, excluded_names=("tmp",), excluded_roots=("/r/no",))
    found = proposals(spark, rules, ["a/1", "a/tmp/2", "a/b/3", "no/4", "tmp/5", "a/tmp2/6"], kinds={"a/link": "symlink", "a/pipe": "other"})
    assert found == {"a": ("a 4", "directory_rename", None)}


def test_first_in_natural_order_has_a_target_unless_it_is_held(spark):
    rules = Rules(*MEDIA, name="{name}", cleanup=("[0-9]+$",))
    found = proposals(spark, rules, ["x10/", "x9/", "x2/", "y1/", "z1/", "z2/", "w1/", "w/"], kinds={"y": "file", "z": "symlink"})
    assert {s: c for s, (_, _, c) in found.items()} == {
        "x2": None, "x9": "PLANNED_TARGET_COLLISION", "x10": "PLANNED_TARGET_COLLISION", "y1": "TARGET_EXISTS", "z1": "SYMLINK_BLOCKED", "z2": "SYMLINK_BLOCKED", "w": None, "w1": "PLANNED_TARGET_COLLISION",
    }


def test_names_and_paths_that_do_not_fit(spark):
    deep = "/".join(["d" * 200] * 20)
    found = proposals(spark, Rules(*MEDIA, name="{name}{?files:" + "é" * 30 + "}", cleanup=("gone",)), [deep + "/éééééééééé/f", "gone/", "n" * 196 + "/f", "." + "gone" + "/"])
    assert found["gone"][2] == found[".gone"][2] == "INVALID_TARGET_NAME" and found["n" * 196][2] == "NAME_TOO_LONG"
    assert found[deep + "/éééééééééé"][2] == "PATH_TOO_LONG"


@pytest.mark.parametrize(("one", "two"), [("Straße", "STRASSE"), ("É", "é")])
def test_advanced_targets_that_differ_by_case_alone(spark, one, two):
    rules = Rules(*MEDIA, name="{name}1", from_depth=2)
    found = proposals(spark, rules, [f"a/{one}/", f"a/{two}/", "b/c/"])
    assert {s: c for s, (_, _, c) in found.items()} == {"a": None, "b": None, f"a/{one}": "PLANNED_TARGET_COLLISION", f"a/{two}": "PLANNED_TARGET_COLLISION", "b/c": None}
    assert found["a"][0] == "a" and found["b/c"][0] == "b/c1"


def test_latest_children(spark):
    rules = Rules(*MEDIA, name="{name}", latest_prefix="New ")
    found = proposals(spark, rules, ["a/x/", "a/y/", "b/x/", "b/y/", "c/New x/", "c/y/"], times={"a/y": 2, "b/x": 3, "b/y": 3, "c/New x": 5})
    assert found["a/y"] == ("a/New y", "latest_child_prefix", None) and found["a/x"][1:] == ("directory_rename", None)
    assert found["b/x"][2] == found["b/y"][2] == "LATEST_CHILD_TIE"
    assert found["c/New x"] == ("c/New x", "latest_child_prefix", None)
    assert found["a"][1:] == ("directory_rename", None)  # those right below the root are in no such order


def test_numbered_files_pass_on_their_places(spark):
    rules = Rules(*MEDIA, name="{name}", file_numbers_from=1, file_number_width=2)
    entries = listed(spark, ["top.txt", "a/0.txt", "a/01.txt", "a/02.txt", "a/10.tar.gz", "a/03.txt/"])
    rows = organizer.preview(entries, rules)
    files = {r.source: (r.target, r.conflict) for r in rows.collect() if r.type == "file_rename"}
    assert files == {"a/0.txt": ("a/01.txt", None), "a/01.txt": ("a/02.txt", None), "a/02.txt": ("a/03.txt", "TARGET_EXISTS"), "a/10.tar.gz": ("a/04.gz", None)}
    order = [r.source for r in organizer.operations(rows, rules).orderBy("sequence").collect()]
    assert order == ["a/01.txt", "a/10.tar.gz", "a/0.txt"]


def test_circles_and_what_waits_for_them(spark):
    rules = Rules(*MEDIA, name="{?images:i}{?videos:v}{?folders:f}", touch_in_order=True)
    paths = ["i/1.mp4", "v/s/", "vf/1.jpg", "f/1.jpg", "f/2.mp4"]  # i -> v -> f -> iv; s has nothing
    rows = organizer.preview(listed(spark, paths), rules)
    assert {r.source: r.conflict for r in rows.collect()} == {"i": None, "v": None, "v/s": "INVALID_TARGET_NAME", "vf": None, "f": None}
    done = [(r.operation, r.source, r.target) for r in organizer.operations(rows, rules).orderBy("sequence").collect()]
    assert done[:4] == [("rename", "f", "iv"), ("rename", "v", "f"), ("rename", "i", "v"), ("rename", "vf", "i")]
    assert [s for o, s, _ in done if o == "touch"] == ["iv", "v", "f", "i", "f/s"]
    stuck = proposals(spark, rules, ["i/1.mp4", "v/1.jpg", "w/1.jpg", "w/2.mp4", "iv/s/"])
    assert {s: c for s, (_, _, c) in stuck.items()} == {"i": "RENAME_CYCLE", "v": "RENAME_CYCLE", "w": None, "iv": None, "iv/s": "INVALID_TARGET_NAME"}


def test_wrappers_and_their_stage(spark):
    rules = Rules(*MEDIA, name="{name}", collapse_wrappers=True, excluded_names=("tmp",))
    paths = ["a/w1/in/1.jpg", "a/w2/1.jpg", "a/w3/w3/1.jpg", "a/w4/in4/", "a/w4/tmp/", "a/w5/a5/", "b/w/in/", "b/tmp/in/", "a/w6/in6/"]
    before = listed(spark, paths, kinds={"b/v/l": "symlink", "b/v": "directory"})
    planned = organizer.wrappers(before, rules)
    assert {r.wrapper: r.conflict for r in planned.collect()} == {
        "a/w1": None, "a/w2": "WRAPPER_CHILD_NOT_DIRECTORY", "a/w3": "WRAPPER_TARGET_EXISTS", "a/w5": None, "a/w6": None, "b/w": None, "b/v": "WRAPPER_CHILD_SYMLINK",
    }
    later = before.filter("path NOT LIKE 'a/w5/%'").withColumn("inode", organizer.F.expr("if(path = 'a/w6', -1, inode)"))
    later = later.unionByName(spark.createDataFrame([("/r", "b/in", "file", 0, 0, 1, 999)], ENTRY))
    rows = {r.wrapper: (r.problem, r.sequence) for r in organizer.structural(planned, later, rules).collect()}
    assert rows == {"a/w1": (None, 1), "a/w5": ("WRAPPER_GONE", None), "a/w6": ("CHANGED", None), "b/w": ("NOT_READY", None)}


def test_nothing(spark):
    entries = spark.createDataFrame([], ENTRY)
    for rules in (Rules(*MEDIA, touch_in_order=True), Rules(*MEDIA, from_depth=3, file_numbers_from=0, latest_prefix="N", collapse_wrappers=True)):
        rows = organizer.preview(entries, rules)
        assert rows.count() == organizer.operations(rows, rules).count() == organizer.summary(rows, entries, rules).count() == 0


def test_numbers_within_groups_of_any_size(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 50}", rng.random()) for i in range(3000)]
    found = numbered_within(spark.createDataFrame(rows, "g string, x double").repartition(7), ["g"], [organizer.F.col("x")]).collect()
    wanted = {(g, x): n for g in {g for g, _ in rows} for n, x in enumerate(sorted(x for h, x in rows if h == g))}
    assert {(r.g, r.x): r.number for r in found} == wanted


@pytest.mark.parametrize(
    "bad",
    [
        {"name": " "}, {"name": "{name"}, {"name": "{who}"}, {"name": "{?who: x}"}, {"statistics": "{index}"}, {"cleanup": ("(a+)+",)}, {"cleanup": ("(",)}, {"cleanup": ("",)}, {"cleanup": ("x" * 201,)}, {"cleanup": ("x",) * 11},
        {"latest_prefix": " "}, {"latest_prefix": "a/b"}, {"latest_prefix": "N", "touch_in_order": True}, {"from_depth": 1}, {"from_depth": 2, "recursive": False}, {"file_numbers_from": -1}, {"file_numbers_from": 1, "file_number_width": 11},
    ],
)
def test_profiles_that_are_refused(bad):
    with pytest.raises(ValueError):
        Rules(*MEDIA, **bad)
    assert organizer.template_problems("{?images: {images}P {?videos:{videos}V}}", organizer.STATISTICS) == []
