"""Sources, sinks, streams and rules that no registered query covers, on small inputs."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from cairn.functions import media, names, paths, schedules
from cairn.operators import dedupe, filters, layout, renames
from cairn.plans import workflow
from cairn.sources import listing, pages, reports, sinks
from cairn.streaming import index


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_directory_listing(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x").write_text("no")
    (tmp_path / "a" / "b" / "f.txt").write_text("four")
    (tmp_path / "a" / "link").symlink_to(tmp_path / "a" / "b" / "f.txt")
    listing.register(spark)
    rows = spark.read.format("cairn_tree").option("root", str(tmp_path)).option("exclude", ".git").load().collect()
    assert sorted((r.relative_path, r.is_dir) for r in rows) == [("a", True), ("a/b", True), ("a/b/f.txt", False)]
    assert {r.size for r in rows if not r.is_dir} == {4}


def test_reports(spark, tmp_path):
    good = {"groups": [{"file_len": 4, "file_hash": "h", "files": ["/r/a", "/r/b", "/x/c"]}, {"size": 7, "hash": "k", "paths": ["/r/d", "/t/e"]}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    found = reports.read_reports(spark, str(tmp_path / "good.json"))
    assert sorted((r.content_hash, r.size, tuple(r.paths)) for r in found.collect()) == [("h", 4, ("/r/a", "/r/b", "/x/c")), ("k", 7, ("/r/d", "/t/e"))]
    assert {r.path for r in reports.members(found, ["/r"], "/r/trash").collect()} == {"/r/a", "/r/b"}
    for i, bad in enumerate(['{"groups": [], "groups": []}', '{"groups": []} tail', '{"groups": [{"size": 1}]}', '{"groups": [,]}']):
        (tmp_path / f"bad{i}.json").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            reports.read_reports(spark, str(tmp_path / f"bad{i}.json")).collect()


def test_pages(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ok" if i % 2 else "conflict", f"u{i % 3}") for i in range(20)], "n int, status string, unit string")
    sinks.write_preview(rows, f"{tmp_path}/preview")
    back = pages.read_lines(spark, f"{tmp_path}/preview", "n int, status string, unit string")
    assert [r.n for r in pages.page(back, "n", 2, 3, status="ok").collect()] == [7, 9, 11]
    assert [r.n for r in pages.page(back, "n", 1, 5, only=("unit", "u2")).collect()] == [2, 5, 8, 11, 14]
    (tmp_path / "array.json").write_text('[{"n": 1}, {"n": 2}]')
    assert [r.n for r in pages.read_array(spark, str(tmp_path / "array.json"), "n int").collect()] == [1, 2]
    (tmp_path / "object.json").write_text('{"n": 1}')
    with pytest.raises(Exception):  # noqa: B017
        pages.read_array(spark, str(tmp_path / "object.json"), "n int").collect()


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([(1, 1, "=x"), (1, 2, "b"), (2, 1, "c")], "plan_id int, sequence int, source string")
    sinks.write_plan(items, f"{tmp_path}/plans")
    sinks.write_plan(items.filter("plan_id = 2").withColumn("source", F.lit("new")), f"{tmp_path}/plans")
    assert sorted((r.plan_id, r.source) for r in spark.read.parquet(f"{tmp_path}/plans").collect()) == [(1, "=x"), (1, "b"), (2, "new")]
    sinks.freeze(items, f"{tmp_path}/frozen")
    assert sinks.thawed(spark, f"{tmp_path}/frozen").count() == 3
    items.limit(1).write.mode("append").parquet(f"{tmp_path}/frozen/rows")
    with pytest.raises(ValueError):
        sinks.thawed(spark, f"{tmp_path}/frozen")
    sinks.write_csv(items, f"{tmp_path}/csv")
    assert {r.source for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()} == {"'=x", "b", "c"}


def test_streamed_index(spark, tmp_path):
    schema = "absolute_path string, scan_generation int, size int"
    for i, batch in enumerate([[("/a", 1, 5), ("/b", 1, 6)], [("/a", 2, 7), ("/c", 1, 8)], [("/a", 1, 9)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        index.keep_index(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint", parts=4).awaitTermination()
        assert (tmp_path / "index").exists(), i
    assert sorted((r.absolute_path, r.size) for r in spark.read.parquet(f"{tmp_path}/index").collect()) == [("/a", 7), ("/b", 6), ("/c", 8)]


def test_streamed_windows(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 10, m), "click", m % 2) for m in range(30)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, user_id int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, user_id int").parquet(f"{tmp_path}/in")
    index.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.events, r.users) for r in spark.table("activity").collect()] == [(30, 2)]
    slots = stream.select(F.col("user_id").alias("schedule_id"), F.date_trunc("hour", "ts").alias("slot"))
    index.first_slots(slots).writeStream.format("memory").queryName("slots").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("slots").count() == 2


@pytest.mark.parametrize(
    "node",
    [
        {"field": "size", "operator": "contains", "value": "x"},
        {"field": "size", "operator": "eq", "value": -1},
        {"field": "size", "operator": "eq", "value": True},
        {"field": "mtime", "operator": "gt", "value": -5},
        {"field": "mtime", "operator": "gt", "value": "2024-01-01T00:00:00"},
        {"field": "extension", "operator": "in", "value": [" "]},
        {"field": "media_type", "operator": "eq", "value": "song"},
        {"field": "name", "operator": "in", "value": []},
        {"op": "and", "children": []},
        {"op": "not", "child": {"op": "not", "child": {"op": "not", "child": {"op": "not", "child": {"op": "not", "child": {"field": "size", "operator": "eq", "value": 1}}}}}},
        {"op": "and", "children": [{"op": "or", "children": [{"field": "size", "operator": "eq", "value": 1}] * 50}] * 5},
    ],
)
def test_filters_that_are_rejected(node):
    with pytest.raises(ValueError):
        filters.checked(node)


def test_filter_literals():
    assert filters.checked({"field": " Size ", "operator": "EQ", "value": 5})["value"] == 5
    assert filters.checked({"field": "mtime", "operator": "gt", "value": "2024-01-01T01:00:00+01:00"})["value"] == 1704067200 * 10**9
    assert filters.checked({"field": "extension", "operator": "in", "value": [" .JPG", "png"]})["value"] == ["jpg", "png"]
    deep = filters.checked({"op": "or", "children": [{"op": "not", "child": {"field": "size", "operator": "eq", "value": 1}}]})
    assert deep["children"][0]["child"]["value"] == 1
    assert filters.checked_excludes(["b", "a", "b"]) == ["b", "a"]
    with pytest.raises(ValueError):
        filters.checked_excludes(["a/b"])


@pytest.mark.parametrize(
    ("rule", "zone", "after", "wanted"),
    [
        ("30 2 * * *", "America/New_York", (2026, 3, 7, 7, 31), (2026, 3, 9, 6, 30)),
        ("30 1 * * *", "America/New_York", (2026, 11, 1, 4, 0), (2026, 11, 1, 5, 30)),
        ("30 1 * * *", "America/New_York", (2026, 11, 1, 5, 31), (2026, 11, 2, 6, 30)),
        ("0 0 29 2 *", "UTC", (2025, 3, 1, 0, 0), (2028, 2, 29, 0, 0)),
        ("0 12 13 * 5", "UTC", (2026, 2, 1, 0, 0), (2026, 2, 6, 12, 0)),
    ],
)
def test_schedules(spark, rule, zone, after, wanted):
    at = F.lit(datetime(*after, tzinfo=timezone.utc))
    found = schedules.next_occurrences(spark.range(1).select(at.alias("after_utc")), rule, zone).select(F.col("next_utc").cast("long").alias("s")).first().s
    assert datetime.fromtimestamp(found, timezone.utc) == datetime(*wanted, tzinfo=timezone.utc)


def test_schedules_without_occurrence(spark):
    rows = spark.range(1).select(F.lit(datetime(2026, 1, 1, tzinfo=timezone.utc)).alias("after_utc"))
    with pytest.raises(Exception):  # noqa: B017
        schedules.next_occurrences(rows, "0 0 30 2 *", "UTC").collect()
    for bad in ("* * * *", "60 * * * *", "1-0 * * * *", "*/0 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            schedules.parse(bad)


def test_stat_suffixes(spark):
    for name, wanted in [("movie [12P 3V 1.2 GB]", "movie"), ("movie[12 B]", "movie[12 B]"), ("movie [foo 7 GB]", "movie [foo 7 GB]"), ("movie [1P 2 mb] [3 TB]  ", "movie")]:
        assert one(spark, names.without_stat_suffixes(F.lit(name))) == wanted


def test_templates(spark):
    values = {"a": F.lit("x"), "b": F.lit(""), "n": F.lit(0)}
    for template, wanted in [("{a}-{b}-{n}", "x--0"), ("{?a: [{a}]}{?b: [{b}]}{?n: no}", " [x]"), ("plain", "plain"), ("{?a:{?b:in}out}", "out")]:
        assert one(spark, names.render(template, values)) == wanted
    for bad in ("{a", "a}", "}{"):
        with pytest.raises(ValueError):
            names.render(bad, values)


def test_values(spark):
    assert str(one(spark, media.exif_time(F.lit("2024:01:31 10:20:30")))) == "2024-01-31 10:20:30"
    assert one(spark, media.exif_time(F.lit("never"))) is None
    assert one(spark, media.filesystem_id(F.lit("u:ffffffffffffffff"))) == 2**64 - 1
    assert one(spark, paths.depth(F.lit("a/b/c"))) == 3
    assert one(spark, paths.common_prefix(F.lit("a/b/c"), F.lit("a/b/d"))) == "a/b"
    assert one(spark, paths.under_any(F.lit("/a/b"), ["/c", "/a"]))


def test_workflow_steps(spark):
    files = spark.createDataFrame([(1, "/r", "a/x.txt", "/r/a/x.txt", False), (2, "/r", "b/x.txt", "/r/b/x.txt", False)], "id long, root_key string, relative_path string, absolute_path string, is_dir boolean")
    made = workflow.compile_workflow(files, [{"type": "scan", "roots": ["/r"]}, {"type": "move", "to": "/out"}, {"type": "touch"}])
    assert sorted((r.id, r.step, r.operation, r.target, r.conflict) for r in made.collect()) == [(i, s, o, "/out/x.txt", True) for i in (1, 2) for s, o in ((1, "move"), (2, "touch"))]
    gone = workflow.compile_workflow(files, [{"type": "scan", "roots": ["/r"]}, {"type": "quarantine"}, {"type": "rename", "mode": "add_prefix", "value": "y"}])
    assert {(r.id, r.operation) for r in gone.collect()} == {(1, "quarantine"), (2, "quarantine")}
    assert workflow.digest({"b": 1, "a": "é"}) == workflow.digest({"a": "é", "b": 1})
    for bad in ([], [{"type": "move"}], [{"type": "scan"}, {"type": "fly"}], [{"type": "scan"}, {"type": "touch"}, {"type": "filter"}]):
        with pytest.raises(ValueError):
            workflow.checked_steps(bad)


def test_free_names(spark):
    names_ = ["a.jpg", "A.jpg", "a__dup002.jpg", "a.JPG", "b", "b", "b__dup002", ".x", ".x"]
    rows = spark.createDataFrame([("g", n, i) for i, n in enumerate(names_)], "g string, name string, position int")
    found = [r.new_name for r in layout.allocate_names(rows, ["g"]).orderBy("position").collect()]
    assert found == ["a.jpg", "A__dup003.jpg", "a__dup002.jpg", "a__dup004.JPG", "b", "b__dup003", "b__dup002", ".x", ".x__dup002"]


def plainly_balanced(members, roots, by, counts=None):
    """The fold over all groups, one copy at a time."""
    groups: dict = {}
    for m in members:
        groups.setdefault((m["content_hash"], m["size"]), []).append(m)
    order = sorted(groups) if by == "files" else sorted(groups, key=lambda k: (-k[1], k[0]))
    freed: dict = dict.fromkeys(roots, 0)
    going: dict = {}
    out = {}
    for key in order:
        if len(groups[key]) < 2:
            continue
        unit = 1 if by == "files" else key[1]
        choices = []
        for keep in groups[key]:
            rest = [m for m in groups[key] if m is not keep]
            leaving = {d: sum(m["directory"] == d for m in rest) for d in {m["directory"] for m in rest}}
            if counts and any(counts[d] - going.get(d, 0) - n < 1 for d, n in leaving.items()):
                continue
            after = {r: freed[r] + unit * sum(m["root_key"] == r for m in rest) for r in roots}
            v = list(after.values())
            choices.append((max(v) - min(v), sum(x * x for x in v), roots.index(keep["root_key"]), keep["absolute_path"], after, leaving))
        if choices:
            best = min(choices, key=lambda c: c[:4])
            freed = best[4]
            for d, n in best[5].items():
                going[d] = going.get(d, 0) + n
            out[key] = best[3]
    return out


@pytest.mark.parametrize("by", ["files", "bytes"])
@pytest.mark.parametrize("protect", [False, True])
def test_balanced(spark, monkeypatch, by, protect):
    import random

    from cairn.operators import dedupe_run

    monkeypatch.setattr(dedupe_run, "RUN_GROUPS", 25)  # runs end between groups that depend on one another

    rng = random.Random(3)
    roots = ["/r0", "/r1", "/r2"]
    members = [
        {"content_hash": f"h{g}", "size": 10 + g % 5, "root_key": (r := rng.choice(roots)), "directory": f"{r}/d{rng.randrange(6)}", "absolute_path": f"{r}/{g}/{i}"} for g in range(60) for i in range(rng.randrange(1, 6))
    ]
    counts: dict = {}
    for m in members:
        counts[m["directory"]] = counts.get(m["directory"], 0) + 1
    for m in members:
        m["directory_files"] = counts[m["directory"]]
    found = dedupe.balanced(spark.createDataFrame(members), roots, by=by, protect_last_file=protect)
    assert {(r.content_hash, r["size"]): r.keep for r in found.collect()} == plainly_balanced(members, roots, by, counts if protect else None)


def plainly_balanced_directories(members, roots):
    """Copy by copy: roots first, then the directories right below the common one."""
    import os

    groups: dict = {}
    for m in members:
        groups.setdefault((m["content_hash"], m["size"]), []).append(m)
    gone: list = []  # (root, directory, size) of every removed copy
    out = {}

    def evenness(values):
        return max(values) - min(values), sum(v * v for v in values)

    def bucket(directory, common):
        if directory == common:
            return "direct"
        rest = directory[len(common) :].lstrip("/") if common else directory
        return (common + "/" if common else "") + rest.split("/")[0]

    def inside(group, keep):
        root = keep["root_key"]
        common = os.path.commonpath(["/" + m["directory"] for m in group]).lstrip("/")
        buckets = {bucket(m["directory"], common) for m in group}
        values = {}
        for b in buckets:
            if b == "direct":
                values[b] = sum(n for r, d, n in gone if r == root and d == common)
            else:
                values[b] = sum(n for r, d, n in gone if r == root and (d == b or d.startswith(b + "/")))
        for m in group:
            if m is not keep:
                values[bucket(m["directory"], common)] += m["size"]
        return evenness(list(values.values()))

    for key in sorted(groups, key=lambda k: (-k[1], k[0])):
        group = groups[key]
        if len(group) < 2:
            continue
        choices = []
        for keep in group:
            own = [m for m in group if m["root_key"] == keep["root_key"]]
            totals = [sum(n for r, _, n in gone if r == root) + sum(m["size"] for m in group if m["root_key"] == root and m is not keep) for root in roots]
            if len(own) == len(group):
                choices.append(((0, 0), inside(group, keep), keep["absolute_path"], keep))
            else:
                choices.append((evenness(totals), inside(own, keep) if len(own) > 1 else (0, 0), keep["absolute_path"], keep))
        keep = min(choices, key=lambda c: c[:3])[3]
        gone += [(m["root_key"], m["directory"], m["size"]) for m in group if m is not keep]
        out[key] = keep["absolute_path"]
    return out


def test_balanced_directories(spark):
    import random

    rng = random.Random(5)
    roots = ["/r0", "/r1"]
    places = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f"]
    members = []
    for g in range(80):
        only = rng.choice(roots) if g % 3 == 0 else None
        for i in range(rng.randrange(1, 6)):
            r, d = only or rng.choice(roots), rng.choice(places)
            members.append({"content_hash": f"h{g:03d}", "size": 10 + g % 5, "root_key": r, "directory": d, "absolute_path": "/".join(filter(None, [r, d, f"{g}_{i}"]))})
    found = dedupe.balanced_recursively(spark.createDataFrame(members), roots)
    assert {(r.content_hash, r["size"]): r.keep for r in found.collect()} == plainly_balanced_directories(members, roots)


def test_trims_without_the_entry_that_would_hold_the_name(spark):
    """Every entry gets a suggestion or a reason: the first of two equal trims is suggested where nothing holds the name."""
    rows = [(0, " n4.txt"), (0, "n4.txt "), (1, " n6.txt"), (1, "n6.txt "), (1, "N6.txt")]
    found = renames.trims(spark.createDataFrame(rows, "directory long, name string")).collect()
    assert {(r.directory, r.name): (r.suggestion, r.reason) for r in found} == {
        (0, " n4.txt"): ("n4.txt", None),
        (0, "n4.txt "): (None, "NAME_TAKEN"),
        (1, " n6.txt"): (None, "NAME_TAKEN"),
        (1, "n6.txt "): (None, "NAME_TAKEN"),
    }
