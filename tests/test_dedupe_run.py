"""The run against a fold over single copies, with runs of any length."""

import os
import random

import pytest

from cairn.operators import dedupe_run


def plain_run(members, roots, counts):
    """Every rule over single copies and full paths."""
    groups: dict = {}
    for m in members:
        groups.setdefault((m["content_hash"], m["size"]), []).append(m)
    released: list = []  # members that went
    out = {}

    def inside(path, directory):
        return path.startswith(directory + "/")

    def within(everyone, candidates, size):
        homes = [os.path.dirname(m["absolute_path"]) for m in everyone]
        common = os.path.commonpath(homes)
        bucket = lambda m: None if (h := os.path.dirname(m["absolute_path"])) == common else common + "/" + h[len(common) + 1 :].split("/")[0]
        before = {b: sum(g["size"] for g in released if (os.path.dirname(g["absolute_path"]) == common if b is None else inside(g["absolute_path"], b))) for b in map(bucket, everyone)}
        options = []
        for c in candidates:
            after = dict(before)
            for m in everyone:
                if m is not c:
                    after[bucket(m)] += size
            v = list(after.values())
            options.append(((max(v) - min(v), sum(x * x for x in v), c["absolute_path"]), c))
        return min(options, key=lambda o: o[0])

    for (content, size), own in sorted(groups.items(), key=lambda g: (-g[0][1], g[0][0])):
        able = [m for m in own if m["eligible"]]
        tops = [m for m in own if m["top"]]
        if not able:
            out[content, size] = None, "NO_ELIGIBLE_KEEP_CANDIDATE"
            continue

        def safe(c):
            leaving = [m["absolute_path"] for m in own if m is not c]
            return all(counts[d] - sum(inside(g["absolute_path"], d) for g in released) - n >= 1 for d in counts if (n := sum(inside(p, d) for p in leaving)))

        if counts:
            tops = [c for c in tops if safe(c)]
            if not tops:
                out[content, size] = None, "RECURSIVE_PROTECT_LAST_FILE_NO_SAFE_SELECTION"
                continue
        if len(able) == 1 or len(tops) == 1:
            keep, why = tops[0], "sole_eligible" if len(able) == 1 else "unique_top_score"
        elif len({m["root_key"] for m in own}) == 1:
            keep, why = within(own, tops, size)[1], "recursive_directory_balanced_by_bytes"
        else:
            now = {r: sum(g["size"] for g in released if g["root_key"] == r) for r in roots}

            def evenness(root):
                v = [now[r] + size * (sum(m["root_key"] == r for m in own) - (r == root)) for r in roots]
                return max(v) - min(v), sum(x * x for x in v)

            best = min(evenness(m["root_key"]) for m in tops)
            options = []
            for r in {m["root_key"] for m in tops if evenness(m["root_key"]) == best}:
                mine = [m for m in tops if m["root_key"] == r]
                options.append(((0, 0, mine[0]["absolute_path"]), mine[0]) if len(mine) == 1 else within([m for m in own if m["root_key"] == r], mine, size))
            keep, why = min(options, key=lambda o: o[0])[1], "recursive_directory_balanced_by_bytes"
        released += [m for m in own if m is not keep]
        out[content, size] = keep["absolute_path"], why
    return out


def drawn(seed, groups=90):
    rng = random.Random(seed)
    roots = ["/r0", "/r1", "/r2"]
    places = ["", "a", "a/b", "a/b/c", "a/b/c/d", "a/x", "ab", "e", "e/f", "e/g"]
    members = []
    for g in range(groups):
        only = rng.choice(roots) if g % 3 == 0 else None
        hopeless = g % 17 == 5
        for i in range(rng.randrange(2, 6)):
            r, d = only or rng.choice(roots[:2]), rng.choice(places)
            relative = "/".join(filter(None, [d, f"{g}_{i}"]))
            members.append({"content_hash": f"h{g:03d}", "size": 10 + g % 7, "root_key": r, "directory": d, "relative_path": relative, "absolute_path": f"{r}/{relative}", "eligible": not hopeless and rng.random() < 0.85, "score": rng.choice([0, 0, 1])})
    best: dict = {}
    for m in members:
        if m["eligible"]:
            best[m["content_hash"]] = max(best.get(m["content_hash"], 0), m["score"])
    for m in members:
        m["top"] = m["eligible"] and m["score"] == best[m["content_hash"]]
    files: dict = {}
    for path in [m["absolute_path"] for m in members] + [f"{r}/{d}/single" for r in roots for d in ("a/x", "e")]:
        at = os.path.dirname(path)
        while at != "/":
            files[at] = files.get(at, 0) + 1
            at = os.path.dirname(at)
    return members, roots, files


@pytest.mark.parametrize(("seed", "run", "protect"), [(1, 25, True), (2, 1000, True), (3, 25, False)])
def test_run_is_the_fold(spark, monkeypatch, seed, run, protect):
    monkeypatch.setattr(dedupe_run, "RUN_GROUPS", run)
    members, roots, files = drawn(seed)
    below = spark.createDataFrame([("/" + d.split("/")[1], "/".join(d.split("/")[2:]), n) for d, n in files.items()], "root_key string, directory string, files long")
    found = dedupe_run.run(spark.createDataFrame(members), roots, below if protect else None).collect()
    assert {(r.content_hash, r["size"]): (r.keep, r.reason) for r in found} == plain_run(members, roots, files if protect else None)
    assert [r.number for r in sorted(found, key=lambda r: (-r["size"], r.content_hash))] == list(range(len(found)))
    assert len({r.reason for r in found}) == 5 if protect else 4


def test_run_without_open_groups(spark):
    members, roots, _ = drawn(4, 12)
    kept = {}
    for m in members:
        m["top"] = m["eligible"] = kept.setdefault(m["content_hash"], m) is m
    found = dedupe_run.run(spark.createDataFrame(members), roots).collect()
    assert {r.keep for r in found} == {m["absolute_path"] for m in kept.values()} and {r.reason for r in found} == {"sole_eligible"}
    assert dedupe_run.run(spark.createDataFrame(members).limit(0), roots).count() == 0
