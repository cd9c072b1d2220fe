"""Hash trees against digests taken plainly, and the rows by which tables differ."""

import hashlib
import random
from collections import Counter

import pytest

from cairn.operators import digest_trees
from cairn.operators.digest_trees import differing, records, roots, tree

ROW = "g string, a string, b long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, leaf):
    """prefix: (items, leaf, digest) of one group, from the top."""
    copies = Counter(sha("".join("-" if v is None else f"{len(str(v))}:{v}" for v in r)) for r in rows)
    nodes = {}

    def node(prefix):
        mine = sorted(h for h in copies if h.startswith(prefix))
        if len(mine) <= leaf:
            digest = sha("\n".join(f"{h}:{copies[h]}" for h in mine))
        else:
            digest = sha("\n".join(c + node(prefix + c) for c in "0123456789abcdef" if any(h.startswith(prefix + c) for h in mine)))
        nodes[prefix] = (len(mine), len(mine) <= leaf, digest)
        return digest

    node("")
    return nodes


def made(n, seed=1):
    rng = random.Random(seed)
    rows = [(("hot", None, "x")[rng.choice([0, 0, 0, 1, 2])], rng.choice(["", None, "é:1", "b"]) if i % 9 else "same", None if i % 50 == 0 else i // (1 + i % 2)) for i in range(n)]
    return rows + [("hot", "again", 7)] * (n // 3)


@pytest.mark.parametrize("leaf", [1, 3, 20, 10_000])
def test_trees_are_those_built_from_the_top(spark, leaf):
    rows = made(600)
    found = tree(records(spark.createDataFrame(rows, ROW).repartition(7), ["g"], ["a", "b"]), ["g"], leaf).collect()
    for g in ("hot", None, "x"):
        assert {r.prefix: (r.items, r.leaf, r.digest) for r in found if r.g == g} == plain([r[1:] for r in rows if r[0] == g], leaf)


def test_a_group_does_not_depend_on_others(spark):
    alone, beside = [("x", "a", i) for i in range(30)], [("y", "a", i) for i in range(3000)]
    one, two = (roots(tree(records(spark.createDataFrame(t, ROW), ["g"], ["a", "b"]), ["g"], 4)).filter("g = 'x'").collect() for t in (alone, alone + beside))
    assert one == two


@pytest.mark.parametrize("leaf", [2, 16, 5000])
def test_rows_that_differ(spark, leaf):
    rng = random.Random(leaf)
    old = made(800)
    new = [r for r in old if rng.random() > 0.02] + [("hot", "new", i) for i in range(9)] + [(None, None, None), ("only", "", 0)]
    sides = [records(spark.createDataFrame(t, ROW), ["g"], ["a", "b"]) for t in (old, new)]
    b, a = Counter(old), Counter(new)
    assert {(r.g, r.a, r.b): (r.before, r.after) for r in differing(*sides, ["g"], leaf).collect()} == {k: (b[k], a[k]) for k in b | a if b[k] != a[k]}
    assert differing(sides[0], sides[0], ["g"], leaf).collect() == []


def test_nothing_and_one_group(spark):
    none = records(spark.createDataFrame([], ROW), ["g"], ["a", "b"])
    some = records(spark.createDataFrame(made(50), ROW), [], ["g", "a", "b"])
    assert tree(none, ["g"]).count() == differing(none, none, ["g"]).count() == 0
    assert [r.items for r in roots(tree(some, [], 5)).collect()] == [len(set(made(50)))]
    assert digest_trees.LEAF == 256


def test_records_are_unambiguous(spark):
    rows = spark.createDataFrame([("a", "1:b"), ("a1:b", ""), ("a", None), ("a", "-"), (None, "a"), ("", "")], "x string, y string")
    assert rows.select(digest_trees.record(["x", "y"])).distinct().count() == 6
