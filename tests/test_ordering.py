"""Orders of operations against Kahn's algorithm over all edges, drawn one by one."""

import random
from collections import defaultdict

import pytest

from cairn.operators import ordering


def plain_levels(ops):
    """Level of each (id, step), none on and behind cycles; an edge for every pair that waits."""
    edges, keys = defaultdict(set), {(o[0], o[1]) for o in ops}
    by_file = defaultdict(list)
    for o in sorted(ops):
        by_file[o[0]].append((o[0], o[1]))
    for chain in by_file.values():
        for a, b in zip(chain, chain[1:]):
            edges[a].add(b)
    moves = [o for o in ops if o[4] is not None and o[4] != o[3]]
    for x in moves:
        for y in moves:
            if y[3] == x[4] and y[0] != x[0]:
                edges[y[0], y[1]].add((x[0], x[1]))
    waits = {k: 0 for k in keys}
    for after in edges.values():
        for b in after:
            waits[b] += 1
    level, ready = {}, [k for k in keys if not waits[k]]
    for k in ready:
        level[k] = 1
    while ready:
        k = ready.pop()
        for b in edges[k]:
            level[b] = max(level.get(b, 0), level[k] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return {k: level[k] for k in keys if not waits[k]}


def drawn(spark, ops):
    shape = "id long, step int, operation string, source string, target string"
    return ordering.operation_order(spark.createDataFrame(ops, shape)).collect()


def check(spark, ops):
    found, wanted = drawn(spark, ops), plain_levels(ops)
    assert {(r.id, r.step): r.level for r in found if not r.cyclic} == wanted
    assert sum(r.cyclic for r in found) == len(ops) - len(wanted)
    run = sorted((r for r in found if not r.cyclic), key=lambda r: r.sequence)
    assert [r.sequence for r in run] == list(range(1, len(run) + 1))
    assert [(r.level, r.step, r.op, r.id, r.source) for r in run] == sorted((r.level, r.step, r.op, r.id, r.source) for r in run)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_workflows(spark, seed):
    rng, ops = random.Random(seed), []
    places = 400 if seed < 2 else 90  # few places make many cycles
    for f in range(120):
        at = f"/{f}"
        for step in range(1, 5):
            if rng.random() < 0.5:
                kind = rng.choice(["move", "move", "touch"])
                to = f"/{rng.randrange(places)}" if kind == "move" else None
                ops.append((f, step, kind, at, to))
                at = to or at
    check(spark, ops)


def test_long_chains_and_rings(spark):
    chain = [(i, 1, "rename", f"/{i}", f"/{i + 1}") for i in range(300)]
    ring = [(i, 1, "rename", f"/{i}", f"/{1000 + (i + 1) % 40}") for i in range(1000, 1040)]
    behind = [(2000, 1, "move", "/x", "/1005"), (2001, 1, "move", "/y", "/x")]
    check(spark, chain + ring + behind)
    assert max(r.level for r in drawn(spark, chain)) == 300


def test_ladders_wait_for_two(spark):
    ops = [(2 * i + side, step, "move", f"/{side}.{i}.{step}", f"/{side if step == 1 else 1 - side}.{i + 1}.1" if step == 2 else f"/{side}.{i}.2") for i in range(6) for side in (0, 1) for step in (1, 2)]
    check(spark, ops)


def test_paths_that_many_leave_and_take(spark):
    """A hub has an edge for each arrival and departure, not for each pair."""
    hub = [(0, 1, "move", "/hub", "/free")] + [(i, 1, "move", f"/{i}", "/hub") for i in range(1, 60)] + [(i, 2, "move", "/hub", f"/out{i}") for i in (7,)]
    check(spark, hub)
    check(spark, hub + [(8, 2, "move", "/hub", "/out8")])  # two pass through: both wait for each other
    back = [(5, 1, "move", "/hub", "/away"), (5, 2, "move", "/away", "/hub"), (6, 1, "move", "/6", "/hub")]
    check(spark, back)
    shape = "id long, step int, operation string, source string, target string"
    assert ordering.waits(spark.createDataFrame(hub, shape)).count() <= 3 * len(hub)


def test_nothing_to_order(spark):
    assert drawn(spark, []) == []
    check(spark, [(1, 1, "touch", "/a", None), (1, 2, "move", "/a", "/a")])
