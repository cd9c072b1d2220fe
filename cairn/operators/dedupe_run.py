"""Dedupe runs whose decisions depend on all decisions before: balance over roots and directories, protection of last files.

Groups go in a fixed order. A group's candidates are its best scored eligible copies. A candidate is not safe if removing the
others would leave a directory without a file, counting all removals decided before. Of several safe candidates that
one is kept which leaves what was released most even: by files or bytes over roots, or over roots first and
then over the directories right below the deepest common one of the group's copies in a root ("directories").

Decisions are those of one fold over all groups, at any size. Groups are numbered in order and taken in runs of RUN_GROUPS. A run in which no
decision hangs on others (one candidate each, no directory that removals could empty) is decided by Spark as a whole.
Another one needs only the balances of the directories above its own copies, which Spark joins to it; a task of bounded
size decides its groups in order. What a run released is added up in parallel and handed to the next.
"""

from __future__ import annotations

from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.lineage import settled
from cairn.operators.numbering import numbered

GROUP = ["content_hash", "size"]
#: Why a copy is kept where balance decides; fixed values.
BALANCED = {"directories": "recursive_directory_balanced_by_bytes", "bytes": "balanced_by_bytes", "files": "balanced_by_files"}
#: Groups to a run; what a run holds is one compact row for each, and the balances of the directories above.
RUN_GROUPS = 50_000

DECISION = "content_hash string, size long, number long, keep string, reason string"


def _above(place: str) -> list[str]:
    """The root of a directory, given as "", down to the directory itself."""
    parts = place.split("/") if place else []
    return ["/".join(parts[:i]) for i in range(len(parts) + 1)]


class Balances:
    """What was removed so far below each directory: bytes, bytes of its own files, files; and how many files it had."""

    def __init__(self, roots: list[str], by: str):
        self.roots, self.by = roots, by
        self.below: dict[tuple[str, str], int] = {}
        self.direct: dict[tuple[str, str], int] = {}
        self.removed: dict[tuple[str, str], int] = {}
        self.files: dict[tuple[str, str], int] = {}

    def remove(self, root: str, place: str, size: int, n: int) -> None:
        own = root, place
        self.direct[own] = self.direct.get(own, 0) + size * n
        for d in self.above(place):
            self.below[root, d] = self.below.get((root, d), 0) + size * n
            self.removed[root, d] = self.removed.get((root, d), 0) + n

    def above(self, place: str) -> list[str]:
        return _above(place) if self.by == "directories" else list(dict.fromkeys(["", place]))

    def safe(self, sides: list[dict], keep: dict) -> bool:
        """Whether every directory has a file left when all copies but one at ``keep``'s place go; one of unknown size has none."""
        leaving: dict[tuple[str, str], int] = {}
        for s in sides:
            if n := s["n"] - (s is keep):
                for d in self.above(s["place"]) if self.by == "directories" else [s["place"]]:
                    leaving[s["root_key"], d] = leaving.get((s["root_key"], d), 0) + n
        return all(self.files.get(d, 0) - self.removed.get(d, 0) - n >= 1 for d, n in leaving.items())

    def within(self, sides: list[dict], candidates: list[dict], size: int) -> tuple[tuple, dict]:
        """How even one root's directories would be (spread, squares, path) at best, and the candidate."""
        places = [s["place"] for s in sides]
        shared = list(takewhile(lambda p: p[0] == p[1], zip(min(places).split("/"), max(places).split("/"), strict=False))) if min(places) else []
        depth, root = len(shared), sides[0]["root_key"]
        top = "/".join(p[0] for p in shared)
        bucket = {p: None if p == top else "/".join(p.split("/")[: depth + 1]) for p in places}
        gone = {b: self.direct.get((root, top), 0) if b is None else self.below.get((root, b), 0) for b in bucket.values()}
        for s in sides:
            gone[bucket[s["place"]]] += s["n"] * size
        options = []
        for c in candidates:
            after = [v - size * (b == bucket[c["place"]]) for b, v in gone.items()]
            options.append(((max(after) - min(after), sum(v * v for v in after), c["path"]), c))
        return min(options, key=lambda o: o[0])

    def choice(self, sides: list[dict], candidates: list[dict], size: int) -> dict:
        by_root: dict[str, list[dict]] = {}
        for s in sides:
            by_root.setdefault(s["root_key"], []).append(s)
        if len(by_root) == 1:
            return self.within(sides, candidates, size)[1]
        gone = {r: self.below.get((r, ""), 0) + size * sum(s["n"] for s in by_root.get(r, [])) for r in self.roots}

        def evenness(root: str) -> tuple[int, int]:
            after = [v - size * (r == root) for r, v in gone.items()]
            return max(after) - min(after), sum(v * v for v in after)

        able: dict[str, list[dict]] = {}
        for c in candidates:
            able.setdefault(c["root_key"], []).append(c)
        even = {r: evenness(r) for r in able}
        found = []
        for r, own in able.items():
            if even[r] == min(even.values()):
                alone = len(own) == 1 and own[0]["tops"] == 1
                found.append(((0, 0, own[0]["path"]), own[0]) if alone else self.within(by_root[r], own, size))
        return min(found, key=lambda f: f[0])[1]

    def evenest(self, sides: list[dict], candidates: list[dict], size: int) -> dict:
        """The candidate that leaves roots most even; by files each copy counts one."""
        unit, now = (1, self.removed) if self.by == "files" else (size, self.below)
        ranks = {r: i for i, r in enumerate(self.roots)}
        gone = {r: now.get((r, ""), 0) for r in [*self.roots, *(s["root_key"] for s in sides)]}
        for s in sides:
            gone[s["root_key"]] += s["n"] * unit

        def key(c: dict) -> tuple:
            after = [v - unit * (r == c["root_key"]) for r, v in gone.items()]
            return max(after) - min(after), sum(v * v for v in after), ranks.get(c["root_key"], len(ranks)), c["path"]

        return min(candidates, key=key)

    def decide(self, sides: list[dict], size: int, able: int, protect: bool) -> tuple[str | None, str]:
        """The path to keep and why; null where nothing is decided."""
        candidates = [s for s in sides if s["tops"]]
        if not candidates:
            return None, "NO_ELIGIBLE_KEEP_CANDIDATE"
        if protect:
            candidates = [c for c in candidates if self.safe(sides, c)]
            if not candidates:
                return None, "RECURSIVE_PROTECT_LAST_FILE_NO_SAFE_SELECTION"
        left = sum(c["tops"] for c in candidates)
        pick = self.choice if self.by == "directories" else self.evenest
        keep = candidates[0] if left == 1 else pick(sides, candidates, size)
        for s in sides:
            self.remove(s["root_key"], s["place"], size, s["n"] - (s is keep))
        return keep["path"], "sole_eligible" if able == 1 else "unique_top_score" if left == 1 else BALANCED[self.by]


def _groups(scored: DataFrame) -> DataFrame:
    """A row for each group: its copies summed up by directory, so that a group is as large as the number of its directories."""
    top = F.when(F.col("top"), F.col("absolute_path"))
    sides = scored.groupBy(*GROUP, "root_key", F.col("directory").alias("place")).agg(
        F.count("*").alias("n"), F.count_if("top").alias("tops"), F.min(top).alias("path"), F.count_if("eligible").alias("able")
    )
    return sides.groupBy(*GROUP).agg(F.collect_list(F.struct("root_key", "place", "n", "tops", "path")).alias("sides"), F.sum("able").alias("able"), F.sum("tops").alias("tops"))


def _reach(groups: DataFrame, by: str) -> DataFrame:
    """A row for each group, place of copies in it and directory at or above that place, with the number of copies."""
    sides = groups.select(*GROUP, F.explode("sides").alias("s")).select(*GROUP, "s.root_key", "s.place", "s.n")
    parts = F.split("place", "/")
    above = F.array_distinct(F.array(F.lit(""), "place"))
    if by == "directories":
        above = F.when(F.col("place") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return sides.select(*GROUP, "root_key", "place", "n", F.explode(above).alias("directory"))


def run(scored: DataFrame, roots: list[str], files_below: DataFrame | None = None, by: str = "directories") -> DataFrame:
    """content_hash, size, number, keep, reason of every group, decided in order.

    ``scored`` holds the members of groups of two or more with ``directory`` (in the root, "" for its top), ``eligible`` and ``top`` (best
    scored of the eligible), as ``dedupe.scored`` gives them. ``files_below`` (root_key, directory, files) asks for
    protection of last files: it counts the files below every directory, or right in it if ``by`` is "files" or "bytes". Groups go by
    size, largest first, and hash; by "files", by hash and size. ``roots`` are all roots, whether or not they have copies.
    """
    protect = files_below is not None
    order = [F.col("content_hash"), F.col("size")] if by == "files" else [F.desc("size"), F.col("content_hash")]
    groups = settled(numbered(_groups(scored), order))
    reach = _reach(groups, by)
    if protect:
        most = reach.groupBy("root_key", "directory").agg(F.sum("n").alias("most"))
        tight = most.join(files_below, ["root_key", "directory"], "left").filter(F.coalesce("files", F.lit(0)) - F.col("most") < 1).select("root_key", "directory")
        critical = reach.join(tight, ["root_key", "directory"], "left_semi").select(*GROUP).distinct().withColumn("critical", F.lit(True))
        groups = groups.join(critical, GROUP, "left")
    else:
        groups = groups.withColumn("critical", F.lit(None).cast("boolean"))
    open_ = (F.col("tops") >= 2) | (F.coalesce("critical", F.lit(False)) & (F.col("tops") >= 1))
    groups = settled(groups.select(*GROUP, "number", "sides", "able", "tops", open_.alias("open"), F.floor(F.col("number") / RUN_GROUPS).alias("run")))
    only = F.element_at(F.filter("sides", lambda s: s.tops > 0), 1).path
    sure = F.when(F.col("tops") == 0, "NO_ELIGIBLE_KEEP_CANDIDATE").when(F.col("able") == 1, "sole_eligible").otherwise("unique_top_score")
    plain = groups.select(*GROUP, "number", F.when(F.col("tops") > 0, only).alias("keep"), sure.alias("reason"), "run")

    balances = found = None
    for r in groups.groupBy("run").agg(F.max("open").alias("open")).orderBy("run").collect():  # one row for each run
        own = groups.filter(F.col("run") == r.run)
        if r.open:
            decided = settled(_folded(own, balances, files_below, roots, by))
        else:
            decided = plain.filter(F.col("run") == r.run).drop("run")
        found = decided if found is None else found.unionByName(decided)
        balances = settled(_added(balances, own, decided, by))
    return plain.drop("run") if found is None else found


def _added(balances: DataFrame | None, groups: DataFrame, decided: DataFrame, by: str) -> DataFrame:
    """Balances with what ``decided`` releases: root_key, directory, below, direct, removed."""
    kept = decided.filter("keep IS NOT NULL").select(*GROUP, "keep")
    gone = _reach(groups, by).join(kept, GROUP)
    sides = groups.select(*GROUP, F.explode("sides").alias("s")).select(*GROUP, "s.root_key", "s.place", "s.path")
    homes = sides.join(kept.withColumnRenamed("keep", "path"), [*GROUP, "path"]).select(*GROUP, "root_key", "place", F.lit(1).alias("stays"))
    left = gone.join(homes, [*GROUP, "root_key", "place"], "left").withColumn("n", F.col("n") - F.coalesce("stays", F.lit(0)))
    freed = F.col("n") * F.col("size")
    rows = left.select("root_key", "directory", freed.alias("below"), F.when(F.col("place") == F.col("directory"), freed).otherwise(0).alias("direct"), F.col("n").alias("removed"))
    rows = rows if balances is None else rows.unionByName(balances)
    return rows.groupBy("root_key", "directory").agg(*(F.sum(c).cast("long").alias(c) for c in ("below", "direct", "removed")))


def _folded(groups: DataFrame, balances: DataFrame | None, files_below: DataFrame | None, roots: list[str], by: str) -> DataFrame:
    """The decisions of a run, made in one task in order, from the balances of the directories above its copies."""
    protect = files_below is not None
    needed = _reach(groups, by).select("root_key", "directory").distinct()
    everywhere = groups.sparkSession.createDataFrame([(r, "") for r in roots], "root_key string, directory string")
    state = needed.union(everywhere).distinct()
    zero = F.lit(0).cast("long")
    state = state.join(files_below, ["root_key", "directory"], "left") if protect else state.withColumn("files", zero)
    state = state.join(balances, ["root_key", "directory"], "left") if balances is not None else state.withColumns({c: zero for c in ("below", "direct", "removed")})
    state = state.select("root_key", "directory", *(F.coalesce(c, zero).cast("long").alias(c) for c in ("files", "below", "direct", "removed")))

    def fold(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        held = Balances(roots, by)
        keys = list(zip(known["root_key"], known["directory"], strict=True))
        for name, column in (("files", held.files), ("below", held.below), ("direct", held.direct), ("removed", held.removed)):
            column.update(zip(keys, known[name].tolist(), strict=True))
        rows = rows.sort_values("number")
        made = [held.decide([s if isinstance(s, dict) else s.asDict() for s in sides], int(size), int(able), protect) for sides, size, able in zip(rows["sides"], rows["size"], rows["able"], strict=True)]
        return pd.DataFrame({"content_hash": rows["content_hash"], "size": rows["size"], "number": rows["number"], "keep": [k for k, _ in made], "reason": [w for _, w in made]})

    together = [df.withColumn("task", zero).groupBy("task") for df in (groups.select(*GROUP, "number", "sides", "able"), state)]
    return together[0].cogroup(together[1]).applyInPandas(fold, DECISION)
