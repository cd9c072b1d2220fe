"""Digests of whole tables as hash trees, and the rows by which two tables differ.

A record's fields are written with their lengths and hashed. A node stands for all records of a group whose hash begins with its
``prefix`` (hexadecimal). Up to ``leaf`` different records make a leaf: the digest of their hashes in order, each with its number of copies.
Any other node is the digest of its up to sixteen children in order. So a digest says the same as one over the whole sorted group,
and follows from the group alone; no group is ever one row or one task's work, and a row that comes or goes changes only the nodes above it,
where blocks by position would all shift. A null differs from an empty text; rows that repeat count; groups whose key is null are groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.lineage import settled

LEAF = 256


def record(columns: list[str]) -> Column:
    """The fields as one text that no other fields give: ``5:hello-2:42`` with ``-`` for a null."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*(F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns))


def records(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, hash, the columns and copies of each different record."""
    hashed = rows.withColumn("hash", F.sha2(record(columns), 256))
    kept = [F.any_value(c).alias(c) for c in columns if c not in by]
    return settled(hashed.groupBy(*by, "hash").agg(*kept, F.count("*").alias("copies")))


def _depth(found: DataFrame, by: list[str], leaf: int) -> int:
    """A level on which no node has more than ``leaf`` records: one number, from the count of all and a check."""
    depth, n = 0, found.count()
    while n > leaf * 16**depth:
        depth += 1
    while (found.groupBy(*by, F.left("hash", F.lit(depth))).count().agg(F.max("count")).first()[0] or 0) > leaf:
        depth += 1
    return depth


def _lines_digest(lines: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)


def tree(found: DataFrame, by: list[str], leaf: int = LEAF) -> DataFrame:
    """by, prefix, level, items (different records), leaf and digest of every node over ``records``."""
    depth = _depth(found, by, leaf)
    line = F.concat("hash", F.lit(":"), F.col("copies").cast("string"))
    nodes = settled(found.groupBy(*by, F.left("hash", F.lit(depth)).alias("prefix")).agg(F.count("*").alias("items"), F.collect_list(line).alias("lines")).withColumn("digest", F.lit(None).cast("string")))
    shown = []
    for level in range(depth - 1, -1, -1):  # one small table for each level, at most one for every 16-fold of the rows
        child = F.struct("prefix", "items", "lines", F.coalesce("digest", _lines_digest(F.col("lines"))).alias("digest"))
        up = nodes.groupBy(*by, F.left("prefix", F.lit(level)).alias("prefix")).agg(F.sum("items").alias("items"), F.array_sort(F.collect_list(child)).alias("children"))
        up = settled(up)
        small = F.col("items") <= leaf
        own = F.sha2(F.array_join(F.transform("children", lambda c: F.concat(F.right(c.prefix, F.lit(1)), c.digest)), "\n"), 256)
        shown.append(up.filter(~small).select(*by, F.inline("children")).filter("lines IS NOT NULL").select(*by, "prefix", "items", F.lit(True).alias("leaf"), "digest"))
        shown.append(up.filter(~small).select(*by, "prefix", "items", F.lit(False).alias("leaf"), own.alias("digest")))
        nodes = up.select(*by, "prefix", "items", F.when(small, F.flatten("children.lines")).alias("lines"), F.when(~small, own).alias("digest"))
    shown.append(nodes.filter("lines IS NOT NULL").select(*by, "prefix", "items", F.lit(True).alias("leaf"), _lines_digest(F.col("lines")).alias("digest")))
    every = reduce(DataFrame.unionByName, shown).withColumn("level", F.length("prefix"))
    return settled(every.select(*by, "prefix", "level", "items", "leaf", "digest"))


def roots(nodes: DataFrame) -> DataFrame:
    """One digest for each group."""
    return nodes.filter("level = 0").drop("prefix", "level", "leaf")


def differing(before: DataFrame, after: DataFrame, by: list[str], leaf: int = LEAF) -> DataFrame:
    """by, the columns, copies before and after of each record of two tables of ``records`` that is not in both as often.

    Only leaves without an equal one in the other tree are opened; their rows alone are compared.
    """
    old, new = (tree(t, by, leaf).filter("leaf").select(*by, "prefix", "level", "digest") for t in (before, after))
    keys = [*by, "prefix", "digest"]
    same = lambda a, b, names: reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))
    opened = settled(old.join(new, same(old, new, keys), "left_anti").unionByName(new.join(old, same(new, old, keys), "left_anti")).select(*by, "prefix", "level").distinct())
    levels = [r.level for r in opened.select("level").distinct().collect()]  # at most 64

    def within(found: DataFrame) -> DataFrame:
        parts = [found.filter("false")]
        for level in levels:
            at = opened.filter(F.col("level") == level)
            on = F.left(found["hash"], F.lit(level)) == at["prefix"]
            parts.append(found.join(at, on & same(found, at, by) if by else on, "left_semi"))
        return reduce(DataFrame.unionByName, parts).distinct()

    names = [c for c in before.columns if c != "copies"]
    sides = within(before).withColumn("side", F.lit(0)).unionByName(within(after).withColumn("side", F.lit(1)))
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("copies")).otherwise(0))
    counted = sides.groupBy(*names).agg(total(0).alias("before"), total(1).alias("after"))
    return counted.filter("before <> after").drop("hash")
