"""Numbering, buckets of bounded size and names without collisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.names import size_label
from cairn.functions.paths import suffix
from cairn.lineage import settled
from cairn.operators.flatten import folded
from cairn.operators.numbering import numbered_within

FILES_PER_BUCKET = 200
#: Fixed value: bytes that a file system takes for a name.
NAME_BYTES = 255


def numbered(index: Column, name: Column, width: int = 3) -> Column:
    """``001.jpg``: at least ``width`` digits, never cut."""
    digits = index.cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(padded, suffix(name))


def buckets(files: DataFrame, order: list) -> DataFrame:
    """Files of packages dealt to buckets of a kind: ``bucket`` (P, P_1, ...), ``position`` and ``new_name``."""
    within = Window.partitionBy("package", "kind").orderBy(*order)
    placed = files.withColumn("place", F.row_number().over(within))
    number = F.floor((F.col("place") - 1) / FILES_PER_BUCKET).cast("long")
    bucket = F.when(number == 0, F.col("kind")).otherwise(F.concat("kind", F.lit("_"), number.cast("string")))
    placed = placed.withColumn("bucket", bucket).withColumn("position", F.col("place") - number * FILES_PER_BUCKET)
    renamed = F.when(F.col("kind") == "Other", F.col("name")).otherwise(numbered(F.col("position"), F.col("name")))
    return placed.withColumn("new_name", renamed).drop("place")


def bucket_labels(placed: DataFrame) -> DataFrame:
    """package, bucket, files, bytes and the folder name ``P [200 1.5MiB]``."""
    grouped = placed.groupBy("package", "bucket").agg(F.count("*").alias("files"), F.sum("bytes").alias("total_bytes"))
    return grouped.withColumn("label", F.concat("bucket", F.lit(" ["), F.col("files").cast("string"), F.lit(" "), size_label(F.col("total_bytes")), F.lit("]")))


def package_shape(files: DataFrame) -> DataFrame:
    """What a package needs: ``flatten`` up to 200 files of one media kind, else ``buckets``."""
    kinds = [F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("P", "V", "Other")]
    counted = files.groupBy("package").agg(F.count("*").alias("files"), *kinds)
    pure = (F.col("files") <= FILES_PER_BUCKET) & (F.col("other") == 0) & ((F.col("p") == 0) | (F.col("v") == 0))
    return counted.withColumn("operation", F.when(pure, "flatten").otherwise("buckets"))


def numbering(files: DataFrame, by: list[str], order: list, start: int, width: int) -> DataFrame:
    """Numbered names per directory in natural order."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)
    return files.withColumn("new_name", numbered(rn, F.col("basename"), width))


def latest_child(entries: DataFrame) -> DataFrame:
    """Each parent's newest child, or a conflict where several are newest."""
    newest = entries.withColumn("top", F.max("mtime_ns").over(Window.partitionBy("root_key", "parent"))).filter("mtime_ns = top")
    grouped = newest.groupBy("root_key", "parent").agg(F.count("*").alias("newest"), F.min("basename").alias("child"))
    return grouped.select("root_key", "parent", F.when(F.col("newest") == 1, F.col("child")).alias("child"), (F.col("newest") > 1).alias("conflict"))


def smart_targets(files: DataFrame) -> DataFrame:
    """Media files with the P or V folder of their directory; directories of one kind alone are skipped."""
    media = files.filter("kind <> 'Other'")
    per_dir = Window.partitionBy("root_key", "directory")
    mixed = (F.max("kind").over(per_dir) != F.min("kind").over(per_dir)) | (F.max(F.col("other_files")).over(per_dir) > 0)
    target = F.concat("directory", F.lit("/"), "kind", F.lit("/"), "basename")
    return media.withColumn("status", F.when(mixed, "move").otherwise("skipped_pure")).withColumn("target", F.when(mixed, target))


def free_numbers(wanted: DataFrame, taken: DataFrame, by: list[str], order: list[Column], start: int) -> DataFrame:
    """``wanted`` with ``free``: within ``by`` its rows in ``order`` get the smallest numbers from ``start`` on that are not ``taken`` (by, k; distinct).

    Before a taken number lie as many free ones as it has smaller numbers less those taken; before the j-th wanted row lie j - 1. In the union of
    both in this order a row's own place is its number. All groups are numbered by ranges, whatever their size.
    """
    held = numbered_within(taken.filter(F.col("k") >= start), by, [F.col("k")], "__i").select(*by, (F.col("k") - start - F.col("__i")).alias("__before"), F.lit(False).alias("__wants"))
    asking = numbered_within(wanted, by, order, "__before").withColumn("__wants", F.lit(True))
    placed = numbered_within(asking.unionByName(held, allowMissingColumns=True), by, [F.col("__before"), F.col("__wants")], "free")
    return placed.filter("__wants").withColumn("free", F.col("free") + start).drop("__before", "__wants")


def allocate_names(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (name, position) with ``new_name``: of names with equal case-folded spelling in a group ``by`` the first stays.

    The j-th of the others gets the j-th suffix of ``__dup002``, ``__dup003`` and so on before its extension that no
    row of the group has as its own name. Where that would take over 255 bytes the name becomes ``file_000007``, the position plus 1, with
    the first such suffix.
    """
    tail = suffix(F.col("name"))
    split = rows.withColumn("__tail", tail).withColumn("__head", F.left("name", F.length("name") - F.length(tail))).withColumn("__key", folded(F.col("name")))
    ranked = settled(numbered_within(split, [*by, "__key"], [F.col("position")], "__again"))

    number = r"^(?s)(.*)__dup([1-9][0-9]{3,}|[0-9]{3})$"
    low = folded(F.col("__head"))
    own = ranked.select(*by, F.concat(F.regexp_extract(low, number, 1), folded(F.col("__tail"))).alias("__key"), F.regexp_extract(low, number, 2).try_cast("long").alias("k")).filter("k >= 2").distinct()

    padded = lambda n, width: F.when(F.length(n.cast("string")) < width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string"))
    plain = F.concat(F.lit("file_"), padded(F.col("position") + 1, 6))
    fits = F.octet_length("name") + len("__dup002") <= NAME_BYTES
    again = ranked.filter("__again > 0").withColumn("__head", F.when(fits, F.col("__head")).otherwise(plain)).withColumn("__key", F.when(fits, F.col("__key")).otherwise(F.concat(plain, folded(F.col("__tail")))))
    ending = F.concat(F.lit("__dup"), padded(F.col("free"), 3), F.col("__tail"))
    made = F.concat("__head", ending)
    renamed = free_numbers(again, own, [*by, "__key"], [F.col("position")], 2).withColumn("new_name", F.when(F.octet_length(made) <= NAME_BYTES, made).otherwise(F.concat(plain, ending)))
    first = ranked.filter("__again = 0").withColumn("new_name", F.col("name"))
    return first.select(*rows.columns, "new_name").unionByName(renamed.select(*rows.columns, "new_name"))


def probe_names(rows: DataFrame, by: list[str]) -> DataFrame:
    """Targets in a folder with some names taken (``occupied``): name, name_1, name_2 and so on."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        taken = {n.casefold() for n in group.loc[group["occupied"], "name"]}
        out = []
        for n, held in zip(group["name"], group["occupied"], strict=True):
            name, k = n, 0
            if not held:
                dot = n.rfind(".")
                head, tail = (n[:dot], n[dot:]) if 0 < dot < len(n) - 1 else (n, "")
                while name.casefold() in taken:
                    k += 1
                    name = f"{head}_{k}{tail}"
                taken.add(name.casefold())
            out.append(name)
        return group.assign(new_name=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", new_name string"
    return rows.groupBy(*by).applyInPandas(lambda g: one(g.sort_values("position", kind="stable")), schema)
