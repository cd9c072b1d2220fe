"""File workflows: scan, filter, rename, move, touch and quarantine steps over virtual paths.

Each file carries its current path from step to step as a column; every step adds its operations, so a workflow is a
chain of projections without a shuffle. Collisions of targets are found at the end over all operations at once.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.names import rename
from cairn.functions.paths import basename, parent
from cairn.operators.filters import checked, compile_filter, not_excluded

STEPS = {"filter", "rename", "move", "touch", "quarantine"}


def checked_steps(steps: list[dict]) -> list[dict]:
    if not steps or steps[0].get("type") != "scan":
        raise ValueError("a workflow starts with a scan")
    for step in steps[1:]:
        if step.get("type") not in STEPS:
            raise ValueError(f"unknown step: {step.get('type')}")
    kinds = [s["type"] for s in steps[1:]]
    if "filter" in kinds[next((i for i, k in enumerate(kinds) if k != "filter"), len(kinds)) :]:
        raise ValueError("filters come before actions")
    return steps


def digest(definition: Any) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(definition, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def compile_workflow(files: DataFrame, steps: list[dict]) -> DataFrame:
    """The operations (id, step, operation, source, target, conflict) of a workflow."""
    steps = checked_steps(steps)
    scan = steps[0]
    rows = files.filter(F.col("root_key").isin(scan["roots"]) & ~F.col("is_dir"))
    if scan.get("subpath"):
        sub = scan["subpath"]
        rows = rows.filter((F.col("relative_path") == sub) | F.col("relative_path").startswith(sub + "/"))
    rows = rows.filter(not_excluded(scan.get("exclude", [])))
    actions = []
    for step in steps[1:]:
        if step["type"] == "filter":
            rows = rows.filter(compile_filter(checked(step["where"])))
        else:
            actions.append(step)
    rows = rows.withColumn("path", F.col("absolute_path")).withColumn("gone", F.lit(False))
    made = F.array().cast("array<struct<step:int,operation:string,source:string,target:string>>")
    rows = rows.select("id", "path", "gone", made.alias("made"))
    for i, step in enumerate(actions, 1):
        here, name = parent(F.col("path")), basename(F.col("path"))
        if step["type"] == "rename":
            target = F.concat(here, F.lit("/"), rename(name, step["mode"], step.get("find", ""), step.get("value", "")))
        elif step["type"] == "move":
            target = F.concat(F.lit(step["to"].rstrip("/") + "/"), name)
        else:
            target = F.col("path")
        acts = ~F.col("gone") & ((target != F.col("path")) | F.lit(step["type"] in ("touch", "quarantine")))
        row = F.struct(F.lit(i).alias("step"), F.lit(step["type"]).alias("operation"), F.col("path").alias("source"), target.alias("target"))
        rows = rows.select(
            "id",
            F.when(F.col("gone"), F.col("path")).otherwise(target).alias("path"),
            (F.col("gone") | F.lit(step["type"] == "quarantine")).alias("gone"),
            F.when(acts, F.array_append("made", row)).otherwise(F.col("made")).alias("made"),
        )
    ends = F.count("*").over(Window.partitionBy("path"))
    final = rows.withColumn("conflict", ~F.col("gone") & (ends > 1))
    return final.select("id", F.explode("made").alias("o"), "conflict").select("id", "o.*", "conflict")
