"""The order of all operations of a workflow: which must wait for which, cycles, and what can never run.

An operation waits for its file's operation before, and, if it goes to a path, for every operation of
other files that leaves that path. The level of an operation is one more than the highest level it waits for. Operations in order of
level, step, place in their file's chain, id and source can be run one after the other; those that lie on a cycle
or wait for one have no level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.lineage import settled as checkpointed
from cairn.operators.numbering import numbered

#: Rows to a partition of a written table, at least: later rounds have few rows.
LEAST_ROWS = 20_000

NODE = "struct<id:bigint,step:int,path:string>"


def settled(df: DataFrame, rows: int) -> DataFrame:
    return checkpointed(df.coalesce(max(1, rows // LEAST_ROWS)))


def _moves() -> Column:
    return F.coalesce(F.col("target") != F.col("source"), F.lit(False))


def chained(operations: DataFrame) -> DataFrame:
    """``operations`` (id, step, operation, source, target) with ``op``, the place in the file's own chain from 0."""
    chain = Window.partitionBy("id").orderBy("step")
    return operations.withColumn("op", F.row_number().over(chain) - 1)


def _node(id_: Column, step: Column) -> Column:
    return F.struct(id_.cast("long").alias("id"), step.cast("int").alias("step"), F.lit(None).cast("string").alias("path")).cast(NODE)


def _place(path: Column, kind: str) -> Column:
    """The point at which a path is free: of all files, or of all but the one that passes through."""
    return F.struct(F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("step"), F.concat(F.lit(kind), path).alias("path")).cast(NODE)


def waits(operations: DataFrame) -> DataFrame:
    """Edges (before, after, weight) between operations and the points at which paths become free.

    All that leave a path come before one point and all that arrive come after it, so a path that n operations leave and m
    take has n + m edges. A file that arrives and leaves later does not wait for itself: if it is the only one, it
    has a point of its own, which the others lead to; if there are several, each waits for the others and all are
    on cycles, which the common point says as well.
    """
    own = Window.partitionBy("id").orderBy("step")
    ops = operations.withColumn("me", _node(F.col("id"), F.col("step")))
    chain = ops.withColumn("before", F.lag("me").over(own)).filter("before IS NOT NULL").select("before", F.col("me").alias("after"), F.lit(1).cast("long").alias("weight"))
    moves = ops.filter(_moves())
    arrive = moves.select(F.col("target").alias("path"), "id", "step", F.col("me").alias("in"))
    leave = moves.select(F.col("source").alias("path"), "id", "step", F.col("me").alias("out"))
    lasts = leave.groupBy("path", "id").agg(F.max("step").alias("leaves"))
    leavers = leave.groupBy("path").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    arrive = arrive.join(leavers, "path").filter("low <> id OR high <> id")  # nobody waits for a path that no other file leaves
    arrive = arrive.join(lasts, ["path", "id"], "left").withColumn("through", F.coalesce(F.col("leaves") > F.col("step"), F.lit(False)))
    passing = arrive.filter("through").groupBy("path").agg(F.min("id").alias("one"), F.max("id").alias("other"))
    lone = passing.filter("one = other").select("path", "one")
    common, apart = _place(F.col("path"), "all:"), _place(F.col("path"), "but:")
    zero, one = F.lit(0).cast("long").alias("weight"), F.lit(1).cast("long").alias("weight")
    out = leave.join(lone, "path", "left")
    arrivals = arrive.join(lone, "path", "left")
    mine = F.coalesce(F.col("through") & (F.col("one") == F.col("id")), F.lit(False))
    return (
        chain.unionByName(out.select(F.col("out").alias("before"), common.alias("after"), zero))
        .unionByName(out.filter("one IS NOT NULL AND one <> id").select(F.col("out").alias("before"), apart.alias("after"), zero))
        .unionByName(arrivals.select(F.when(mine, apart).otherwise(common).alias("before"), F.col("in").alias("after"), one))
    )


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level of all ``nodes`` (node, level if nothing comes before; others count from 0) that are on no cycle and wait for none.

    The level of a node is the highest level before it plus the weight of that edge. A round settles nodes that wait for nothing
    open. A node that waits for one open node alone is at max(c, level of that one + w); such functions compose, so
    pointers along chains of these are doubled, and a chain of n takes log n steps, not n rounds. What comes
    after a chain then waits for its head. So the number of rounds follows the nodes that wait for several open
    ones in a row. A round that leaves as many nodes open as before ends it: these are on cycles or behind them.
    """
    known = nodes.count()
    waiting = settled(edges, 3 * known)
    points = waiting.select(F.col("after").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    open_ = settled(nodes.select("node", F.col("level").cast("long").alias("c")).unionByName(points.select("node", F.lit(0).cast("long").alias("c"))), known)
    done, postponed, before = None, [], -1
    while (still := open_.count()) not in (0, before):
        before = still
        own = waiting.groupBy(F.col("after").alias("node")).agg(F.min("before").alias("head"), F.max("before").alias("other"), F.max("weight").alias("w"))
        placed = settled(open_.join(own, "node", "left"), still)
        ready = placed.filter("head IS NULL").select("node", F.col("c").alias("level"))
        single = placed.filter("head = other").select("node", "c", "head", "w")
        many = placed.filter("head <> other").select("node", "c")
        # along chains of single nodes, to a head that is not one
        steps, last = single, -1
        inner = single.select(F.col("node").alias("head"), F.lit(True).alias("on"))
        while (inside := steps.join(inner, "head", "left_semi").count()) not in (0, last):
            last = inside
            ahead = steps.select(F.col("node").alias("head"), F.col("c").alias("c2"), F.col("head").alias("head2"), F.col("w").alias("w2"))
            grown = steps.join(ahead, "head", "left")
            c = F.greatest("c", F.coalesce(F.col("c2") + F.col("w"), F.col("c")))
            steps = settled(grown.select("node", c.alias("c"), F.coalesce("head2", "head").alias("head"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")), still)
        ended = steps.join(inner, "head", "left_anti")  # the others go in circles
        reached = ended.join(ready.select(F.col("node").alias("head"), F.col("level").alias("at")), "head", "left")
        level = F.greatest("c", F.col("at") + F.col("w"))
        fresh = settled(ready.unionByName(reached.filter("at IS NOT NULL").select("node", level.alias("level"))), still)
        done = fresh if done is None else done.unionByName(fresh)
        behind = settled(reached.filter("at IS NULL").select("node", "c", "head", "w"), still)
        postponed.append(behind)
        # what the nodes with several open ones before them wait for now
        kept = waiting.join(many.select(F.col("node").alias("after")), "after", "left_semi")
        told = kept.join(fresh.select(F.col("node").alias("before"), "level"), "before", "left").join(behind.select(F.col("node").alias("before"), F.col("c").alias("least"), "head", "w"), "before", "left")
        told = settled(told, still)
        bound = F.max(F.coalesce(F.col("level"), F.col("least")) + F.col("weight"))
        least = told.groupBy(F.col("after").alias("node")).agg(bound.alias("more"))
        open_ = settled(many.join(least, "node", "left").select("node", F.greatest("c", F.coalesce("more", "c")).alias("c")), still)
        rest = told.filter("level IS NULL").select(F.coalesce("head", "before").alias("before"), "after", (F.col("weight") + F.coalesce("w", F.lit(0))).alias("weight"))
        waiting = settled(rest.groupBy("before", "after").agg(F.max("weight").alias("weight")), still)
    if done is None:
        return open_.select("node", F.col("c").alias("level"))
    for behind in reversed(postponed):  # heads of a later round come first
        found = behind.join(done.select(F.col("node").alias("head"), F.col("level").alias("at")), "head")
        done = settled(done.unionByName(found.select("node", F.greatest("c", F.col("at") + F.col("w")).alias("level"))), known)
    return done


def operation_order(operations: DataFrame) -> DataFrame:
    """Operations (id, step, operation, source, target) with ``op``, ``level`` and ``sequence`` (from 1); both are null on and behind cycles, where ``cyclic`` is true."""
    ops = checkpointed(chained(operations).withColumn("node", _node(F.col("id"), F.col("step"))))
    found = levels(ops.select("node", F.lit(1).alias("level")), waits(ops.drop("node")))
    placed = ops.join(found, "node", "left").drop("node")
    order = [F.col("level"), F.col("step"), F.col("op"), F.col("id"), F.col("source")]
    run = numbered(placed.filter("level IS NOT NULL"), order, "place").withColumn("sequence", F.col("place") + 1).drop("place")
    stuck = placed.filter("level IS NULL").withColumn("sequence", F.lit(None).cast("long"))
    return run.unionByName(stuck).withColumn("cyclic", F.col("level").isNull())


def operation_problems(operations: DataFrame, existing: DataFrame) -> DataFrame:
    """id, step, problem of operations that must not run, one row each; ``existing`` lists all paths (path) before the workflow, those of its files included.

    STEP_COLLISION: another file has the same target in the same step. FINAL_COLLISION: another file ends at the same
    path. TARGET_EXISTS: the path is held by what is no file of the workflow. TARGET_NOT_VACATED: it is held by a
    file of the workflow that never leaves it.
    """
    ops = chained(operations)
    moves = ops.filter(_moves())
    step = moves.withColumn("same", F.count("*").over(Window.partitionBy("step", "target"))).filter("same > 1").select("id", "step", F.lit("STEP_COLLISION").alias("problem"))
    ends = ops.groupBy("id").agg(F.max_by(F.struct("step", F.coalesce("target", "source").alias("path"), (F.col("operation") == "quarantine").alias("gone")), "step").alias("end")).filter("NOT end.gone")
    crowded = ends.withColumn("same", F.count("*").over(Window.partitionBy("end.path"))).filter("same > 1")
    final = crowded.select("id", F.col("end.step").alias("step"), F.col("end.path").alias("path"))
    final = final.join(moves.select("id", "step", F.col("target").alias("path")), ["id", "step", "path"]).select("id", "step", F.lit("FINAL_COLLISION").alias("problem"))
    starts = ops.filter("op = 0").select(F.col("source").alias("target"), F.lit(True).alias("ours")).distinct()
    left = moves.select(F.col("source").alias("target"), F.lit(True).alias("left")).distinct()
    held = moves.join(existing.select(F.col("path").alias("target")).distinct(), "target", "left_semi").join(starts, "target", "left").join(left, "target", "left")
    problem = F.when(F.col("ours").isNull(), "TARGET_EXISTS").when(F.col("left").isNull(), "TARGET_NOT_VACATED")
    return step.unionByName(final).unionByName(held.withColumn("problem", problem).filter("problem IS NOT NULL").select("id", "step", "problem"))
