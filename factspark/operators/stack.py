"""Slot stacks from an op log by window functions.

A log has (rid, kind, slot, ...); ``define`` pushes, ``forget`` pops and on an empty slot does nothing. Windows are by slot, so a slot
of any depth is one sorted run; no frame looks forward, which Spark would evaluate in quadratic time. Nothing is gathered in arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ALL = (Window.unboundedPreceding, 0)


def annotate(log: DataFrame, order: str = "rid") -> DataFrame:
    """The log with ``depth`` after each record and whether a define is still ``visible`` at the end."""
    forward = Window.partitionBy("slot").orderBy(order)
    backward = Window.partitionBy("slot").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    run = log.where("kind in ('define', 'forget')").withColumn("_run", F.sum(F.when(F.col("kind") == "define", 1).otherwise(-1)).over(forward.rowsBetween(*_ALL)))
    deep = run.withColumn("depth", F.col("_run") - F.least(F.lit(0), F.min("_run").over(forward.rowsBetween(*_ALL))))
    later = F.min("depth").over(backward)
    return deep.withColumn("visible", (F.col("kind") == "define") & (F.coalesce(later, F.col("depth")) >= F.col("depth"))).drop("_run")


def visible(log: DataFrame, order: str = "rid") -> DataFrame:
    """The definitions of each slot that a sequence of forgets can still reveal, with their depth."""
    return annotate(log, order).where("visible").drop("visible", "kind")


def active(log: DataFrame, order: str = "rid") -> DataFrame:
    """The head of each slot that has one."""
    top = visible(log, order)
    heads = Window.partitionBy("slot").orderBy(F.desc("depth"))
    return top.withColumn("_n", F.row_number().over(heads)).where("_n = 1").drop("_n")


def history(log: DataFrame, order: str = "rid") -> DataFrame:
    """Every record with the head that it found (``previous_head``) and the one that it left (``resulting_head``)."""
    deep = annotate(log, order).drop("visible")
    level = Window.partitionBy("slot", "depth").orderBy(order).rowsBetween(*_ALL)
    seen = deep.withColumn("resulting_head", F.when(F.col("depth") > 0, F.last(F.when(F.col("kind") == "define", F.col(order)), ignorenulls=True).over(level)))
    return seen.withColumn("previous_head", F.lag("resulting_head").over(Window.partitionBy("slot").orderBy(order)))


def resume(checkpoint: DataFrame, tail: DataFrame) -> DataFrame:
    """The log to go on from: a visible stack as plain defines in order of depth, then the newer records."""
    old = checkpoint.select("rid", F.lit("define").alias("kind"), "slot", "s", "p", "o")
    return old.unionByName(tail.select("rid", "kind", "slot", "s", "p", "o"))
