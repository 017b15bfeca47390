"""Connected components of a graph of ids, by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.session import shared_dir


def _size(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


#: Rows for which a task of these small tables is worth its files.
ROWS_A_TASK = 20_000


def tasks_for(rows: int) -> int:
    return 1 + rows // ROWS_A_TASK


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of each id that has an edge (a, b); the label is the least id of the component.

    Each step is two aggregations and two joins over the edges; nothing but counts reaches the driver, and each round is cut by
    ``checkpoint``. The rounds grow with the logarithm of the longest path.
    """
    shared_dir(edges.sparkSession)
    tasks = tasks_for(edges.count())
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(tasks).checkpoint()
    seen = _size(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().coalesce(tasks).checkpoint()
        new = _size(now)
        if new == seen:
            break
        seen = new
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return labels.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
