"""Benchmark decontamination: which test items stand in which documents. DataFrame functions only.

Words are runs of letters and digits of the lower-cased text; shingles are five words, or all words of an item that has fewer. Items are
partitioned by size (powers of two of their number of shingles). For a size class with at most u shingles, an item's sketch is its
floor((1 - t) u) + 1 least shingle hashes: a document that holds a share of t or more of an item's shingles has at least one of them, so
no match is missed. Documents are not reduced, however long: their shingles are looked up in the sketches, each hit is a candidate, and
candidates are verified by the exact share of the item's distinct shingles that the document holds.

Sketches are broadcast if there are at most ``BROADCAST_ROWS`` of them, and joined otherwise. A null or wordless item or document matches
nothing. Rows with the same id are taken together; a null id is an id. Further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.llm.frames import documents, public_id

WIDTH = 5
THRESHOLD = 0.8
#: Rows of two numbers: 8 MB.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingles(words: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """(keys..., h) for each place of ``width`` words of ``w``; hashes are computed where the places are made, without a slice of the array."""
    at = words.where(F.size("w") >= width).select(*keys, "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.lit(width))).alias("i"))
    return at.select(*keys, F.xxhash64(F.lit(width), *[F.col("w")[F.col("i") + k] for k in range(width)]).alias("h"))


def item_shingles(items: DataFrame, threshold: float, widths: list[int]) -> DataFrame:
    """(item, width, n, h, sketch): the distinct shingles of each item, marked if they are of its sketch."""
    from pyspark.sql import Window

    parts = [_shingles(items.where(F.least(F.size("w"), F.lit(WIDTH)) == width), width, ["item"]).withColumn("width", F.lit(width)) for width in widths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # one item's shingles make a group: it is as long as the item
    each = Window.partitionBy("item")
    counted = out.distinct().withColumn("n", F.count("*").over(each)).withColumn("place", F.row_number().over(each.orderBy("h")))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))  # of the size class
    return counted.select("item", "width", "n", "h", (F.col("place") <= F.floor((1 - threshold) * upper + 1e-9) + 1).alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of each document that holds an item."""
    plain = documents(docs, id_col, text_col)
    asked = documents(items, item_id_col, item_text_col).select(F.col("id").alias("item"), _words(F.col("text")).alias("w")).where("w[0] <> ''")
    widths = sorted(r["k"] for r in asked.select(F.least(F.size("w"), F.lit(WIDTH)).alias("k")).distinct().collect()) or [WIDTH]  # five numbers at most
    known = item_shingles(asked, threshold, widths)
    sketch = known.where("sketch").select("item", "h")
    small = known.count() <= BROADCAST_ROWS

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    def of_documents(texts: DataFrame) -> DataFrame:
        words = texts.select("id", _words(F.col("text")).alias("w"))
        parts = [_shingles(words, width, ["id"]) for width in widths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    candidates = of_documents(plain).join(sized(sketch), "h").select("id", "item").distinct()
    hit = plain.join(candidates.select("id").distinct(), "id", "left_semi")
    shared = of_documents(hit).join(sized(known.select("item", "n", "h")), "h").select("id", "item", "n", "h").distinct()
    counted = shared.groupBy("id", "item").agg(F.count("*").alias("n_shared"), F.max("n").alias("n")).join(candidates, ["id", "item"])
    good = counted.where(F.col("n_shared") >= F.lit(threshold) * F.col("n") - F.lit(1e-9))
    return good.select(public_id().alias(id_col), public_id("item").alias(item_id_col), "n_shared", F.col("n").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = contained_items(docs, items, threshold, id_col, text_col).select(F.col(id_col).alias("__leaked")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["__leaked"]), "left_anti")
