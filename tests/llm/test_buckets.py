"""The packed exchange of bands and the filter of keys against plain Python, and near classes by the joins of large tables."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspark.llm import buckets, fingerprint, icws, near, sieve


@pytest.mark.parametrize("run_bands, range_bands", [(buckets.RUN_BANDS, buckets.RANGE_BANDS), (50, 20)])
def test_members_are_those_of_shared_buckets(spark, monkeypatch, run_bands, range_bands):
    monkeypatch.setattr(buckets, "RUN_BANDS", run_bands)
    monkeypatch.setattr(buckets, "RANGE_BANDS", range_bands)
    rng = np.random.Generator(np.random.PCG64(5))
    pool = rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
    rows = [(int(r), [int(pool[0])] * (r % 3 == 0) + [int(x) for x in rng.choice(pool, 4)]) for r in range(150)]
    rows += rows[:20] + [(900, None), (901, []), (902, [7, 7]), (902, [7, 7])]  # repeated rows, no bands, one text in a bucket twice
    table = spark.createDataFrame(rows, "rep long, bands array<long>").repartition(5)
    found = collections.defaultdict(list)
    for r in buckets.members(table, sum(len(b or []) for _, b in rows)).distinct().collect():
        found[r["band"]].append(r["rep"])
    want = collections.defaultdict(set)
    for rep, bands in rows:
        for b in bands or []:
            want[b].add(rep)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert buckets.members(table.limit(0), 0).count() == 0


def test_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(0, 300_000, 3).select((F.col("id") * 7919).alias("key"))
    table = spark.range(0, 300_000).select(F.when(F.col("id") % 1000 != 1, F.col("id") * 7919).alias("x"), "id")
    passed = {r["id"] for r in table.where(sieve.passing(keys, 100_000, F.col("x"))).select("id").collect()}
    assert set(range(0, 300_000, 3)) - {i for i in range(300_000) if i % 1000 == 1} <= passed
    assert len(passed) < 110_000 and 1 not in passed


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sieve, "MOST", 1 << 12)
    monkeypatch.setattr(sieve, "SLICE", 1 << 10)
    keys = spark.range(0, 20_000, 2).select(F.col("id").alias("key"))
    assert {r["id"] for r in spark.range(20_000).where(sieve.passing(keys, 10_000, F.col("id"))).collect()} >= set(range(0, 20_000, 2))


@pytest.mark.parametrize("classes", [icws.near_duplicate_classes, fingerprint.near_classes])
def test_large_tables_join_gives_the_same_classes(spark, monkeypatch, classes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    docs = docs.unionByName(docs.limit(40).withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(docs.limit(5))

    def rows():
        return sorted(map(tuple, classes(docs).select("*").drop("key").collect()))

    broadcast = rows()
    monkeypatch.setattr(near, "BROADCAST_KEYS", 0)
    assert rows() == broadcast
