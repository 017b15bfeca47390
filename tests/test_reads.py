"""Queries of worlds, controllers and scripted cases against their SQL, and a controller's policies by themselves."""

import duckdb
import pytest

import __spark_entry__
from factspark import golden, reads
from factspark.streaming.controller import Adaptive, Coalesce, Immediate

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in __spark_entry__.queries().items() if f.__module__ in (golden.__name__, reads.__name__)]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "orders", "lineitem", "events"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    known = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF).select(*[f"`{c}`" for c in known.columns]).collect()
    assert got and sorted(map(str, map(tuple, got))) == sorted(map(str, known.fetchall()))


def test_policies():
    assert Immediate(4).wait(1, 0.0, 0.0) == 0
    assert Coalesce(4, 1.0).wait(3, 0.25, 0.0) == 0.75 and Coalesce(4, 1.0).wait(4, 0.0, 0.0) == 0 and Coalesce(4, 1.0).wait(1, 2.0, 0.0) == 0
    assert Adaptive(8, 1.0, 4).wait(2, 0.0, 10.0) == 0.2 and Adaptive(8, 1.0, 4).wait(2, 0.9, 1.0) == pytest.approx(0.1) and Adaptive(8, 1.0, 4).wait(2, 0.0, 0.0) == 0


def test_unknown_step(spark):
    with pytest.raises(ValueError):
        golden.run_cases(spark, [{"name": "x", "entities": [], "steps": [{"op": "shout", "name": "y"}]}])
