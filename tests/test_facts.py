import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from factspark.errors import ConstraintViolation, LogCorruption, QueueFull, TransactionClosed, TransactionConflict
from factspark.operators import stack
from factspark.plans.patterns import Options, query
from factspark.sources.commits import MemoryStore, ParquetStore
from factspark.streaming.epochs import Ingress, Intent, Temp, apply_epoch, stream
from factspark.terms import Entity, Fact, Literal, Pattern, Predicate, Variable
from factspark.transactions import Transaction

SF = "/root/testdata/sf0.001"
P = Predicate("p")


def fact(n, text="x"):
    return Fact(Entity(n), P, Literal(text))


def test_catalogue_equals_sql(spark):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    sql = __spark_entry__.oracle_sql()
    for name, run in __spark_entry__.queries().items():
        if name in sql and not name.startswith("op"):
            df = run(spark, SF)
            columns = sorted(df.columns)
            got = sorted(str([r[c] for c in columns]) for r in df.collect())
            rel = con.sql(sql[name])
            at = [rel.columns.index(c) for c in columns]
            assert got == sorted(str([r[k] for k in at]) for r in rel.fetchall()), name


def test_stack_equals_ordinary_stack(spark):
    rng = random.Random(7)
    rows, stacks, resulting, previous = [], {}, {}, {}
    for rid in range(1500):
        slot, kind = f"s{rng.randrange(12)}", rng.choice(["define", "define", "forget"])
        st = stacks.setdefault(slot, [])
        previous[rid] = st[-1] if st else None
        if kind == "define":
            st.append(rid)
        elif st:
            st.pop()
        resulting[rid] = st[-1] if st else None
        rows.append((rid, kind, slot))
    log = spark.createDataFrame(rows, "rid long, kind string, slot string")
    got = {}
    for r in stack.visible(log).orderBy("depth").collect():
        got.setdefault(r["slot"], []).append(r["rid"])
    assert got == {k: v for k, v in stacks.items() if v}
    assert {r["slot"]: r["rid"] for r in stack.active(log).collect()} == {k: v[-1] for k, v in stacks.items() if v}
    for r in stack.history(log).collect():
        assert (r["resulting_head"], r["previous_head"]) == (resulting[r["rid"]], previous[r["rid"]])


def test_patterns_equal_nested_loops(spark):
    rng = random.Random(3)
    facts = [(f"s{k}", k, Entity(rng.randrange(5)), f"p{rng.randrange(2)}", rng.choice([Entity(rng.randrange(5)), Literal("1")])) for k in range(40)]
    from factspark.functions.atoms import ATOM, row_of, value_of

    df = spark.createDataFrame([(a, b, row_of(c), d, row_of(e)) for a, b, c, d, e in facts], f"slot string, rid long, s {ATOM}, p string, o {ATOM}")
    V = Variable
    for patterns in ([Pattern(V("a"), Predicate("p0"), V("b")), Pattern(V("b"), Predicate("p1"), V("c"))], [Pattern(V("a"), V("q"), V("a"))], [Pattern(V("a"), V("q"), Literal("1")), Pattern(V("b"), V("q"), V("a"))], [Pattern(V("a"), V("a"), V("b"))]):
        frames = [({}, ())]
        for p in patterns:
            new = []
            for binding, slots in frames:
                for slot, _, s, name, o in facts:
                    b = dict(binding)
                    for term, value in ((p.p, Predicate(name)), (p.s, s), (p.o, o)):
                        if isinstance(term, V):
                            if b.setdefault(term.name, value) != value:
                                break
                        elif term != value:
                            break
                    else:
                        new.append((b, (*slots, slot)))
            frames = new
        out = query(df, patterns, Options(distinct=False, provenance=True, optimize=False)).collect()
        got = sorted(str((sorted((k, value_of(v)) for k, v in r.asDict(recursive=False).items() if k != "provenance"), tuple(r["provenance"]))) for r in out)
        assert got == sorted(str((sorted(b.items()), s)) for b, s in frames)
    with pytest.raises(AssertionError):
        query(df, [Pattern(V("a"), V("a"), V("b"))], Options(strict=True))
    assert query(df, [], Options()).count() == 1
    assert query(df, [Pattern(V("a"), V("q"), V("b"))], Options(limit=0)).count() == 1


def test_bad_terms():
    for bad in ("", "?x"):
        with pytest.raises(ValueError):
            Variable(bad)
    with pytest.raises(ValueError):
        Entity(-1)


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_transactions(spark, tmp_path, kind):
    store = MemoryStore(spark) if kind == "memory" else ParquetStore(spark, str(tmp_path / "log"))
    late = Transaction(store)
    with Transaction(store) as tx:
        e = tx.entity()
        tx.define("a", fact(e.id)).define("a", fact(e.id, "y")).forget("zzz")
    assert store.head["version"] == 1 and store.head["records"] == 3 and store.world().resolve("a") == fact(1, "y")
    with pytest.raises(TransactionConflict):
        late.define("a", fact(9)).commit()
    with pytest.raises(TransactionClosed):
        late.define("a", fact(9))
    with pytest.raises(ConstraintViolation):
        Transaction(store).forget("a").require(lambda w: 1 / 0).commit()
    with pytest.raises(ZeroDivisionError), Transaction(store) as tx:
        tx.define("b", fact(1))
        1 / 0
    with Transaction(store) as tx:
        tx.forget("a")
    assert [f.o.text for f in store.world().definitions("a")] == ["x"]
    assert [f.o.text for f in store.world(1).definitions("a")] == ["y", "x"]
    assert [r["kind"] for r in store.world().history("a").collect()] == ["define", "define", "forget"]
    Transaction(store).commit()
    assert store.head["version"] == 3


def test_recovery(spark, tmp_path):
    folder = tmp_path / "log"
    store = ParquetStore(spark, str(folder))
    with Transaction(store) as tx:
        tx.define("a", fact(1))
    with pytest.raises(OSError):  # a file without a manifest is no commit, and doesn't stand in the way
        store.append(store.head, [], 1, fail_before="manifest")
    other = ParquetStore(spark, str(folder))
    with Transaction(other) as tx:
        tx.define("b", fact(2))
    with pytest.raises(TransactionConflict):
        store.append(store.head, [], 5)
    assert ParquetStore(spark, str(folder)).world().counts() == {"active_slots": 2, "records": 2}
    part = next(folder.glob("ops/*/*.parquet"))
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2] ^= 1
    part.write_bytes(bytes(raw))
    with pytest.raises(LogCorruption):
        ParquetStore(spark, str(folder))


def test_epochs(spark):
    store = MemoryStore(spark)
    a, b, c = Intent(), Intent(), Intent()
    t = a.entity()
    a.expect_absent("s").define("s", t, P, Literal("1"))
    b.expect_absent("s").define("s", Entity(9), P, Literal("2"))  # sees the first one's work
    b.entity()
    c.define("s", Temp(0), P, Literal("3"))
    d = Intent()
    d.expect_value("s", Fact(Entity(1), P, Literal("1"))).define("s", d.entity(), P, Literal("4"))
    out = apply_epoch(store, [a, b, c, d])
    assert [(o.accepted, o.reason, o.entities) for o in out] == [(True, None, (1,)), (False, "slot_mismatch", ()), (False, "unknown_temporary_entity", ()), (True, None, (2,))]
    assert store.head["version"] == 1 and store.head["next_entity"] == 3
    assert apply_epoch(store, [Intent().reject()])[0].reason == "rejected" and store.head["version"] == 1
    apply_epoch(store, [Intent().forget("s"), Intent().forget("s")], per_intent=True)
    assert store.head["version"] == 3 and store.world().resolve("s") is None
    ingress = Ingress(store, 1)
    ingress.submit(Intent())
    with pytest.raises(QueueFull):
        ingress.submit(Intent())
    assert ingress.flush()[0].accepted


def test_stream_applies_each_batch_once(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "log"))
    one = '{"expect": [{"slot": "s", "absent": true}], "ops": [{"op": "define", "slot": "s", "s": {"entity": 1}, "p": "p", "o": {"literal": "x"}}]}'
    spark.createDataFrame([(0, one), (1, one)], "position int, intent string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema("position int, intent string").parquet(str(tmp_path / "in"))
        stream(source, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.head["version"] == 1 and store.world().counts()["active_slots"] == 1
    assert apply_epoch(store, [Intent()], batch=0) == []
