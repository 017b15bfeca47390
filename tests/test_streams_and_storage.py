import json

import pytest
from pyspark.sql import functions as F

from factspark.errors import ConstraintViolation, LeaseTaken, QueueFull
from factspark.functions.atoms import entity, literal
from factspark.plans.patterns import metrics
from factspark.sources import instructions as isa
from factspark.sources.commits import MemoryStore, ParquetStore, WriterLease
from factspark.streaming.admission import Journal
from factspark.streaming.epochs import Ingress, Intent, apply_epoch, intent_of, text_of
from factspark.terms import Entity, Fact, Literal, Pattern, Predicate, Variable
from factspark.transactions import Transaction

P = Predicate("p")


def fact(n, text="x"):
    return Fact(Entity(n), P, Literal(text))


def builder():
    b = isa.Builder(namespace=7)
    t = b.allocate()
    return b.define("é/slot", t, P, Literal("wörld")).expect_object("é/slot", Literal("wörld")).forget("zzz")


def test_frame_bytes():
    frame = builder().frame()
    raw = frame.encode()
    assert raw[:16] == b"SISA" + (1).to_bytes(4, "little") + (7).to_bytes(8, "little")
    tables = b"".join([(2).to_bytes(4, "little"), (0).to_bytes(4, "little"), (7).to_bytes(4, "little"), "é/slot".encode(), (1).to_bytes(4, "little"), (3).to_bytes(4, "little"), b"zzz"])
    assert raw[16 : 16 + len(tables)] == tables
    assert len(frame.steps) == 8 and raw[-13:] == b"\x07" + (1).to_bytes(4, "little") + bytes(8)
    assert isa.Frame.decode(raw) == frame
    assert isa.Frame.decode_at(b"xx" + raw + raw, 2) == (frame, 2 + len(raw))


def test_frames_that_are_none():
    raw = builder().frame().encode()
    for bad in [raw[:k] for k in range(len(raw))] + [raw + b"x", b"SISB" + raw[4:], raw[:4] + b"\x02" + raw[5:]]:
        with pytest.raises(isa.BadFrame):
            isa.Frame.decode(bad)
    for steps in ([(isa.DEFINE, 0, 0)], [(isa.STORE, 0, 0)], [(isa.LOAD, 3, 0)], [(9, 0, 0)], [(isa.FORGET, 5, 0)], [(isa.PUSH, 0, 1), (isa.PUSH, 0, 4), (isa.PUSH, 0, 1), (isa.DEFINE, 0, 0)]):
        with pytest.raises(isa.BadFrame):
            isa.to_intent(isa.Frame(1, {0: "s"}, {0: "p"}, {}, 0, steps))


def test_frames_are_applied(spark):
    store = MemoryStore(spark)
    refused = isa.Builder().expect_object("é/slot", Literal("other")).define("q", Entity(1), P, Entity(2))
    rejected = isa.Builder()
    rejected.allocate()
    rejected.define("q", Entity(1), P, Entity(2)).reject()
    frames = [builder().frame(), refused.frame(), rejected.frame(), builder().frame()]
    out = apply_epoch(store, [isa.to_intent(isa.Frame.decode(f.encode())) for f in frames])
    assert [(o.accepted, o.reason, o.entities) for o in out] == [(True, None, (1,)), (False, "slot_mismatch", ()), (False, "rejected", ()), (True, None, (2,))]
    assert [f.s for f in store.world().definitions("é/slot")] == [Entity(2), Entity(1)] and store.world().resolve("q") is None
    ahead = isa.Builder().expect_world(store.head["digest"]).forget("é/slot")
    assert [o.reason for o in apply_epoch(store, [isa.to_intent(ahead.frame()), isa.to_intent(ahead.frame())])] == [None, "world_mismatch"]


def test_canonical_frames():
    ops = [("allocate", "b"), ("object", "z", Literal("2")), ("define", "a", "b", Predicate("q"), Literal("1")), ("define", "z", Entity(4), P, "b"), ("forget", "m"), ("reject",)]
    frame = isa.lower(ops)
    assert list(frame.slots.values()) == ["a", "m", "z"] and list(frame.predicates.values()) == ["p", "q"]
    assert frame.literals == {isa.LITERAL_BASE: "1", isa.LITERAL_BASE + 1: "2"}
    assert isa.of_intent(isa.to_intent(frame)).steps[:2] == frame.steps[:2]
    for bad in ([("allocate", "b"), ("allocate", "b")], [("define", "a", "b", P, Entity(1))], [("allocate", "b"), ("object", "a", "b")]):
        with pytest.raises(ValueError):
            isa.lower(bad)
    with pytest.raises(ValueError):
        isa.of_intent(Intent().expect_absent("a"))


def test_frames_from_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(builder().frame().encode())
    (row,) = isa.frames(spark, str(tmp_path)).collect()
    assert isa.Frame.decode(bytes(row["content"])) == builder().frame()


def test_intents_as_text():
    i = Intent().expect_world("d").expect_absent("a").expect_value("b", fact(1)).expect_object("c", Entity(3))
    i.define("a", i.entity(), P, Literal("é")).forget("b").reject()
    i.ops += [("expect_object", "a", Literal("é")), ("expect_world_cell", 5)]
    assert intent_of(text_of(i)) == i
    assert intent_of("{}") == Intent()


class Stops(MemoryStore):
    """Fails at the second commit."""

    def append(self, *a, **b):
        if len(self.manifests) == 1 and not hasattr(self, "on"):
            self.on = True
            raise OSError("stopped")
        return super().append(*a, **b)


def test_a_stopped_batch_goes_on(spark):
    store = Stops(spark)
    intents = [Intent().expect_absent(s).define(s, Entity(1), P, Literal(str(k))) for k, s in enumerate("abac")]
    with pytest.raises(OSError):
        apply_epoch(store, intents, per_intent=True, batch=3)
    rest = apply_epoch(store, intents, per_intent=True, batch=3)
    assert [(o.position, o.reason) for o in rest] == [(1, None), (2, "slot_mismatch"), (3, None)]
    assert store.head["version"] == 3 and apply_epoch(store, intents, per_intent=True, batch=3) == []
    assert [o[0] for o in store.outcomes(3)] == [0, 1, 2, 3]


def test_private_worlds_are_the_committed_ones(spark):
    intents = [Intent().define("a", Entity(1), P, Literal("1"))]
    first = MemoryStore(spark)
    apply_epoch(first, intents)
    store = MemoryStore(spark)
    out = apply_epoch(store, [*intents, Intent().expect_world(first.head["digest"]).forget("a"), Intent().expect_world(first.head["digest"])], per_intent=True)
    assert [o.reason for o in out] == [None, None, "world_mismatch"]


def test_narrow_epochs_of_a_queue(spark):
    store = MemoryStore(spark)
    ingress = Ingress(store, 8, max_batch=2)
    for _ in range(5):
        ingress.submit(Intent().expect_absent("a").define("a", Entity(1), P, Entity(2)))
    out = ingress.flush()
    assert [o.position for o in out] == [0, 1, 2, 3, 4] and [o.accepted for o in out] == [True] + [False] * 4


def test_checkpoints_and_bulk_commits(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "log"))
    df = spark.range(1000).repartition(4).selectExpr("concat('s', id) as slot", "id")
    rows = df.select("slot", entity(df["id"]).alias("s"), "id")
    m = store.append_frame(rows.selectExpr("slot", "s", "'p' as p", "s as o"), next_entity=1000)
    assert m["records"] == 1000
    with Transaction(store) as tx:
        tx.define("s5", fact(5)).define("s5", fact(5, "y")).forget("s6").define("n", Fact(tx.entity(), P, Literal("new")))
    plain = store.world()
    note = store.checkpoint()
    assert note["version"] == 2 and store.checkpoint()["version"] == 2
    with Transaction(store) as tx:
        tx.forget("s5").define("s6", fact(6, "again"))
    w = ParquetStore(spark, str(tmp_path / "log")).world()
    assert "stacks" in str(w.short.inputFiles()) and w.resolve("s5") == fact(5) and w.resolve("s6") == fact(6, "again") and len(w.definitions("s5")) == 2
    assert w.audit().count() == 0 and w.counts() == {"active_slots": 1001, "records": 1006}
    assert store.world(2).signature() == plain.signature() != w.signature()
    assert store.world(1).resolve("s6").o == Entity(6)  # older than the checkpoint
    assert [r["ops"] for r in store.frames().orderBy("version").collect()] == [1000, 4, 2]
    path = tmp_path / "log" / "checkpoints" / f"{2:020d}.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | {"digest": "other"}))
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    w = ParquetStore(spark, str(tmp_path / "log")).world()
    assert w.short is w.log and w.resolve("s5") == fact(5)  # a checkpoint of another history is passed over
    store.append_frame(rows.limit(0).selectExpr("slot", "s", "'p' as p", "s as o"))
    assert store.head["records"] == 1006


def test_validators_of_a_store(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "log"))
    seen = []

    def no_z(world):
        seen.append(world.version)
        if world.resolve("z"):
            raise ValueError("z")

    store.register_validator(no_z)
    with pytest.raises(ConstraintViolation):
        Transaction(store).define("z", fact(1)).commit()
    assert [o.reason for o in apply_epoch(store, [Intent().define("z", Entity(1), P, Entity(1)), Intent().define("a", Entity(1), P, Entity(1))])] == ["constraint_violation", None]
    df = spark.range(1).select(literal(F.col("id")).alias("s"))
    with pytest.raises(ValueError):
        store.append_frame(df.selectExpr("'z' as slot", "s", "'p' as p", "s as o"))
    assert store.head["version"] == 1 and seen


def test_leases(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "log"))
    with WriterLease(store, "one") as one:
        assert one.holder() == "one"
        with pytest.raises(LeaseTaken), WriterLease(store, "two"):
            pass
        with WriterLease(store, "three", take=True):
            one.__exit__()
            assert one.holder() == "three"
    assert one.holder() is None


def test_journal(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "log"))
    journal = Journal(store, window=2, width=2)
    claim = [Intent().expect_absent("a").define("a", Entity(1), P, Literal(x)) for x in "12"]
    assert journal.admit(claim) == 0 and journal.admit([Intent().reject()]) == 1
    for too_much in ([Intent()], [Intent()] * 3):
        with pytest.raises(QueueFull):
            journal.admit(too_much)
    assert store.head["version"] == 0  # admitted, not applied
    store = ParquetStore(spark, str(tmp_path / "log"))
    apply_epoch(store, claim, batch="journal/0")  # stopped between the commit and the outcomes
    journal = Journal(ParquetStore(spark, str(tmp_path / "log")), window=2, width=2)
    assert journal.waiting() == [0, 1]
    journal.apply()
    assert journal.waiting() == [] and journal.store.head["version"] == 1
    got = [(r["epoch"], r["position"], r["accepted"], r["reason"]) for r in journal.outcomes().orderBy("epoch", "position").collect()]
    assert got == [(0, 0, True, None), (0, 1, False, "slot_mismatch"), (1, 0, False, "rejected")]


def test_counts_of_join_steps(spark):
    store = MemoryStore(spark)
    with Transaction(store) as tx:
        for k, (s, o) in enumerate([(1, 1), (1, 2), (2, 2), (3, 1)]):
            tx.define(f"s{k}", Fact(Entity(s), P, Entity(o)))
    w, x, y = store.world(), Variable("x"), Variable("y")
    assert [(r["candidates"], r["emitted"]) for r in metrics(w.active, [Pattern(x, P, x)]).collect()] == [(4, 2)]
    both = [Pattern(x, P, y), Pattern(y, P, y)]
    # y is bound by the first step, so the second one looks up whole facts
    assert [(r["position"], r["candidates"], r["emitted"]) for r in metrics(w.active, both, optimize=False).collect()] == [(0, 4, 4), (1, 4, 4)]
    out = w.explain([Pattern(x, Predicate("none"), y), Pattern(y, P, x)])
    assert out["first_path"] == ["?x none ?y"] and out["rows"] == 0 and out["candidate_facts"] == 0
    assert w.count(Pattern(Entity(1), P, y)) == 2 and [r["slot"] for r in w.slots(Pattern(x, P, Entity(1))).collect()] == ["s0", "s3"]
