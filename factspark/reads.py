"""Queries of whole worlds over the driver's tables: reads by version, orders, limits, signatures, audits, epochs and controllers."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.catalogue import _HALF, _LAST, _STACK, ORACLE, P, V, _half, event_log, facts, ident, key_of, register, supplied
from factspark.errors import ConstraintViolation, LeaseTaken, QueueFull, TransactionClosed
from factspark.functions.atoms import ATOM, record_name
from factspark.plans.patterns import Options, in_order, query
from factspark.scenarios import AT, _folder, _rows
from factspark.sources.commits import MemoryStore, ParquetStore, WriterLease, digest
from factspark.streaming.controller import Adaptive, Coalesce, Controller, Immediate
from factspark.streaming.epochs import Ingress, Intent, apply_epoch
from factspark.terms import Entity, Fact, Literal, Pattern, Predicate, Variable
from factspark.transactions import Transaction
from factspark.world import World


def events_world(spark: SparkSession, d: str, up_to: str = "true") -> World:
    """The world that the events table tells, one version."""
    log = event_log(spark, d, up_to).select(F.lit(1).cast("long").alias("version"), "rid", "kind", "slot", F.col("s").cast(ATOM).alias("s"), "p", F.col("o").cast(ATOM).alias("o"))
    return World(spark, log, 1, "", 0)


@register("world_scan", _STACK.format(where="true") + f" select user_id, stack[len(stack)] as event_id from st where {_LAST}")
def world_scan(spark, d):
    """Every active fact of a world, by a pattern of variables alone."""
    out = events_world(spark, d).query([Pattern(V("s"), V("p"), V("o"))])
    return out.select(key_of("s").alias("user_id"), key_of("o").alias("event_id"))


@register("resolve_at", _STACK.format(where=_HALF) + f" select user_id, stack[len(stack)] as head from st where {_LAST} and user_id = (select min(user_id) from (select user_id from st where {_LAST}))")
def resolve_at(spark, d):
    """One slot's head at an earlier time."""
    world = events_world(spark, d, _half(spark, d))
    user = world.active.agg(F.min(key_of("s"))).first()[0]
    fact = world.resolve(f"user/{user}")
    return _rows(spark, [(user, fact.o.id % (1 << 40))], "user_id long, head long")


@register("world_slots", "select concat((3 * 1099511627776 + c_custkey), '/in_nation/current') as slot, row_number() over (order by concat((3 * 1099511627776 + c_custkey), '/in_nation/current')) as place from customer where c_nationkey = 3")
def world_slots(spark, d):
    """The slots that a pattern matches, in order of their text."""
    world = World(spark, _log(facts(spark, d, "in_nation")), 1, "", 0)
    return _placed(world.slots(Pattern(V("c"), P("in_nation"), Entity(ident("nation", 3)))))


def _log(f: DataFrame) -> DataFrame:
    return f.select(F.lit(1).cast("long").alias("version"), "rid", F.lit("define").alias("kind"), "slot", "s", "p", "o")


def _placed(df: DataFrame) -> DataFrame:
    """A sorted table with the number of each row, from 1, by the executors' own counts."""
    schema = df.schema.add("place", "long")
    return df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)), schema)


@register("sorted_bindings", "select c_custkey as c, row_number() over (order by cast(3 * 1099511627776 + c_custkey as varchar)) as place from customer where c_nationkey = 3")
def sorted_bindings(spark, d):
    """Bindings in the order of results."""
    out = in_order(query(facts(spark, d), [Pattern(V("c"), P("in_nation"), Entity(ident("nation", 3)))]))
    return _placed(out).select(key_of("c").alias("c"), "place")


@register("sorted_provenance", "select l_suppkey as s, concat(l_orderkey, '/', l_linenumber, '/supplied_by') as slot, row_number() over (order by cast(4 * 1099511627776 + l_suppkey as varchar), concat(l_orderkey, '/', l_linenumber, '/supplied_by')) as place from lineitem where l_partkey = 1")
def sorted_provenance(spark, d):
    """Equal bindings stand in the order of their provenance."""
    out = in_order(query(supplied(spark, d), [Pattern(Entity(ident("part", 1)), P("supplied_by"), V("s"))], Options(distinct=False, provenance=True)))
    return _placed(out).select(key_of("s").alias("s"), F.col("provenance")[0].alias("slot"), "place")


@register("limit_zero", "select 'zero' as asked, l_suppkey as s from lineitem where l_orderkey * 16 + l_linenumber = (select min(l_orderkey * 16 + l_linenumber) from lineitem) union all select 'negative', l_suppkey from lineitem where l_orderkey * 16 + l_linenumber = (select min(l_orderkey * 16 + l_linenumber) from lineitem)")
def limit_zero(spark, d):
    """A limit that isn't positive still lets the first match through."""
    one = [query(supplied(spark, d), [Pattern(V("p"), P("supplied_by"), V("s"))], Options(limit=n)).select(F.lit(name).alias("asked"), key_of("s").alias("s")) for name, n in (("zero", 0), ("negative", -5))]
    return one[0].unionByName(one[1])


@register("limit_join", "select distinct c, n from (select c_custkey as c, cast(c_nationkey as bigint) as n from orders join customer on o_custkey = c_custkey order by o_orderkey, c_custkey limit 300)")
def limit_join(spark, d):
    """The first matches of a join in the order of its patterns' records, then distinct."""
    f = facts(spark, d, "placed_by", "in_nation").withColumn("s", F.when(F.col("p") == "placed_by", F.struct(F.lit(1).cast("tinyint").alias("tag"), F.lit(None).cast("long").alias("ent"), F.lit("order").alias("lit"))).otherwise(F.col("s")))
    out = query(f, [Pattern(Literal("order"), P("placed_by"), V("c")), Pattern(V("c"), P("in_nation"), V("n"))], Options(limit=300, optimize=False))
    return out.select(key_of("c").alias("c"), key_of("n").alias("n"))


@register("cross_role_variable", "select * from (values ('lenient', 'no rows'), ('strict', 'refused')) t(mode, outcome)")
def cross_role_variable(spark, d):
    """One name for a predicate here and an entity there: matches nothing, and is refused if asked."""
    ps, out = [Pattern(V("a"), V("x"), V("b")), Pattern(V("x"), P("in_region"), V("r"))], []
    for mode, strict in (("lenient", False), ("strict", True)):
        try:
            n = query(facts(spark, d, "in_region", "nation_name"), ps, Options(strict=strict)).count()
            out.append((mode, f"{n} rows" if n else "no rows"))
        except AssertionError:
            out.append((mode, "refused"))
    return _rows(spark, out, "mode string, outcome string")


@register("record_names", "select concat('Record_', event_id) as record, concat('Entity_', 7 * 1099511627776 + user_id) as entity from events where event_type <> 'error'")
def record_names(spark, d):
    log = event_log(spark, d).where("kind = 'define'")
    return log.select(record_name(F.col("rid")).alias("record"), F.concat(F.lit("Entity_"), F.col("s.ent").cast("string")).alias("entity"))


@register("pattern_keys", "select * from (values ('Entity_1 located_at ?x'), ('?s ?p ?o'), ('deep state v2')) t(pattern)")
def pattern_keys(spark, d):
    told = [Pattern(Entity(1), AT, Variable("x")), Pattern(V("s"), V("p"), V("o")), Pattern(Literal("deep"), Predicate("state"), Literal("v2"))]
    return _rows(spark, [(p.key(),) for p in told], "pattern string")


@register("state_digest", "select cast(k as bigint) as version, case k when 1 then sha256('[\"' || g || '\",1,2,[]]') else sha256('[\"' || sha256('[\"' || g || '\",1,2,[]]') || '\",2,2,[]]') end as digest from (select sha256('genesis') as g), range(1, 3) t(k)")
def state_digest(spark, d):
    """The chain of two commits without an operation, the first of which allocates an entity; also the frames of a history."""
    store = MemoryStore(spark)
    first = Transaction(store)
    first.entity()
    first.commit()
    Transaction(store).commit()
    found = {r["version"]: r for r in store.frames().collect()}
    if found[2]["parent"] != found[1]["digest"] or digest(found[1]["digest"], 2, 2, []) != found[2]["digest"]:
        raise AssertionError("the chain is broken")
    return _rows(spark, [(v, r["digest"]) for v, r in sorted(found.items())], "version long, digest string")


@register("world_signature", "select n_nationkey >= 0 as same, count(*) as n from nation group by 1")
def world_signature(spark, d):
    """Two worlds with equal heads, one told in the opposite order and with claims taken back, have one signature."""
    f = facts(spark, d, "nation_name")
    log = _log(f)
    detour = log.unionByName(log.withColumn("rid", F.col("rid") + (1 << 50)).withColumn("p", F.lit("wrong"))).unionByName(log.withColumn("rid", F.col("rid") + (1 << 51)).withColumn("kind", F.lit("forget")))
    one, other = (World(spark, x, 1, "", 0).signature() for x in (log, detour.orderBy(F.desc("rid"))))
    return _rows(spark, [(one == other, one[0])], "same boolean, n long")


@register("world_audit", "select cast(0 as bigint) as wrong, count(*) as heads from (" + ORACLE["active_heads"] + ")")
def world_audit(spark, d):
    """No head differs from what its slot's records left."""
    world = events_world(spark, d)
    return world.audit().agg(F.count("*").alias("wrong")).crossJoin(world.active.agg(F.count("*").alias("heads")))


@register("explain_plan", "select cast(0 as integer) as position, '?n in_region ' || 'Entity_' || (1099511627776 + 2) as pattern, count(*) as candidates, count(*) as emitted from nation where n_regionkey = 2 union all select 1, '?n nation_name ?name', count(*), count(*) from nation where n_regionkey = 2")
def explain_plan(spark, d):
    """The step with fewer candidates comes first; candidates and bindings of each."""
    ps = [Pattern(V("n"), P("nation_name"), V("name")), Pattern(V("n"), P("in_region"), Entity(ident("region", 2)))]
    told = World(spark, _log(facts(spark, d, "nation_name", "in_region")), 1, "", 0).explain(ps)
    rows = [(k, p, told["candidates_by_pattern"][at, p], told["emitted_by_pattern"][at, p]) for k, p in enumerate(told["first_path"]) for at in range(2) if (at, p) in told["candidates_by_pattern"]]
    return _rows(spark, rows, "position int, pattern string, candidates long, emitted long")


_CLAIMS = "(select *, row_number() over (partition by n_regionkey order by n_nationkey) as k, row_number() over (order by n_nationkey) - 1 as place from nation)"


def _claims(spark: SparkSession, d: str) -> list[Intent]:
    """Each nation in order claims its region if it is free."""
    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()
    return [Intent().expect_absent(f"region/{r['n_regionkey']}").define(f"region/{r['n_regionkey']}", Entity(r["n_nationkey"]), Predicate("holds"), Literal(r["n_name"])) for r in rows]


_OUTCOMES = f"select cast(place as integer) as position, k = 1 as accepted, case when k = 1 then {{version}} else 0 end as version from {_CLAIMS}"


def _told(spark: SparkSession, outcomes) -> DataFrame:
    return _rows(spark, [(k, o.accepted, o.version or 0) for k, o in enumerate(outcomes)], "position int, accepted boolean, version long")


@register("epoch_per_intent", _OUTCOMES.format(version="count(*) filter (k = 1) over (order by place)"))
def epoch_per_intent(spark, d):
    """Each accepted intent makes a version of its own."""
    return _told(spark, apply_epoch(MemoryStore(spark), _claims(spark, d), per_intent=True))


@register("ingress_flush", _OUTCOMES.format(version="dense_rank() over (partition by k = 1 order by place // 8)"))
def ingress_flush(spark, d):
    """A bounded queue is flushed in epochs of eight; an epoch without an accepted intent makes no version."""
    ingress = Ingress(MemoryStore(spark), capacity=1000, max_batch=8)
    for intent in _claims(spark, d):
        ingress.submit(intent)
    return _told(spark, ingress.flush())


@register("queue_full", "select count(*) filter (place < 10) as taken, count(*) filter (place >= 10) as returned from (select row_number() over (order by n_nationkey) - 1 as place from nation)")
def queue_full(spark, d):
    """What a full queue gives back."""
    ingress, returned = Ingress(MemoryStore(spark), capacity=10), 0
    for intent in _claims(spark, d):
        try:
            ingress.submit(intent)
        except QueueFull:
            returned += 1
    return _rows(spark, [(len(ingress.queue), returned)], "taken long, returned long")


@register("epoch_mixed", "select * from (values (0, true, null), (1, true, null), (2, false, 'slot_mismatch'), (3, false, 'rejected'), (4, false, 'world_mismatch'), (5, false, 'constraint_violation'), (6, false, 'unknown_temporary_entity')) t(position, accepted, reason)")
def epoch_mixed(spark, d):
    """Intents with checks before and between their operations, and every reason for which one is refused."""
    from factspark.streaming.epochs import Temp

    store, name = MemoryStore(spark), Predicate("name")

    def small(world: World) -> None:
        if world.count(Pattern(V("s"), Predicate("forbidden"), V("o"))):
            raise ValueError("forbidden")

    one, two = Intent(), Intent().expect_object("a", Literal("x"))
    e = one.entity()
    one.define("a", e, name, Literal("x"))
    two.define("a", Literal("list"), name, Literal("y"))
    two.ops.append(("expect_object", "a", Literal("y")))
    rest = [Intent().expect_object("a", Literal("x")).forget("a"), Intent().forget("a").reject(), Intent().expect_world("0" * 64).forget("a"), Intent().define("b", Entity(9), Predicate("forbidden"), Literal("z")), Intent().define("b", Temp(0), name, Literal("z"))]
    return _rows(spark, [(o.position, o.accepted, o.reason) for o in apply_epoch(store, [one, two, *rest], validators=[small])], "position int, accepted boolean, reason string")


def _policies() -> dict[str, Immediate]:
    return {"adaptive": Adaptive(8, 0.02, 8), "coalesce": Coalesce(8, 0.02), "immediate": Immediate(8)}


@register("controller_outcomes", "select policy, 'closed' as state, count(*) as submitted, count(distinct n_regionkey) as accepted, count(*) - count(distinct n_regionkey) as rejected, count(distinct n_regionkey) as heads from nation, (values ('adaptive'), ('coalesce'), ('immediate')) t(policy) group by policy")
def controller_outcomes(spark, d):
    """Four threads submit to a controller of each policy; whoever comes first, one claim a region is accepted."""
    rows = []
    for name, policy in _policies().items():
        store, claims, tickets = MemoryStore(spark), _claims(spark, d), []
        with Controller(store, policy) as c:
            threads = [threading.Thread(target=lambda part: tickets.extend(c.submit(i) for i in part), args=(claims[k::4],)) for k in range(4)]
            for t in threads:
                t.start()
            for t in threads:
                t.join()
            tickets[0].abandon()
            c.flush()
        accepted = sum(t.result(0).accepted for t in tickets)
        rows.append((name, c.state.value, c.metrics.submitted, accepted, c.metrics.summary()["rejected"], store.world().active.count()))
    return _rows(spark, rows, "policy string, state string, submitted long, accepted long, rejected long, heads long")


@register("controller_lifecycle", "select * from (values ('before', 'starting'), ('open', 'running'), ('after', 'closed'), ('late submit', 'refused'), ('broken store', 'poisoned'), ('its ticket', 'OSError')) t(step, state)")
def controller_lifecycle(spark, d):
    """Its states, and what a store that fails does to tickets."""
    claims, out = _claims(spark, d), []
    c = Controller(MemoryStore(spark))
    out.append(("before", c.state.value))
    with c:
        c.submit(claims[0]).result(60)
        out.append(("open", c.state.value))
    out.append(("after", c.state.value))
    try:
        c.submit(claims[1])
    except RuntimeError:
        out.append(("late submit", "refused"))

    class Broken(MemoryStore):
        def append(self, *_):
            raise OSError("no space")

    with Controller(Broken(spark)) as broken:
        try:
            broken.submit(claims[0]).result(60)
        except OSError as e:
            out += [("broken store", broken.state.value), ("its ticket", type(e).__name__)]
    return _rows(spark, out, "step string, state string")


@register("tx_edges", "select * from (values ('empty commit', 'version 1'), ('closed', 'refused'), ('stopped before publish', 'version 1'), ('after it', 'version 2'), ('validators inside', 'refused')) t(step, outcome)")
def tx_edges(spark, d):
    """A commit without operations, a closed transaction, one stopped before it is published, and a store's validator."""
    store, out = MemoryStore(spark), []
    tx = Transaction(store)
    tx.commit()
    out.append(("empty commit", f"version {store.head['version']}"))
    try:
        tx.define("a", Fact(Entity(1), AT, Literal("x")))
    except TransactionClosed:
        out.append(("closed", "refused"))
    try:
        with Transaction(store) as tx:
            tx.define("a", Fact(Entity(1), AT, Literal("x")))
            raise OSError("stopped")
    except OSError:
        out.append(("stopped before publish", f"version {store.head['version']}"))
    with Transaction(store) as tx:
        tx.define("a", Fact(Entity(1), AT, Literal("x"))).forget("a")
    out.append(("after it", f"version {store.head['version']}"))

    def never(world: World) -> None:
        raise ValueError("no")

    store.register_validator(never)
    try:
        Transaction(store).commit()
    except ConstraintViolation:
        out.append(("validators inside", "refused"))
    return _rows(spark, out, "step string, outcome string")


@register("store_edges", "select * from (values ('stopped before the manifest', 'version 1'), ('stopped after the manifest', 'version 2'), ('second writer', 'refused'), ('lease given back', 'taken'), ('frame too wide', 'refused'), ('version 1', 'x'), ('version 2', 'y')) t(step, outcome)")
def store_edges(spark, d):
    """A durable store stopped before and after its manifest, opened anew; the writer's lease; the limit of a frame; reads of each version."""
    folder, out = _folder(spark), []
    fact = lambda text: Fact(Entity(1), AT, Literal(text))
    with Transaction(ParquetStore(spark, folder)) as tx:
        tx.define("a", fact("x"))
    for point, name in (("manifest", "stopped before the manifest"), ("publish", "stopped after the manifest")):
        store = ParquetStore(spark, folder)
        tx = Transaction(store).define("a", fact("y"))
        try:
            store.append(tx.base, tx._ops(), tx.next_entity, fail_before=point)
        except OSError:
            out.append((name, f"version {ParquetStore(spark, folder).head['version']}"))
    store = ParquetStore(spark, folder)
    with WriterLease(store, "one"):
        try:
            WriterLease(store, "two").__enter__()
        except LeaseTaken:
            out.append(("second writer", "refused"))
    with WriterLease(store, "two"):
        out.append(("lease given back", "taken"))
    store.max_ops = 1
    try:
        Transaction(store).define("a", fact("z")).define("b", fact("z")).commit()
    except ValueError:
        out.append(("frame too wide", "refused"))
    out += [(f"version {v}", store.world(v).resolve("a").o.text) for v in (1, 2)]
    return _rows(spark, out, "step string, outcome string")


@register("library_counters", "select count(*) as active_slots, count(*) filter (o_orderstatus = 'F') as checked_out, count(*) filter (o_orderstatus = 'P') as holds, count(*) filter (o_orderstatus = 'O') as available, count(*) as located, 2 * count(*) as records from orders")
def library_counters(spark, d):
    """The six counters of a lending library in which each order is a copy: lent, held or available, and shelved at its customer."""
    f = facts(spark, d, "status", "placed_by")
    one = lambda c: F.count(F.when(c, 1))
    status, shelved = F.col("p") == "status", F.col("p") == "placed_by"
    return f.agg(one(status).alias("active_slots"), one(status & (F.col("o.lit") == "F")).alias("checked_out"), one(status & (F.col("o.lit") == "P")).alias("holds"), one(status & (F.col("o.lit") == "O")).alias("available"), one(shelved).alias("located"), F.count("*").alias("records"))


@register("percentiles", "select min(v) filter (c >= 0.5) as median, min(v) filter (c >= 0.95) as p95, min(v) filter (c >= 0.99) as p99, max(v) as most from (select v, cume_dist() over (order by v) as c from (select cast(l_quantity as bigint) as v from lineitem))")
def percentiles(spark, d):
    """Exact percentiles of a measure of few values; partial counts of each value are all that is exchanged."""
    v = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("long").alias("v"))
    return v.agg(*[F.expr(f"percentile_disc({q}) within group (order by v)").cast("long").alias(name) for name, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))], F.max("v").alias("most"))


@register("intent_codec", "select n_nationkey as k, n_name as name from nation")
def intent_codec(spark, d):
    """Intents to text and back, then one epoch."""
    from factspark.streaming.epochs import intent_of, text_of

    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()
    intents = [Intent().expect_absent(f"nation/{r['n_nationkey']}").define(f"nation/{r['n_nationkey']}", Entity(r["n_nationkey"]), Predicate("name"), Literal(r["n_name"])) for r in rows]
    again = [intent_of(json.dumps(json.loads(text_of(i)))) for i in intents]
    store = MemoryStore(spark)
    apply_epoch(store, again)
    return store.world().active.select(F.col("s.ent").cast("int").alias("k"), F.col("o.lit").alias("name"))
