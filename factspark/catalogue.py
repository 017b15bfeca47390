"""Fact queries over the driver's star schema, and the same in SQL.

Entity ids are kind * 2**40 + key. Facts are projections of the tables, so a query over a relation prunes all other branches and columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factspark.functions.atoms import entity, literal, relation_slot, rendered
from factspark.operators import stack
from factspark.plans.patterns import Options, metrics, query
from factspark.terms import Entity, Literal, Pattern, Predicate, Variable

KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "user": 7, "event": 8}
SPAN = 1 << 40

#: relation: (table, kind and key of the subject, object: a kind and its key, or a text column)
RELATIONS: dict[str, tuple[str, str, str, str | None, str]] = {
    "region_name": ("region", "region", "r_regionkey", None, "r_name"),
    "nation_name": ("nation", "nation", "n_nationkey", None, "n_name"),
    "in_region": ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
    "in_nation": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "segment": ("customer", "customer", "c_custkey", None, "c_mktsegment"),
    "based_in": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    "placed_by": ("orders", "order", "o_orderkey", "customer", "o_custkey"),
    "status": ("orders", "order", "o_orderkey", None, "o_orderstatus"),
    "brand": ("part", "part", "p_partkey", None, "p_brand"),
}


def ident(kind: str, key: Column | int) -> Column | int:
    return KINDS[kind] * SPAN + key if isinstance(key, int) else F.lit(KINDS[kind] * SPAN) + key.cast("long")


def key_of(name: str) -> Column:
    return F.pmod(F.col(name)["ent"], F.lit(SPAN))


def facts(spark: SparkSession, sf_dir: str, *relations: str) -> DataFrame:
    """(slot, rid, s, p, o) of the named relations, or all."""
    parts = []
    for n, (name, (table, kind, key, target, value)) in enumerate(RELATIONS.items()):
        if relations and name not in relations:
            continue
        s, o = ident(kind, F.col(key)), F.col(value)
        parts.append(
            spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
                relation_slot(s, F.lit(name), F.lit("current")).alias("slot"), (F.lit((n + 1) * SPAN) + F.col(key).cast("long")).alias("rid"), entity(s).alias("s"), F.lit(name).alias("p"), (entity(ident(target, o)) if target else literal(o)).alias("o")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part supplied_by supplier, asserted once for each line item."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rid = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    slot = F.concat_ws("/", "l_orderkey", "l_linenumber", F.lit("supplied_by"))
    return line.select(slot.alias("slot"), rid.alias("rid"), entity(ident("part", F.col("l_partkey"))).alias("s"), F.lit("supplied_by").alias("p"), entity(ident("supplier", F.col("l_suppkey"))).alias("o"))


def event_log(spark: SparkSession, sf_dir: str, up_to: str = "true") -> DataFrame:
    """Ops of a slot for each user: an ``error`` forgets, any other event defines."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(up_to)
    kind = F.when(F.col("event_type") == "error", "forget").otherwise("define")
    defined = F.col("event_type") != "error"
    return e.select(F.col("event_id").alias("rid"), kind.alias("kind"), F.concat(F.lit("user/"), F.col("user_id")).alias("slot"), F.when(defined, entity(ident("user", F.col("user_id")))).alias("s"), F.when(defined, F.lit("did")).alias("p"), F.when(defined, entity(ident("event", F.col("event_id")))).alias("o"))


V, P = Variable, Predicate
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


def _user() -> Column:
    return F.substring(F.col("slot"), 6, 30).cast("long").alias("user_id")


@register("scan_all_active", "select n_nationkey as k, 'nation_name' as p, n_name as v from nation union all select r_regionkey, 'region_name', r_name from region union all select n_nationkey, 'in_region', cast(n_regionkey as varchar) from nation")
def scan_all_active(spark, d):
    f = facts(spark, d, "nation_name", "region_name", "in_region")
    return f.select(key_of("s").cast("int").alias("k"), "p", F.coalesce(F.col("o.lit"), key_of("o").cast("string")).alias("v"))


@register("pattern_s", "select 'segment' as p, c_mktsegment as v from customer where c_custkey = 7 union all select 'in_nation', cast(c_nationkey as varchar) from customer where c_custkey = 7")
def pattern_s(spark, d):
    out = query(facts(spark, d, "segment", "in_nation"), [Pattern(Entity(ident("customer", 7)), V("p"), V("o"))])
    return out.select(F.col("p.lit").alias("p"), F.coalesce(F.col("o.lit"), key_of("o").cast("string")).alias("v"))


@register("predicate_variable", "select 'in_region' as p, count(*) as n from nation union all select 'nation_name', count(*) from nation")
def predicate_variable(spark, d):
    """How often each predicate stands, by a variable in its place."""
    return query(facts(spark, d, "in_region", "nation_name"), [Pattern(V("s"), V("p"), V("o"))]).groupBy(F.col("p.lit").alias("p")).agg(F.count("*").alias("n"))


@register("pattern_p", "select c_custkey as c, cast(c_nationkey as bigint) as n from customer")
def pattern_p(spark, d):
    return query(facts(spark, d), [Pattern(V("c"), P("in_nation"), V("n"))]).select(key_of("c").alias("c"), key_of("n").alias("n"))


@register("pattern_o", "select 'in_nation' as p, c_custkey as k from customer where c_nationkey = 3 union all select 'based_in', s_suppkey from supplier where s_nationkey = 3")
def pattern_o(spark, d):
    out = query(facts(spark, d, "in_nation", "based_in"), [Pattern(V("x"), V("p"), Entity(ident("nation", 3)))])
    return out.select(F.col("p.lit").alias("p"), key_of("x").alias("k"))


@register("pattern_sp", "select o_custkey as c from orders where o_orderkey = 5")
def pattern_sp(spark, d):
    return query(facts(spark, d), [Pattern(Entity(ident("order", 5)), P("placed_by"), V("c"))]).select(key_of("c").alias("c"))


@register("pattern_so", "select 'segment' as p from customer where c_custkey = 7 and c_mktsegment = 'BUILDING'")
def pattern_so(spark, d):
    return query(facts(spark, d, "segment", "in_nation"), [Pattern(Entity(ident("customer", 7)), V("p"), Literal("BUILDING"))]).select(F.col("p.lit").alias("p"))


@register("pattern_po", "select c_custkey as c from customer where c_mktsegment = 'BUILDING'")
def pattern_po(spark, d):
    return query(facts(spark, d), [Pattern(V("c"), P("segment"), Literal("BUILDING"))]).select(key_of("c").alias("c"))


@register("pattern_spo", "select true as found from customer where c_custkey = 7 and c_nationkey = (select c_nationkey from customer where c_custkey = 7)")
def pattern_spo(spark, d):
    n = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey = 7").first()["c_nationkey"]
    return query(facts(spark, d), [Pattern(Entity(ident("customer", 7)), P("in_nation"), Entity(ident("nation", n)))]).select(F.col("_row").alias("found"))


@register("repeated_variable", "select n_nationkey as k from nation where n_nationkey = n_regionkey")
def repeated_variable(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    f = n.select(F.col("n_name").alias("slot"), F.col("n_nationkey").cast("long").alias("rid"), entity(F.col("n_nationkey")).alias("s"), F.lit("same").alias("p"), entity(F.col("n_regionkey")).alias("o"))
    return query(f, [Pattern(V("x"), P("same"), V("x"))]).select(F.col("x.ent").cast("int").alias("k"))


_TWO = [Pattern(V("o"), P("placed_by"), V("c")), Pattern(V("c"), P("in_nation"), V("n"))]


@register("two_hop_join", "select o_orderkey as o, c_custkey as c, cast(c_nationkey as bigint) as n from orders join customer on o_custkey = c_custkey")
def two_hop_join(spark, d):
    return query(facts(spark, d), _TWO).select(key_of("o").alias("o"), key_of("c").alias("c"), key_of("n").alias("n"))


@register("three_hop_join", "select o_orderkey as o, n_name as nation, r_name as region from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def three_hop_join(spark, d):
    """Orders to regions, with nations and regions rendered by name."""
    found = query(facts(spark, d), [*_TWO, Pattern(V("n"), P("in_region"), V("r")), Pattern(V("n"), P("nation_name"), V("nation")), Pattern(V("r"), P("region_name"), V("region"))])
    return found.select(key_of("o").alias("o"), rendered(F.col("nation"), F.lit(None)).alias("nation"), rendered(F.col("region"), F.lit(None)).alias("region"))


@register("star_join", "select o_orderkey as o, c_mktsegment as segment, cast(c_nationkey as bigint) as n from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'")
def star_join(spark, d):
    ps = [Pattern(V("o"), P("status"), Literal("F")), Pattern(V("o"), P("placed_by"), V("c")), Pattern(V("c"), P("segment"), V("g")), Pattern(V("c"), P("in_nation"), V("n"))]
    return query(facts(spark, d), ps, Options(distinct=False)).select(key_of("o").alias("o"), F.col("g.lit").alias("segment"), key_of("n").alias("n"))


@register("multi_var_join", "select distinct l_partkey as p, l_suppkey as s from lineitem where l_partkey = l_suppkey")
def multi_var_join(spark, d):
    same = supplied(spark, d).select("slot", "rid", "s", F.lit("also").alias("p"), "o").where("s.ent % 1099511627776 = o.ent % 1099511627776")
    f = supplied(spark, d).unionByName(same)
    return query(f, [Pattern(V("p"), P("supplied_by"), V("s")), Pattern(V("p"), P("also"), V("s"))]).select(key_of("p").alias("p"), key_of("s").alias("s"))


@register("self_join", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey")
def self_join(spark, d):
    return query(facts(spark, d), [Pattern(V("a"), P("in_region"), V("r")), Pattern(V("b"), P("in_region"), V("r"))]).select(key_of("a").cast("int").alias("a"), key_of("b").cast("int").alias("b"))


@register("cartesian_join", "select n_name as n, r_name as r from nation, region")
def cartesian_join(spark, d):
    return query(facts(spark, d), [Pattern(V("a"), P("nation_name"), V("n")), Pattern(V("b"), P("region_name"), V("r"))]).select(F.col("n.lit").alias("n"), F.col("r.lit").alias("r"))


@register("distinct_bindings", "select distinct l_partkey as p, l_suppkey as s from lineitem")
def distinct_bindings(spark, d):
    return query(supplied(spark, d), [Pattern(V("p"), P("supplied_by"), V("s"))]).select(key_of("p").alias("p"), key_of("s").alias("s"))


@register("duplicate_provenance", "select l_partkey as p, l_suppkey as s, concat(l_orderkey, '/', l_linenumber, '/supplied_by') as slot from lineitem")
def duplicate_provenance(spark, d):
    out = query(supplied(spark, d), [Pattern(V("p"), P("supplied_by"), V("s"))], Options(distinct=False, provenance=True))
    return out.select(key_of("p").alias("p"), key_of("s").alias("s"), F.col("provenance")[0].alias("slot"))


@register("distinct_first_provenance", "select l_partkey as p, l_suppkey as s, concat(l_orderkey, '/', l_linenumber, '/supplied_by') as slot from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey * 16 + l_linenumber) as n from lineitem) where n = 1")
def distinct_first_provenance(spark, d):
    out = query(supplied(spark, d), [Pattern(V("p"), P("supplied_by"), V("s"))], Options(provenance=True))
    return out.select(key_of("p").alias("p"), key_of("s").alias("s"), F.col("provenance")[0].alias("slot"))


@register("limit_before_distinct", "select distinct s from (select l_suppkey as s from lineitem order by l_orderkey * 16 + l_linenumber limit 500)")
def limit_before_distinct(spark, d):
    f = supplied(spark, d).withColumn("s", literal(F.lit("all")))
    return query(f, [Pattern(Literal("all"), P("supplied_by"), V("s"))], Options(limit=500)).select(key_of("s").alias("s"))


_STACK = """with recursive o as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) rn from events where {where}),
st(user_id, rn, stack) as (select distinct user_id, cast(0 as bigint), cast([] as bigint[]) from o union all
select o.user_id, o.rn, case when o.event_type = 'error' then case when len(stack) = 0 then stack else stack[1:len(stack)-1] end else list_append(stack, o.event_id) end
from st join o on o.user_id = st.user_id and o.rn = st.rn + 1)"""
_LAST = "rn = (select max(rn) from o where o.user_id = st.user_id) and len(stack) > 0"
_HALF = "event_id < (select max(event_id) / 2 from events)"


@register("active_heads", _STACK.format(where="true") + f" select user_id, stack[len(stack)] as head, cast(len(stack) as bigint) as depth from st where {_LAST}")
def active_heads(spark, d):
    return stack.active(event_log(spark, d)).select(_user(), F.col("rid").alias("head"), F.col("depth").cast("long").alias("depth"))


@register("definitions_stack", _STACK.format(where="true") + f" select user_id, unnest(stack) as event_id, unnest(range(1, len(stack) + 1)) as depth from st where {_LAST}")
def definitions_stack(spark, d):
    return stack.visible(event_log(spark, d)).select(_user(), F.col("rid").alias("event_id"), F.col("depth").cast("long").alias("depth"))


@register("slot_history", "select user_id, event_id, case when event_type = 'error' then 'forget' else 'define' end as kind, row_number() over (partition by user_id order by event_id) as place from events")
def slot_history(spark, d):
    place = F.row_number().over(Window.partitionBy("slot").orderBy("rid")).cast("long")
    return stack.history(event_log(spark, d)).select(_user(), F.col("rid").alias("event_id"), "kind", place.alias("place"))


@register("resulting_heads", _STACK.format(where="true") + ", r as (select user_id, rn, case when len(stack) > 0 then stack[len(stack)] end as head from st) select o.user_id, o.event_id, a.head as resulting_head, b.head as previous_head from o join r a on a.user_id = o.user_id and a.rn = o.rn join r b on b.user_id = o.user_id and b.rn = o.rn - 1")
def resulting_heads(spark, d):
    return stack.history(event_log(spark, d)).select(_user(), F.col("rid").alias("event_id"), "resulting_head", "previous_head")


def _half(spark, d) -> str:
    top = spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0]
    return f"event_id < {top / 2}"


@register("time_travel", _STACK.format(where=_HALF) + f" select user_id, stack[len(stack)] as head from st where {_LAST}")
def time_travel(spark, d):
    return stack.active(event_log(spark, d, _half(spark, d))).select(_user(), F.col("rid").alias("head"))


@register("checkpoint_plus_tail", ORACLE["active_heads"])
def checkpoint_plus_tail(spark, d):
    """Heads from the visible stack at half time and the newer records."""
    half = _half(spark, d)
    log = stack.resume(stack.visible(event_log(spark, d, half)), event_log(spark, d, f"not ({half})"))
    return stack.active(log).select(_user(), F.col("rid").alias("head"), F.col("depth").cast("long").alias("depth"))


@register("active_slot_count", f"select count(*) as n from ({ORACLE['active_heads']})")
def active_slot_count(spark, d):
    return stack.active(event_log(spark, d)).agg(F.count("*").alias("n"))


@register("record_count", "select count(*) as n from events")
def record_count(spark, d):
    return event_log(spark, d).where("kind <> 'allocate'").agg(F.count("*").alias("n"))


@register("display_render", "select c_custkey as c, n_name as nation from customer join nation on c_nationkey = n_nationkey")
def display_render(spark, d):
    f = facts(spark, d, "in_nation", "nation_name")
    names = f.where("p = 'nation_name'").select(F.col("s.ent").alias("ent"), F.col("o.lit").alias("name"))
    out = query(f, [Pattern(V("c"), P("in_nation"), V("n"))])
    return out.join(names, out["n"]["ent"] == names["ent"], "left").select(key_of("c").alias("c"), rendered(F.col("n"), F.col("name")).alias("nation"))


@register("symbol_compile", "select n_nationkey as n from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")
def symbol_compile(spark, d):
    """The name becomes an entity before the plan is made, and stays that entity."""
    row = facts(spark, d, "region_name").where("o.lit = 'EUROPE'").select("s.ent").first()
    return query(facts(spark, d), [Pattern(V("n"), P("in_region"), Entity(row["ent"] if row else 0))]).select(key_of("n").cast("int").alias("n"))


@register("drift", "with v as (select user_id, max(event_id) as id from events where event_type = 'view' group by 1), c as (select user_id, max(event_id) as id from events where event_type = 'click' group by 1) select user_id, v.id as desired, c.id as observed from v join c using (user_id) where v.id <> c.id")
def drift(spark, d):
    """Desired and observed claims that differ: the heads of two slots for each user."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type in ('view', 'click')")
    slot = F.concat_ws("/", "user_id", F.when(F.col("event_type") == "view", "desired").otherwise("observed"))
    log = e.select(F.col("event_id").alias("rid"), F.lit("define").alias("kind"), slot.alias("slot"), entity(F.col("user_id")).alias("s"), F.when(F.col("event_type") == "view", "desired").otherwise("observed").alias("p"), entity(F.col("event_id")).alias("o"))
    out = query(stack.active(log), [Pattern(V("u"), P("desired"), V("a")), Pattern(V("u"), P("observed"), V("b"))])
    return out.where("a <> b").select(F.col("u.ent").alias("user_id"), F.col("a.ent").alias("desired"), F.col("b.ent").alias("observed"))


@register("missing_requirement", "select distinct l_suppkey as s, n_nationkey as n from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where not exists (select 1 from customer where c_nationkey = s_nationkey and c_mktsegment = 'BUILDING' and c_acctbal > 5000)")
def missing_requirement(spark, d):
    """Suppliers in use whose nation has no customer of a kind: an anti-join on what is required."""
    rich = spark.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'BUILDING' and c_acctbal > 5000").select(F.col("c_nationkey").cast("long").alias("k")).distinct()
    f = facts(spark, d, "based_in").unionByName(supplied(spark, d))
    out = query(f, [Pattern(V("p"), P("supplied_by"), V("s")), Pattern(V("s"), P("based_in"), V("n"))])
    return out.select(key_of("s").alias("s"), key_of("n").alias("k")).distinct().join(rich, "k", "left_anti").select("s", F.col("k").cast("int").alias("n"))


@register("application_projection", "select count(*) as orders, count(*) filter (o_orderstatus = 'F') as finished, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderstatus not in ('F', 'O')) as other from orders")
def application_projection(spark, d):
    f = facts(spark, d, "status")
    one = lambda c: F.count(F.when(c, 1))
    return f.agg(F.count("*").alias("orders"), one(F.col("o.lit") == "F").alias("finished"), one(F.col("o.lit") == "O").alias("open"), one(~F.col("o.lit").isin("F", "O")).alias("other"))


@register("explain_metrics", "select cast(position as integer) as position, emitted from (select 0 as position, (select count(*) from orders) as emitted union all select 1, (select count(*) from orders join customer on o_custkey = c_custkey))")
def explain_metrics(spark, d):
    return metrics(facts(spark, d), _TWO).select("position", "emitted")
