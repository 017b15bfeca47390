"""Committed worlds: an op log up to a version, and what can be read of it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from factspark.functions.atoms import ATOM, rendered, row_of, value_of
from factspark.operators import stack
from factspark.plans.patterns import Options, in_order, match, metrics, query
from factspark.terms import Entity, Fact, Literal, Pattern, Predicate, Symbol, Variable

LOG = f"version long, rid long, kind string, slot string, s {ATOM}, p string, o {ATOM}"
DISPLAY, RESOLVES = Predicate("display_name"), Predicate("resolves_to")


@cache
def _kind(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def table(rows: list[tuple], schema: str | StructType) -> pa.Table:
    kind = schema if isinstance(schema, StructType) else _kind(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return pa.table([pa.array([dict(zip(f.dataType.names, x, strict=True)) if isinstance(f.dataType, StructType) and x is not None else x for x in c], to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)], kind.names)


def local(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """Rows of the driver as a local relation, which needs no job to read."""
    kind = schema if isinstance(schema, StructType) else _kind(schema)
    return spark.createDataFrame(table(rows, kind), kind).coalesce(1)  # one task, and what is done with it needs no exchange


def op_row(version: int, rid: int, kind: str, slot: str, fact: Fact | None) -> tuple:
    return version, rid, kind, slot, row_of(fact.s) if fact else None, fact.p.name if fact else None, row_of(fact.o) if fact else None


class World:
    """An immutable version; its DataFrames are those of the log up to it. Where ``resumed`` is given (a checkpoint's stacks and newer ops),
    heads and stacks come from it, and only histories and counts of records from the log."""

    def __init__(self, spark: SparkSession, log: DataFrame, version: int, digest: str, next_entity: int, resumed: DataFrame | None = None, small: bool = False):
        self.small = small  # the log is the driver's own, so its heads may be held there as well
        self.spark, self.version, self.digest, self.next_entity = spark, version, digest, next_entity
        self.log = log.where(F.col("version") <= version)
        self.short = self.log if resumed is None else resumed
        self._active: DataFrame | None = None

    @property
    def active(self) -> DataFrame:
        if self._active is None:
            self._active = stack.active(self.short).select("slot", "rid", "s", "p", "o")
            if self.small:
                self._active = local(self.spark, [tuple(r) for r in self._active.collect()], self._active.schema)
        return self._active

    def query(self, patterns: list[Pattern], options: Options = Options()) -> DataFrame:
        return in_order(query(self.active, [p for p in patterns], options))

    def bindings(self, patterns: list[Pattern], **options) -> list[dict]:
        """Rows as Python values, for small results."""
        rows = self.query(patterns, Options(**options)).collect()
        return [{k: (list(v) if k == "provenance" else value_of(v)) for k, v in r.asDict(recursive=False).items() if k != "_row"} for r in rows]

    def resolve(self, slot: str) -> Fact | None:
        r = (self.active.where(F.col("slot") == slot) if self.small else stack.active(self.short.where(F.col("slot") == slot))).first()
        return None if r is None else Fact(value_of(r["s"]), Predicate(r["p"]), value_of(r["o"]))

    def definitions(self, slot: str) -> list[Fact]:
        rows = stack.visible(self.short.where(F.col("slot") == slot)).orderBy(F.desc("depth")).collect()
        return [Fact(value_of(r["s"]), Predicate(r["p"]), value_of(r["o"])) for r in rows]

    def history(self, slot: str) -> DataFrame:
        return stack.history(self.log.where(F.col("slot") == slot)).orderBy("rid")

    def display_name(self, entity: Entity) -> str:
        fact = self.resolve(f"display/{entity.id}")
        return fact.o.text if fact is not None and isinstance(fact.o, Literal) else str(entity)

    def resolve_symbol(self, namespace: str, symbol: str) -> Entity:
        fact = self.resolve(f"namespace/{namespace}/{symbol}")
        if fact is None or not isinstance(fact.o, Entity):
            raise KeyError(f"{namespace}:{symbol}")
        return fact.o

    def compile(self, namespace: str, s, p, o) -> Pattern:
        """A pattern whose symbols are entities as of this world; it stays so when names change."""

        def fixed(t):
            return self.resolve_symbol(namespace, t.name) if isinstance(t, Symbol) else t

        return Pattern(fixed(s), p if isinstance(p, (Predicate, Variable)) else Predicate(p), fixed(o))

    def names(self) -> DataFrame:
        """(ent, name) of all entities with a literal display name."""
        shown = self.active.where((F.col("p") == DISPLAY.name) & F.col("slot").startswith("display/") & (F.col("o.tag") == 1))
        return shown.select(F.substring(F.col("slot"), 9, 40).cast("long").alias("ent"), F.col("o.lit").alias("name"))

    def render(self, bindings: DataFrame) -> DataFrame:
        """Each binding as text; one left join for each variable."""
        out = bindings
        for v in [c for c in bindings.columns if c not in ("provenance", "_row")]:
            names = self.names().select(F.col("ent").alias("_ent"), F.col("name").alias("_name"))
            out = out.join(names, out[v]["ent"] == F.col("_ent"), "left").withColumn(v, rendered(F.col(v), F.col("_name"))).drop("_ent", "_name")
        return out

    def count(self, pattern: Pattern) -> int:
        """The active facts that a pattern matches."""
        return match(self.active, pattern, 0).count()

    def slots(self, pattern: Pattern) -> DataFrame:
        """The slots whose head a pattern matches, in order."""
        return match(self.active, pattern, 0).select(F.col("_slot0").alias("slot")).orderBy("slot")

    def explain(self, patterns: list[Pattern], options: Options = Options()) -> dict:
        """The order of joins up to the first step without bindings, candidates and bindings of each pattern, and the number of rows."""
        steps = metrics(self.active, patterns, options.optimize).collect()  # a row for each pattern
        path = []
        for r in steps:
            path.append(r["pattern"])
            if not r["emitted"]:
                break
        return {
            "first_path": path,
            "candidate_facts": sum(r["candidates"] for r in steps),
            "bindings_emitted": sum(r["emitted"] for r in steps),
            "candidates_by_pattern": {(r["position"], r["pattern"]): r["candidates"] for r in steps},
            "emitted_by_pattern": {(r["position"], r["pattern"]): r["emitted"] for r in steps},
            "rows": query(self.active, patterns, options).count(),
        }

    def signature(self) -> tuple[int, int]:
        """(number, combined hash) of the active records, whatever their order; equal worlds have equal ones."""
        r = self.active.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("slot", "rid", "s", "p", "o")).alias("x")).first()
        return r["n"], r["x"] or 0

    def audit(self) -> DataFrame:
        """(slot, head, expected) where the active head isn't the one that the slot's last record left; empty in a sound world."""
        last = stack.history(self.log).groupBy("slot").agg(F.max_by("resulting_head", "rid").alias("expected")).where("expected is not null")
        heads = self.active.select("slot", F.col("rid").alias("head"))
        return heads.join(last, "slot", "full").where(~F.col("head").eqNullSafe(F.col("expected")))

    def counts(self) -> dict[str, int]:
        return {"active_slots": self.active.count(), "records": self.log.where("kind <> 'allocate'").count()}


Validator = Callable[[World], None]
