"""Conjunctive patterns as DataFrame joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.functions.atoms import is_constant, predicate, text_key
from factspark.terms import Pattern, Variable


@dataclass(frozen=True)
class Options:
    distinct: bool = True
    provenance: bool = False
    optimize: bool = True
    limit: int | None = None
    strict: bool = False  # a variable that stands for a predicate here and an atom there is an error


def ordered(patterns: list[Pattern]) -> list[int]:
    """The order of joins: the most constants first, then always a pattern that shares a variable, if there is one."""
    left, out, bound = list(range(len(patterns))), [], set()
    while left:
        best = min(left, key=lambda k: (bool(bound) and not bound & set(patterns[k].variables()), -patterns[k].constants() - len(bound & set(patterns[k].variables())), k))
        left.remove(best)
        out.append(best)
        bound |= set(patterns[best].variables())
    return out


def match(facts: DataFrame, pattern: Pattern, k: int, probe: list[str] | None = None) -> DataFrame:
    """The facts of one pattern: a column for each variable, and ``_slot{k}``, ``_rid{k}``.

    With ``probe``, the variables bound before, a fact whose repeated unbound variable disagrees stays, with ``_ok`` false.
    """
    condition, columns, agree = F.lit(True), {}, F.lit(True)
    for term, column, compared in ((pattern.p, predicate(F.col("p")), None), (pattern.s, F.col("s"), F.col("s")), (pattern.o, F.col("o"), F.col("o"))):
        if not isinstance(term, Variable):
            condition = condition & (F.col("p") == term.name if compared is None else is_constant(compared, term))
        elif term.name in columns and probe is not None and term.name not in probe:
            agree = agree & (columns[term.name] == column)
        elif term.name in columns:
            condition = condition & (columns[term.name] == column)
        else:
            columns[term.name] = column
    return facts.where(condition).select(*[c.alias(v) for v, c in columns.items()], F.col("slot").alias(f"_slot{k}"), F.col("rid").alias(f"_rid{k}"), *([] if probe is None else [agree.alias("_ok")]))


def _roles(patterns: list[Pattern]) -> None:
    atoms = {t.name for p in patterns for t in (p.s, p.o) if isinstance(t, Variable)}
    if both := atoms & {p.p.name for p in patterns if isinstance(p.p, Variable)}:
        raise AssertionError(f"{sorted(both)} stand for predicates and for atoms")


def query(facts: DataFrame, patterns: list[Pattern], options: Options = Options()) -> DataFrame:
    """Bindings of (slot, rid, s, p, o): a struct column for each variable, ``provenance`` if asked, ``_row`` if there is no variable.

    The limit applies to matches in order of their records, before duplicates go, and is one at least. Without ``optimize`` patterns are
    joined as they come, which makes limited rows and first provenances exact.
    """
    spark = facts.sparkSession
    if options.strict:
        _roles(patterns)
    if not patterns:
        out = spark.range(1).select(F.lit(True).alias("_row"))
        return out.withColumn("provenance", F.array().cast("array<string>")) if options.provenance else out
    order = ordered(patterns) if options.optimize else list(range(len(patterns)))
    names: list[str] = []
    frame = None
    for k in order:
        new = match(facts, patterns[k], k)
        shared = [v for v in patterns[k].variables() if v in names]
        frame = new if frame is None else frame.join(new, shared) if shared else frame.crossJoin(new)
        names += [v for v in patterns[k].variables() if v not in names]
    rids = [f"_rid{k}" for k in order]
    if options.limit is not None:
        frame = frame.orderBy(*rids).limit(max(1, options.limit))
    if options.distinct:
        if options.provenance:
            first = F.min(F.struct(*[F.struct(r, f"_slot{k}").alias(f"x{k}") for r, k in zip(rids, order, strict=True)])).alias("_first")
            frame = frame.groupBy(*names).agg(first).where("_first is not null")
            frame = frame.select(*names, *[F.col(f"_first.x{k}._slot{k}").alias(f"_slot{k}") for k in order])
        else:
            frame = frame.dropDuplicates(names) if names else frame.limit(1)
    columns = [F.col(v) for v in names] or [F.lit(True).alias("_row")]
    if options.provenance:
        columns.append(F.array(*[f"_slot{k}" for k in order]).alias("provenance"))
    return frame.select(*columns)


def in_order(bindings: DataFrame) -> DataFrame:
    """Rows by variable name: kind, then text; then provenance."""
    names = sorted(c for c in bindings.columns if c not in ("provenance", "_row"))
    keys = [text_key(F.col(v)) for v in names] + (["provenance"] if "provenance" in bindings.columns else [])
    return bindings.orderBy(*keys) if keys else bindings


def metrics(facts: DataFrame, patterns: list[Pattern], optimize: bool = True) -> DataFrame:
    """(position, pattern, candidates, emitted) of each join step, in order: facts that agree with constants and bound variables, for every
    binding before; and bindings made, which a variable repeated in the pattern may make fewer."""
    spark, frame, names, rows = facts.sparkSession, None, [], None
    for step, k in enumerate(ordered(patterns) if optimize else range(len(patterns))):
        pattern = patterns[k]
        new = match(facts, pattern, k, names)
        shared = [v for v in pattern.variables() if v in names]
        frame = new if frame is None else frame.join(new, shared) if shared else frame.crossJoin(new)
        row = frame.agg(F.count("*").alias("candidates"), F.count_if("_ok").alias("emitted"))
        row = row.select(F.lit(step).alias("step"), F.lit(k).alias("position"), F.lit(pattern.key()).alias("pattern"), "candidates", "emitted")
        rows = row if rows is None else rows.unionByName(row)
        frame = frame.where("_ok").drop("_ok")
        names += [v for v in pattern.variables() if v not in names]
    if rows is None:
        return spark.createDataFrame([], "position int, pattern string, candidates long, emitted long")
    return rows.orderBy("step").drop("step")
