"""Columns for atoms, names of slots and rendered values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factspark.terms import Entity, Literal, Predicate

ENTITY, LITERAL, PREDICATE = 0, 1, 2
ATOM = "struct<tag:tinyint,ent:bigint,lit:string>"


def _atom(tag: int, ent: Column, lit: Column) -> Column:
    return F.struct(F.lit(tag).cast("tinyint").alias("tag"), ent.cast("bigint").alias("ent"), lit.cast("string").alias("lit"))


def entity(ent: Column) -> Column:
    return _atom(ENTITY, ent, F.lit(None))


def literal(text: Column) -> Column:
    return _atom(LITERAL, F.lit(None), text)


def predicate(name: Column) -> Column:
    return _atom(PREDICATE, F.lit(None), name)


def is_constant(column: Column, term: Entity | Literal | Predicate) -> Column:
    """A filter on the leaves, which Parquet scans can push down."""
    if isinstance(term, Entity):
        return (column["tag"] == ENTITY) & (column["ent"] == term.id)
    return (column["tag"] == (LITERAL if isinstance(term, Literal) else PREDICATE)) & (column["lit"] == str(term))


def row_of(term: Entity | Literal) -> tuple:
    return (ENTITY, term.id, None) if isinstance(term, Entity) else (LITERAL, None, term.text)


def value_of(row: tuple) -> Entity | Literal | Predicate:
    """From a row of Spark, or a plain (tag, ent, lit)."""
    return Entity(row[1]) if row[0] == ENTITY else (Literal if row[0] == LITERAL else Predicate)(row[2])


def text_key(column: Column) -> Column:
    """The order of bindings: by kind, then by text, so that entities come as 1, 10, 2."""
    return F.struct(column["tag"], F.coalesce(column["ent"].cast("string"), column["lit"]))


def record_name(rid: Column) -> Column:
    return F.concat(F.lit("Record_"), rid.cast("string"))


def display_slot(ent: Column) -> Column:
    return F.concat(F.lit("display/"), ent.cast("string"))


def symbol_slot(namespace: Column, symbol: Column) -> Column:
    return F.concat_ws("/", F.lit("namespace"), namespace, symbol)


def relation_slot(owner: Column, relation: Column, suffix: Column) -> Column:
    return F.concat_ws("/", owner.cast("string"), relation, suffix)


def rendered(column: Column, name: Column) -> Column:
    """An entity by its display name or ``Entity_n``, anything else by its text."""
    return F.when(column["tag"] == ENTITY, F.coalesce(name, F.concat(F.lit("Entity_"), column["ent"].cast("string")))).otherwise(column["lit"])
