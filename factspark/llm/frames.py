"""How the operators read a table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.session import ship

#: Stands for a null id inside an operator.
NO_ID = -(1 << 63)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, text) alone, so that other columns can't clash: a null text is empty, a null id the least id.

    With ``carry`` a struct ``rest`` holds the other columns and the id as they were.
    """
    ship(df.sparkSession)
    rest = [F.struct(*[df[c] for c in df.columns if c != text_col]).alias("rest")] if carry else []
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *rest)


def public_id(name: str = "id") -> Column:
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name))
