"""Whole rows fetched by decisions that were made on narrow ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for an id with its text, either of which may be null."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.concat(F.lit("t"), F.col(text_col)), F.lit("n"))]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def best_row(df: DataFrame, keys: dict[str, Column], order: list[Column]) -> DataFrame:
    """One row of ``df`` for each combination of ``keys``: the first by ``order``; the keys and ``_row``.

    An aggregate, so repeated rows meet before the shuffle and each whole row is shuffled once. Rows
    that tie in all of ``order`` go by a hash of their columns.
    """
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind and "void" not in kind]
    made = df.select(*(c.alias(k) for k, c in keys.items()), F.struct(*order, F.xxhash64(*(F.col(f"`{c}`") for c in plain))).alias("_order"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    return made.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row"))


def fetch_rows(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in ``wanted`` (``_key``, ``_times``), each as often as it says.

    Rows that repeat an id and a text are one row here. Both sides meet by the key that the rows
    were grouped by, so whole rows are shuffled once.
    """
    held = best_row(df, {"_key": row_key(id_col, text_col)}, [])
    times = F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int"))).alias("_time")
    return held.join(wanted.select("_key", "_times"), "_key").select("_row", times).select("_row.*")
