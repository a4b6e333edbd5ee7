"""Ranks and neighbours that no single task has to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.storage import cut

SLICES = 256


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str, slices: int = SLICES, number: str | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2 … without gaps within each combination of ``keys``.

    A key may hold most rows: it is dealt into ``slices`` by a hash of ``order``, each slice is
    numbered on its own and starts where the slices before it end. Only the counts (keys x
    slices rows) meet per key. Rows that tie in all of ``order`` get their numbers in any order.
    Where such rows may be many, ``number`` names a column that differs between them and stays what
    it is (``numbered``); it is dropped.
    """
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*order, *([number] if number else [])), F.lit(slices)).cast("int")).drop(*([number] if number else []))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    starts = cut(starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "starts")
    same = [dealt[k].eqNullSafe(starts[k]) for k in [*keys, "_slice"]]
    joined = dealt.join(starts, same, "inner").select(*(dealt[c] for c in dealt.columns), starts["_start"])
    own = W.partitionBy(*keys, "_slice").orderBy(*order)
    return joined.withColumn(out, F.col("_start") + F.row_number().over(own) - 1).drop("_slice", "_start")


def numbered(df: DataFrame, name: str, number: str = "_number") -> DataFrame:
    """``df`` written, with a number for each row that is fixed by that."""
    return cut(df.withColumn(number, F.monotonically_increasing_id()), name)


def rank_all(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the place 0, 1, 2 … of each row in one global order; the result is a written table.

    Range partitioning deals the rows, the sizes of the parts (one row each) give their starts.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per part, not per row
    starts = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = parts.join(starts, F.col("_part") == F.col("_p"))
    own = W.partitionBy("_part").orderBy(*order)
    return cut(ranked.withColumn(out, F.col("_start") + F.row_number().over(own) - 1).drop("_part", "_p", "_start"), "ranked")
