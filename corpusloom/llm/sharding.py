"""Shards by jump consistent hashing (Lamping and Veach, 2014): no ring table, few moves on growth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.ordering import numbered, rank_within

#: The step of the published generator, and the bits of a key.
STEP, KEY_DIGITS = 2862933555777941757, 15


def stable_key(col: Column) -> Column:
    """60 bits of the MD5 of a value as text; a null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, KEY_DIGITS), 16, 10).cast("long")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; from n to n + 1 shards a key stays or moves to shard n."""
    key, at, nxt = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = nxt[live]
        key[live] = key[live] * np.uint64(STEP) + np.uint64(1)
        nxt[live] = ((at[live] + 1) * (2147483648.0 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return shard(key)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The id and the number of shards alone decide the shard, so equal texts may part and rows that
    repeat an id meet. ``slot`` numbers a shard's rows from 0. A null text counts as empty, a null
    id as the empty text; an empty table gives an empty result; other columns are ignored.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), stable_key(F.col(id_col)).alias("_key"))
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), jump_shard(F.col("_key"), shards).alias("shard"), jump_shard(F.col("_key"), shards + 1).alias("grown_shard"))
    return rank_within(numbered(rows, "rows"), ["shard"], ["doc_id", "text_crc32"], "slot", number="_number")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
