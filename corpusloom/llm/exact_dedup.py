"""Exact de-duplication by content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.rows import best_row
from corpusloom.storage import cut

#: The characters that equality ignores.
BLANKS = " \t\n\x0b\f\r"


def hash128(sha256_hex: Column) -> Column:
    """The first 128 bits of a SHA-256 in hexadecimal."""
    return F.substring(sha256_hex, 1, 32)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical without the characters of ``BLANKS``; null counts as
    empty, and all empty texts are equal. Of equal texts the row with the most code points stays,
    then the one with the smallest id (a null id comes last). Of rows that repeat an id and a text
    one is kept. An empty table gives an empty result. Other columns,
    whatever their names, are ignored.

    Rows meet by a 128-bit hash of the text. Only texts whose hash occurs again are shuffled a
    second time, to be compared with the bytes of the row that stays; rows that differ from it in
    spite of an equal hash are grouped again by their text.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.char_length(raw).alias("_n"), F.translate(raw, BLANKS, "").alias("_text"))
    hashed = texts.withColumn("text_sha256", F.sha2("_text", 256)).withColumn("_key", key(F.col("text_sha256")))
    numbered = lambda df: df.withColumn("_row", F.monotonically_increasing_id())  # noqa: E731; fixed once the rows are written
    rows = cut(numbered(hashed.drop("_text")), "rows")
    best = F.min(F.struct((-F.col("_n")).alias("_n"), F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), F.col("_row").alias("row")))
    stays = [F.count("*").alias("group_size"), best["id"].alias("keep_id"), best["row"].alias("_keep_row")]
    groups = cut(rows.groupBy("_key").agg(*stays, best["sha"].alias("_keep_sha")), "groups")
    again = hashed.join(groups.filter("group_size > 1").select("_key", "_keep_sha"), "_key")
    again = cut(again, "again")
    first = again.filter(F.col("text_sha256") == F.col("_keep_sha")).groupBy("_key").agg(F.min("_text").alias("_first"))
    differs = again.join(cut(first, "first"), "_key").filter(F.col("_text") != F.col("_first")).select("doc_id", "_n", "_text", "text_sha256", "_key")
    differs = cut(numbered(differs), "differs")
    groups = groups.drop("_keep_sha")
    decided = rows.join(groups, "_key")
    if not differs.isEmpty():  # two texts with one hash
        other = cut(differs.groupBy("_key", "_text").agg(*stays), "other")
        apart = differs.join(other, ["_key", "_text"]).drop("_text")
        fewer = differs.groupBy("_key").agg(F.count("*").alias("_less"))
        main = rows.join(differs.select("doc_id", "text_sha256", "_key").distinct(), [rows[c].eqNullSafe(differs[c]) for c in ("doc_id", "text_sha256", "_key")], "left_anti")
        main = main.join(groups, "_key").join(fewer, "_key", "left").withColumn("group_size", F.col("group_size") - F.coalesce("_less", F.lit(0))).drop("_less")
        decided = main.unionByName(apart)
    kept = F.col("_row") == F.col("_keep_row")
    return decided.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies: all columns of one row for each text, the row that ``exact_dedup`` keeps.

    Rows are grouped by the hash and, within it, by the bytes of the text itself, whatever their
    ids; copies meet before the shuffle, which each distinct text passes once. Of rows that repeat
    an id and a text one stays.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(raw, BLANKS, "")
    order = [-F.char_length(raw), F.col(id_col).isNull(), F.col(id_col), F.xxhash64(raw)]
    return best_row(docs, {"_key": hash128(F.sha2(bare, 256)), "_text": bare}, order).select("_row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id)
"""
