"""Bottom-k sketches of shingle hashes (Broder, 1997), in DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.ordering import rank_all
from corpusloom.llm.rows import row_key
from corpusloom.storage import cut

K, WORDS = 128, 5
SPACE = " \t\n\x0b\f\r"


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, n: int = WORDS) -> DataFrame:
    """Add ``out``: the ``k`` smallest distinct hashes of the shingles of ``n`` words, ascending.

    Words are what white space parts, in lower case. A text of fewer words is one shingle; a null
    text or one without words has an empty sketch. The word hashes are a column of their own, so
    that each is computed once.
    """
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(SPACE))
    words = df.withColumn("_words", F.split(trimmed, r"\s+"))
    hashed = words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_blank", F.col("_words")[0] == "").drop("_words")
    h = F.col("_hashes")
    shingles = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(h[i + j] for j in range(n))))
    short = F.when(F.col("_blank"), F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    smallest = F.slice(F.array_sort(F.array_distinct(F.when(F.size(h) >= n, shingles).otherwise(short))), 1, k)
    return hashed.withColumn(out, smallest).drop("_hashes", "_blank")


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together; parts that are complete (below ``k``) merge without loss."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated Jaccard likeness, exact where both sketches are complete; two empty ones are alike."""
    both = F.size(F.array_intersect(F.array_intersect(union_sketch(a, b, k), a), b))
    exact = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    complete = (F.size(a) < k) & (F.size(b) < k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(complete, exact).otherwise(both / F.size(union_sketch(a, b, k)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: the k-th smallest hash tells how dense they lie."""
    share = (F.element_at(sketch, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of ``a``'s shingles that ``b`` has too."""
    shared = resemblance(a, b, k) * distinct_shingles(union_sketch(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_sketches(df: DataFrame, key: str, sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per ``key``: that of all its rows' shingles together.

    Salted groups are cut to ``k`` hashes before the group as a whole is, so a key may hold most rows.
    """
    hashes = df.select(key, F.explode(sketch_col).alias("_h")).withColumn("_salt", F.pmod(F.hash("_h"), F.lit(salts))).distinct()
    part = hashes.withColumn("_r", F.row_number().over(W.partitionBy(key, "_salt").orderBy("_h"))).filter(F.col("_r") <= k)
    return part.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("_h")), 1, k).alias(sketch_col))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``, ``distinct_shingles``.

    The edited text ends in the beginning of the next document, by ascending id (null first; the
    first document follows the last), for a fourth of its code points. A null text is empty; a next
    document that is shorter gives all it has; rows that repeat an id and a text count as one in
    that order and come back as often as they are; an empty table gives an empty result; other
    columns are ignored.

    Lengths and places are settled on narrow rows. The texts are shuffled once, by a key of their
    own; each document then sends the few characters that its predecessor needs, and its sketch.
    """
    texts = docs.select(row_key(id_col, text_col).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("_k"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))
    rows = rows.groupBy("_k").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("*").cast("int").alias("_times"))
    placed = rank_all(rows, [F.col("doc_id"), F.col("_k")], "_rank")
    n = placed.count()
    ahead = placed.select(F.pmod(F.col("_rank") + 1, F.lit(max(n, 1))).alias("_rank"), F.col("_k").alias("_to"), F.floor(F.col("n_chars") / 4).cast("int").alias("_wants"))
    known = cut(placed.join(ahead, "_rank").drop("_rank"), "neighbours")
    once = texts.groupBy("_k").agg(F.first("_text").alias("_text")).join(known, "_k")  # repeated rows meet before the shuffle
    sketched = with_sketch(once, "_text", "_own", k)
    sent = sketched.select(F.col("_to").alias("_k"), F.expr("left(_text, _wants)").alias("_start"), F.col("_own").alias("_next"))
    kept = F.expr("left(_text, cast(n_chars - floor(n_chars / 4) as int))")
    both = sketched.join(sent, "_k").withColumn("_edited", F.concat(kept, F.col("_start"))).drop("_text", "_start")
    both = with_sketch(both, "_edited", "_after", k)
    one, two, nxt = F.col("_own"), F.col("_after"), F.col("_next")
    return both.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text(one).alias("fingerprint"), as_text(two).alias("edited_fingerprint"),
        resemblance(one, two, k).alias("near_edited"), resemblance(one, nxt, k).alias("near_next"), distinct_shingles(one, k).alias("distinct_shingles"),
        F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_time"),
    ).drop("_time")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
