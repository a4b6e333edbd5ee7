"""Chunks of documents with their pages and sections, and vectors of their words (CHK-*, EMB-*)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Features whose hash a task keeps: some 40 MB.
KNOWN = 200_000
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")


def _spans(text: str, lo: int, hi: int, size: int, level: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``size`` between separators; a separator stays at the head of what follows it."""
    if hi - lo <= size:
        yield lo, hi
        return
    while level < len(SEPARATORS) and text.find(SEPARATORS[level], lo, hi) < 0:
        level += 1
    if level == len(SEPARATORS):
        for at in range(lo, hi, size):
            yield at, min(hi, at + size)
        return
    mark, start = SEPARATORS[level], lo
    at = text.find(mark, lo, hi)
    while at >= 0:
        if at > start:
            yield from _spans(text, start, at, size, level + 1) if at - start > size else [(start, at)]
            start = at
        at = text.find(mark, at + len(mark), hi)
    yield from _spans(text, start, hi, size, level + 1) if hi - start > size else [(start, hi)]


def split_text(text: str, size: int = 1200, overlap: int = 200) -> list[tuple[int, str]]:
    """CHK-1/3: offset and text of each chunk. Neighbouring spans are gathered up to ``size``; the next
    chunk begins with the last spans that fit in ``overlap``. As spans keep their places, so do chunks."""
    out, held = [], []

    def emit() -> None:
        piece = text[held[0][0] : held[-1][1]]
        if piece.strip():
            out.append((held[0][0] + len(piece) - len(piece.lstrip()), piece.strip()))

    for lo, hi in _spans(text, 0, len(text), size, 0):
        if held and hi - held[0][0] > size:
            emit()
            while held and (held[-1][1] - held[0][0] > overlap or hi - held[0][0] > size):
                held.pop(0)
        held.append((lo, hi))
    if held:
        emit()
    return out


def recursive_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """CHK-1, CHK-3, CHK-6: ``idx``, ``start``, ``chunk_end``, ``text``, ``token_estimate`` for each chunk."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, i, at, at + len(piece), piece) for key, text in zip(batch[id_col], batch[text_col], strict=True) for i, (at, piece) in enumerate(split_text(text or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "idx", "start", "chunk_end", "text"])

    out = docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, idx int, start int, chunk_end int, text string")
    return out.withColumn("token_estimate", token_estimate(F.col("text")))


@F.udtf(returnType="idx int, start int, text string")
class SplitText:
    """The splitter for SQL: ``SELECT id, c.* FROM papers, LATERAL split_text(full_text, 1200, 200) c``."""

    def eval(self, text: str, size: int, overlap: int):
        for idx, (start, piece) in enumerate(split_text(text or "", size, overlap)):
            yield idx, start, piece


def register_splitter(spark: SparkSession, name: str = "split_text") -> None:
    spark.udtf.register(name, SplitText)


def token_estimate(text: Column) -> Column:
    """CHK-6"""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """CHK-2: windows of ``size`` characters, each beginning ``size - overlap`` after the last."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text_col), F.lit(1)), F.lit(size - overlap))
    rows = docs.filter(F.length(text_col) > 0).select(id_col, text_col, F.posexplode(starts).alias("idx", "at"))
    return rows.select(id_col, "idx", (F.col("at") - 1).alias("start"), F.substring(F.col(text_col), F.col("at"), F.lit(size)).alias("text"))


def attach_last(rows: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str, out: str) -> DataFrame:
    """An as-of join: the ``value`` of the last mark at or before each row's place, within ``key``.

    Both sides are laid in one order and the last mark is carried on: one shuffle by key.
    """
    carried = F.last(F.col("_v"), ignorenulls=True).over(W.partitionBy(key).orderBy(F.col("_at"), F.col("_side")).rowsBetween(W.unboundedPreceding, 0))
    left = rows.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(marks.schema[value].dataType).alias("_v"))
    right = marks.select(key, F.col(mark_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    return left.unionByName(right).withColumn(out, carried).filter("_side = 1").select("_row.*", out)


def page_of(chunks: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """CHK-4: the pages that a chunk begins and ends on; ``pages`` has ``page_no`` and ``offset``."""
    out = attach_last(chunks, pages, key, "start", "offset", "page_no", "page_start")
    return attach_last(out, pages, key, "chunk_end", "offset", "page_no", "page_end")


def page_offsets(pages: DataFrame, key: str) -> DataFrame:
    before = W.partitionBy(key).orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def section_of(chunks: DataFrame, marks: DataFrame, key: str, heading: Callable[[Column], Column]) -> DataFrame:
    """CHK-5: a heading in the chunk's first three lines, else the last one before the chunk.

    The chunk's first line counts if it is a heading line of the text: the rest of a line that the chunk's beginning cuts is none.
    """
    last = marks.filter("section is not null").withColumn("_mark", F.struct("section", "start", "inset"))
    out = attach_last(chunks, last, key, "start", "start", "_mark", "_before")
    whole = F.coalesce(F.col("start").between(F.col("_before.start"), F.col("_before.inset")), F.lit(False))
    named = F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda line, i: F.when((i > 0) | whole, heading(line)))
    own = F.get(F.filter(named, lambda h: h.isNotNull()), F.lit(0))
    return out.withColumn("section", F.coalesce(own, "_before.section")).drop("_before")


def hashed_terms(rows: DataFrame, id_col: str, text_col: str, dims: int = 384) -> DataFrame:
    """EMB-1: the sparse hashed vector of words and word pairs: id, ``bucket``, ``weight`` of unit length.

    The first 8 hex digits of a feature's MD5 choose its bucket, the next two its sign. The texts are
    dealt by id before they are taken apart, so that sums and lengths need no further shuffle.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: a stated number
    words = rows.select(id_col, text_col).repartition(tasks, id_col).select(id_col, F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9]+)"), F.lit(1)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.get(F.col("w"), i - 1), F.lit(" "), F.get(F.col("w"), i)))).otherwise(F.array().cast("array<string>"))
    features = words.select(id_col, F.explode(F.concat("w", pairs)).alias("f")).withColumn("h", F.md5(F.col("f").cast("binary")))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = features.groupBy(id_col, bucket.alias("bucket")).agg(F.sum(sign).alias("s")).filter("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(W.partitionBy(id_col)))
    return sums.select(id_col, "bucket", (F.col("s") / norm).alias("weight"))


def hash_embedder(dims: int = 384) -> Callable[[list[str]], np.ndarray]:
    """UDF-1: a batch function from texts to unit vectors, with BLAKE2b as its hash.

    Features that a task has met lately (``KNOWN`` of them) are not hashed again.
    """

    @lru_cache(KNOWN)
    def place(feature: str) -> int:
        """Twice the number of the feature's bucket, plus one if it counts against it."""
        digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
        return int.from_bytes(digest[:4], "big") % dims * 2 + digest[4] % 2

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"[a-z0-9]+", (text or "").lower())
            places = [*map(place, words), *map(place, map(" ".join, zip(words, words[1:], strict=False)))]
            counts = np.bincount(np.array(places, np.int64), minlength=2 * dims).reshape(dims, 2)
            row[:] = counts[:, 0] - counts[:, 1]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def embed(rows: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]], backend: str, out: str = "embedding") -> DataFrame:
    """EMB-2: vectors by any batch function; ``make`` builds it once per task, ``backend`` is kept beside them."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for texts in batches:
            yield pd.Series(list(run(texts.tolist())))

    return rows.withColumn(out, vectors(text_col)).withColumn("backend", F.lit(backend))


def foreign_vectors(vectors: DataFrame, active: str) -> DataFrame:
    """EMB-3: how many vectors each backend made, and which are not the active one's."""
    return vectors.groupBy("backend").agg(F.count("*").alias("n")).withColumn("mismatch", F.col("backend") != active)
