"""Passages that repeat across documents, found by compressed full-text indexes over shards of words.

Equal windows have the same smallest hash among the runs of a few words in them. Neighbouring windows
that share it are one piece, and pieces with one smallest hash go to one shard: so equal windows meet,
and a document is streamed past the few shards that can hold a match of it, not past all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.fm_index import FMIndex
from corpusloom.llm.infill import text_slices
from corpusloom.llm.rows import row_key
from corpusloom.storage import cut, scratch

#: Words of a window, and of the runs whose hashes choose its shard: the first, and longer ones for crowds.
WINDOW, GRAMS = 50, (8, 32)
#: Windows of a piece at most; words that are hashed at a time; words of a shard, about.
RUN, CHUNK, SHARD_WORDS = 64, 1 << 20, 1 << 19
#: Pieces that share a smallest hash beyond which they are cut again by longer runs.
CROWD = 1024
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of texts that lie one behind the other, each text with a blank at its end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        blank = _BLANK[data]
        ends = blank.copy()
        ends[1:] &= ~blank[:-1]
        ends[:1] = False
        self.texts = np.searchsorted(np.flatnonzero(ends), starts)  # words before each text, and all
        keep = ~blank | ends
        self.data = data[keep]
        self.data[blank[keep]] = 32  # each word is followed by one space
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.concatenate([[0], self.ends + 1])

    def __len__(self) -> int:
        return len(self.ends)

    def coded(self) -> pa.DictionaryArray:
        return pa.BinaryArray.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.starts.astype(np.int32)), pa.py_buffer(self.data)]).dictionary_encode()

    def hashes(self) -> np.ndarray:
        coded = self.coded()
        table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        return table[coded.indices.to_numpy()] if len(self) else np.zeros(0, np.uint64)


def run_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each run of ``gram`` words, put together from runs of powers of two."""
    base, power, width, out, done = np.uint64(0x9E3779B97F4A7C15), hashes, 1, None, 0
    while True:
        if gram & width:
            out = power if out is None else out[: len(out) - width] * base + power[done : done + len(out) - width]
            done += width
        if done == gram:
            break
        power = power[:-width] * base + power[width:]
        width, base = 2 * width, np.uint64(int(base) ** 2 & (1 << 64) - 1)
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(32))


def smallest_hashes(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of words the smallest hash of a run of ``gram`` words in it."""
    hashes = run_hashes(hashes, gram)
    width, wanted = 1, window - gram + 1
    while width < wanted:
        step = min(width, wanted - width)
        hashes = np.minimum(hashes[:-step], hashes[step:])
        width += step
    return hashes


def pieces_in(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its text, its first word, its windows, its smallest hash."""
    hashes, found = words.hashes(), []
    for low in range(0, len(words), CHUNK):
        part = hashes[low : low + CHUNK + window - 1]
        if len(part) < window:
            break
        least = smallest_hashes(part, window, gram)
        at = np.arange(low, low + len(least))
        text = np.searchsorted(words.texts, at, side="right") - 1
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        first = np.flatnonzero(since % RUN == 0)
        last = np.minimum(at[np.append(first[1:], len(at)) - 1] + 1, words.texts[text[first] + 1] - window + 1)
        whole = last > at[first]  # the last windows of a text would reach into the next
        found.append((text[first][whole], at[first][whole], (last - at[first])[whole], least[first][whole].view(np.int64)))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))


def occurrences(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``start``, ``windows``, ``least`` and ``piece`` (128 bits of its words) of each piece, with all columns of ``rows`` but its last, ``text``."""
    carried = rows.columns[:-1]
    names = [*carried, "start", "windows", "least", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in text_slices(batch, len(carried)):
                words = Words(data, starts)
                text, first, windows, least = pieces_in(words, window, gram)
                view = memoryview(words.data)
                bounds = zip(words.starts[first].tolist(), words.ends[first + windows + window - 2].tolist(), strict=True)
                piece = [xxhash.xxh3_128_digest(view[a:b]) for a, b in bounds]
                own = pa.array(text, pa.int64())
                columns = [*(part.column(k).take(own) for k in range(len(carried))), pa.array(first - words.texts[text], pa.int32()), pa.array(windows, pa.int32()), pa.array(least), pa.array(piece, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", start int, windows int, least long, piece binary")


def by_id() -> list[Column]:
    """The smallest and the largest id, and whether a null one occurs (it comes after all others)."""
    return [F.min("low").alias("low"), F.max("high").alias("high"), F.max("none").alias("none")]


def ids() -> list[Column]:
    return [F.col("id").alias("low"), F.col("id").alias("high"), F.col("id").isNull().cast("int").alias("none")]


#: Two documents, of which one comes before the other.
SHARED = "low < high OR (low IS NOT NULL AND none = 1)"


def cut_pieces(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of pieces. ``rows``: ``key``, ``text``; ``wanted``: ``key``, ``start``, ``windows``, ``piece``, ``least``, ``low``, ``high``, ``none``."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "piece", "least", "low", "high", "none")).alias("pieces"))
    both = rows.join(lists, "key").select("key", "text", "pieces")
    kinds = {"piece": pa.binary(), "least": pa.int64(), "low": pa.int64(), "high": pa.int64(), "none": pa.int32(), "words": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat an id and a text come to one task, one is enough
        for batch in batches:
            for part, data, starts in text_slices(batch, 1):
                words, out = Words(data, starts), {k: [] for k in kinds}
                for row, (key, pieces) in enumerate(zip(part.column(0).to_pylist(), part.column(2), strict=True)):
                    if key in seen:
                        continue
                    seen.add(key)
                    for p in pieces.as_py():
                        first = words.texts[row] + p["start"]
                        p["words"] = words.data[words.starts[first] : words.ends[first + p["windows"] + window - 2]].tobytes()
                        for k in kinds:
                            out[k].append(p[k])
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return both.mapInArrow(run, "piece binary, least long, low long, high long, none int, words binary")


@dataclass
class Level:
    """Pieces by runs of one length: where they occur, the distinct ones, and those whose smallest hash too many others share."""

    some: DataFrame
    distinct: DataFrame
    crowds: DataFrame | None


def spans_of(some: DataFrame, decided: DataFrame) -> DataFrame:
    """``key``, ``s``: the windows (from, to) that repeat what comes before, of those that hold pieces (``some``).

    ``decided`` has the smallest document of each piece, and what that one repeats. A document after it repeats
    the whole piece.
    """
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    later = (F.col("low") > F.col("_low")) | (F.col("low").isNull() & F.col("_low").isNotNull())
    joined = some.select("key", "start", "windows", "piece", "low").join(decided.withColumnRenamed("low", "_low"), "piece")
    return joined.select("key", "start", F.explode(F.when(later, whole).otherwise(F.col("spans"))).alias("s")).select("key", F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b")).alias("s"))


def search_shard(pieces: list[bytes], low: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of one shard, and all its pieces streamed past it.

    ``low``: the rank of the smallest document that has each piece. Returns, for each piece and each of its
    windows, the smallest rank of a document that holds the window (a row each, padded), and the pieces' windows.
    """
    joined = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    words = Words(joined, np.array([0, len(joined)]))
    coded = words.coded()
    counts = np.array([p.count(b" ") + 1 for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), counts)
    text = np.zeros(len(words) + len(pieces), np.int64)  # 0 behind each piece
    text[np.arange(len(words)) + piece] = coded.indices.to_numpy().astype(np.int64) + 1
    index = FMIndex(text, len(coded.dictionary) + 1, window)
    owner = np.repeat(np.arange(len(pieces)), counts + 1)
    smallest = np.minimum.reduceat(low[owner[index.order]], index.edges)  # of each class of equal windows
    starts = np.cumsum(counts + 1) - counts - 1
    longest_first = np.argsort(-counts, kind="stable")
    queries = np.zeros((len(pieces), counts.max()), np.int64)
    own = np.arange(counts.max()) < counts[longest_first, None]
    queries[own] = text[(starts[longest_first, None] + np.arange(counts.max()))[own]]
    out = np.full((len(pieces), counts.max() - window + 1), np.iinfo(np.int64).max)
    for back, length, first, _ in index.matching_statistics(queries, counts[longest_first]):
        found = np.flatnonzero(length == window)
        out[longest_first[found], counts[longest_first[found]] - 1 - back] = smallest[np.searchsorted(index.edges, first[found], side="right") - 1]
    return out, counts - window + 1


def search(shards: DataFrame, window: int) -> DataFrame:
    """``piece`` and the ``spans`` of its windows that begin in a document before its own first.

    ``shards``: ``shard``, ``piece``, ``low``, ``words``.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = {p: i for i, p in enumerate(table["piece"].to_pylist())}  # once each
        table = table.take(pa.array(list(at.values()), pa.int64()))
        low = table["low"].to_pylist()
        values = np.unique(np.array([v for v in low if v is not None], np.int64))
        ranks = np.array([len(values) if v is None else np.searchsorted(values, v) for v in low], np.int64)  # a null comes last
        found, windows = search_shard(table["words"].to_pylist(), ranks, window)
        inside = np.arange(found.shape[1]) < windows[:, None]
        before = np.pad((found < ranks[:, None]) & inside, ((0, 0), (1, 1)))
        edges = np.diff(before.astype(np.int8), axis=1)
        row, first = np.nonzero(edges == 1)
        last = np.nonzero(edges == -1)[1]
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(windows)))]), pa.int32()), pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["a", "b"]))
        return pa.Table.from_arrays([table["piece"], spans], names=["piece", "spans"])

    return shards.groupBy("shard").applyInArrow(run, "piece binary, spans array<struct<a:int,b:int>>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grams: tuple[int, ...] = GRAMS, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``key`` (``row_key``), ``spans``: the words (from, to) of each document that a repeated window covers, unmerged.

    Where more than ``crowd`` distinct pieces share a smallest hash, they are cut again by longer runs, at last by
    whole windows; of these only what two documents share goes on. What a hash decides is 128 bits wide.
    Every step reads what the one before has written.
    """
    spark = docs.sparkSession
    with scratch(spark, "passages") as keep:
        texts = docs.select(row_key(id_col, text_col).alias("key"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(" ")).alias("text"))
        rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(" ")).alias("text"))
        levels, ready = [], None
        for gram in (*grams, window):
            made = cut(occurrences(rows, window, gram), "pieces")
            bounds = ids() if not levels else [F.col(c) for c in ("low", "high", "none")]
            shared = cut(made.select("least", *bounds).groupBy("least").agg(*by_id()).filter(SHARED).select("least"), "shared")
            some = cut(made.join(shared, "least").select("key", "start", "windows", "least", "piece", *bounds), "some")
            holder = F.min_by(F.struct("key", "start"), F.struct(F.col("low").isNull(), "low", "key", "start")).alias("_holder")
            distinct = some.groupBy("least", "piece", "windows").agg(*by_id(), holder)
            distinct = cut(distinct.select("least", "piece", "windows", "low", "high", "none", "_holder.*"), "distinct")
            crowds = cut(distinct.groupBy("least").agg(F.count("*").alias("_n")).filter(F.col("_n") > crowd).select("least"), "crowds") if gram < window else None
            words = cut(cut_pieces(texts, distinct, window), "texts")
            if crowds is not None and crowds.isEmpty():
                crowds = None
            levels.append(Level(some, distinct, crowds))
            own = words.select("piece", "least", "low", "words")
            own = own if crowds is None else own.join(crowds, "least", "left_anti")
            ready = own if ready is None else ready.unionByName(own)
            if crowds is None:
                break
            rows = words.dropDuplicates(["piece"]).join(crowds, "least", "left_semi").select(F.col("piece").alias("key"), "low", "high", "none", F.concat(F.col("words").cast("string"), F.lit(" ")).alias("text"))
            rows = cut(rows, "crowded")
            texts = rows.select("key", "text")
        size = ready.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (6 * shard_words) + 1)
        found = cut(search(ready.select(F.pmod(F.xxhash64("least"), F.lit(shards)).alias("shard"), "piece", "low", "words"), window), "found")
        decided = None
        for level in reversed(levels):
            searched = level.distinct if level.crowds is None else level.distinct.join(level.crowds, "least", "left_anti")
            now = searched.select("piece", "low").join(found, "piece")
            if level.crowds is not None:
                inner = spans_of(below.some, decided).groupBy(F.col("key").alias("piece")).agg(F.collect_set("s").alias("spans"))
                crowded = level.distinct.join(level.crowds, "least", "left_semi").select("piece", "low").join(inner, "piece", "left")
                now = now.unionByName(crowded.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))))
            decided, below = cut(now, "decided"), level
        spans = spans_of(levels[0].some, decided).select("key", F.struct(F.col("s.a"), (F.col("s.b") + window - 1).alias("b")).alias("s"))
        return keep(spans.groupBy("key").agg(F.collect_set("s").alias("spans")), "spans")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept`` (what is left, with single spaces) and ``spans``.

    A word goes if a window of ``window`` words covers it that also begins in a document with a smaller id;
    windows are judged on the input. A null id comes after all others, documents of one id are not before
    each other, rows that repeat an id and a text are alike. A null text has no words. ``spans`` are the
    words (from, to) that went, in order and apart. An empty table gives an empty result; other columns are ignored.
    """
    spans = repeated_spans(docs, id_col, text_col, window, **options)
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(" ")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in text_slices(batch, 1):
                words = Words(data, starts)
                held = part.column(2)
                of = np.repeat(np.arange(len(held)), np.nan_to_num(held.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                flat = held.flatten()
                first, last = (words.texts[of] + flat.field(k).to_numpy() for k in (0, 1))
                change = np.bincount(first, minlength=len(words) + 1) - np.bincount(last, minlength=len(words) + 1)
                gone = np.cumsum(change[: len(words)]) > 0
                left = words.data[np.repeat(~gone, np.diff(words.starts))]
                kept_before = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(words.starts)))])[words.texts]
                removed = np.concatenate([[0], np.cumsum(gone)])[words.texts]
                kept = [left[a : max(a, b - 1)].tobytes().decode() for a, b in zip(kept_before[:-1].tolist(), kept_before[1:].tolist(), strict=True)]
                text = np.repeat(np.arange(len(held)), np.diff(words.texts))
                new = np.diff(gone.astype(np.int8), prepend=0) == 1
                new[words.texts[:-1][np.diff(words.texts) > 0]] |= gone[words.texts[:-1][np.diff(words.texts) > 0]]
                end = np.append(np.diff(gone.astype(np.int8)) == -1, gone[-1:])
                end[words.texts[1:][np.diff(words.texts) > 0] - 1] |= gone[words.texts[1:][np.diff(words.texts) > 0] - 1]
                a, b = np.flatnonzero(new), np.flatnonzero(end) + 1
                base = words.texts[text[a]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[a], minlength=len(held)))]), pa.int32()), pa.StructArray.from_arrays([pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32())], names=["a", "b"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.texts), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(kept, pa.string()), lists], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    joined = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<a:int,b:int>>")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
