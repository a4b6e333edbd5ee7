"""Words of a batch of texts as numbers, each distinct word handled once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import cut, scratch

#: A labelled row to learn from is a window of WINDOW_WORDS words of a sampled text; there are at most WINDOWS times as many as texts.
WINDOW_WORDS, WINDOWS = 512, 2
#: Punctuation that is cut from the ends of words.
EDGES = ".,;:!?\"'()[]{}<>|*#%&$@/\\+=_~`^-–—…«»„“”‘’¿¡"


def chunks(batch: pa.RecordBatch, text: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and about ``size`` bytes of text, one long text by itself."""
    bytes_ = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        done = bytes_[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(bytes_, done + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (lower case, without punctuation at their ends), the word at each place, where texts start."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    starts = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    trimmed = pc.utf8_trim(coded.dictionary, characters=EDGES).dictionary_encode()
    code = trimmed.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    distinct, starts = trimmed.dictionary, starts - starts[0]
    blank = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
    if blank.any() and len(code):  # empty words from blank edges and lone punctuation
        keep = ~blank[code]
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        code = code[keep]
    return distinct, code, starts


def ngrams(words: pa.Array, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte n-grams of all words, edges marked, and where each word's begin. Affixes are those at an edge."""
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    data = np.frombuffer(marked.buffers()[2], np.uint8) if len(marked) and marked.buffers()[2] else np.zeros(0, np.uint8)
    offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64) if len(marked) else np.zeros(1, np.int64)
    length = np.diff(offsets)
    word = np.repeat(np.arange(len(words), dtype=np.int32), length)
    data = data[offsets[0] : offsets[-1]]
    left = np.repeat(offsets[1:] - offsets[0], length) - np.arange(len(data))
    codes, owners = [], []
    rolled = np.zeros(len(data), np.uint64)
    for n in range(1, max(sizes) + 1):
        ahead = np.zeros(len(data), np.uint64)
        ahead[: len(data) - n + 1] = data[n - 1 :]
        rolled = (rolled + ahead + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        if n in sizes:
            fits = left >= n
            codes.append(((rolled[fits] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
            owners.append(word[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(codes)[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def summed(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """The sum of ``table``'s rows over each word's codes, for about ``at_once`` codes at a time."""
    out = np.zeros((len(starts) - 1, table.shape[1]), table.dtype)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + at_once, side="right")) - 1)
        has = np.diff(starts[at : to + 1]) > 0
        if has.any():
            first = (starts[at:to] - starts[at])[has]
            out[at:to][has] = np.add.reduceat(table[codes[starts[at] : starts[to]]], first, axis=0)
        at = to
    return out


def lookup(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The place of each word in the vocabulary, from 1; 0 for other words."""
    return pc.fill_null(pc.add(pc.index_in(words, value_set=vocabulary), 1), 0).to_numpy().astype(np.int64)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_windows(texts: DataFrame, names: list[str], text_col: str, words: int = WINDOW_WORDS) -> DataFrame:
    """The windows of whole texts, side by side: ``names``, ``rank``, ``place``, ``piece``.

    A text of at most ``words`` words is its own window. ``rank`` orders the windows of a text by a
    hash of their places, so that the first few ranks lie all over it.
    """
    kinds = dict(texts.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, len(names)):
                row, rank, place, piece = [], [], [], []
                for i, text in enumerate(part.column(len(names)).to_pylist()):
                    own = (text or "").split()
                    n = max(1, -(-len(own) // words))
                    order = np.argsort(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
                    ranks = np.empty(n, np.int64)
                    ranks[order] = np.arange(n)
                    row += [i] * n
                    rank += ranks.tolist()
                    place += range(n)
                    piece += [text or ""] if n == 1 else [" ".join(own[k * words : (k + 1) * words]) for k in range(n)]
                keys = [part.column(k).take(pa.array(row, pa.int64())) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(rank, pa.int64()), pa.array(place, pa.int64()), pa.array(piece, pa.string())], names=[*names, "rank", "place", "piece"])

    return texts.select(*names, text_col).mapInArrow(run, f"{schema}, rank long, place long, piece string")


def fetch_sample(docs: DataFrame, keys: list[tuple], columns: list[str], text_col: str, windows: int = WINDOWS) -> list[tuple]:
    """One text for each of ``keys`` (values of ``columns``, an id first) that ``docs`` has, ordered: what a model learns from.

    Of rows that repeat a key the text with the smallest hash is taken. Labelled rows are windows of
    these texts: all of them, or, where there are more than ``windows`` times the number of keys, those
    of the first ranks, the same number of ranks for each text. So the driver gets at most
    ``windows * len(keys)`` windows, however often an id repeats and however long its text.
    """
    names = [f"_{i}" for i in range(len(columns))]
    kinds = dict(docs.dtypes)
    spark, keys = docs.sparkSession, sorted(set(keys))
    chosen = F.broadcast(spark.createDataFrame(keys, ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, columns, strict=True))))  # as many rows as the sample
    own = docs.select(*(F.col(c).alias(n) for n, c in zip(names, columns, strict=True)), F.col(text_col).alias("_text")).join(chosen, names, "left_semi")
    one = own.groupBy(*names).agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))
    with scratch(spark, "labelled"):
        pieces, most = cut(labelled_windows(one, names, "_text"), "windows"), max(1, windows) * len(keys)
        held, ranks = 0, 0
        for r in pieces.groupBy("rank").count().orderBy("rank").limit(most).collect():  # each rank has a window, so no more are needed
            held += r["count"]
            if held > most:
                break
            ranks += 1
        parts: dict[tuple, list] = {}
        for r in pieces.filter(F.col("rank") < ranks).collect():
            parts.setdefault(tuple(r)[:-3], []).append((r["place"], r["piece"]))
    return sorted((*k, " ".join(x for _, x in sorted(v))) for k, v in parts.items())


def bounded_sample(rows: DataFrame, id_col: str, class_col: str, most: int) -> list[tuple[int, object]]:
    """At most ``most`` ids per class, the same ones every time: those with the smallest hashes.

    Counts per class give the share of hashes to fetch, so that about twice ``most`` ids per class
    leave the executors whatever the table holds. An id that repeats counts once.
    """
    rows = rows.select(id_col, class_col).distinct()
    counts = {r[class_col]: r["count"] for r in rows.groupBy(class_col).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(class_col) == value, min(1.0, (2.0 * most + 50) / n)).otherwise(share)
    hash_ = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    some = rows.filter(hash_ < share * float(1 << 40)).select(hash_.alias("h"), F.col(id_col).alias("id"), F.col(class_col).alias("c")).collect()
    out, taken = [], {}
    for r in sorted(some, key=lambda r: (r["h"], r["id"])):
        taken[r["c"]] = taken.get(r["c"], 0) + 1
        if taken[r["c"]] <= most:
            out.append((r["id"], r["c"]))
    return out
