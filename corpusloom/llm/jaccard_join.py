"""Near-duplicate documents by MinHash banding, verified on their full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.blocks import components, local_roots, pair_bands, units_of
from corpusloom.llm.rows import fetch_rows, row_key
from corpusloom.storage import cut

#: 24 bands of 6 rows: a pair at 0.8 shares a band with probability 0.9993, one at 0.3 with 0.017.
WORDS, LIKE, BANDS, ROWS = 5, 0.8, 24, 6
DOCS_AT_ONCE, PERMUTED_AT_ONCE = 256, 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text (lower case, parted by white space), and where each text starts."""
    trimmed = pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    words = pc.utf8_split_whitespace(trimmed)
    starts = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = table[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    first = starts - starts[0]
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    if blank.any():  # a blank text splits into one empty word
        n = np.diff(first)
        keep = np.repeat(~blank, n)
        n[blank] = 0
        hashes, first = hashes[keep], np.concatenate([[0], np.cumsum(n)])
    return hashes, first


def shingles(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the n-word shingles of all texts and where each text starts; a shorter text is one shingle."""
    sizes = np.diff(starts)
    many = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(first[-1]) + np.repeat(starts[:-1] - first[:-1], many)
    left = np.repeat(starts[1:], many) - at
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        here = j < left
        out += np.where(here, hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] if len(hashes) else 0, 0) * np.uint64(mix(np.array([2 * j + 1], np.uint64))[0] | np.uint64(1))
    return mix(out), first


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of ``bands`` keys for each text: each the mixed minima of ``rows`` permutations."""
    n = len(starts) - 1
    low = np.empty((bands * rows, n), np.uint64)
    numbers = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = numbers[::2] | np.uint64(1), numbers[1::2]
    edge = 0
    while edge < n:  # texts whose shingles fit the processor's cache
        to = max(edge + 1, int(np.searchsorted(starts, starts[edge] + PERMUTED_AT_ONCE, side="right")) - 1)
        own, at = hashes[starts[edge] : starts[to]], starts[edge:to] - starts[edge]
        for p in range(bands * rows):
            low[p, edge:to] = np.minimum.reduceat(own * a[p] + b[p], at)
        edge = to
    keys = np.empty((n, bands), np.uint64)
    for k in range(bands):
        key = np.full(n, k + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[k * rows + r])
        keys[:, k] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``_key``, two halves of a 128-bit hash of the words, number of shingles, band keys (none without words).

    docs: ``doc_id``, ``_key``, ``text``.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                hashes, starts = word_hashes(part.column(2))
                made, first = shingles(hashes, starts, n)
                has = np.diff(first) > 0
                keys = band_keys(made, np.concatenate([first[:-1][has], first[-1:]]), bands, rows)
                buffer = hashes.tobytes()
                digests = [xxhash.xxh3_128_digest(buffer[8 * s : 8 * e]) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.diff(first)), lists], names=["doc_id", "_key", "h1", "h2", "shingles", "keys"])

    return docs.mapInArrow(sign, "doc_id long, _key binary, h1 long, h2 long, shingles long, keys array<long>")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with the text replaced by its sorted distinct shingle hashes, ``set``."""
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in docs.select(*names).dtypes) + ", set array<long>"

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                made, first = shingles(*word_hashes(part.column("text")), n)
                own = [np.unique(made[s:e].view(np.int64)) for s, e in zip(first[:-1], first[1:], strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, "set"])

    return docs.mapInArrow(to_sets, schema)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections left x right, by products of 0/1 matrices over the shared shingles."""
    out = np.zeros((len(left), len(right)), np.float32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    in_left = np.isin(row, left)
    in_right = np.isin(row, right)
    shared = (np.bincount(at[in_left], minlength=len(values)) > 0) & (np.bincount(at[in_right], minlength=len(values)) > 0)
    if left is right:
        shared = np.bincount(at, minlength=len(values)) > 1
    code = np.cumsum(shared) - 1
    keep = shared[at]
    row, at = row[keep], code[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(shared.sum()), 2048):
        s, e = np.searchsorted(at, [low, low + 2048])
        dense = np.zeros((len(sets), 2048), np.float32)
        dense[row[s:e], at[s:e] - low] = 1
        out += dense[left] @ dense[right].T
    return out


def verify(units: DataFrame, like: float) -> DataFrame:
    """``node``, ``root`` (smallest node it links to within the unit), ``links`` (documents that are alike).

    units: rows of ``unit``, ``node``, ``side``, ``band``, ``weight``, ``keys``, ``hot_bands``, ``set``.
    """

    def judge(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, side, weight = (np.array(rows[c]) for c in ("node", "side", "weight"))
        keys = np.array(rows["keys"], np.int64)
        hot = np.zeros(keys.shape, bool)
        for i, bands in enumerate(rows["hot_bands"]):
            hot[i, bands] = True
        left = np.flatnonzero(side != 1)
        right = left if (side == 2).all() else np.flatnonzero(side == 1)
        counts = pair_bands(keys, hot, left, right, rows["band"][0])
        if left is right:
            counts &= ~np.eye(len(left), dtype=bool)
        if not counts.any():
            return node, node, np.zeros(len(node), np.int64)
        size = np.array([len(s) for s in rows["set"]])
        both = overlaps(rows["set"], left, right)
        alike = counts & (both >= like * (size[left][:, None] + size[right][None, :] - both) - 1e-6)
        links = np.zeros(len(node), np.int64)
        links[left] += alike @ weight[right]
        if left is not right:
            links[right] += alike.T @ weight[left]
        a, b = np.nonzero(alike)
        order = np.argsort(node, kind="stable")  # so that the smallest index is the smallest node
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        root = local_roots(len(node), place[left[a]], place[right[b]])
        return node, node[order][root[place]], links

    columns = ["node", "side", "band", "weight", "keys", "hot_bands", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, done = None, {c: [] for c in columns}, []

        def flush() -> pa.RecordBatch:
            node, root, links = (np.concatenate(x) for x in zip(*done, strict=True))
            keep = (links > 0) | (node != root)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep]), pa.array(links[keep])], names=["node", "root", "links"])

        for batch in batches:
            own = batch.column("unit").to_numpy()
            sets = batch.column("set")
            values, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
            plain = {c: batch.column(c).to_pylist() for c in columns if c != "set"}
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1), len(own)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if own[s] != unit and rows["node"]:
                    done.append(judge(rows))
                    rows = {c: [] for c in columns}
                unit = own[s]
                for c, x in plain.items():
                    rows[c] += x[s:e]
                rows["set"] += [values[offsets[i] : offsets[i + 1]].copy() for i in range(s, e)]
            if len(done) > 64:
                yield flush()
        if rows["node"]:
            done.append(judge(rows))
        if done:
            yield flush()

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "node long, root long, links long")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, like: float = LIKE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, ``class_id``, ``class_size``, ``n_links``, ``group_id``, ``kept``.

    A class holds the documents with the same words in the same order (any case and white space);
    ``class_id`` is its smallest id. ``n_links`` counts the other documents whose sets of ``n``-word
    shingles are alike to ``like`` or more by Jaccard, copies included. A group is connected by such
    links; ``group_id`` is its smallest id, and one row with it is ``kept``. A text of fewer than ``n``
    words is one shingle; texts without words (null, empty, blank) are one class that links to no
    other. Every row is a document of its own, whether its id is null (after all others) or repeated.
    An empty table gives an empty result; other columns are ignored.

    Only classes take part in the join, under numbers of their own. Pairs are candidates when a band
    of MinHash minima agrees; ``blocks`` deals them into bounded units, where all candidate pairs are
    verified by products of 0/1 matrices, and only counts and spanning links leave the unit.
    """
    return grouped_rows(docs, id_col, text_col, n, like, bands, rows).drop("_key")


def grouped_rows(docs: DataFrame, id_col: str, text_col: str, n: int = WORDS, like: float = LIKE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``jaccard_groups`` and the ``row_key`` of each row as ``_key``."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("text"))
    signed = cut(signatures(plain, n, bands, rows).withColumn("_row", F.monotonically_increasing_id()), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("_row").alias("row"), F.col("_key").alias("key")))
    classes = signed.groupBy("h1", "h2").agg(first.alias("first"), F.count("*").alias("weight"), F.first("shingles").alias("shingles"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # fixed once written
    nodes = classes.filter("shingles > 0")
    keys = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    units, near = units_of(keys, nodes.select("node", F.col("shingles").alias("weight")))
    near = near.join(nodes.select("node", "weight", "keys", F.col("first.key").alias("_key")), "node")
    texts = plain.groupBy("_key").agg(F.first("text").alias("text"))  # rows that repeat an id and a text meet before the shuffle
    sets = cut(sets_of(near.join(texts, "_key").drop("_key"), n), "sets")
    linked = cut(verify(units.join(sets, "node"), like), "linked")
    links = linked.groupBy("node").agg(F.sum("links").alias("_links"))
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    best = cut(roots.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("best")), "best")
    best = roots.join(best, "root").select("node", "best")
    found = classes.select("h1", "h2", "node", "weight", "first").join(links, "node", "left").join(best, "node", "left")
    head = F.coalesce("best", "first")
    found = cut(found.select("h1", "h2", F.col("first.id").alias("class_id"), F.col("weight").alias("class_size"), (F.col("weight") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), head["id"].alias("group_id"), head["row"].alias("_head")), "found")
    all_ = signed.select("doc_id", "_key", "_row", "h1", "h2").join(found, ["h1", "h2"])
    return all_.select("doc_id", "class_id", "class_size", "n_links", "group_id", (F.col("_row") == F.col("_head")).alias("kept"), "_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group that ``jaccard_groups`` finds, all columns kept."""
    kept = grouped_rows(docs, id_col, text_col).filter("kept").select("_key", F.lit(1).alias("_times"))
    return fetch_rows(docs, id_col, text_col, cut(kept, "kept"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
