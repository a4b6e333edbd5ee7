"""VEC-3: an index of vectors in cells, with product codes of what is left (Jégou et al., 2011)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.vectors import blocks_of, matrix
from corpusloom.storage import cut

#: Cells and codebooks are fitted on so many rows at most, chosen by a hash of their ids. Every row is indexed.
SAMPLE_ROWS = 20_000


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(x[at : at + 4096] @ centres.T - half, axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from ``k`` rows; a centre that loses all rows stays where it is."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass
class Cells:
    """The fitted part: centres of the cells, and a codebook of at most 256 for each part of a residual."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def parts(self) -> list[slice]:
        edges = np.linspace(0, self.width, len(self.books) + 1).astype(int)
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = x - self.centres[cell]
        return np.stack([nearest(left[:, part], book) for part, book in zip(self.parts(), self.books, strict=True)], axis=1).astype(np.uint8)


def fit_cells(items: DataFrame, item_id: str = "item_id", cells: int | None = None, codes: int = 16, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Cells:
    """Cells (the square root of the sample's rows by default) and ``codes`` codebooks, on a bounded sample of unit vectors.

    The width is that of most sampled vectors.
    """
    sample = items.filter("size(embedding) > 0").select("embedding").orderBy(F.xxhash64(F.col(item_id), F.lit(seed))).limit(sample_rows).toPandas()["embedding"]
    widths = sample.map(len)
    width = int(widths.mode().max()) if len(sample) else 1
    x = np.stack(list(sample[widths == width])).astype(float) if len(sample) else np.zeros((1, 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = k_means(x, cells or max(1, round(len(x) ** 0.5)), seed)
    made = Cells(centres, [np.zeros((1, 0))] * min(codes, width))
    left = x - centres[nearest(x, centres)]
    made.books = [k_means(left[:, part], 256, seed + 1 + k, 8) for k, part in enumerate(made.parts())]
    return made


def index_vectors(items: DataFrame, model: Cells, item_id: str = "item_id") -> DataFrame:
    """Every row of ``items`` under its cell: ``cell``, ``item``, ``codes`` (a byte for each part), ``unit`` (the vector at length one).

    Null and zero vectors and those of another width, which are like nothing, are cell -1. Written by ranges
    of cell and id: a cell is a few neighbouring files, a large one is dealt over several tasks, and a reader
    that asks for some cells skips the files of the others by their statistics.
    """
    kind = dict(items.dtypes)[item_id]
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = matrix(batch.column(1), own.width)
            cell = nearest(x, own.centres)
            codes = own.codes(x, cell)
            cell[~x.any(axis=1)] = -1
            bytes_of = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * own.width, pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), bytes_of, unit], names=["cell", "item", "codes", "unit"])

    made = items.select(item_id, "embedding").mapInArrow(run, f"cell int, item {kind}, codes binary, unit array<double>")
    made = cut(made, "assigned")
    return cut(made.repartitionByRange("cell", "item").sortWithinPartitions("cell", "item"), "cells")


def search_cells(queries: DataFrame, index: DataFrame, model: Cells, k: int = 8, query_id: str = "query_id", item_id: str = "item_id", probed: float = 0.8, compared: float = 0.1) -> DataFrame:
    """The best ``k`` items of each query among its nearest cells, ranked from 0.

    A query looks into the nearest ``probed`` of the cells. There items are scored by their codes, with a
    table of products for each query, and the best ``compared`` of a batch (``k`` at least) by the vectors.
    Queries go to the tasks in blocks that are counted; a task keeps each query's best ``k`` of a batch, so
    neither pairs nor vectors are shuffled. Queries that are like nothing have no rows.
    """
    spark = queries.sparkSession
    asked = cut(queries.select(F.monotonically_increasing_id().alias("_q"), query_id, "embedding"), "queries")
    kind, out = dict(index.dtypes)["item"], None
    for block in blocks_of(asked, "_q"):
        rows = block.select("_q", "embedding").toArrow()  # a block of the stated queries
        x = matrix(rows["embedding"].combine_chunks(), model.width)
        numbers, x = rows["_q"].to_numpy()[x.any(axis=1)], x[x.any(axis=1)]
        near = np.argsort(-(x @ model.centres.T), axis=1, kind="stable")[:, : max(1, round(probed * len(model.centres)))]
        wanted = np.unique(near).tolist()
        shared = spark.sparkContext.broadcast((model, numbers, x, near))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, numbers, x, near = shared.value
            tables = [x[:, part] @ book.T for part, book in zip(model.parts(), model.books, strict=True)]
            to_centre, probes = x @ model.centres.T, np.zeros((len(x), len(model.centres)), bool)
            np.put_along_axis(probes, near, True, axis=1)
            for batch in batches:
                if not len(x) or not batch.num_rows:
                    continue
                cell = batch.column(0).to_numpy()
                lists = batch.column(2)
                codes = np.frombuffer(b"".join(lists.to_pylist()), np.uint8).reshape(len(lists), -1)
                unit = matrix(batch.column(3), model.width)
                order = np.argsort(pc.rank(batch.column(1)).to_numpy(), kind="stable")  # ties go by id
                cell, codes, unit = cell[order], codes[order], unit[order]
                for q in range(len(x)):
                    inside = np.flatnonzero(probes[q, cell])
                    if not len(inside):
                        continue
                    score = to_centre[q, cell[inside]] + sum(table[q, codes[inside, part]] for part, table in enumerate(tables))
                    few = min(len(inside), max(k, round(compared * len(inside))))
                    few = np.sort(inside[np.argpartition(-score, few - 1)[:few]])
                    exact = np.round(unit[few] @ x[q], 4)
                    top = np.argsort(-exact, kind="stable")[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), numbers[q])), batch.column(1).take(pa.array(order[few[top]])), pa.array(exact[top])], names=["_q", "_item", "score"])

        best = index.filter(F.col("cell").isin(wanted)).select("cell", "item", "codes", "unit").mapInArrow(run, f"_q long, _item {kind}, score double")
        place = F.row_number().over(W.partitionBy("_q").orderBy(F.col("score").desc(), F.col("_item")))
        ranked = best.withColumn("_r", place).filter(F.col("_r") <= k).select("_q", "_item", "score", (F.col("_r") - 1).alias("rank"))
        out = ranked if out is None else out.unionByName(ranked)
    return out.join(asked.select("_q", query_id), "_q").select(query_id, F.col("_item").alias(item_id), "score", "rank")


def approximate_top_k(queries: DataFrame, items: DataFrame, k: int = 8, query_id: str = "query_id", item_id: str = "item_id", cells: int | None = None, codes: int = 16, probed: float = 0.8, compared: float = 0.1) -> DataFrame:
    """VEC-3 in one call: fit, index, search.

    The defaults suit vectors without near neighbours, the hardest case: a query's best items then lie
    in many cells. Clustered vectors need few (``probed`` of 0.1).
    """
    model = fit_cells(items, item_id, cells, codes)
    return search_cells(queries, index_vectors(items, model, item_id), model, k, query_id, item_id, probed, compared)
