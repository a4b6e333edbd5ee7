"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.ordering import numbered, rank_within

SEPARATOR = 0
#: Characters of white space in a row from which a text goes to ``tokenizers``.
BLANK_RUN = 10_000
_encoders: dict[str, object] = {}


def encoder(name: str):
    """The byte-level BPE ``name`` of the public tokenizer files, one for each Python worker.

    The rank file holds the same vocabulary as the ``.json`` of that name and gives the same ids
    (tests/llm/test_mixing_and_packing.py compares them) at a fourth of the time. The added tokens,
    which a text may contain and which are one id each, stand in the ``.json`` only.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encoders[name]


def token_ids(name: str) -> Callable[[str], list[int]]:
    """Text to ids. The fast encoder's matcher recurses over a run of white space and overflows at some hundred
    thousand characters, so texts with very long runs go to ``tokenizers`` and the ``.json`` itself."""
    fast = encoder(name)

    def ids(text: str) -> list[int]:
        if len(text) < BLANK_RUN or max(map(len, re.findall(r"\s++", text)), default=0) < BLANK_RUN:
            return fast.encode(text, allowed_special="all")
        if (exact := f"{name}.json") not in _encoders:
            import public_tokenizers
            from tokenizers import Tokenizer

            _encoders[exact] = Tokenizer.from_file(public_tokenizers.path(exact))
        return _encoders[exact].encode(text, add_special_tokens=False).ids

    return ids


def token_pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids``.

    A document is its token ids and a separator; one longer than ``capacity`` is cut into pieces of
    ``capacity`` ids, of which the first takes what is over. A null text counts as empty.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # the ids of few documents at a time
                part = batch.slice(at, 512)
                out = defaultdict(list)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = array("I", encode(text.as_py() or ""))
                    ids.append(SEPARATOR)
                    start, end = 0, len(ids) % capacity or capacity
                    for piece in range(-(-len(ids) // capacity)):
                        own = ids[start:end]
                        row = (doc_id, piece, start, len(own), zlib.crc32(np.frombuffer(own, np.uint32).astype("<u4", copy=False)))
                        for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32"), row, strict=True):
                            out[name].append(value)
                        if with_ids:
                            out["ids"].append(list(own))
                        start, end = end, end + capacity
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, schema)


class OpenBins:
    """A segment tree over remaining capacities: which of them have open bins, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.bins: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: runs of (first bin, bins)

    def mark(self, room: int) -> None:
        at = self.leaves + room
        self.tree[at] = bool(self.bins.get(room))
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.bins.setdefault(room, []).append((first, count))
            self.mark(room)

    def tightest(self, length: int) -> int | None:
        """The smallest room >= length that has an open bin, in logarithmic time."""
        at = self.leaves + length
        if self.tree[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing of ``counts`` pieces of each length, as runs.

    Bins of one remaining capacity are alike, so a run of pieces of one length into a run of such
    bins is one row: length, first rank, first bin, pieces in a bin, first offset. Placing piece by
    piece gives the same bins; the rows depend on ``capacity`` and not on the number of pieces.
    """
    bins, opened, rows = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:  # as many new bins as these pieces fill
                room, run = capacity, (opened, -(-left // (capacity // length)))
                opened += run[1]
            else:
                run = bins.bins[room].pop()
                bins.mark(room)
            each = room // length
            full = min(run[1], left // each)
            rest = min(left - full * each, each) if full < run[1] else 0
            rows.append((length, rank, run[0], each, capacity - room))
            bins.add(room - each * length, run[0], full)
            if rest:
                bins.add(room - rest * length, run[0] + full, 1)
            bins.add(room, run[0] + full + bool(rest), run[1] - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """``token_pieces`` with the ``sequence_id`` and ``offset`` that best-fit decreasing gives each piece.

    Empty and null texts are one separator; very long texts are cut; pieces of equal length are
    ranked by id, piece and content, and repeated rows are packed as often as they occur. An empty
    table gives an empty result; other columns are ignored.

    What all tasks need to know is how many pieces each length has (at most ``capacity`` numbers):
    from these the whole packing follows as a list of runs, sent to the tasks (at most one run for
    each length and remaining capacity or split run, whatever the number of documents). A piece
    finds its run by its length and its rank among the pieces of that length.
    """
    pieces = numbered(token_pieces(docs, capacity, id_col, text_col, tokenizer, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    plan = best_fit_plan(counts, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    first = plan[:, 0] << 48 | plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        run = plan[np.searchsorted(first, length << 48 | rank, side="right") - 1]
        nth = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + nth // run[:, 3], "offset": run[:, 4] + nth % run[:, 3] * length})

    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", number="_number")
    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(*pieces.drop("_number").columns, "_at.sequence_id", "_at.offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2048)
