"""Vector search and its fusion (VEC-*, RET-*)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.storage import cut

BROADCAST_ROWS = 10_000
#: The openings of questions that a variant leaves out.
PREFIXES = ["what is ", "what are ", "how does ", "how do ", "why is ", "why do ", "which "]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """VEC-1: 0 for empty vectors, different lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 1) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def blocks_of(stated: DataFrame, id_col: str, rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """A stated set in blocks that are small enough to be sent to all tasks: about ``rows`` each, dealt by a hash."""
    n = -(-2 * stated.count() // rows)
    return [stated] if n <= 2 else [stated.filter(F.pmod(F.xxhash64(id_col), F.lit(n)) == i) for i in range(n)]


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """A row of length one for each vector; null and zero vectors and those of another width are zeros."""
    flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out, fits = np.zeros((len(lists), width)), size == width
    out[fits] = flat[np.repeat(fits, size)].reshape(int(fits.sum()), width)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def top_k(queries: DataFrame, items: DataFrame, k: int = 8, query_id: str = "query_id", item_id: str = "item_id", scope: DataFrame | None = None, scope_key: str = "paper_id") -> DataFrame:
    """VEC-2: the ``k`` nearest items of each query, ranked from 0.

    Items are scoped before they are ranked. Queries are a stated set: blocks of at most ``BROADCAST_ROWS``
    (counted) go to all tasks, one pass each. A task multiplies batches of items with the block and keeps each
    query's best ``k`` of a batch, so pairs never become rows. Null and zero vectors and those of another
    width score 0.
    """
    if scope is not None:
        items = items.join(scope.select(scope_key).distinct(), scope_key, "left_semi")
    asked = cut(queries.select(F.monotonically_increasing_id().alias("_q"), query_id, "embedding"), "queries")
    held = items.select(F.col(item_id).alias("_item"), "embedding")
    kind, out = dict(held.dtypes)["_item"], None
    for block in blocks_of(asked, "_q"):
        rows = block.select("_q", "embedding").toArrow()  # a block of the stated queries
        vectors = rows["embedding"].combine_chunks()
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        groups = [(int(w), own, matrix(vectors.take(pa.array(own)), int(w))) for w in np.unique(size) for own in [np.flatnonzero(size == w)]]
        shared = queries.sparkSession.sparkContext.broadcast((rows["_q"].to_numpy(), groups))
        best = held.mapInArrow(dense_best(shared, k), f"_q long, _item {kind}, score double")
        place = F.row_number().over(W.partitionBy("_q").orderBy(F.col("score").desc(), F.col("_item")))
        ranked = best.withColumn("_r", place).filter(F.col("_r") <= k).select("_q", "_item", "score", (F.col("_r") - 1).alias("rank"))
        out = ranked if out is None else out.unionByName(ranked)
    return out.join(asked.select("_q", query_id), "_q").select(query_id, F.col("_item").alias(item_id), "score", "rank")


def dense_best(shared, k: int, at_once: int = 256, places: int = 4):
    """For ``top_k``: from batches of items (id, vector) to the best ``k`` of each batch for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, groups = shared.value
        for batch in batches:
            order = np.argsort(pc.rank(batch.column(0)).to_numpy(), kind="stable")  # ties go by id
            for width, own, asked in groups:
                items = matrix(batch.column(1), width)[order].T
                for at in range(0, len(own), at_once):
                    score = np.round(asked[at : at + at_once] @ items, places) + 0.0
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    query, nth = np.nonzero(top >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[own[at + query]]), batch.column(0).take(pa.array(order[top[query, nth]])), pa.array(score[query, top[query, nth]])], names=["_q", "_item", "score"])

    return run


def sparse_top_k(queries: DataFrame, items: DataFrame, k: int = 8, query_id: str = "query_id", item_id: str = "item_id", places: int = 6) -> DataFrame:
    """VEC-2 over sparse vectors (``bucket``, ``weight``): the ``k`` best items that share a bucket with the query.

    A query or an item is one row of at most as many weights as there are buckets. Query blocks of at
    most ``BROADCAST_ROWS`` go to all tasks; a task multiplies batches of items with them and keeps
    each query's best ``k`` of a batch, so pairs never become rows.
    """
    vector = F.collect_list(F.struct("bucket", "weight")).alias("v")
    asked = queries.groupBy(query_id).agg(vector).select(F.monotonically_increasing_id().alias("_q"), query_id, "v")
    asked = cut(asked, "queries")
    held = items.groupBy(F.col(item_id).alias("_item")).agg(vector)
    kind = dict(held.dtypes)["_item"]
    out = None
    for block in blocks_of(asked, "_q"):
        rows = block.select("_q", "v").toPandas()  # a block of the stated queries
        best = held.mapInArrow(batch_best(rows["_q"].to_numpy(), list(rows["v"]), k, places), f"_q long, _item {kind}, score double")
        rank = F.row_number().over(W.partitionBy("_q").orderBy(F.col("score").desc(), F.col("_item"))) - 1
        ranked = best.withColumn("score", F.round("score", places)).withColumn("rank", rank).filter(F.col("rank") < k)
        out = ranked if out is None else out.unionByName(ranked)
    return out.join(asked.select("_q", query_id), "_q").select(query_id, F.col("_item").alias(item_id), "score", "rank")


def batch_best(numbers: np.ndarray, vectors: list, k: int, places: int, at_once: int = 256):
    """For ``sparse_top_k``: from batches of items (id, sparse vector) to the best ``k`` of each batch for each query."""
    width = 1 + max((b for v in vectors for b, _ in v), default=0)
    asked = np.zeros((len(vectors), width))
    for row, v in zip(asked, vectors, strict=True):
        for b, w in v:
            row[b] = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            item = np.repeat(np.arange(len(lists)), np.diff(starts))
            bucket, weight = flat.field("bucket").to_numpy(), flat.field("weight").to_numpy()
            fits = bucket < width
            dense = np.zeros((len(lists), width))
            dense[item[fits], bucket[fits]] = weight[fits]
            order = np.argsort(pc.rank(batch.column(0)).to_numpy(), kind="stable")  # ties go by id
            dense, shares = dense[order], (dense[order] != 0).astype(np.float32)
            for at in range(0, len(asked), at_once):
                own = asked[at : at + at_once]
                score = np.round(own @ dense.T, places)
                score[(own != 0).astype(np.float32) @ shares.T == 0] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                kept = np.take_along_axis(score, top, axis=1)
                query, nth = np.nonzero(kept > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[at + query]), batch.column(0).take(pa.array(order[top[query, nth]])), pa.array(kept[query, nth])], names=["_q", "_item", "score"])

    return run


def chunk_page(chunks: DataFrame, key: str, order: str, offset: int, limit: int) -> DataFrame:
    """VEC-4/5: a page of each document's chunks, with the total."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    total = F.count("*").over(W.partitionBy(key))
    return chunks.withColumn("_r", rank).withColumn("total", total).filter((F.col("_r") > offset) & (F.col("_r") <= offset + limit)).drop("_r")


def mixed_index(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """VEC-6: text chunks and figures in one index, told apart by ``kind``."""
    text = chunks.withColumn("kind", F.lit("text")).withColumn("item_id", F.col("chunk_id"))
    own = figures.withColumn("kind", F.lit("figure")).withColumn("item_id", F.concat(F.lit("figure:"), "figure_id")).withColumn("idx", F.lit(0)).withColumn("source", F.lit("figure"))
    return text.unionByName(own, allowMissingColumns=True)


def query_variants(question: Column) -> Column:
    """RET-1: the question, without its opening words, and its long words; at most three, distinct in any case."""
    q = F.btrim(question, F.lit(" \t\r\n"))
    low = F.btrim(F.rtrim(F.lower(q), F.lit("?")), F.lit(" \t\r\n"))
    bare = F.lit(None).cast("string")
    for prefix in reversed(PREFIXES):
        bare = F.when(low.startswith(prefix), F.substring(low, F.lit(len(prefix) + 1), F.length(low))).otherwise(bare)
    long_ = F.slice(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3), 1, 12)
    words = F.when(F.size(long_) >= 3, F.array_join(long_, " "))
    every = F.filter(F.transform(F.array(q, bare, words), lambda v: F.btrim(v)), lambda v: F.coalesce(v != "", F.lit(False)))
    first = F.filter(F.transform(every, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: F.array_position(F.transform(every, lambda y: F.lower(y)), F.lower(x["v"])) == x["i"] + 1)
    return F.slice(F.transform(first, lambda x: x["v"]), 1, 3)


def fuse(hits: DataFrame, k: int = 8, query_id: str = "query_id", item_id: str = "item_id") -> DataFrame:
    """RET-2: reciprocal ranks (from 0) over variants; the score is that of the first variant that found the item."""
    place = F.struct("variant", "rank")
    fused = hits.groupBy(query_id, item_id).agg(F.sum(1.0 / (60 + F.col("rank"))).alias("rrf"), F.min_by("score", place).alias("score"), F.min(place).alias("_first"))
    order = W.partitionBy(query_id).orderBy(F.round("rrf", 12).desc(), "_first", item_id)
    return fused.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < k).drop("_first")


def pack_blocks(rows: DataFrame, key: str, order: str, block: str, budget: int, separator: str) -> DataFrame:
    """RET-3/4, GRF-24: blocks in order until the first that would exceed ``budget``, joined to one text."""
    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    kept = rows.withColumn("_sum", F.sum(F.length(block)).over(upto)).filter(F.col("_sum") <= budget)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(block).alias("b")))), lambda x: x["b"])
    return kept.groupBy(key).agg(F.array_join(ordered, separator).alias("context"), F.count("*").alias("n_blocks"))


def chunk_block(number: Column, title: Column, page: Column, section: Column, kind: Column, label: Column, text: Column) -> Column:
    """RET-3: a numbered passage under its header."""
    place = F.coalesce(F.concat(F.lit("p."), page.cast("string")), F.lit("n/a"))
    plain = F.concat(title, F.lit(" ("), place, F.coalesce(F.concat(F.lit(", section: "), section), F.lit("")), F.lit(")"))
    figure = F.concat(title, F.lit(" — "), F.coalesce(label, F.lit("Figure")), F.lit(" ("), place, F.lit(") [FIGURE]"))
    return F.concat(F.lit("[S"), number.cast("string"), F.lit("] "), F.when(kind == "figure", figure).otherwise(plain), F.lit("\n"), F.btrim(text, F.lit(" \t\r\n")))


def paper_block(number: Column, title: Column, authors: Column, year: Column, venue: Column, text: Column, most: int = 60_000) -> Column:
    """RET-4: a numbered paper with a line of metadata."""
    meta = F.concat_ws(
        " | ", F.when(F.size(authors) > 0, F.concat(F.lit("Authors: "), F.array_join(F.slice(authors, 1, 8), ", "))), F.when(year > 0, F.concat(F.lit("Year: "), year.cast("string"))),
        F.when(venue != "", F.concat(F.lit("Venue: "), venue)),
    )
    body = F.substring(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")), 1, most)
    return F.concat(F.lit("[S"), number.cast("string"), F.lit("] TITLE: "), title, F.lit("\n"), meta, F.lit("\n\n"), body)


def paper_budget(n: Column) -> Column:
    """RET-5"""
    return F.when(n <= 1, 90_000).when(n <= 3, 45_000).when(n <= 6, 25_000).when(n <= 12, 14_000).otherwise(8_000)


#: The sections that inform most, in order.
INFORMATIVE = ["abstract", "introduction", "method", "experiments", "results", "discussion", "limitations", "conclusion"]


def condense(text: Column, sections: Column, budget: Column) -> Column:
    """RET-6: the text if it fits, else its informative sections, else its head and tail."""
    text = F.coalesce(text, F.lit(""))
    bodies = [F.btrim(F.coalesce(F.element_at(sections, F.lit(s)), F.lit("")), F.lit(" \t\r\n")) for s in INFORMATIVE]
    present = sum((F.when(b != "", 1).otherwise(0) for b in bodies), F.lit(0))
    share = F.greatest(F.lit(1200), F.floor(budget / F.greatest(present, F.lit(1))).cast("int"))
    parts = F.concat_ws("\n\n", *(F.when(b != "", F.concat(F.lit(f"### {s.replace('_', ' ').title()}\n"), F.substring(b, F.lit(1), share))) for s, b in zip(INFORMATIVE, bodies, strict=True)))
    head = F.substring(text, F.lit(1), F.floor(budget * 0.65).cast("int"))
    n_tail = F.floor(budget * 0.35).cast("int")
    tail = F.substring(text, F.length(text) - n_tail + 1, n_tail)
    return F.when(F.length(text) <= budget, text).when(parts != "", F.substring(parts, F.lit(1), budget)).otherwise(F.concat(head, F.lit("\n\n[... middle omitted ...]\n\n"), tail))


def load_documents(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """RET-7: indexed papers in the order of year and title, each condensed to its share of the budget."""
    indexed = papers.filter("status = 'indexed'")
    n = indexed.groupBy("owner_id").agg(F.count("*").alias("_n"))
    joined = indexed.join(n, "owner_id").join(sections, "paper_id", "left")
    place = F.row_number().over(W.partitionBy("owner_id").orderBy(F.coalesce("year", F.lit(0)), "title", "paper_id"))
    return joined.select("owner_id", "paper_id", "title", place.alias("place"), condense(F.col("full_text"), F.col("sections"), paper_budget(F.col("_n"))).alias("text"))


def phrases(text: Column, most: int = 6, width: int = 8) -> Column:
    """RET-9: phrases to look for: the beginnings of sentences, of the text, and of its middle."""
    x = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    lead = lambda s: F.when(F.size(F.split(s, " ")) >= 4, F.array_join(F.slice(F.split(s, " "), 1, width), " "))
    long_ = F.slice(F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 30), 1, most)
    words = F.split(x, " ")
    middle = F.when(F.size(words) > 2 * width, F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, F.lit(width)), " "))
    every = F.filter(F.concat(F.transform(long_, lead), F.array(lead(x), middle)), lambda p: F.coalesce(F.length(p) > 12, F.lit(False)))
    lows = F.transform(every, lambda p: F.lower(p))
    first = F.filter(F.transform(every, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda s: F.array_position(lows, F.lower(s["p"])) == s["i"] + 1)
    return F.slice(F.transform(first, lambda s: s["p"]), 1, most)


#: Phrases of one automaton, about.
AUTOMATON = 20_000


def locate(passages: DataFrame, pages: DataFrame, window: int = 1) -> DataFrame:
    """RET-10: page and character of the first phrase of a passage that occurs near its hinted page.

    ``passages``: passage_id, paper_id, text, hint. The hinted page comes first, then the next, then the one
    before; all pages in order if the hint is null or no page of the paper. A passage that is not found keeps its
    hint. Offsets count in the page in lower case with single blanks.

    The phrases of a paper are one automaton (Aho and Corasick, 1975), or several if it has very many, and a
    page is read once by each: it is neither searched nor normalised for each phrase.
    """
    phrased = cut(passages.select("passage_id", "paper_id", "hint", F.posexplode(phrases(F.col("text"))).alias("phrase_no", "phrase")), "phrases")
    per_paper = phrased.groupBy("paper_id").agg(F.ceil(F.count("*") / AUTOMATON).cast("int").alias("parts"))
    dealt = phrased.join(per_paper, "paper_id").withColumn("part", F.pmod(F.xxhash64("passage_id"), F.col("parts")).cast("int"))
    wanted = cut(dealt.groupBy("paper_id", "part").agg(F.collect_list(F.struct(F.col("passage_id").cast("string").alias("id"), "hint", "phrase_no", F.lower("phrase").alias("low"))).alias("wanted")), "wanted")
    counts = pages.groupBy("paper_id").agg(F.count("*").alias("n_pages"))
    rows = pages.select("paper_id", "page_no", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("text")).join(counts, "paper_id").join(wanted, "paper_id").select("paper_id", "part", "page_no", "n_pages", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        held, automaton, owners = None, None, {}
        for batch in batches:
            out = ([], [], [], [], [])
            lists = batch.column(5)
            for i, (paper, part, page, n_pages, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if held != (paper, part):
                    held, automaton, owners = (paper, part), ahocorasick.Automaton(), {}
                    for w in lists[i].as_py():
                        owners.setdefault(w["low"], []).append((w["id"], w["hint"], w["phrase_no"]))
                    for low in owners:
                        automaton.add_word(low, low)
                    automaton.make_automaton()
                first = {}
                for end, low in automaton.iter(text or ""):
                    first.setdefault(low, end - len(low) + 1)
                for low, at in first.items():
                    for passage, hint, phrase_no in owners[low]:
                        apart = None if hint is None or not 1 <= hint <= n_pages else page - hint
                        if apart is not None and abs(apart) > window:
                            continue
                        order = page if apart is None else 2 * abs(apart) - (apart > 0)
                        for column, value in zip(out, (passage, order, phrase_no, page, at), strict=True):
                            column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["_id", "order", "phrase_no", "page_no", "offset"])

    met = rows.sortWithinPartitions("paper_id", "part").withColumn("page_no", F.col("page_no").cast("int")).mapInArrow(run, "_id string, order int, phrase_no int, page_no int, offset int")
    best = met.groupBy("_id").agg(F.min(F.struct("order", "phrase_no", "page_no", "offset")).alias("b")).select("_id", "b.*")
    best = best.join(phrased.select(F.col("passage_id").cast("string").alias("_id"), "phrase_no", "phrase"), ["_id", "phrase_no"])
    out = passages.select("passage_id", "hint", F.col("passage_id").cast("string").alias("_id")).join(best, "_id", "left")
    return out.select("passage_id", F.coalesce("page_no", "hint", F.lit(1)).alias("page_no"), "phrase", "offset", F.col("phrase_no").isNotNull().alias("found"))
