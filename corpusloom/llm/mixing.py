"""Mixing sources to target weights by pivotal dependent rounding (Deville and Tillé, 1998)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.ordering import rank_all
from corpusloom.llm.rows import fetch_rows, row_key
from corpusloom.storage import cut

#: The weights of the sources in turn, the share of all sizes to take, the most copies.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK, FAN_IN = 2048, 64


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source_size``, ``target``.

    Sources in the order of their code points, null last, take ``weights`` in turn. The total is
    split by weight; what would exceed ``most`` times a source's size is split again among the
    others, until none is above. Only sums come to the driver, however many sources there are.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rank_all(totals, [F.col("source").isNull(), F.col("source")], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("_weight", weight).withColumn("_most", most * F.col("source_size"))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0  # of words for one unit of weight; it grows as sources reach their most
    while True:
        above = F.col("_weight") * rate >= F.col("_most")
        x = ranked.agg(F.sum(F.when(above, F.col("_most"))).alias("full"), F.sum(F.when(~above, F.col("_weight"))).alias("open")).first()
        if not x["open"] or (then := (total - (x["full"] or 0)) / x["open"]) <= rate * (1 + 1e-12):
            break
        rate = then
    return ranked.select("source", "source_size", F.least(F.col("_weight") * rate, F.col("_most")).alias("target"))


def mix64(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def uniform(*parts: int) -> float:
    x = 0x9E3779B97F4A7C15
    for part in parts:
        x = mix64((x + part) & (1 << 64) - 1)
    return x / 2**64



def pivotal_round(level: DataFrame, by: list[str], order: list[str], seed: int, tasks: int) -> DataFrame:
    """One level of the tree: within each block all fractions but one become 0 or 1.

    Rows come sorted, so that neighbours of like size exchange mass and the words of a block hardly
    change. A block is a stream: only the open row is held. The blocks go to ``tasks`` tasks: they are
    short rows but much work, so their bytes would put too many into one.
    """
    names = level.columns
    key_at, p_at, copies_at, tie_at = [names.index(k) for k in by], names.index("_p"), names.index("_copies"), names.index("_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, kinds = None, None, None

        def table(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            done, kinds = [], batch.schema.types
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if (key := tuple(row[k] for k in key_at)) != block:
                    if held is not None:
                        done.append(held)
                    block, held = key, row
                    continue
                p, q = held[p_at], row[p_at]
                u = uniform(seed, held[tie_at], row[tie_at])
                if p + q < 1:  # one of them gets nothing
                    winner, loser = (held, row) if u * (p + q) < p else (row, held)
                    winner[p_at], loser[p_at] = p + q, 0.0
                else:  # one of them gets a whole copy
                    loser, winner = (held, row) if u * (2 - p - q) < 1 - q else (row, held)
                    loser[p_at], winner[p_at] = 0.0, p + q - 1
                    loser[copies_at] += 1
                done.append(loser)
                held = winner if winner[p_at] > 1e-12 else None
                if held is None:
                    winner[p_at] = 0.0
                    done.append(winner)
                    block = None
            if done:
                yield table(done)
        if held is not None:
            yield table([held])

    return level.repartition(tasks, *by).sortWithinPartitions(*by, *order).mapInArrow(run, level.schema)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_key: bool = False) -> DataFrame:
    """One row per document: id, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``; ``_key`` (``row_key``) if wanted.

    A document's copies are the rate of its source (target by size, at most ``most``) rounded down,
    plus one with the probability of the rest, such that a source's words stay near its target.
    Null texts have size 0, a null source is a source of its own, repeated rows are documents of
    their own, an empty table gives an empty result, other columns are ignored. Equal input and seed
    give equal results, however the rows are dealt.

    Blocks of about ``BLOCK`` documents of one source and like size are rounded first; what each
    leaves open meets in a tree with ``FAN_IN`` branches until one document per source is open,
    which chance settles. Rows that repeat an id, a text and a source go as one row with their number,
    so however many they are they are no burden; all but one of them are settled by themselves.
    """
    key = {"_key": row_key(id_col, text_col)} if with_key else {}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), F.xxhash64(id_col, text_col).alias("_tie"), *(c.alias(k) for k, c in key.items()))
    rows = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("_same")), "sizes")
    targets = cut(source_targets(rows.select("source", (F.col("size") * F.col("_same")).alias("size")), weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shape = F.floor(F.log2(F.col("size") + 1.0) * 2).cast("int")
    per_shape = cut(rows.groupBy("source", shape.alias("_shape")).agg(F.count("*").alias("_rows")), "shapes")
    known = per_shape.join(targets, per_shape["source"].eqNullSafe(targets["source"])).select(per_shape["source"].alias("_of"), "_shape", "_rows", "source_size", "target", rate.alias("_rate"))
    known = cut(known, "rates")
    parts = F.ceil(F.col("_rows") / BLOCK)
    open_ = rows.withColumn("_s", shape).join(known, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_s") == F.col("_shape"))).select(
        "doc_id", "size", "source", "source_size", "target", "_tie", "_shape", "_same", *key,
        F.pmod(F.col("_tie"), parts).alias("_part"), F.floor(F.col("_rate") + 1e-12).cast("int").alias("_copies"), (F.col("_rate") - F.floor(F.col("_rate") + 1e-12)).alias("_p"),
    )
    # of equal rows as many as their fractions fill up get one more, one is left with the rest
    filled = F.floor(F.col("_same") * F.col("_p") + 1e-12)
    kind = lambda copies, p, times: F.struct(copies.cast("int").alias("_copies"), p.cast("double").alias("_p"), times.cast("long").alias("_times"))
    kinds = F.array(kind(F.col("_copies") + 1, F.lit(0), filled), kind(F.col("_copies"), F.col("_same") * F.col("_p") - filled, F.lit(1)), kind(F.col("_copies"), F.lit(0), F.col("_same") - filled - 1))
    open_ = open_.select("*", F.explode(kinds).alias("_kind")).drop("_copies", "_p", "_same").select("*", "_kind.*").drop("_kind").filter("_times > 0")
    whole = F.col("_p") <= 1e-12
    settled, level = open_.filter(whole), open_.filter(~whole)
    widest, blocks = per_shape.agg(F.max("_rows"), F.sum(F.ceil(F.col("_rows") / BLOCK))).first()
    widest, blocks, most_tasks = widest or 0, blocks or 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts_left, order = -(-widest // BLOCK), ["size", "doc_id", "_tie"]
    keys = ["source", "_shape", "_part"]
    while True:
        # `_block` stands for the keys: a hash deals them, whatever their types and nulls
        level = level.withColumn("_block", F.xxhash64(*keys))
        out = cut(pivotal_round(level, ["_block"], order, seed, max(1, min(blocks, most_tasks))).drop("_block"), "rounded")
        blocks //= FAN_IN
        settled, level = settled.unionByName(out.filter(whole)), out.filter(~whole)
        if keys == ["source"]:
            break
        if parts_left > 1:
            parts_left = -(-parts_left // FAN_IN)
            level = level.withColumn("_part", F.floor(F.col("_part") / FAN_IN))
        else:
            keys = ["source"]
    chance = F.pmod(F.xxhash64("_tie", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) < F.col("_p")
    settled = settled.unionByName(level.withColumn("_copies", F.col("_copies") + chance.cast("int")))
    each = F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int"))).alias("_time")
    out = settled.select("doc_id", "size", "source", "source_size", "target", F.col("_copies").alias("copies"), (F.col("size") * F.col("_copies")).alias("taken"), *key, each)
    return out.drop("_time")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it, all columns kept.

    Rows that repeat an id and a text are one row that comes as often as ``mix`` takes them all.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    copies = mix(docs, **options, with_key=True).groupBy("_key").agg(F.sum("copies").alias("_times")).filter("_times > 0")
    return fetch_rows(docs, id_col, text_col, cut(copies, "copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
