"""Candidate pairs from shared keys, without listing the pairs, and connected components.

Nodes that share a key are candidates. Keys that few nodes share become small units: equal sets of
nodes are one unit however many keys they share. Nodes that meet under a frequent key go by the
component of frequent keys they belong to; a hash deals a component into tiles, and each pair of
tiles is a unit. So a unit is bounded, every candidate pair is in one, and ``pair_bands`` tells in
which one a pair counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import cut

SMALL, TILE, TILE_WEIGHT = 32, 128, 1 << 18


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for each node of ``edges``.

    Large-star and small-star steps (Kiveris et al., 2014) on tables: a step links a node's
    neighbours to the smallest of them. Minima are aggregates, partly before the shuffle, and are
    written, so that the join back can be split where a node has very many neighbours. Null ends
    and loops are ignored.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v")
    state, seen = cut(pairs.distinct(), "edges"), None

    def star(both: DataFrame, only_larger: bool) -> DataFrame:
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        joined = both.join(least, "u")
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if only_larger else joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return cut(out.filter("u > v").distinct(), "star")

    while True:
        state = star(state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        state = star(state, False)
        now = tuple(state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def units_of(keys: DataFrame, weights: DataFrame, small: int = SMALL, tile: int = TILE, tile_weight: int = TILE_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """Units of candidates, and for each node that has candidates which of its keys are frequent.

    ``keys``: ``node``, ``band``, ``key`` (a key stands for its band too). ``weights``: ``node``,
    ``weight``. Returns ``unit``, ``node``, ``side`` (0, 1, or 2 for both), ``band`` (-1 in tiles),
    and ``node``, ``hot_bands`` as a sorted array.
    """
    counts = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1"), "counts")
    members = cut(keys.join(counts, "key"), "members")
    few = members.filter(F.col("n") <= small)
    few = few.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.min("band").alias("band"))
    few = few.groupBy("nodes").agg(F.min("band").alias("band"))
    units = few.select(F.xxhash64("nodes").alias("unit"), F.explode("nodes").alias("node"), F.lit(2).alias("side"), "band")
    many = members.filter(F.col("n") > small)
    hot = cut(many.groupBy("node").agg(F.array_sort(F.collect_list("band")).alias("hot_bands")), "hot")
    if not hot.isEmpty():
        roots = components(many.select(F.col("node").alias("a"), F.col("head").alias("b")))
        rows = cut(roots.join(weights, "node"), "roots")
        tiles = F.ceil(F.greatest(F.count("*") / tile, F.sum("weight") / tile_weight)).cast("int").alias("tiles")
        sizes = cut(rows.groupBy("root").agg(tiles), "tiles")
        dealt = rows.join(sizes, "root").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        pairs = dealt.select("root", "node", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
        side = F.when(F.col("t") == F.col("o"), 2).when(F.col("t") < F.col("o"), 0).otherwise(1)
        unit = F.xxhash64("root", F.least("t", "o"), F.greatest("t", "o"))
        units = units.unionByName(pairs.select(unit.alias("unit"), "node", side.alias("side"), F.lit(-1).alias("band")))
    nodes = members.select("node").distinct().join(hot, "node", "left").withColumn("hot_bands", F.coalesce("hot_bands", F.array().cast("array<int>")))
    return cut(units, "units"), cut(nodes, "nodes")


def pair_bands(keys: np.ndarray, hot: np.ndarray, left: np.ndarray, right: np.ndarray, band: int) -> np.ndarray:
    """Which pairs (left x right) of a unit count in it.

    keys: a row of band keys for each node. hot: which of them are frequent. In tiles a pair counts
    if it shares a frequent key; in small units if it shares none and its first common band is the
    unit's. So a pair counts once, however many units it is in.
    """
    first = np.full((len(left), len(right)), -1)
    shares_hot = np.zeros((len(left), len(right)), bool)
    for k in range(keys.shape[1] - 1, -1, -1):
        same = keys[left, k][:, None] == keys[right, k][None, :]
        shares_hot |= same & hot[left, k][:, None] & hot[right, k][None, :]
        first[same] = k
    return shares_hot if band < 0 else ~shares_hot & (first == band)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of ``n`` nodes under the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root
