"""The trie of conversation prefixes, by adaptive radix trees over ranges of sorted conversations.

A turn has an identifier of fixed width, so a conversation is a string of bytes and its prefixes
of whole turns are the nodes of a trie. Distinct conversations are sorted over the cluster; a run
of neighbours is one radix tree (Leis et al., 2013). Two neighbouring runs share no nodes but
those on the paths of the keys where they meet, so every other node is final where it is made, and
only these seams are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.mixing import word_count
from corpusloom.storage import cut, scratch

#: Bytes of a turn's identifier in the whole table (MD5), and in one tree (its rank among the tree's turns).
WIDE, WIDTH = 16, 4
#: Turns of one tree, about: its memory does not depend on how the rows are dealt.
TREE_TURNS = 1 << 17
#: Members of a group whose identifiers are one piece of text are of one stretch of so many bits.
STRETCH_BITS = 12


class Node:
    """An inner node or leaf with its compressed path; the layout grows with the number of children.

    Up to 4 and up to 16 children: their bytes, searched. Up to 48: a table of 256 places. Beyond: a
    child for each byte.
    """

    __slots__ = ("path", "layout", "keys", "children", "end")

    def __init__(self, path: bytes, end: int | None = None):
        self.path, self.layout, self.keys, self.children, self.end = path, 4, bytearray(), [], end

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.children[at] if at < 48 else None
        return self.children[byte]

    def add(self, byte: int, child: Node) -> None:
        if self.layout < 256 and len(self.children) == self.layout:
            self.grow()
        if self.layout == 256:
            self.children[byte] = child
            return
        if self.layout == 48:
            self.keys[byte] = len(self.children)
        else:
            self.keys.append(byte)
        self.children.append(child)

    def grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            places = bytearray(b"\xff" * 256)
            for at, byte in enumerate(self.keys):
                places[byte] = at
            self.layout, self.keys = 48, places
        else:
            self.children = [self.children[at] if at < 48 else None for at in self.keys]
            self.layout, self.keys = 256, bytearray()

    def below(self) -> list[Node]:
        return [c for c in self.children if c is not None] if self.layout == 256 else self.children

    def split(self, at: int) -> None:
        """A node of its own for the first ``at`` bytes of the path; what was here hangs below it."""
        lower = Node(self.path[at + 1 :], self.end)
        lower.layout, lower.keys, lower.children = self.layout, self.keys, self.children
        byte, self.path = self.path[at], self.path[:at]
        self.layout, self.keys, self.children, self.end = 4, bytearray(), [], None
        self.add(byte, lower)


def common(a: bytes, b: bytes) -> int:
    """How many bytes ``a`` and ``b`` begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class RadixTree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, end: int) -> None:
        if self.root is None:
            self.root = Node(key, end)
            return
        node, at = self.root, 0
        while True:
            own = key[at : at + len(node.path)]
            if own != node.path:
                node.split(common(own, node.path))
            at += len(node.path)
            if at == len(key):
                node.end = end
                return
            child = node.find(key[at])
            if child is None:
                node.add(key[at], Node(key[at + 1 :], end))
                return
            node, at = child, at + 1

    def walk(self, key: bytes) -> list[Node]:
        """The nodes on the path of a key that was inserted."""
        node, at, out = self.root, 0, []
        while True:
            out.append(node)
            at += len(node.path)
            if at == len(key):
                return out
            node, at = node.find(key[at]), at + 1


FIELDS = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
    "key": pa.binary(), "parent_key": pa.binary(), "tree": pa.int64(), "side": pa.int32(), "words": pa.int64(),
}
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, tree long, side int, words long"


def prefix_keys(key: bytes) -> list[bytes]:
    """128 bits for each prefix of whole turns, the empty one first."""
    state = hashlib.md5()
    out = [state.digest()]
    for at in range(0, len(key), WIDE):
        state.update(key[at : at + WIDE])
        out.append(state.copy().digest())
    return out


def nodes_of(rows: list[tuple], tree_id: int) -> dict[str, list]:
    """The nodes of one run of sorted conversations: key, words of each turn, smallest id, how many, hash of the ids.

    On the seams (the paths of the first and the last key) a row holds what lies beside the seam:
    children, leaves and savings of the nodes that are in no other tree.
    """
    turns = [[key[at : at + WIDE] for at in range(0, len(key), WIDE)] for key, *_ in rows]
    ranks = {turn: rank.to_bytes(WIDTH, "big") for rank, turn in enumerate(sorted({t for own in turns for t in own}))}
    keys = [b"".join(map(ranks.__getitem__, own)) for own in turns]
    tree = RadixTree()
    for at, key in enumerate(keys):
        tree.insert(key, at)
    sides = [(0, keys[0], prefix_keys(rows[0][0]))] + ([(1, keys[-1], prefix_keys(rows[-1][0]))] if len(rows) > 1 else [])
    seam: dict[int, list] = {}
    for side, key, names in sides:
        for node in tree.walk(key):
            seam.setdefault(id(node), []).append((side, names))

    order, stack = [], [(tree.root, -1, -1)]  # node, the byte depth above it, the place of its parent
    while stack:
        node, above, parent = stack.pop()
        at, depth = len(order), max(above, 0) + len(node.path)
        order.append((node, above, parent, depth))
        stack.extend((child, depth + 1, at) for child in node.below())  # the branching byte is in no path
    n, first, leaves, saved, tops, sample = ([0] * len(order) for _ in range(6))
    out: dict[str, list] = {k: [] for k in FIELDS}
    lasts = [-1] * len(order)  # where the last emitted row of a node is, to name its parent
    for at in range(len(order) - 1, -1, -1):
        node, above, parent, depth = order[at]
        if node.end is not None:
            _, _, smallest, times, _ = rows[node.end]
            first[at] = min(first[at], smallest) if n[at] else smallest
            n[at], sample[at] = n[at] + times, node.end
        # the bytes above belong to the node's edge: the branching byte is the last of `above`
        low = -1 if parent < 0 else above - 1
        words, held = rows[sample[at]][1], seam.get(id(node))
        for level in range(depth // WIDTH, low // WIDTH, -1):
            weight = int(words[level - 1]) if level else 0
            ends = rows[node.end][4] if node.end is not None and level * WIDTH == depth else None
            if held is None:
                leaves[at] += not tops[at]
                saved[at] += (n[at] - 1) * weight
                values = (first[at], level, first[at], n[at], tops[at], leaves[at], saved[at], ends, None, None, tree_id, None, weight)
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
                lasts[at], tops[at] = len(out["key"]) - 1, 1
                continue
            for nth, (side, names) in enumerate(held):  # what both seams share is counted on the first
                beside = (n[at], tops[at], leaves[at], saved[at]) if nth == 0 else (0, 0, 0, 0)
                values = (first[at], level, None, *beside, ends, names[level], names[level - 1] if level else None, tree_id, side, weight)
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            tops[at] = 0
        if parent >= 0:
            first[parent] = min(first[parent], first[at]) if n[parent] else first[at]
            n[parent] += n[at]
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
            tops[parent] += tops[at]
            sample[parent] = sample[at]
    emits = [d // WIDTH > (-1 if p < 0 else a - 1) // WIDTH for _, a, p, d in order]
    for at, last in enumerate(lasts):
        if last >= 0:  # the uppermost row of a node has its parent in a node above
            up = order[at][2]
            while not emits[up]:
                up = order[up][2]
            held = seam.get(id(order[up][0]))
            if held is None:
                out["parent_conv_id"][last] = first[up]
            else:
                out["parent_conv_id"][last], out["parent_key"][last] = None, held[0][1][out["depth"][last] - 1]
    return out


def grow_trees(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    rows, turns = [], 0

    def done() -> Iterator[pa.RecordBatch]:
        made = nodes_of(rows, number)
        yield pa.RecordBatch.from_arrays([pa.array(made[k], t) for k, t in FIELDS.items()], names=list(FIELDS))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            turns += 1 + len(row[0]) // WIDE
            if turns >= most:
                yield from done()
                rows, turns, number = [], 0, number + 1
    if rows:
        yield from done()


def hash_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a group is a stream of pieces, of which only the hash is kept."""
    group, state = None, hashlib.sha256()
    for batch in batches:
        done = ([], [])
        for name, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if name != group:
                if group is not None:
                    done[0].append(group)
                    done[1].append(state.hexdigest())
                group, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["_name", "ends_sha256"])
    if group is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["_name", "ends_sha256"])


def ends_of(sequences: DataFrame) -> DataFrame:
    """``_name``, ``ends_sha256``: for each distinct sequence the hash of the identifiers that have it, ascending, with commas.

    Identifiers of one stretch become one piece of text, partly before the shuffle; the hash runs over the pieces.
    """
    pieces = sequences.groupBy("_name", F.shiftright("conv_id", STRETCH_BITS).alias("_stretch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("_ids"))
    return pieces.repartition("_name").sortWithinPartitions("_name", "_stretch").mapInArrow(hash_of_ids, "_name binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """One row per node of the trie of ``sequences`` (``conv_id`` long and unique, ``key`` binary, ``words`` array).

    ``key`` is the identifiers of the turns, ``WIDE`` bytes each, ``words`` how many words each has. A node
    has ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Equal sequences are one key that
    counts as often. Without sequences there is no node, not even a root.

    The identifiers of one sequence (16 bytes a turn, no texts) lie in one row; nothing else is gathered.
    """
    spark = sequences.sparkSession
    with scratch(spark, "trie") as keep:
        rows = cut(sequences.select("conv_id", "key", "words", F.unhex(F.md5("key")).alias("_name")), "sequences")
        alike = rows.groupBy("key", "words", "_name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("times"))
        distinct = cut(alike.join(ends_of(rows), "_name").select("key", "words", "conv_id", "times", "ends_sha256"), "distinct")
        turns = distinct.agg(F.sum(F.octet_length("key") / WIDE + 1)).first()[0] or 0
        trees = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-turns // tree_turns)))
        made = cut(distinct.repartitionByRange(trees, "key").sortWithinPartitions("key").mapInArrow(partial(grow_trees, most=tree_turns), SCHEMA), "nodes")
        at_seams = made.filter("key IS NOT NULL")
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        met = cut(at_seams.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), *(F.max(c).alias(c) for c in ("depth", "parent_key", "words")), F.min(F.struct("tree", "side")).alias("_at")), "met")
        joints = met.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_joints"))
        met = met.join(joints, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_joints", F.lit(0)))
        met = cut(met.withColumn("_leaf", (F.col("n_children") == 0).cast("long")).withColumn("_saves", (F.col("n_convs") - 1) * F.col("words")), "met")
        # each node counts in the one tree where it is met first; every node of that path has what lies below it there
        paths = at_seams.select("key", "tree", "side", "depth").join(met.select("key", "_at", "_leaf", "_saves"), "key")
        here = F.col("_at") == F.struct("tree", "side")
        below = W.partitionBy("tree", "side").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
        paths = paths.select("key", *(F.sum(F.when(here, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("_leaf", "_saves")))
        under = paths.groupBy("key").agg(F.sum("_leaf").alias("_leaves"), F.sum("_saves").alias("_saved"))
        met = met.join(under, "key").withColumns({"n_leaves": F.col("n_leaves") + F.col("_leaves"), "saved_tokens": F.col("saved_tokens") + F.col("_saved")})
        names = cut(met.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")), "names")
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")]
        beside = made.filter("key IS NULL")
        whole = beside.filter("parent_key IS NULL").select(*columns)
        hanging = beside.filter("parent_key IS NOT NULL").select(*beside.columns).unionByName(met.select(*(c if c in met.columns else F.lit(None).cast(beside.schema[c].dataType).alias(c) for c in beside.columns)))
        hanging = hanging.join(names, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent")).select(*columns)
        return keep(whole.unionByName(hanging), "trie")


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``conv_id``, ``key``, ``words`` of each rebuilt conversation.

    Turns go by number, null first; turns of one number by the MD5 of role and text, so that repeated rows
    stay. Null roles and texts are empty; rows without a ``conv_id`` belong to no conversation. Conversation
    c begins with the first h turns of conversation c - c % every (h: CRC-32 of c, modulo ``most``), its own
    turns follow from the h-th on. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"), word_count(text).alias("words"))
    own = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    own = cut(own.select("conv_id", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("own")), "own")
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("own", 1, most - 1).alias("_head"))
    own = own.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % every, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    own = own.join(heads, "_base", "left")
    none = F.array().cast("array<struct<id:string,words:bigint>>")
    turns = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")), F.slice("own", F.col("_h") + 1, F.greatest(F.size("own"), F.lit(1))))
    both = own.select("conv_id", turns.alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("turns.id"), "")).alias("key"), F.col("turns.words").alias("words"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: CRC-32 bit by bit; each conversation's node of depth d is named by the hashes of its first d turns.
SQL = """
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(id := id, w := w) ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY 1),
h AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) % 4 AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.base),
p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
k AS (SELECT conv_id, depth, len(turns) AS ends, coalesce(turns[depth].w, 0) AS w, md5(array_to_string(list_transform(turns[1:depth], lambda t: t.id), '')) AS key,
    CASE WHEN depth > 0 THEN md5(coalesce(array_to_string(list_transform(turns[1:depth - 1], lambda t: t.id), ''), '')) END AS parent FROM p),
kk AS (SELECT conv_id, depth, ends, w, coalesce(key, md5('')) || ':' || depth AS key, parent || ':' || (depth - 1) AS parent FROM k),
n AS (SELECT key, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends = depth), '')) AS ends_sha256 FROM kk GROUP BY key),
c AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
u AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (key)),
s AS (SELECT a.key, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.w) AS saved FROM u JOIN kk a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.key)
SELECT u.conv_id, u.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, u.ends_sha256
FROM u JOIN s USING (key) LEFT JOIN u q ON q.key = u.parent
"""
