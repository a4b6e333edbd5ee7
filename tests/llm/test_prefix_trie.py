"""The trie of prefixes against a dictionary of all prefixes."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from corpusloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_members) - 1) * words
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), len(children[v]), leaves[v], saved[v], digest(ends[v])) for v, m in members.items())


def found(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def conversations(seed, count, kinds, longest=7):
    rng = random.Random(seed)
    pool = [(rng.choice(["user", "bot", None, ""]), " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 4))) + f" {k}") for k in range(kinds)]
    rows = [(c, turn, *rng.choice(pool)) for c in range(count) for turn in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


AWKWARD = [
    (None, 0, "user", "lost"), (1, None, None, None), (1, None, None, None), (1, 0, "", ""), (2, 3, "u", "a b"), (2, 3, "u", "a b"), (2, 3, "u", "a c"), (3, -1, "u", "x\ty\x0bz"),
    (20, 0, "user", "hello there"), (20, 1, "bot", "hi"), (21, 0, "z", "only"), (22, 0, "user", "hello there"), (22, 1, "bot", "hi"), (25, 5, "q", "unused"), (45, 0, "q", "no base"), (-7, 0, "q", "negative"), (-20, 0, "q", "base"), (10**15, 0, "u", "far"),
    *((c, 0, "same", "copy") for c in range(3000, 3060)), *((c, t, "user", "long " * 3000) for c in (60, 61) for t in range(300)),
]


@pytest.mark.parametrize("rows", [AWKWARD, conversations(1, 150, 3), conversations(2, 80, 400), conversations(3, 300, 2, 12), [(5, 0, "a", "b")], [(5, 0, "a", "b"), (6, 0, "a", "b")]], ids=["awkward", "few turns", "many turns", "deep", "one", "two"])
@pytest.mark.parametrize("tree_turns", [1, 9, 1 << 17])
def test_against_all_prefixes(spark, rows, tree_turns):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS key", "1 AS words", "2 AS depth", "'x' AS own", "'y' AS tree")
    assert found(prefix_trie.prefix_trie(prefix_trie.rebuilt(df), tree_turns)) == by_hand(rows)


def test_no_conversations(spark):
    out = prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)))
    assert out.count() == 0
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA))).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_layouts_grow_and_keep_their_children():
    tree, keys = prefix_trie.RadixTree(), [bytes([a, b, 7]) for a in (0, 9) for b in range(256)] + [b"", b"\x09", b"\x09\x05\x07\x01\x02"]
    random.Random(1).shuffle(keys)
    layouts = set()
    for at, key in enumerate(keys):
        tree.insert(key, at)
        layouts |= {node.layout for node in tree.walk(key)}
    assert layouts == {4, 16, 48, 256}
    for at, key in enumerate(keys):
        assert tree.walk(key)[-1].end == at
    stack, ends = [(tree.root, b"")], []
    while stack:
        node, above = stack.pop()
        ends += [(above + node.path)] * (node.end is not None)
        bytes_of = {48: lambda: [b for b in range(256) if node.keys[b] < 48], 256: lambda: [b for b in range(256) if node.children[b]]}.get(node.layout, lambda: list(node.keys))()
        assert len(bytes_of) == len(node.below())
        stack += [(node.find(b), above + node.path + bytes([b])) for b in bytes_of]
    assert sorted(ends) == sorted(keys)


def test_paths_are_compressed():
    tree = prefix_trie.RadixTree()
    tree.insert(b"abcdefgh", 0)
    tree.insert(b"abcdxyzw", 1)
    assert tree.root.path == b"abcd" and [n.path for n in tree.root.below()] == [b"fgh", b"yzw"]


def test_the_query_gives_the_rows_of_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = prefix_trie.op11_prefix_trie(spark, sf)
    rows = con.execute(prefix_trie.SQL)
    assert [d[0] for d in rows.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows.fetchall(), key=repr)
