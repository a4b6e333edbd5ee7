import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusloom.llm import blocks, jaccard_join
from tests.llm.cases import awkward_texts, documents, empty, words


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(texts, like=0.8):
    sets, keys = sets_of(texts), [tuple((t or "").lower().split()) for t in texts]
    n = len(texts)
    alike = [[i != j and (keys[i] == keys[j] or bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= like * len(sets[i] | sets[j]) - 1e-9) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if alike[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    return {i: (min(j for j in range(n) if keys[j] == keys[i]), sum(alike[i]), root[i]) for i in range(n)}


def found(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in df.collect()}


def test_awkward_rows_against_brute_force(spark):
    texts = awkward_texts()
    rows = jaccard_join.jaccard_groups(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in rows} == brute(texts)
    assert {r["doc_id"] for r in rows if r["kept"]} == {v[2] for v in brute(texts).values()}


def test_frequent_keys_go_through_tiles(spark, monkeypatch):
    """A large group of near copies: units stay small, links are counted once."""
    rng = random.Random(3)
    base = words(9, 80).split()
    texts = []
    for k in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(jaccard_join, "units_of", lambda keys, weights: blocks.units_of(keys, weights, small=4, tile=16))
    assert found(jaccard_join.jaccard_groups(documents(spark, texts, clash=False))) == brute(texts)


def test_empty_table_and_repeated_rows(spark):
    assert jaccard_join.jaccard_groups(empty(spark)).count() == 0
    df = documents(spark, [words(5, 30), words(6, 30)])
    rows = jaccard_join.jaccard_groups(df.union(df)).collect()
    assert sorted((r["doc_id"], r["class_size"], r["n_links"], r["kept"]) for r in rows) == [(i, 2, 1, k) for i in (0, 1) for k in (False, True)]


def test_each_row_counts_whatever_its_id(spark):
    """Null ids and different texts under one id: links, groups and the rows that stay are those of the texts."""
    base = words(11, 90).split()
    near = [" ".join(w if j != 9 * k else f"e{k}" for j, w in enumerate(base)) for k in range(5)]
    rows = [(None, near[0]), (1, near[1]), (1, near[2]), (1, words(12, 40)), (2, words(12, 40).upper()), (None, words(13, 40)), (None, near[3]), (1, near[1]), (3, near[4]), (3, None), (None, "")]
    expected = brute([t for _, t in rows])
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == Counter((i, expected[k][1]) for k, (i, _) in enumerate(rows))
    assert sum(r["kept"] for r in got) == len({v[2] for v in expected.values()})
    assert Counter(r["group_id"] for r in got) == {1: 8, 3: 2, None: 1}
    left = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in left.filter("doc_id is not null and text <> ''").collect()) == sorted([(1, near[1]), (1, words(12, 40))]) and left.count() == 4


def test_band_probability_matches_the_formula():
    """Pairs of a known likeness share a band as often as 1 - (1 - s^rows)^bands says."""
    rng = np.random.default_rng(0)
    hits, pairs = 0, 300
    for _ in range(pairs):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (120, 40, 40))  # s = 0.6
        keys = jaccard_join.band_keys(np.concatenate([common, a, common, b]), np.array([0, 160, 320]), jaccard_join.BANDS, jaccard_join.ROWS)
        hits += bool((keys[0] == keys[1]).any())
    expected = 1 - (1 - 0.6**jaccard_join.ROWS) ** jaccard_join.BANDS
    assert abs(hits / pairs - expected) < 4 * math.sqrt(expected * (1 - expected) / pairs)


def test_shingles_of_short_and_blank_texts():
    hashes, starts = jaccard_join.word_hashes(pa.array(["a b c d e f", "", None, "  ", "A  b\tc", "a b c"]))
    made, first = jaccard_join.shingles(hashes, starts, 5)
    assert list(np.diff(first)) == [2, 0, 0, 0, 1, 1]
    assert made[2] == made[3]


def test_components_are_the_transitive_closure(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r["node"]: r["root"] for r in blocks.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got}
    assert all(root[k] == k and list(root.values()).count(k) == 1 for k in set(root) - set(got))
