"""Repeated passages against a dictionary of all windows; the index against plain comparison."""

import random
import re

import numpy as np
import pytest

from corpusloom.llm import fm_index, substring_dedup
from tests.llm.cases import awkward_texts, documents, empty, words


def by_hand(rows, window):
    """(id, text) rows to (id, words, removed, kept, spans)."""
    order = lambda i: (i is None, i or 0)
    texts, first = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows], {}
    for (i, _), w in zip(rows, texts, strict=True):
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < order(i):
                gone[at : at + window] = [True] * window
        spans = [m.span() for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), spans))
    return sorted(out, key=repr)


def found(df, window=substring_dedup.WINDOW, **options):
    rows = substring_dedup.drop_repeats(df, window=window, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], [tuple(s) for s in r["spans"]]) for r in rows), key=repr)


def small_texts(seed, count, vocabulary):
    rng = random.Random(seed)
    word = [f"w{k}" for k in range(vocabulary)]
    passages = [[rng.choice(word) for _ in range(rng.randint(3, 30))] for _ in range(6)]
    texts = []
    for _ in range(count):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [rng.choice(word) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p))
    return texts


@pytest.mark.parametrize(("vocabulary", "crowd"), [(2, 1), (2, 1000), (300, 3), (300, 1000)])
def test_small_windows_against_all_windows(spark, vocabulary, crowd):
    texts = [*small_texts(vocabulary, 60, vocabulary), "a a a a a a a a a a a a", "a a a a a a a", None, ""]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, texts[5]), (7, texts[7]), (7, texts[9]), (-4, texts[11]), (None, "only here " * 9), (None, "only here " * 9)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS key", "1 AS low", "2 AS piece", "'x' AS spans", "'y' AS least")
    assert found(df, window=6, grams=(2, 3), crowd=crowd, shard_words=50) == by_hand(rows, 6)


@pytest.mark.parametrize("crowd", [2, substring_dedup.CROWD])
def test_windows_of_fifty_words(spark, crowd):
    passage, rng = words(9, 70), random.Random(2)
    texts = [*awkward_texts(), *(f"{words(100 + k, rng.randint(0, 60))} {passage} {words(200 + k, 30)}" for k in range(12)), words(300, 49), words(300, 49), words(301, 50), words(301, 50), "same " * 500, "same " * 120, words(400, 3000) + " " + passage]
    assert found(documents(spark, texts), crowd=crowd) == by_hand(list(enumerate(texts)), 50)


def test_no_rows(spark):
    out = substring_dedup.drop_repeats(empty(spark))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "n_removed", "kept", "spans"]


def test_pieces_hold_each_window_once():
    texts = [" ".join(t.split()) for t in small_texts(4, 40, 5)]
    joined = "".join(t + " " for t in texts).encode()
    starts = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])
    for chunk in (7, 1 << 20):
        substring_dedup.CHUNK, held = chunk, substring_dedup.CHUNK
        try:
            w = substring_dedup.Words(np.frombuffer(joined, np.uint8), starts)
            text, first, windows, least = substring_dedup.pieces_in(w, 6, 4)
        finally:
            substring_dedup.CHUNK = held
        got = sorted((t, at + k - int(w.texts[t]), h) for t, at, n, h in zip(text.tolist(), first.tolist(), windows.tolist(), least.tolist(), strict=True) for k in range(n))
        assert [(t, at) for t, at, _ in got] == [(t, at) for t, x in enumerate(texts) for at in range(len(x.split()) - 5)]
        same = {}
        for t, at, h in got:
            assert same.setdefault(tuple(texts[t].split()[at : at + 6]), h) == h


def test_hashes_of_runs_depend_on_their_words_only():
    hashes = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    twice = np.concatenate([hashes, hashes])
    for gram in (1, 2, 3, 7, 8, 32, 37):
        out = substring_dedup.run_hashes(twice, gram)
        assert len(out) == 81 - gram and (out[: 41 - gram] == out[40 : 81 - gram]).all() and len(set(out[:40].tolist())) == 40


def longest_match(text, query, depth):
    held, at = {tuple(text[i : i + n]) for n in range(1, depth + 1) for i in range(len(text) - n + 1)}, 0
    while at < min(depth, len(query)) and tuple(query[: at + 1]) in held:
        at += 1
    return at


@pytest.mark.parametrize("symbols", [2, 3, 40])
@pytest.mark.parametrize("depth", [1, 2, 5, 8])
def test_matching_statistics(symbols, depth):
    rng = np.random.default_rng(symbols * depth)
    text = rng.integers(1, symbols + 1, 300)
    text[rng.integers(0, 300, 12)] = 0
    text[-1] = 0
    index = fm_index.FMIndex(text, symbols + 2, depth)  # one symbol does not occur
    lengths = np.sort(rng.integers(1, 25, 30))[::-1]
    queries = rng.integers(1, symbols + 2, (30, 25))
    for row in range(0, 30, 3):
        at = rng.integers(0, 275)
        queries[row] = np.maximum(text[at : at + 25], 1)
    for back, length, low, high in index.matching_statistics(queries, lengths):
        for row in range(len(length)):
            query = queries[row, lengths[row] - 1 - back : lengths[row]].tolist()
            assert length[row] == longest_match(text.tolist(), query, depth)
            match = query[: length[row]]
            assert high[row] - low[row] == (sum(text[i : i + len(match)].tolist() == match for i in range(300)) if match else 300)


def test_ranks_in_the_wavelet_tree():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 37, 1000)
    tree = fm_index.WaveletTree(values, 37)
    symbols, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert (tree.rank(symbols, at) == [(values[:a] == s).sum() for s, a in zip(symbols, at, strict=True)]).all()

