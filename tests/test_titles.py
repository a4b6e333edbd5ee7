"""Likeness joins and free-text search against all pairs."""

import random
import re

import pytest

from corpusloom.operators import discovery, titles

VOCABULARY = [f"word{k}" for k in range(30)]


def some_titles(seed, count):
    rng = random.Random(seed)
    return [" ".join(VOCABULARY[min(29, int(rng.expovariate(0.15)))] for _ in range(rng.randint(0, 9))) for _ in range(count)]


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8, 1.0])
def test_likeness_against_all_pairs(spark, least):
    left, right = ([(str(i), sorted(set(t.split()))) for i, t in enumerate(some_titles(seed, 150))] for seed in (1, 2))
    frame = lambda rows: spark.createDataFrame(rows, "id string, words array<string>")
    got = titles.similar_sets(frame(left), frame(right), least).collect()
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    assert sorted((r["left_id"], r["right_id"], round(r["likeness"], 9)) for r in got) == sorted((i, j, round(like(a, b), 9)) for i, a in left for j, b in right if like(a, b) >= least)


def test_a_work_is_found_by_doi_then_title_then_words(spark):
    works = [("W1", "Sparse attention for long documents", "10.1/a"), ("W2", "Sparse Attention: for long documents!", None), ("W3", "Dense retrieval of short passages", "10.1/c"), ("W4", None, None), ("W5", "!!", None), ("W10", "dense retrieval of short passages", None)]
    papers = [("a", "other title", "10.1/C"), ("b", "sparse attention for LONG documents", "10.9/none"), ("c", "Dense retrieval for short passages", None), ("d", "nothing like it", None), ("e", None, None), ("f", "??", None), ("g", "", "10.1/a")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, title string, doi string")
    found = discovery.find_works(frame(papers, "paper_id"), frame(works, "external_id"))
    assert sorted(map(tuple, found.select("paper_id", "external_id", "matched_by").collect())) == [("a", "W3", "doi"), ("b", "W1", "title"), ("c", "W3", "words"), ("g", "W1", "doi")]


def test_papers_meet_one_work_per_key(spark, monkeypatch):
    """300 papers and 400 works of one DOI, and of one title, are rows in proportion, not 120,000 pairs."""
    written = {}

    def spy(df, name="step"):
        out = kept(df, name)
        written[name] = out.count()
        return out

    kept = discovery.cut
    monkeypatch.setattr(discovery, "cut", spy)
    works = spark.range(400).selectExpr("concat('W', id + 1) AS external_id", "'one title' AS title", "CASE WHEN id < 200 THEN '10.1/X' END AS doi")
    papers = spark.range(300).selectExpr("concat('p', id) AS paper_id", "'One, title' AS title", "CASE WHEN id % 2 = 0 THEN '10.1/x' ELSE '10.9/none' END AS doi")
    found = discovery.find_works(papers, works).groupBy("external_id", "matched_by").count().collect()
    assert sorted(map(tuple, found)) == [("W1", "doi", 150), ("W1", "title", 150)]
    assert written["first"] == 2


@pytest.mark.parametrize("postings", [0, 3, 12, 40, 5000])
def test_search_against_counting_every_work(spark, postings):
    works = [(f"W{i}", t, 2000 + i % 20) for i, t in enumerate(some_titles(3, 200))] + [("N", None, None)]
    queries = [(i, t) for i, t in enumerate([*some_titles(4, 40), "word0", "word0 word1 word2 word3", "word29 word28 word27 word0", None, "", "unknown"])]
    words = lambda t: set(re.findall("[a-z0-9]{4,}", (t or "").lower()))
    for floor in (None, 2010):
        got = titles.search_works(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(works, "external_id string, title string, year int"), 5, floor, postings).collect()
        expected = []
        for i, t in queries:
            hits = sorted((-len(words(t) & words(w)), x) for x, w, y in works if words(t) & words(w) and (floor is None or y and y >= floor))
            expected += [(i, x, -n, place) for place, (n, x) in enumerate(hits[:5], 1)]
        assert sorted((r["query_id"], r["external_id"], r["n_words"], r["place"]) for r in got) == sorted(expected)
