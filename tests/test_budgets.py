"""The queries with whole budgets keep what those with small budgets leave out."""

from __future__ import annotations

import hashlib

from corpusloom.plans import documents as P

SCHEMA = "doc_id long, text string"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_a_long_hit_stays_in_the_context(spark, monkeypatch):
    texts = ["a" * 30_000, "b" * 100_000, "c" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    monkeypatch.setattr(P, "search", lambda *_: spark.createDataFrame([(7, i, i) for i in range(3)], "item_id long, doc_id long, place int"))
    monkeypatch.setattr(P, "table", lambda *_: docs)
    blocks = [f"[S{i + 1}] d{i} (n/a)\n{t}" for i, t in enumerate(texts)]
    assert [tuple(r) for r in P.context_pack_full(spark, "").select("item_id", "context", "n_blocks").collect()] == [(7, md5("\n\n---\n\n".join(blocks[:2])), 2)]


def test_long_papers_stay_in_the_pack(spark, monkeypatch):
    rows = [(1, f"p{i}", "T", ["A"], 2000, None, x * 70_000) for i, x in enumerate("abcd")]
    papers = spark.createDataFrame(rows, "owner_id long, paper_id string, title string, authors array<string>, year int, venue string, full_text string")
    monkeypatch.setattr(P, "view", lambda *_: papers)
    blocks = [f"[S{i + 1}] TITLE: T\nAuthors: A | Year: 2000\n\n{x * 60_000}" for i, x in enumerate("abc")]
    assert [tuple(r) for r in P.paper_pack_full(spark, "").select("context", "n_blocks").collect()] == [(md5("\n\n========\n\n".join(blocks)), 3)]


def test_forty_pages_are_recognised(spark, monkeypatch):
    pages = spark.createDataFrame([(1, n, "x" * 500) for n in range(5, 230, 5)], "doc_id long, page_no int, text string")
    monkeypatch.setattr(P, "pages_of", lambda *_: pages)
    row = P.page_provenance_full(spark, "").first()
    assert row["ocr_pages"] == list(range(5, 205, 5)) and row["skipped_pages"] == list(range(205, 230, 5))
