"""Fill-in-the-middle against a plain cut of each text, and the way back."""

import hashlib
import random
import re

import numpy as np

from corpusloom.llm import infill
from tests.llm.cases import awkward_texts, documents, empty


def by_hand(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab\n\n\r é€😀<>PSM") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*awkward_texts(), *made, "\n", "\n\n\n", "a<P>b\nc", "<M", "<", "x\ny<", ">\nP>", "é\n" * 500, "no end", "end\n", "<S\n>", "a\x00b\n\x00", "😀\n😀", "long line " * 30_000 + "\nlast"]


def check(spark, rows, df, **options):
    got = infill.restored(infill.fill_in_middle(df, **options)).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == sorted(((i, *by_hand(i, t, **options)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["restored"]) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_against_cuts_by_hand(spark):
    texts = odd_texts()
    df = documents(spark, texts).withColumnsRenamed({"n_chars": "form"}).selectExpr("*", "1 AS n", "'x' AS output", "2 AS h", "3 AS h0")
    check(spark, list(enumerate(texts)), df)
    check(spark, list(enumerate(texts)), df, seed=3, rate=40, spm=90)


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "a\nb\nc"), (None, "a\nb\nc"), (None, None), (4, "x\ny"), (4, "x\ny"), (4, "z\n\nz")]
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))
    out = infill.restored(infill.fill_in_middle(empty(spark)))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


def test_displacements_do_not_depend_on_the_blocks(monkeypatch):
    bounds, shifts = np.array([0, 3, 3, 9]), np.array([4, -1, 2, 7])
    expected = np.repeat([4, 2, 7], [3, 6, 4])
    for block in (1, 2, 5, 100):
        monkeypatch.setattr(infill, "BLOCK", block)
        assert (np.concatenate([moved for *_, moved in infill.displacements(bounds, shifts, 13)]) == expected).all()


def test_the_query_gives_the_rows_of_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = infill.op13_fill_in_middle(spark, sf)
    found = con.execute(infill.SQL)
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(found.fetchall(), key=repr)
