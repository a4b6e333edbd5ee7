import hashlib

from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup as x
from tests.llm.cases import awkward_texts, documents, empty


def brute(texts):
    norm = ["".join(c for c in t or "" if c not in x.BLANKS) for t in texts]
    out = {}
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        out[i] = (keep, len(same), keep == i, hashlib.sha256(n.encode()).hexdigest())
    return out


def found(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


def test_against_brute_force(spark):
    texts = [*awkward_texts(), "a b", "ab", "a\tb ", "Ab"]
    assert found(x.exact_dedup(documents(spark, texts))) == brute(texts)


def test_equal_hashes_of_different_texts_are_told_apart(spark):
    texts = [f"text {i % 40}" + " " * (i % 3) for i in range(120)]
    collided = x.exact_dedup(documents(spark, texts), key=lambda sha: F.substring(sha, 1, 1))
    assert found(collided) == brute(texts)


def test_no_rows_and_repeated_rows(spark):
    assert x.exact_dedup(empty(spark)).count() == 0
    df = documents(spark, ["a b", "ab", "c"])
    assert sorted(r["doc_id"] for r in x.drop_copies(df.union(df)).collect()) == [0, 2]


def test_no_python_in_the_plan(spark):
    plan = x.exact_dedup(documents(spark, ["a"], clash=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_row_is_decided_however_ids_repeat(spark):
    rows = [(None, "a b"), (None, "c"), (None, "ab"), (None, "c"), (1, "d"), (1, "e e"), (1, "e  e"), (1, "c"), (2, "e e"), (2, None), (None, " ")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    expected = [(None, " "), (None, "a b"), (1, "c"), (1, "d"), (1, "e  e")]
    assert sorted(map(tuple, x.drop_copies(df).collect()), key=str) == sorted(expected, key=str)
    for key in (x.hash128, lambda sha: F.substring(sha, 1, 0)):
        found = x.exact_dedup(df, key=key).collect()
        kept = [(r["doc_id"], r["text_sha256"]) for r in found if r["kept"]]
        assert sorted(kept, key=str) == sorted(((i, hashlib.sha256("".join(t.split()).encode()).hexdigest()) for i, t in expected), key=str)
        assert len(found) == len(rows) * 2
