import hashlib
import struct

import xxhash

from corpusloom.llm import fingerprints as fp
from tests.llm.cases import awkward_texts, documents, empty, words
from pyspark.sql import functions as F


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sketch(text, k=fp.K, n=5):
    w = (text or "").lower().strip(fp.SPACE)
    if not w:
        return []
    h = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) for x in w.split()]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
        return signed(seed)

    every = {chain(h[i : i + n]) for i in range(len(h) - n + 1)} if len(h) >= n else {chain(h)}
    return sorted(every)[:k]


def likeness(a, b, k=fp.K):
    if not a and not b:
        return 1.0
    union = sorted({*a, *b})
    union = union if len(a) < k and len(b) < k else union[:k]
    return len({*union} & {*a} & {*b}) / len(union)


def text_of(s):
    return "".join(f"{x & (1 << 64) - 1:016X}" for x in s)


def test_against_brute_force(spark):
    texts = awkward_texts()
    rows = {r["doc_id"]: r for r in fp.fingerprint_edits(documents(spark, texts)).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text_of(sketch(text)), text_of(sketch(edited)))
        assert abs(r["near_edited"] - likeness(sketch(text), sketch(edited))) < 1e-12
        assert abs(r["near_next"] - likeness(sketch(text), sketch(after))) < 1e-12


def test_one_row_repeated_rows_and_no_rows(spark):
    assert fp.fingerprint_edits(empty(spark)).count() == 0
    df = documents(spark, ["a b c d e f g h"])
    rows = fp.fingerprint_edits(df.union(df)).collect()
    assert len(rows) == 2 and {r["near_next"] for r in rows} == {1.0}


def test_merge_containment_and_count(spark):
    a, b = words(1, 3000), words(2, 3000)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " " + b), (3, a)], "key long, text string")
    made = fp.with_sketch(df, "text", "s")
    merged = {r["key"]: r["s"] for r in fp.merge_sketches(made, "key", "s").collect()}
    every = sorted({*sketch(a), *sketch(b)})[: fp.K]
    assert merged[1] == every and merged[3] == sketch(a)
    pair = made.filter("key = 3").select(F.col("s").alias("x")).crossJoin(made.filter("key = 2").select(F.col("s").alias("y")))
    r = pair.select(fp.containment(F.col("x"), F.col("y")).alias("in"), fp.containment(F.col("y"), F.col("x")).alias("out"), fp.distinct_shingles(F.col("y")).alias("n")).first()
    assert r["in"] > 0.75 and 0.35 < r["out"] < 0.65 and 4500 < r["n"] < 7500


def test_no_python_in_the_plan(spark):
    df = fp.fingerprint_edits(documents(spark, ["a b c"], clash=False))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
