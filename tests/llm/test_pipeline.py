from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from corpusloom import storage  # noqa: E402
from corpusloom.llm import exact_dedup, toxicity  # noqa: E402
from corpusloom.llm.wordfeatures import fold  # noqa: E402
from tests.llm.cases import words  # noqa: E402
from tests.llm.test_jaccard_join import brute as near_brute  # noqa: E402
from tests.llm.test_models import toxic_corpus  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    texts, labels = toxic_corpus(500, 7)
    base = words(3, 90).split()
    near = [" ".join(w if j != 10 * k else f"e{k}" for j, w in enumerate(base)) for k in range(5)]
    extra = [texts[1], texts[1] + " ", *near, None, "", words(8, 5000)]
    rows = [(i, t, "en", ["a", "b", "b"][i % 3], len(t or "")) for i, t in enumerate([*texts, *extra])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_does_its_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for _, stage in pipeline.STAGES:
        tables.append(storage.cut(stage(spark, tables[-1], folder)))
    assert [t.columns for t in tables[:-1]] == [COLUMNS] * 5
    rows = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:5]]
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(fold(F.col("doc_id"), 5) != 0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s < 0.5}
    norm = {}
    for i, t in rows[1].items():
        norm.setdefault("".join(c for c in t or "" if c not in exact_dedup.BLANKS), []).append(i)
    assert set(rows[2]) == {min(ids, key=lambda i: (-len(rows[1][i] or ""), i)) for ids in norm.values()}
    ids = sorted(rows[2])
    groups = near_brute([rows[2][i] for i in ids])
    assert set(rows[3]) == {ids[g] for _, _, g in groups.values()}
    times = Counter(r["doc_id"] for r in tables[4].collect())
    assert set(times) <= set(rows[3]) and max(times.values()) <= 2
    packed = tables[5].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == times
    assert max(Counter(r["sequence_id"] for r in packed).values()) >= 1
    assert all(sum(r["length"] for r in packed if r["sequence_id"] == s) <= 2048 for s in list({r["sequence_id"] for r in packed})[:50])


def test_a_second_run_leaves_the_first_result_alone(spark, folder):
    first = pipeline.run(spark, folder)
    rows = sorted(first.collect())
    second = pipeline.run(spark, folder)
    assert sorted(first.collect()) == rows == sorted(second.collect()) and len(rows) > 100


def odd_folder(spark, folder, path):
    """Null and repeated ids, repeated rows, null texts, and columns with the names that operators use inside."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = docs.filter("doc_id % 5 = 0").limit(40)
    extra = spark.createDataFrame([(None, "null id text " + words(70, 60)), (None, "null id text " + words(70, 60)), (None, "another " + words(71, 60)), (None, None), (9_000, "same id one " + words(72, 60)), (9_000, "same id two " + words(73, 60)), (9_001, "twice " + words(74, 60)), (9_001, "twice " + words(74, 60)), (9_002, None), (9_003, " \t")], "doc_id long, text string")
    every = clean.unionByName(extra.selectExpr("doc_id", "text", "'en' AS lang", "cast(null AS string) AS source", "length(text) AS n_chars"))
    for name in ("_key", "_row", "node", "kept", "score", "copies", "piece", "_times"):
        every = every.selectExpr("*", f"'clash' AS {name}")
    every.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return every


def test_odd_rows(spark, folder, tmp_path):
    every = odd_folder(spark, folder, tmp_path)
    tables = [every]
    for _, stage in pipeline.STAGES:
        tables.append(storage.cut(stage(spark, tables[-1], str(tmp_path))))
    assert [t.columns for t in tables[:-1]] == [every.columns] * 5
    texts = lambda t: Counter((r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect())
    kept = [texts(t) for t in tables[:5]]
    assert all(set(b) <= set(a) for a, b in zip(kept, kept[1:]))
    odd = {k: n for k, n in kept[0].items() if k[0] is None or k[0] >= 9_000}
    assert {k: kept[1][k] for k in odd} == odd  # none is toxic, each row stays
    bare = lambda t: "".join((t or "").split())
    assert {bare(t) for _, t in kept[2]} == {bare(t) for _, t in kept[1]} and set(kept[2].values()) == {1}
    assert sum(1 for _, t in kept[2] if not bare(t)) == 1
    assert {bare(t) for i, t in kept[3] if i is None or i >= 9_000} >= {bare(t) for i, t in odd if bare(t)}
    packed = tables[5].filter("piece = 0").groupBy("doc_id").count().collect()
    times = Counter()
    for (i, _), n in kept[4].items():
        times[i] += n
    assert {r["doc_id"]: r["count"] for r in packed} == times and max(kept[4].values()) <= 2


def test_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
