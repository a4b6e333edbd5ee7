"""Small cases of the operators: those that have no SQL form, and the awkward ones."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import discovery as X
from corpusloom.operators import documents as D
from corpusloom.operators import graph as G
from corpusloom.operators import listings as L
from corpusloom.operators import results as R
from corpusloom.operators import vectors as V
from corpusloom.plans import ALL_ORACLE, ALL_QUERIES
from corpusloom.sources import tables as S
from corpusloom.storage import shared_dir


def one(spark, col, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items()))
    assert df.columns == names
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("MedQA [S1]", "MedQA"), ("ROUGE-L (S2)", "ROUGE-L"), ("[BERT]", "BERT"), (None, ""), ("Convolutional Neural Network (CNN)", "Convolutional Neural Network (CNN)"), ("(a) and (b)", "(a) and (b)"), ("Net (", "Net"), ("x )", "x")],
)
def test_clean_name(spark, raw, clean):
    assert one(spark, T.clean_name(F.col("v")), v=raw) == clean


@pytest.mark.parametrize(
    ("name", "forms"),
    [("Convolutional Neural Network (CNN", ["Convolutional Neural Network (CNN", "Convolutional Neural Network", "CNN"]), ("Gaussian Mixture Models (GMMs", ["Gaussian Mixture Models (GMMs", "Gaussian Mixture Models", "GMM"]), ("BERT", ["BERT"]), ("", [])],
)
def test_name_variants(spark, name, forms):
    got = one(spark, T.name_variants(F.col("v")), v=name)
    assert got[1:] == forms[1:] and len(got) == len(forms)


def test_canonical_key(spark):
    assert one(spark, T.canonical_key(F.col("v")), v="  The BERT ") == "bert"


@pytest.mark.parametrize(
    ("text", "kind", "label"),
    [
        ("Figure 3. The architecture of the model", "figure", "Figure 3"), ("Fig. 12: Loss over time steps", "figure", "Figure 12"), ("TABLE III Results of all runs", "table", "Table III"),
        ("Algorithm 1 Training loop of it", "algorithm", "Algorithm 1"), ("Fig. 20). as mentioned before", None, None), ("Table III contains the results", None, None), ("Figure illustrates the idea well", None, None), ("Fig. 1", None, None),
    ],
)
def test_captions(spark, text, kind, label):
    got = one(spark, T.caption(F.col("v")), v=text)
    assert (got and got["kind"], got and got["label"]) == (kind, label)


def test_names_and_keys(spark):
    assert [one(spark, f(F.col("v")), v=n) for n in ("Lovelace, Ada", "Plato", "Jean-Luc Picard") for f in (T.family, T.given)] == ["Lovelace", "Ada", "Plato", "", "Picard", "Jean-Luc"]
    assert one(spark, T.citation_key(F.col("a"), F.lit(None).cast("int"), F.col("t")), a=["Zoë Müller"], t="The Using Deep graphs") == "mullernodatedeep"
    assert one(spark, T.latex(F.col("v")), v=r"a&b_c~d^e") == r"a\&b\_c\textasciitilde{}d\textasciicircum{}e"


def test_a_number_in_the_title_is_no_year(spark):
    head = "A study of  item number 2011\nAda Lovelace\nProceedings of the 1991 Workshop"
    year = lambda text, title: one(spark, T.year(F.col("v"), title_=F.col("t")), v=text, t=title)
    assert year(head, "A study of item number 2011") == 1991 and year(head, None) == 2011
    assert year("arXiv:2105.12345\n" + head, "A study of item number 2011") == 2021
    assert year(head + "\nAbstract\nin 2085", "A study of item number 2011") == 1991 and year("Abstract\nin 2085", None) is None
    assert one(spark, T.year(F.col("v")), v=head) == 2011


def test_doc_identifiers_of_documents_whose_number_is_like_a_year(spark, tmp_path):
    spark.createDataFrame([(i, f"some text of {i + 10}", "en", "src1", 9) for i in (1949, 2011, 2012, 2014)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["year"] for r in ALL_QUERIES["doc_identifiers"](spark, str(tmp_path)).collect()}
    duck = duckdb.sql(ALL_ORACLE["doc_identifiers"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert got == {i: y for i, _, y, _ in duck}


@pytest.mark.parametrize(("length", "rest", "found"), [(79, "", None), (80, "", 80), (79, "\n1 Introduction\nmore", 99), (80, "\n1 Introduction\nmore", 80)])
def test_an_abstract_has_80_characters_after_its_marks(spark, length, rest, found):
    got = one(spark, T.abstract(F.col("v")), v="Abstract: \n" + "x" * length + rest)
    assert (got and len(got)) == found


@pytest.mark.parametrize("size,overlap", [(60, 15), (200, 50), (1200, 200)])
def test_recursive_chunks(size, overlap):
    rng = random.Random(size)
    text = "".join(rng.choice(["word ", "a. ", "why? ", "line\n", "para\n\n", "x" * rng.randint(1, 90), ", "]) for _ in range(800))
    pieces = C.split_text(text, size, overlap)
    covered = set()
    for at, piece in pieces:
        assert text[at : at + len(piece)] == piece and len(piece) <= size and piece.strip() == piece
        covered |= set(range(at, at + len(piece)))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert all(b[0] >= a[0] and b[0] >= a[0] + len(a[1]) - overlap - 1 for a, b in zip(pieces, pieces[1:]))
    assert C.split_text("", size, overlap) == [] and C.split_text(" \n ", size, overlap) == []


@pytest.mark.parametrize(
    ("lines", "at", "section"),
    [
        (["Abstract", "x" * 30, "1 Introduction", "y" * 30, "References", "none"], 42, "references"), (["Abstract", "x" * 30, "1 Introduction", "y" * 200], 42, "introduction"), (["Abstract", "x" * 30, "1 Introduction", "y" * 30, "References", "none"], 40, "introduction"),
        (["Abstract", "x" * 30, "   Introduction", "y" * 30, "References", "none"], 43, "introduction"), (["Introduction", "this is our", "model results", "x"], 31, "method"), (["a model", "x"], 2, None), (["x", "Results"], 0, "results"),
    ],
)
def test_the_rest_of_a_cut_line_is_no_heading(spark, lines, at, section):
    text = "\n".join(lines)
    papers = spark.createDataFrame([("p", text)], "paper_id string, t string")
    chunks = spark.createDataFrame([("p", 0, at, text[at:])], "paper_id string, idx int, start int, text string")
    out = C.section_of(chunks, D.heading_marks(papers, "paper_id", "t"), "paper_id", T.heading)
    assert out.columns == ["paper_id", "idx", "start", "text", "section"] and out.first()["section"] == section


def test_hash_embedder_is_deterministic_and_near_for_related_texts():
    a, b, c, zero = C.hash_embedder(256)(["deep learning for speech", "speech with deep learning", "ferry timetables in winter", ""])
    assert abs(float(a @ a) - 1) < 1e-5 and float(a @ b) > float(a @ c) and not zero.any()


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([], []), ([0.0], [0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r["x"] for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, 0.0, 0.0, 1.0]


def test_packing_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "b" * 9), (1, 2, "c")], "k int, o int, b string")
    assert V.pack_blocks(df, "k", "o", "b", 10, "|").first()["context"] == "aaaa"


ASH_NODES = [("ash", "Volcanic Ash", "Concept", ["p1"]), ("seed", "Cloud Seeds", "Concept", ["p1", "p2"]), ("glow", "Albedo", "Concept", ["p1", "p3"]), ("vine", "Harvest Date", "Concept", ["p2", "p3"]), ("hub", "Survey", "Concept", ["p5"]), *((f"s{i}", f"Ship Route {i}", "Concept", [f"p{10 + i}"]) for i in range(4))]
ASH_EDGES = [("ash", "seed", "AFFECTS", ["p1"]), ("ash", "glow", "AFFECTS", ["p1"]), ("seed", "vine", "AFFECTS", ["p2"]), ("vine", "glow", "USES", ["p3"]), ("ash", "hub", "USES", ["p1"]), *(("hub", f"s{i}", "USES", [f"p{10 + i}"]) for i in range(4)), ("ash", "s0", "MENTIONS", ["p1"])]
NODE, EDGE = "id string, name string, type string, papers array<string>", "source string, target string, type string, papers array<string>"


def discover(spark, nodes, edges, **kw):
    ent, adj = X.entity_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    return [r["c_name"] for r in X.open_discovery(spark.createDataFrame([("ash",)], "id string"), ent, adj, **kw).orderBy("place").collect()]


def test_open_discovery(spark):
    assert discover(spark, ASH_NODES, ASH_EDGES)[0] == "Harvest Date"
    assert "Harvest Date" not in discover(spark, ASH_NODES, [*ASH_EDGES, ("vine", "ash", "CITES", ["p9"])])
    shared = [n if n[0] != "vine" else (*n[:3], ["p1"]) for n in ASH_NODES]
    assert "Harvest Date" not in discover(spark, shared, ASH_EDGES) and "Harvest Date" in discover(spark, shared, ASH_EDGES, disjoint=False)


def test_aliases_merge(spark):
    nodes = spark.createDataFrame([("a", "CNN", "Method", ["p1"]), ("b", "Convolutional Neural Network (CNN)", "Method", ["p1", "p2"]), ("c", "LSTM", "Method", ["p3"])], NODE)
    got = {r["id"]: r["canonical"] for r in G.resolve_entities(nodes).collect()}
    assert got == {"a": "b", "b": "b", "c": "c"}


def test_graph_components_are_the_closure(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in G.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and all(root[k] == k for k in set(root) - set(got))


def test_removal_keeps_what_was_empty_from_the_start(spark):
    nodes = spark.createDataFrame([("x", "X", "Method", ["p1"]), ("y", "Y", "Method", ["p1", "p2"]), ("z", "Z", "Method", []), ("paper:p1", "P", "Paper", [])], NODE)
    edges = spark.createDataFrame([("x", "y", "USES", ["p1"]), ("y", "z", "USES", ["p1", "p2"])], EDGE)
    n, e = G.remove_papers(nodes, edges, spark.createDataFrame([("p1",)], "paper_id string"))
    assert {r["id"]: r["papers"] for r in n.collect()} == {"y": ["p2"], "z": []} and [r["target"] for r in e.collect()] == ["z"]


def test_markers_and_parsing(spark):
    texts = spark.createDataFrame([(1, "True [S1]. Invented [S9]. Also true [S2]."), (2, "A claim [S7]."), (3, "none")], "review_id int, text string")
    valid = spark.createDataFrame([(1, ["S1", "S2"]), (2, ["S1"])], "review_id int, markers array<string>")
    got = {r["review_id"]: (r["text"], r["used"]) for r in R.clean_citations(texts, valid).collect()}
    assert got == {1: ("True [S1]. Invented. Also true [S2].", ["S1", "S2"]), 2: ("A claim.", []), 3: ("none", [])}
    for raw, found in (('x {"a": 1,} y', 1), ("```json\n{\"a\": 2}\n```", 2), ("3", None), (None, None)):
        x = one(spark, R.parse_json(F.col("v"), "a int"), v=raw)
        assert (x and x["a"]) == found


def test_matrix_keys():
    assert [k for k, _ in R.column_keys(["Sample size", "Size", "Size", "size", "", "!!"])] == ["sample_size", "size", "size_2", "size_3", "column"]


def test_roll_up_without_checkable_claims(spark):
    rows = spark.createDataFrame([("v", False, "unsupported"), ("w", True, "supported"), ("w", True, "partially_supported")], "verification_id string, checkable boolean, verdict string")
    got = {r["verification_id"]: (r["checked"], r["score"], r["unsupported"], r["problems"]) for r in R.roll_up(rows).collect()}
    assert got == {"v": (0, 0.0, 0, 0), "w": (2, 0.75, 0, 0)}


def test_reading_order_of_a_stray_line(spark):
    schema = "paper_id string, page_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, width double, height double"
    rows = [("p", 1, f"l{i}", 60.0, 20.0 * i, 260.0, 20.0 * i + 10, 0.9, 600.0, 800.0) for i in range(7)] + [("p", 1, "stray", 500.0, 60.0, 560.0, 70.0, 0.9, 600.0, 800.0)]
    got = D.reading_order(spark.createDataFrame(rows, schema)).first()
    assert got["n_columns"] == 1 and got["text"].split("\n")[3] == "l3 stray"


def test_files_are_judged(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"hello there")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-" + b"x" * 2_000_000)
    got = {r["filename"]: r["reason"] for r in S.scan_binaries(spark, str(tmp_path), max_mb=1).collect()}
    assert got == {"a.pdf": None, "b.pdf": "empty file", "c.pdf": "wrong type", "d.pdf": "too large"}


def test_sinks(spark, tmp_path):
    papers = spark.createDataFrame([("p2", "B", ["Zed Y"], 2000), ("p1", "A", ["Ann X"], 2001)], "paper_id string, title string, authors array<string>, year int")
    S.write_bibliography(papers, "apa", f"{tmp_path}/bib")
    assert [r["value"].split(",")[0] for r in spark.read.text(f"{tmp_path}/bib").filter("value <> ''").collect()] == ["X", "Y"]
    matrix = spark.createDataFrame([("p1", ["a", "b"], "yes")], "paper_id string, k array<string>, open string")
    S.matrix_to_csv(matrix, papers, [("k", "Kinds"), ("open", "Open")], f"{tmp_path}/csv")
    row = spark.read.option("header", "true").csv(f"{tmp_path}/csv").first()
    assert row.asDict() == {"Paper": "A", "Kinds": "a; b", "Open": "yes"}
    runs = spark.createDataFrame([("r", None, ["x"]), ("s", "bad", []), ("t", None, [])], "run_id string, error string, errors array<string>")
    S.append_runs(runs, f"{tmp_path}/runs")
    S.append_runs(runs.filter("run_id = 't'"), f"{tmp_path}/runs")
    assert sorted((r["run_id"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/runs").collect()) == [("r", "partial"), ("s", "failed"), ("t", "completed"), ("t", "completed")]


def test_label_of_a_run(spark):
    label = L.run_label(F.col("q"), F.col("r"), F.lit(2))
    assert one(spark, label, q=" ", r='{"gaps": [{"title": "T"}]}') == "1 gap — T" and one(spark, label, q="", r="{}") == "2 papers"


def test_no_cartesian_product_where_keys_exist(spark):
    """Plans of joins by key: no product, no Python."""
    from corpusloom.plans import ALL_QUERIES

    for name in ("doc_sections", "chunk_page", "hash_embed", "rrf_search", "extract_aggregate", "related_works", "owner_scope"):
        plan = ALL_QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name


def test_terms_meet_names_on_their_rarest_runs(spark):
    """Against comparing each term with each name; no nested loop in the plan."""
    rng = random.Random(3)
    names = [(f"e{i}", "".join(rng.choice("abc é-") for _ in range(rng.randint(1, 12)))) for i in range(300)] + [("e9", "same name"), ("e1", "same name"), ("aa", "other"), ("x", "ABC Def")]
    names = list({i: (i, n) for i, n in names}.values())
    terms = ["a", "b-", "abc", " AB ", "cab", "é", "zzz", "", " ", None, "same name", "name", "aa", "c é", "bc def", "a" * 20] + [n[2:6] for _, n in names[:60]]
    low = lambda t: t.strip(" ").lower()
    expected = {}
    for t in {t for t in terms if t and low(t)}:
        ways = [(0, 0, i) for i, _ in names if i == low(t)] or [(1, 0, i) for i, n in names if low(n) == low(t)] or [(2, len(n), i) for i, n in names if low(t) in n.lower()]
        if ways:
            expected[t] = min(ways)[2]
    found = X.resolve_terms(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(names, "id string, name string"))
    assert {r["term"]: r["id"] for r in found.collect()} == expected
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_hubs_are_dealt_over_keys(spark, monkeypatch):
    """Open discovery over a hub with many links gives the same rows however its links are dealt."""
    rng = random.Random(8)
    links = {(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}", rng.choice(["USES", "PART"]), f"p{rng.randint(0, 60)}") for _ in range(60)} | {("hub", f"n{i}", "USES", f"q{i}") for i in range(31)}
    edges = spark.createDataFrame([(a, b, t, [p]) for a, b, t, p in links if a != b], "source string, target string, type string, papers array<string>")
    adjacent = G.adjacency(edges)
    entities = adjacent.select("id", F.explode("papers").alias("p")).groupBy("id").agg(F.collect_set("p").alias("papers")).select("id", F.concat(F.lit("name "), "id").alias("name"), F.lit("Method").alias("type"), "papers")
    start = spark.createDataFrame([("n1",), ("n2",), ("hub",), ("none",)], "id string")
    got = []
    for most in (10_000, 3):
        monkeypatch.setattr(X, "HUB_LINKS", most)
        got.append((sorted(map(str, X.open_discovery(start, entities, adjacent).collect())), sorted(map(str, X.open_diagnostics(start, entities, adjacent).collect()))))
    assert got[0] == got[1] and len(got[0][0]) > 20


def test_passages_are_located_as_by_looking_page_by_page(spark, monkeypatch):
    rng = random.Random(4)
    pages = {p: [" ".join(rng.choice(["Alpha", "beta", "gamma\n", "Delta.", "épsilon", "zeta"]) for _ in range(60)) for _ in range(4)] for p in ("p", "q")}
    passages = [(i, rng.choice("pqr"), " ".join(rng.choice(sum(pages.values(), [])).split()[20:50]) if i % 4 else "nothing like this occurs anywhere", rng.choice([None, 0, 1, 2, 3, 4, 9])) for i in range(60)] + [(90, "p", None, 2), (91, "p", "", None)]
    df = spark.createDataFrame(passages, "passage_id int, paper_id string, text string, hint int")
    forms = {r["passage_id"]: r["f"] for r in df.select("passage_id", V.phrases(F.col("text")).alias("f")).collect()}

    def look(paper, hint, phrases):
        own = pages.get(paper, [])
        order = [n for n in (hint, hint + 1, hint - 1) if 1 <= n <= len(own)] if hint and 1 <= hint <= len(own) else range(1, len(own) + 1)
        for n in order:
            text = " ".join(own[n - 1].split()).lower()
            for phrase in phrases:
                if phrase.lower() in text:
                    return n, phrase, text.index(phrase.lower()), True
        return (hint if hint is not None else 1), None, None, False

    rows = spark.createDataFrame([(p, n + 1, t) for p, own in pages.items() for n, t in enumerate(own)], "paper_id string, page_no int, text string")
    expected = sorted((i, *look(p, h, forms[i])) for i, p, _, h in passages)
    for most in (20_000, 7):
        monkeypatch.setattr(V, "AUTOMATON", most)
        assert sorted((r["passage_id"], r["page_no"], r["phrase"], r["offset"], r["found"]) for r in V.locate(df, rows).collect()) == expected
    assert sum(e[4] for e in expected) > 10


def tables_in(folder):
    names = os.listdir(folder.removeprefix("file:")) if os.path.isdir(folder.removeprefix("file:")) else []
    return set(names)


def kinds_of(names):
    return {name.rsplit("-", 1)[0] for name in names}


@pytest.mark.parametrize("pairs", [1, 3, 1_000_000])
def test_discovery_in_slices_leaves_its_result_only(spark, monkeypatch, pairs):
    nodes, edges = ASH_NODES, ASH_EDGES
    entities, adjacent = X.entity_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    start = spark.createDataFrame([("ash",), ("seed",), ("nowhere",)], "id string")
    whole = sorted(map(str, X.open_discovery(start, entities, adjacent).collect())), sorted(map(str, X.open_diagnostics(start, entities, adjacent).collect()))
    before = tables_in(shared_dir(spark))
    monkeypatch.setattr(X, "PAIRS", pairs)
    assert (sorted(map(str, X.open_discovery(start, entities, adjacent).collect())), sorted(map(str, X.open_diagnostics(start, entities, adjacent).collect()))) == whole
    assert kinds_of(tables_in(shared_dir(spark)) - before) == {"discovery", "counts"}


def test_a_graph_leaves_its_tables_only(spark):
    before = tables_in(shared_dir(spark))
    X.entity_graph(spark.createDataFrame(ASH_NODES, NODE), spark.createDataFrame(ASH_EDGES, EDGE))
    assert kinds_of(tables_in(shared_dir(spark)) - before) == {"alias", "entities", "adjacent"}


def test_closed_discovery_leaves_its_result_only(spark):
    entities, adjacent = X.entity_graph(spark.createDataFrame(ASH_NODES, NODE), spark.createDataFrame(ASH_EDGES, EDGE))
    before = tables_in(shared_dir(spark))
    found = X.closed_discovery(spark.createDataFrame([("ash", "vine"), ("ash", "seed"), ("ash", "nowhere")], "a string, c string"), entities, adjacent)
    assert sorted((r["a"], r["c"], r["b"], r["a_to_b"], r["b_to_c"], r["already_linked"], tuple(r["shared_papers"])) for r in found.collect()) == [("ash", "vine", "glow", "AFFECTS", "USES", False, ()), ("ash", "vine", "seed", "AFFECTS", "AFFECTS", False, ())]
    assert kinds_of(tables_in(shared_dir(spark)) - before) == {"closed"}


def test_a_name_is_worked_out_once(spark, monkeypatch):
    """Six rows of two spellings, and rows without a name, are folded by two worked-out names."""
    written, kept = {}, G.cut
    monkeypatch.setattr(G, "cut", lambda df, name="step": written.setdefault(name, kept(df, name)))
    entities = spark.createDataFrame([("p1", 1, i, name, "Method", None) for i, name in enumerate(["the BERT [S1]", "BERT", "BERT", None, ""])], "paper_id string, paper_ord int, ord int, name string, type string, description string")
    relations = spark.createDataFrame([("p1", 1, 0, "BERT", "A title", "uses", None), ("p1", 1, 1, None, "BERT", "uses", None)], "paper_id string, paper_ord int, ord int, source string, target string, type string, evidence string")
    papers = spark.createDataFrame([("p1", 1, "A title", [])], "paper_id string, paper_ord int, title string, authors array<string>")
    nodes, edges = G.fold(entities, relations, papers)
    assert sorted((r["id"], r["name"]) for r in nodes.collect()) == [("entity:bert", "the BERT"), ("paper:p1", "A title")]
    assert sorted((r["source"], r["target"], r["type"]) for r in edges.collect()) == [("entity:bert", "paper:p1", "USES"), ("paper:p1", "entity:bert", "MENTIONS")]
    assert sorted(r["raw"] for r in written["names"].collect()) == ["", "A title", "BERT", "the BERT [S1]"]
