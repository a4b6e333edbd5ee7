"""Queries over the knowledge graph and the works table, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import discovery as X
from corpusloom.operators import graph as G
from corpusloom.operators import reports as RP
from corpusloom.operators import retrieval as RT
from corpusloom.operators import titles as TT
from corpusloom.operators import vectors as V
from corpusloom.plans import documents as D_PLANS
from corpusloom.plans.views import table, view, with_views
from corpusloom.storage import cut

QUERIES, ORACLE = {}, {}
KG = ["kg_nodes_v", "kg_edges_v"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def kg(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf, "kg_nodes_v"), view(spark, sf, "kg_edges_v")


def sorted_papers(df: DataFrame) -> DataFrame:
    return df.withColumn("papers", F.array_sort("papers"))


NAME = "concat(CASE doc_id % 4 WHEN 0 THEN concat('the ', initcap_(lang), ' Network (', upper(lang), 'N)') WHEN 1 THEN concat('[', source, ' model] [S', doc_id % 9, ']') WHEN 2 THEN concat('  A ', source, '   set (S1, S2)') ELSE concat(source, ' (draft') END, CASE WHEN doc_id % 8 = 3 THEN ', ' ELSE '' END)"


@query("""WITH n AS (SELECT doc_id, upper(lang[1]) || lang[2:] AS l, lang, source FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'the ' || l || ' Network (' || upper(lang) || 'N)' WHEN 1 THEN source || ' model' WHEN 2 THEN 'A ' || source || ' set' ELSE source || ' (draft' END AS name,
  CASE doc_id % 4 WHEN 0 THEN lower(l || ' Network (' || upper(lang) || 'N)') WHEN 1 THEN source || ' model' WHEN 2 THEN source || ' set' ELSE source || ' (draft' END AS key,
  CASE doc_id % 4 WHEN 0 THEN 3 ELSE CASE WHEN doc_id % 4 = 3 THEN 3 ELSE 1 END END AS n_forms FROM n""")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-1, GRF-2, GRF-3"""
    raw = table(spark, sf, "documents").selectExpr("doc_id", NAME.replace("initcap_", "initcap") + " AS raw")
    return raw.select("doc_id", T.clean_name(F.col("raw")).alias("name"), T.canonical_key(F.col("raw")).alias("key"), F.size(T.name_variants(F.col("raw"))).alias("n_forms"))


def fragments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relations that papers (orders) state about suppliers and parts; every fifth line names a ghost."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    base = li.select(F.concat(F.lit("o"), "l_orderkey").alias("paper_id"), F.col("l_orderkey").alias("paper_ord"), F.col("l_linenumber").alias("ord"), "s_name", F.concat(F.lit("Part "), "l_partkey").alias("part"), "l_linenumber")
    text = F.lit(None).cast("string")
    ent = base.select("paper_id", "paper_ord", "ord", F.col("s_name").alias("name"), F.lit("Method").alias("type"), text.alias("description")).unionByName(
        base.select("paper_id", "paper_ord", "ord", F.concat(F.lit("the "), "part", F.lit(" [S1]")).alias("name"), F.lit("Gadget").alias("type"), F.concat(F.lit("made for "), "part").alias("description"))
    )
    rel = base.select("paper_id", "paper_ord", "ord", F.col("s_name").alias("source"), F.when(F.col("l_linenumber") % 5 == 0, "Ghost").otherwise(F.col("part")).alias("target"), F.when(F.col("l_linenumber") % 2 == 0, "evaluated on").otherwise("invented").alias("type"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("evidence"))
    papers = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("paper_id"), F.col("o_orderkey").alias("paper_ord"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.array(F.concat(F.lit("Ada C"), "o_custkey")).alias("authors"))
    return ent, rel, papers


@query("""WITH s AS (SELECT 'entity:' || lower(s_name) AS id, s_name AS name, 'Method' AS type, CAST(NULL AS VARCHAR) AS description, list_sort(list(DISTINCT 'o' || l_orderkey)) AS papers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name),
p AS (SELECT 'entity:part ' || l_partkey, 'the Part ' || l_partkey, 'Concept', 'made for Part ' || l_partkey, list_sort(list(DISTINCT 'o' || l_orderkey)) FROM lineitem GROUP BY l_partkey),
a AS (SELECT 'entity:ada c' || o_custkey, 'Ada C' || o_custkey, 'Author', NULL, list_sort(list(DISTINCT 'o' || o_orderkey)) FROM orders GROUP BY o_custkey),
o AS (SELECT DISTINCT 'paper:o' || o_orderkey, 'Order ' || o_orderkey, 'Paper', NULL, list_value('o' || o_orderkey) FROM orders)
SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM a UNION ALL SELECT * FROM o""")
def kg_fold_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-4, GRF-5"""
    return G.fold(*fragments(spark, sf))[0]


@query("""WITH b AS (SELECT 'o' || l_orderkey AS paper, l_orderkey AS po, l_linenumber AS ord, 'entity:' || lower(s_name) AS s, 'entity:part ' || l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
e AS (SELECT s AS source, p AS target, CASE WHEN ord % 2 = 0 THEN 'EVALUATED_ON' ELSE 'RELATED_TO' END AS type, paper, po, ord, 'line ' || ord AS evidence FROM b WHERE ord % 5 <> 0
  UNION ALL SELECT 'paper:' || paper, s, 'MENTIONS', paper, po, ord, '' FROM b UNION ALL SELECT 'paper:' || paper, p, 'MENTIONS', paper, po, ord, '' FROM b
  UNION ALL SELECT 'paper:o' || o_orderkey, 'entity:ada c' || o_custkey, 'AUTHORED_BY', 'o' || o_orderkey, o_orderkey, 1000000, '' FROM orders)
SELECT source, target, type, list_sort(list(DISTINCT paper)) AS papers, arg_min(evidence, po * 10000000 + ord) AS evidence FROM e GROUP BY ALL""")
def kg_fold_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.fold(*fragments(spark, sf))[1]


@query(with_views(KG, "SELECT 'node' AS part, type, count(*) AS n FROM kg_nodes_v GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM kg_edges_v GROUP BY ALL"))
def kg_stats(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-10"""
    return G.type_counts(*kg(spark, sf))


@query(with_views(KG, ", n AS (SELECT id FROM kg_nodes_v WHERE type IN ('Method', 'Dataset')) SELECT source, target, type FROM kg_edges_v WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)"))
def kg_types(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-11"""
    return G.of_types(*kg(spark, sf), ["Method", "Dataset"])[1].select("source", "target", "type")


@query(with_views(KG, ", d AS (SELECT id FROM (SELECT source AS id FROM kg_edges_v UNION ALL SELECT target FROM kg_edges_v) GROUP BY id HAVING count(*) >= 30) SELECT id, name FROM kg_nodes_v WHERE id IN (SELECT id FROM d)"))
def kg_min_degree(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-12"""
    return G.min_degree(*kg(spark, sf), 30)[0].select("id", "name")


@query(with_views(KG, """, s AS (SELECT 'o' || o_orderkey AS p FROM orders WHERE o_orderkey % 100 = 0),
h AS (SELECT DISTINCT id FROM (SELECT id, unnest(papers) AS p FROM kg_nodes_v) JOIN s USING (p)), n AS (SELECT id FROM h ORDER BY id LIMIT 2000)
SELECT source, target, type FROM kg_edges_v WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)"""))
def kg_scope(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-9: the papers of every hundredth order are the stated scope."""
    papers = table(spark, sf, "orders").filter("o_orderkey % 100 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("paper_id"))
    return G.scoped(*kg(spark, sf), papers)[1].select("source", "target", "type")


GONE = "g AS (SELECT 'o' || o_orderkey AS p FROM orders WHERE o_orderstatus = 'F')"


@query(with_views(KG, f""", {GONE}, gl AS (SELECT list(p) AS l FROM g), n AS (SELECT id, list_sort(list(p)) AS papers FROM (SELECT id, unnest(papers) AS p FROM kg_nodes_v) WHERE p NOT IN (SELECT p FROM g) GROUP BY id)
SELECT id, papers FROM n WHERE id NOT IN (SELECT 'paper:' || p FROM g)"""))
def kg_remove(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-6"""
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("paper_id")).distinct()
    return G.remove_papers(*kg(spark, sf), gone)[0].select("id", "papers")


@query(with_views(KG, """, o AS (SELECT * FROM kg_nodes_v WHERE hash_ % 2 = 0), nn AS (SELECT id, name || ' (new)' AS name, type, list_value('x1') AS papers FROM kg_nodes_v WHERE hash_ % 3 = 0)
SELECT coalesce(o.id, nn.id) AS id, coalesce(nn.name, o.name) AS name, coalesce(nn.type, o.type) AS type, list_sort(list_distinct(list_concat(coalesce(o.papers, []), coalesce(nn.papers, [])))) AS papers FROM o FULL JOIN nn ON o.id = nn.id""").replace("hash_", "length(id || name)"))
def kg_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-8"""
    nodes, edges = kg(spark, sf)
    h = F.length(F.concat("id", "name"))
    new = nodes.filter(h % 3 == 0).withColumn("name", F.concat("name", F.lit(" (new)"))).withColumn("papers", F.array(F.lit("x1")))
    return G.upsert(nodes.filter(h % 2 == 0), edges, new, edges.limit(0))[0]


HOPS = """, b AS (SELECT source AS x, target AS y FROM kg_edges_v UNION SELECT target, source FROM kg_edges_v), s AS (SELECT 'paper:o' || o_orderkey AS id FROM orders WHERE o_orderkey % 100 = 0),
h1 AS (SELECT DISTINCT y AS id FROM b JOIN s ON x = s.id WHERE y NOT IN (SELECT id FROM s)), h2 AS (SELECT DISTINCT y AS id FROM b JOIN h1 ON x = h1.id WHERE y NOT IN (SELECT id FROM s) AND y NOT IN (SELECT id FROM h1)),
r AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"""


@query(with_views(KG, HOPS + " SELECT DISTINCT r.id, name, hop FROM r JOIN kg_nodes_v n ON n.id = r.id"))
def kg_khop(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-11: two hops from the papers of every hundredth order."""
    start = table(spark, sf, "orders").filter("o_orderkey % 100 = 0").select(F.concat(F.lit("paper:o"), "o_orderkey").alias("id"))
    return G.neighbourhood(*kg(spark, sf), start, 2)[0].select("id", "name", "hop")


ALIAS = ", al AS (SELECT id, CASE WHEN id[1:3] = 'pa:' THEN 'p:' || id[4:] ELSE id END AS c, name, type, papers FROM kg_nodes_v WHERE type IN ('Method', 'Dataset'))"
ENT = ALIAS + ", en AS (SELECT c AS id, arg_max(name, length(name)) AS name, max(type) AS type, list_sort(list_distinct(flatten(list(papers)))) AS papers, list_sort(list(DISTINCT name)) AS aliases FROM al GROUP BY c)"
ADJ = ENT + """, ce AS (SELECT a.c AS source, b.c AS target, e.type, arg_min(list_sort(e.papers), e.source || chr(1) || e.target) AS papers FROM kg_edges_v e JOIN al a ON a.id = e.source JOIN al b ON b.id = e.target WHERE e.type <> 'MENTIONS' AND a.c <> b.c GROUP BY ALL),
adj AS (SELECT source AS id, target AS other, type, papers, 'out' AS direction FROM ce UNION ALL SELECT target, source, type, papers, 'in' FROM ce), dg AS (SELECT id, count(*) AS degree, 1 / log2(count(*) + 2) AS w FROM adj GROUP BY id)"""


def entities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return X.entity_graph(*kg(spark, sf))


@query(with_views(KG, ENT + " SELECT * FROM en"))
def kg_entities(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-12, GRF-13"""
    return X.entity_table(view(spark, sf, "kg_nodes_v"))[0]


@query(with_views(KG, ADJ + " SELECT source, target, type, papers FROM ce"))
def kg_canonical_edges(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-14"""
    nodes, edges = kg(spark, sf)
    alias = G.resolve_entities(nodes.filter(F.col("type").isin(G.SCIENTIFIC)))
    return sorted_papers(G.canonical_edges(edges, alias))


@query(with_views(KG, ADJ + " SELECT id, degree, round(w, 6) AS hub_weight FROM dg"))
def kg_degree(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-15"""
    return G.degrees(entities(spark, sf)[1]).withColumn("hub_weight", F.round("hub_weight", 6))


@query(with_views(KG, ADJ + " SELECT id, name, type, degree, CAST(len(papers) AS INT) AS n_papers FROM en JOIN dg USING (id) ORDER BY degree DESC, name, id LIMIT 40"))
def lbd_terms(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-20"""
    return X.start_terms(*entities(spark, sf))


TERM = "SELECT CASE p_partkey % 3 WHEN 0 THEN concat('P:', p_partkey) WHEN 1 THEN concat(' part ', p_partkey, ' ') ELSE concat('0', p_partkey) END AS term FROM {part} WHERE p_partkey % 100 = 0"


@query(with_views(KG, ENT + f""", t AS ({TERM.replace('{part}', 'part')}), m AS (SELECT DISTINCT term, lower(trim(term)) AS low FROM t),
x AS (SELECT term, id, 0 AS how, 0 AS n FROM m JOIN en ON low = id UNION ALL SELECT term, id, 1, 0 FROM m JOIN en ON low = lower(trim(name)) UNION ALL SELECT term, id, 2, length(name) FROM m JOIN en ON contains(lower(name), low))
SELECT term, arg_min(id, how * 1000000 + n) AS id FROM (SELECT * FROM x ORDER BY term, how, n, id) GROUP BY term"""))
def lbd_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-16"""
    return X.resolve_terms(spark.sql(TERM, part=table(spark, sf, "part")), X.entity_table(view(spark, sf, "kg_nodes_v"))[0])


SOURCES = ADJ + """, a0 AS (SELECT 'p:' || p_partkey AS a FROM part WHERE p_partkey % 100 = 0), abc AS (SELECT a, x.other AS b, y.other AS c, x.type AS ab, y.type AS bc FROM a0 JOIN adj x ON x.id = a JOIN adj y ON y.id = x.other WHERE y.other <> a AND y.other <> x.other),
pr AS (SELECT a, c, list_has_any(ea.papers, ec.papers) AS shares, EXISTS (SELECT 1 FROM adj WHERE adj.id = a AND adj.other = c) AS linked FROM (SELECT DISTINCT a, c FROM abc) JOIN en ea ON ea.id = a JOIN en ec ON ec.id = c)"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth part is a stated start."""
    return table(spark, sf, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("p:"), "p_partkey").alias("id"))


@query(with_views(KG, SOURCES + """, g AS (SELECT DISTINCT a, b, c FROM abc JOIN pr USING (a, c) WHERE NOT linked AND NOT shares), f AS (SELECT a, c, round(sum(w), 6) AS score, count(*) AS support FROM g JOIN dg ON dg.id = b GROUP BY ALL)
SELECT * FROM (SELECT a, c, en.name AS c_name, score, support, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, support DESC, en.name, c) AS INT) AS place FROM f JOIN en ON en.id = c) WHERE place <= 25"""))
def lbd_open(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-17"""
    return X.open_discovery(sources(spark, sf), *entities(spark, sf)).select("a", "c", "c_name", "score", "support", "place")


@query(with_views(KG, SOURCES + """, k AS (SELECT a, count(*) AS c_examined, count(*) FILTER (linked) AS rejected_already_linked, count(*) FILTER (NOT linked AND shares) AS rejected_shared_paper, count(DISTINCT c) FILTER (NOT linked AND NOT shares) AS candidates_found FROM abc JOIN pr USING (a, c) GROUP BY a)
SELECT a, coalesce(degree, 0) AS b_terms, coalesce(c_examined, 0) AS c_examined, coalesce(rejected_already_linked, 0) AS rejected_already_linked, coalesce(rejected_shared_paper, 0) AS rejected_shared_paper, coalesce(candidates_found, 0) AS candidates_found, (SELECT count(*) FROM en) AS entities,
  CASE WHEN coalesce(degree, 0) = 0 THEN 'no connections' WHEN coalesce(candidates_found, 0) = 0 THEN 'every chain was rejected' END AS reason FROM a0 LEFT JOIN dg ON dg.id = a LEFT JOIN k USING (a)"""))
def lbd_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-18"""
    return X.open_diagnostics(sources(spark, sf), *entities(spark, sf))


@query(with_views(KG, ADJ + """, q AS (SELECT 'p:' || p_partkey AS a, 'p:' || (p_partkey - 7) AS c FROM part WHERE p_partkey % 100 = 0), l AS (SELECT id AS a, other AS b, arg_max(type, type || direction) AS a_to_b FROM adj GROUP BY ALL)
SELECT q.a, q.c, l.b, eb.name AS b_name, a_to_b, y.type AS b_to_c, round(w, 6) AS weight, EXISTS (SELECT 1 FROM adj z WHERE z.id = q.a AND z.other = q.c) AS already_linked, list_sort(list_intersect(ea.papers, ec.papers)) AS shared_papers
FROM q JOIN l ON l.a = q.a JOIN adj y ON y.id = q.c AND y.other = l.b JOIN dg ON dg.id = l.b JOIN en ea ON ea.id = q.a JOIN en ec ON ec.id = q.c JOIN en eb ON eb.id = l.b WHERE l.b <> q.a AND l.b <> q.c"""))
def lbd_closed(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-19"""
    pairs = table(spark, sf, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("p:"), "p_partkey").alias("a"), F.concat(F.lit("p:"), F.col("p_partkey") - 7).alias("c"))
    return X.closed_discovery(pairs, *entities(spark, sf)).drop("a_papers", "c_papers")


@query(with_views(KG, SOURCES + """, g AS (SELECT DISTINCT a, b, c FROM abc JOIN pr USING (a, c) WHERE NOT linked AND NOT shares), f AS (SELECT a, c, round(sum(w), 6) AS score, count(*) AS support FROM g JOIN dg ON dg.id = b GROUP BY ALL),
best AS (SELECT * FROM (SELECT a, c, score, support, row_number() OVER (PARTITION BY a ORDER BY score DESC, support DESC, en.name, c) AS place FROM f JOIN en ON en.id = c) WHERE place <= 25),
lk AS (SELECT best.a, best.c, b.id AS b, w, x.type AS ab, y.type AS bc, list_sort(x.papers) AS ap, list_sort(y.papers) AS cp FROM best JOIN adj x ON x.id = best.a JOIN adj y ON y.id = x.other AND y.other = best.c JOIN dg b ON b.id = x.other WHERE x.other <> best.a AND x.other <> best.c),
ln AS (SELECT lk.a, lk.c, row_number() OVER (PARTITION BY lk.a, lk.c ORDER BY w DESC, b, ab, bc, ap, cp) AS i, ea.name || ' —' || lower(replace(ab, '_', ' ')) || '→ ' || eb.name || ' —' || lower(replace(bc, '_', ' ')) || '→ ' || ec.name AS line FROM lk JOIN en ea ON ea.id = lk.a JOIN en eb ON eb.id = b JOIN en ec ON ec.id = lk.c),
tx AS (SELECT a, c, string_agg(line, chr(10) ORDER BY i) AS chain_text FROM ln WHERE i <= 5 GROUP BY ALL), pp AS (SELECT a, c, list_sort(list_distinct(flatten(list(list_concat(ap, cp))))) AS paper_ids FROM lk GROUP BY ALL),
v AS (SELECT *, CASE place % 4 WHEN 0 THEN 'promising' WHEN 1 THEN 'trivial' ELSE 'plausible' END AS verdict FROM best)
SELECT a, c, verdict, score, CAST(row_number() OVER (PARTITION BY a ORDER BY CASE verdict WHEN 'promising' THEN 0 WHEN 'plausible' THEN 1 ELSE 2 END, score DESC, c) AS INT) AS place, paper_ids, chain_text FROM v JOIN pp USING (a, c) JOIN tx USING (a, c)"""))
def lbd_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-26, GRF-27"""
    found = cut(X.open_discovery(sources(spark, sf), *entities(spark, sf)), "found")
    verdict = F.when(F.col("place") % 4 == 0, "Promising").when(F.col("place") % 4 == 1, "trivial").when(F.col("place") % 4 == 2, "odd")
    ranked = X.rank_hypotheses(found, found.filter("place % 4 < 3").select("a", "c", verdict.alias("verdict")))
    text = found.select("a", "c", X.chain_text(F.col("a_name"), F.col("chains"), F.col("c_name")).alias("chain_text"))
    return ranked.join(text, ["a", "c"])


@query(with_views(KG, SOURCES + """, g AS (SELECT DISTINCT a, b, c FROM abc JOIN pr USING (a, c) WHERE NOT linked AND NOT shares), f AS (SELECT a, c, round(sum(w), 6) AS score, count(*) AS support FROM g JOIN dg ON dg.id = b GROUP BY ALL),
best AS (SELECT * FROM (SELECT a, c, score, support, row_number() OVER (PARTITION BY a ORDER BY score DESC, support DESC, en.name, c) AS place FROM f JOIN en ON en.id = c) WHERE place <= 25),
ln AS (SELECT best.a, best.c, row_number() OVER (PARTITION BY best.a, best.c ORDER BY w DESC, abc.b, ab, bc) AS i, '- ' || ea.name || ' —' || ab || '→ ' || eb.name || ' (' || eb.type || ') —' || bc || '→ ' || ec.name AS line FROM best JOIN abc ON abc.a = best.a AND abc.c = best.c JOIN dg ON dg.id = abc.b JOIN en ea ON ea.id = best.a JOIN en eb ON eb.id = abc.b JOIN en ec ON ec.id = best.c),
tx AS (SELECT a, c, string_agg(line, chr(10) ORDER BY i) AS lines FROM ln WHERE i <= 5 GROUP BY ALL)
SELECT a, c, '## A' || chr(10) || ea.name || chr(10) || chr(10) || '## C' || chr(10) || ec.name || ' (' || ec.type || ')' || chr(10) || chr(10) || '## Paths' || chr(10) || lines || chr(10) || chr(10) || '## Graph' || chr(10) || 'Intermediates: ' || support || '; papers: ' || len(ea.papers) || ' and ' || len(ec.papers) || chr(10) || chr(10) || 'Is the link between A and C worth a study?' AS prompt
FROM best JOIN tx USING (a, c) JOIN en ea ON ea.id = a JOIN en ec ON ec.id = c"""))
def chain_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-5: the chains of implied connections"""
    return RP.chain_prompts(X.open_discovery(sources(spark, sf), *entities(spark, sf)))


QUESTION = "concat('How does Supplier#', lpad(doc_id % 100 + 1, 9, '0'), ' relate to Part ', doc_id % 200 + 1, ' and the P', doc_id % 20 * 10, '?')"


#: What DuckDB pads is text.
LPAD, LPAD_SQL = "lpad(doc_id % 100 + 1, 9, '0')", "lpad(CAST(doc_id % 100 + 1 AS VARCHAR), 9, '0')"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("doc_id % 100 = 0").selectExpr("doc_id AS question_id", f"{QUESTION} AS question")


@query(f"""WITH q AS (SELECT doc_id AS question_id, {QUESTION.replace("lpad(doc_id % 100 + 1, 9, '0')", "lpad(CAST(doc_id % 100 + 1 AS VARCHAR), 9, '0')")} AS t FROM documents), w AS (SELECT question_id, regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9\\-/+.]*') AS w FROM q),
g AS (SELECT question_id, w, unnest(range(1, least(4, len(w)) + 1)) AS n_words FROM w), p AS (SELECT question_id, w, n_words, unnest(range(0, len(w) - n_words + 1)) AS place FROM g),
t AS (SELECT question_id, CAST(n_words AS INT) AS n_words, CAST(place AS INT) AS place, array_to_string(w[place + 1:place + n_words], ' ') AS term FROM p)
SELECT * FROM t WHERE length(term) >= 3 AND NOT (n_words = 1 AND lower(term) IN ('how', 'does', 'to', 'and', 'the'))""")
def question_terms(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-21"""
    return X.question_terms(table(spark, sf, "documents").selectExpr("doc_id AS question_id", f"{QUESTION} AS question"), "question_id", "question")


@query(with_views(KG, """, q AS (SELECT doc_id AS question_id, doc_id % 200 + 1 AS k, doc_id % 20 * 10 AS z FROM documents WHERE doc_id % 100 = 0),
m AS (SELECT question_id, n.id, n.name, n.type, 0.85::DOUBLE AS confidence, CASE WHEN k % 10 = 0 THEN 'alias' ELSE 'exact' END AS method FROM q JOIN kg_nodes_v n ON n.id = 'p:' || k
  UNION ALL SELECT question_id, n.id, n.name, n.type, 0.8::DOUBLE, 'alias' FROM q JOIN kg_nodes_v n ON n.id = 'p:' || z WHERE z <> k AND length('P' || z) >= 3)
SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, id) AS INT) AS place FROM m"""))
def link_entities(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-22"""
    return X.link_entities(questions(spark, sf), kg(spark, sf)[0], "question_id", "question")


@query(with_views(KG, f""", qs AS (SELECT doc_id AS question_id, {QUESTION.replace(LPAD, LPAD_SQL)} AS t, doc_id % 200 + 1 AS k, doc_id % 20 * 10 AS z FROM documents WHERE doc_id % 100 = 0),
fn AS (SELECT * FROM kg_nodes_v WHERE type NOT IN ('Paper', 'Figure', 'Author')), src AS (SELECT 'q' || question_id AS id, t FROM qs UNION ALL SELECT 'n' || id, name FROM fn), {D_PLANS.TERMS},
e AS (SELECT id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS weight FROM s), p AS (SELECT CAST(a.id[2:] AS BIGINT) AS question_id, b.id[2:] AS id, round(sum(a.weight * b.weight), 6) AS score FROM e a JOIN e b ON a.bucket = b.bucket AND a.id[1] = 'q' AND b.id[1] = 'n' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS i FROM p),
m AS (SELECT question_id, n.id, n.name, n.type, 0.85::DOUBLE AS confidence, CASE WHEN k % 10 = 0 THEN 'alias' ELSE 'exact' END AS method FROM qs JOIN kg_nodes_v n ON n.id = 'p:' || k UNION ALL SELECT question_id, n.id, n.name, n.type, 0.8::DOUBLE, 'alias' FROM qs JOIN kg_nodes_v n ON n.id = 'p:' || z WHERE z <> k AND length('P' || z) >= 3),
x AS (SELECT * FROM m UNION ALL SELECT question_id, id, name, type, round(score, 3), 'embedding' FROM r JOIN fn USING (id) WHERE i <= 6 AND score >= 0.55 AND NOT EXISTS (SELECT 1 FROM m WHERE m.question_id = r.question_id AND m.id = r.id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, id) AS INT) AS place FROM x) WHERE place <= 6"""))
def link_entities_similar(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-22 with hashed vectors of names for the places that literal matches leave."""
    nodes = kg(spark, sf)[0].filter(~F.col("type").isin(G.NON_FACTUAL))
    near = V.sparse_top_k(C.hashed_terms(questions(spark, sf), "question_id", "question"), C.hashed_terms(nodes, "id", "name"), 6, "question_id", "id")
    return X.link_entities(questions(spark, sf), kg(spark, sf)[0], "question_id", "question", similar=near.select("question_id", "id", "score"))


def facts_of(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = kg(spark, sf)
    seeds = cut(X.link_entities(questions(spark, sf), nodes, "question_id", "question"), "seeds")
    return X.expand_facts(seeds, nodes, edges, "question_id")


FACTS = """, q AS (SELECT doc_id AS question_id, doc_id % 200 + 1 AS k, doc_id % 20 * 10 AS z FROM documents WHERE doc_id % 100 = 0), sd AS (SELECT DISTINCT question_id, c FROM (SELECT question_id, 'p:' || k AS c FROM q UNION ALL SELECT question_id, 'p:' || z FROM q WHERE length('P' || z) >= 3) JOIN en ON en.id = c),
bo AS (SELECT source AS c, target AS other, source AS s, target AS t, type FROM ce UNION ALL SELECT target, source, source, target, type FROM ce),
s1 AS (SELECT question_id, bo.* FROM sd JOIN bo USING (c)), f2 AS (SELECT DISTINCT question_id, other AS c FROM s1 EXCEPT SELECT question_id, c FROM sd), s2 AS (SELECT question_id, bo.* FROM f2 JOIN bo USING (c)),
nr AS (SELECT question_id, s, t, type, min(h) AS hops FROM (SELECT question_id, s, t, type, 1 AS h FROM s1 UNION ALL SELECT question_id, s, t, type, 2 FROM s2) GROUP BY ALL),
fa AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY hops, s, t, type) AS INT) AS place FROM nr),
fx AS (SELECT question_id, place, a.name AS source, fa.type AS relation, b.name AS target, hops, ce.papers FROM fa JOIN ce ON ce.source = s AND ce.target = t AND ce.type = fa.type JOIN en a ON a.id = s JOIN en b ON b.id = t WHERE place <= 60)"""


@query(with_views(KG, ADJ + FACTS + " SELECT *, '' AS evidence FROM fx"))
def graph_facts(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-23"""
    return facts_of(spark, sf)


LINES = """, l AS (SELECT question_id, place, '[G' || place || '] ' || source || ' ' || lower(replace(relation, '_', ' ')) || ' ' || target || ' (from: ' || array_to_string(list_transform(papers, lambda p: 'Order ' || p[2:])[1:2], ', ') || ')' AS line FROM fx),"""
CONTEXT = with_views(KG, ADJ + FACTS + LINES + """
u AS (SELECT *, sum(length(line)) OVER (PARTITION BY question_id ORDER BY place) AS used FROM l) SELECT question_id, string_agg(line, chr(10) ORDER BY place) AS context, count(*) AS n_blocks FROM u WHERE used <= BUDGET GROUP BY question_id""")


@query(CONTEXT.replace("BUDGET", "2000"))
def graph_context(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-24"""
    return packed_facts(spark, sf, 2000)


@query(CONTEXT.replace("BUDGET", "12000"))
def graph_context_full(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-24 with the whole budget"""
    return packed_facts(spark, sf, 12_000)


def order_line() -> Column:
    titles = F.transform("papers", lambda p: F.concat(F.lit("Order "), F.substring(p, F.lit(2), F.length(p))))
    return X.fact_line(F.col("place"), F.col("source"), F.col("relation"), F.col("target"), titles, F.col("evidence"))


def packed_facts(spark: SparkSession, sf: str, budget: int) -> DataFrame:
    return V.pack_blocks(facts_of(spark, sf).withColumn("line", order_line()), "question_id", "place", "line", budget, "\n")


@query(with_views(KG, ADJ + FACTS + f""", src AS (SELECT 'q' || doc_id AS id, {QUESTION.replace(LPAD, LPAD_SQL)} AS t FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT 'd' || doc_id, text FROM documents), {D_PLANS.TERMS},
nh AS (SELECT CAST(a.id[2:] AS BIGINT) AS question_id, least(8, count(DISTINCT b.id)) AS n_passages FROM s a JOIN s b ON a.bucket = b.bucket AND a.id[1] = 'q' AND b.id[1] = 'd' GROUP BY 1),
ns AS (SELECT question_id, count(*) AS n_seeds FROM (SELECT question_id FROM q JOIN kg_nodes_v n ON n.id = 'p:' || k UNION ALL SELECT question_id FROM q JOIN kg_nodes_v n ON n.id = 'p:' || z WHERE z <> k AND length('P' || z) >= 3) GROUP BY 1), nf AS (SELECT question_id, count(*) AS n_facts FROM fx GROUP BY 1)
SELECT question_id, coalesce(n_seeds, 0) AS n_seeds, coalesce(n_facts, 0) AS n_facts, CASE WHEN n_seeds IS NULL THEN 'no entity was named' WHEN n_facts IS NULL THEN 'the entities are isolated' END AS reason, n_passages FROM q LEFT JOIN ns USING (question_id) LEFT JOIN nf USING (question_id) LEFT JOIN nh USING (question_id)"""))
def graph_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-25, RET-8: both kinds of context side by side."""
    nodes, edges = kg(spark, sf)
    asked = questions(spark, sf)
    by_graph = X.graph_retrieval(asked, nodes, edges, "question_id", "question")
    q = C.hashed_terms(asked, "question_id", "question")
    hits = V.sparse_top_k(q, C.hashed_terms(table(spark, sf, "documents"), "doc_id", "text"), 8, "question_id", "doc_id")
    return by_graph.join(hits.groupBy("question_id").agg(F.count("*").alias("n_passages")), "question_id", "left")


MODED = f"SELECT doc_id AS item_id, CASE WHEN doc_id % 700 = 0 THEN ' ' ELSE {QUESTION.replace(LPAD, LPAD_SQL)} END AS text, CASE doc_id // 100 % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'vector' ELSE 'graph' END AS mode FROM documents WHERE doc_id % 100 = 0"


@query(with_views(KG, ADJ + FACTS.replace("FROM documents WHERE doc_id % 100 = 0)", "FROM documents WHERE doc_id % 100 = 0 AND doc_id % 700 <> 0 AND doc_id // 100 % 3 <> 1)") + LINES.rstrip(",") + ", " + D_PLANS.search_sql(f"SELECT item_id, text FROM ({MODED}) WHERE trim(text) <> '' AND mode <> 'graph'", "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents", 8) + f""",
al2 AS (SELECT question_id, list(name ORDER BY confidence DESC, id) AS matches FROM (SELECT question_id, n.id, n.name, 0.85::DOUBLE AS confidence FROM q JOIN kg_nodes_v n ON n.id = 'p:' || k UNION ALL SELECT question_id, n.id, n.name, 0.8::DOUBLE FROM q JOIN kg_nodes_v n ON n.id = 'p:' || z WHERE z <> k AND length('P' || z) >= 3) GROUP BY 1),
tb AS (SELECT item_id, place, '[S' || (place + 1) || '] d' || chunk_id || ' (n/a)' || chr(10) || trim(text, {D_PLANS.WS}) AS block FROM fused JOIN passages USING (chunk_id)),
tc AS (SELECT item_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context, count(*) AS n_passages FROM (SELECT *, sum(length(block)) OVER (PARTITION BY item_id ORDER BY place) AS n FROM tb) WHERE n <= 220000 GROUP BY 1),
gc AS (SELECT question_id, string_agg(line, chr(10) ORDER BY place) AS graph_context FROM (SELECT *, sum(length(line)) OVER (PARTITION BY question_id ORDER BY place) AS used FROM l) WHERE used <= 12000 GROUP BY 1),
nf AS (SELECT question_id, count(*) AS n_facts FROM fx GROUP BY 1)
SELECT m.item_id AS question_id, m.mode, md5(coalesce(context, '')) AS context, coalesce(graph_context, '') AS graph_context, coalesce(n_passages, 0) AS n_passages, coalesce(n_facts, 0) AS n_facts, coalesce(matches, []) AS matches,
  CASE WHEN trim(m.text) = '' THEN 'no question' WHEN m.mode <> 'vector' AND matches IS NULL THEN 'no entity was named' WHEN m.mode <> 'vector' AND n_facts IS NULL THEN 'the entities are isolated' END AS reason
FROM ({MODED}) m LEFT JOIN tc USING (item_id) LEFT JOIN gc ON gc.question_id = m.item_id LEFT JOIN nf ON nf.question_id = m.item_id LEFT JOIN al2 ON al2.question_id = m.item_id"""))
def hybrid_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """RET-8: a third of the questions each from text, graph and both; a few are blank."""
    nodes, edges = kg(spark, sf)
    asked = questions(spark, sf).select("question_id", F.when(F.col("question_id") % 700 == 0, " ").otherwise(F.col("question")).alias("question"), F.element_at(F.array(F.lit("hybrid"), F.lit("vector"), F.lit("graph")), (F.floor(F.col("question_id") / 100) % 3 + 1).cast("int")).alias("mode"))
    passages = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("title"), "text")
    out = RT.retrieve(asked, passages, nodes, edges, order_line())
    return out.withColumn("context", F.md5(F.col("context").cast("binary")))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT 'paper:o' || k AS source, 'figure:' || k || '-' || n AS target, 'CONTAINS' AS type, ['o' || k] AS papers FROM lineitem JOIN a ON k = l_orderkey AND n = l_linenumber AND p = l_partkey UNION ALL SELECT 'figure:' || k || '-' || n, 'entity:part ' || p, 'EVALUATED_ON', ['o' || k] FROM a""")
def figure_edges(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-7: a figure per order line that names its part and its supplier."""
    ent, rel, papers = fragments(spark, sf)
    nodes = G.fold(ent, rel, papers)[0]
    li = table(spark, sf, "lineitem")
    names = F.create_map(F.lit("datasets"), F.array(F.concat(F.lit("Part "), "l_partkey"), F.lit("Nowhere")))
    figures = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("figure_id"), F.concat(F.lit("o"), "l_orderkey").alias("paper_id"), F.lit("Figure").alias("label"), F.when(F.col("l_linenumber") % 2 == 0, "analysed").otherwise("pending").alias("status"), names.alias("entities"))
    return G.figure_edges(figures, nodes)[1]


WORKS = ["works_v", "papers_v"]
FOUND = """, fw AS (SELECT paper_id, arg_min(external_id, how * 1000000000 + length(external_id) * 100000000 + CAST(external_id[2:] AS BIGINT)) AS external_id, min(how) AS how FROM (
  SELECT p.paper_id, w.external_id, 0 AS how FROM papers_v p JOIN works_v w ON lower(p.doi) = lower(w.doi) UNION ALL
  SELECT p.paper_id, w.external_id, 1 FROM papers_v p JOIN works_v w ON nullif(regexp_replace(lower(p.title), '[^a-z0-9]+', '', 'g'), '') = nullif(regexp_replace(lower(w.title), '[^a-z0-9]+', '', 'g'), '')) GROUP BY paper_id),
rw AS (SELECT DISTINCT paper_id, unnest(related_works) AS work_id, 'related' AS relation FROM fw JOIN works_v USING (external_id) UNION ALL SELECT DISTINCT paper_id, unnest(referenced_works), 'references' FROM fw JOIN works_v USING (external_id)),
rr AS (SELECT work_id, paper_id, relation, title, doi, citations, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY citations DESC, title, work_id, relation) AS INT) AS place FROM rw JOIN works_v ON external_id = work_id)"""


@query(with_views(WORKS, FOUND + " SELECT paper_id, external_id, CASE WHEN how = 0 THEN 'doi' ELSE 'title' END AS matched_by FROM fw"))
def find_works(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-2"""
    return X.find_works(view(spark, sf, "papers_v"), view(spark, sf, "works_v"))


@query(with_views(WORKS, r""", ask AS (SELECT paper_id, CASE WHEN CAST(paper_id[2:] AS BIGINT) % 2 = 0 THEN 'Revised ' || regexp_replace(title, '^[^ ]+', '') ELSE title || ' and a tail of five words' END AS title FROM papers_v WHERE doi IS NULL),
keyed AS (SELECT paper_id, title, nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '') AS k FROM ask), wk AS (SELECT external_id, title, nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '') AS k FROM works_v),
eq AS (SELECT paper_id, arg_min(external_id, CAST(external_id[2:] AS BIGINT)) AS external_id FROM keyed JOIN wk USING (k) GROUP BY 1),
ps AS (SELECT paper_id, list_sort(list_distinct(regexp_extract_all(lower(substr(title, 1, 250)), '[a-z0-9]+'))) AS s FROM keyed WHERE k IS NOT NULL AND paper_id NOT IN (SELECT paper_id FROM eq)),
ws AS (SELECT min(CAST(external_id[2:] AS BIGINT)) AS n, s FROM (SELECT external_id, list_sort(list_distinct(regexp_extract_all(lower(substr(title, 1, 250)), '[a-z0-9]+'))) AS s FROM works_v) GROUP BY s),
c AS (SELECT paper_id, n, len(list_intersect(ps.s, ws.s)) AS i, len(ps.s) + len(ws.s) AS t FROM ps JOIN ws ON len(ws.s) >= 0.6 * len(ps.s) AND len(ps.s) >= 0.6 * len(ws.s)),
b AS (SELECT paper_id, arg_min(n, (-(i / (t - i)), n)) AS n FROM c WHERE i / (t - i) >= 0.6 - 1e-9 GROUP BY 1)
SELECT paper_id, external_id, 'title' AS matched_by FROM eq UNION ALL SELECT paper_id, 'W' || n, 'words' FROM b"""))
def find_works_edited(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-2: papers without a DOI under edited titles"""
    number = F.substring("paper_id", 2, 20).cast("long")
    title = F.when(number % 2 == 0, F.concat(F.lit("Revised "), F.regexp_replace("title", "^[^ ]+", ""))).otherwise(F.concat("title", F.lit(" and a tail of five words")))
    return X.find_works(view(spark, sf, "papers_v").filter("doi IS NULL").withColumn("title", title), view(spark, sf, "works_v"))


@query(with_views(WORKS, FOUND + " SELECT * FROM rr WHERE place <= 15"))
def related_works(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-1"""
    return X.related_works(view(spark, sf, "papers_v"), view(spark, sf, "works_v"))


@query(with_views(["works_v"], """, q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))) AS w FROM benchmark), t AS (SELECT external_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{4,}'))) AS w FROM works_v),
h AS (SELECT query_id, external_id, count(*) AS n_words FROM q JOIN t USING (w) GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n_words DESC, external_id) AS INT) AS place FROM h) WHERE place <= 15"""))
def search_works(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-3"""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return TT.search_works(asked, view(spark, sf, "works_v"))


NEW = """SELECT external_id, title, doi, citations FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), ''), chr(1) || external_id) ORDER BY citations DESC, external_id) AS r FROM works_v
  WHERE doi NOT IN (SELECT doi FROM corpus WHERE doi IS NOT NULL) AND (nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '') IS NULL OR regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') NOT IN (SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') FROM corpus WHERE title IS NOT NULL))) WHERE r = 1"""


@query(with_views(WORKS, ", corpus AS (SELECT * FROM papers_v WHERE owner_id < 'src15') " + NEW))
def new_works(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-4"""
    works = view(spark, sf, "works_v").select("external_id", "title", "doi", "citations")
    return X.new_works(works, view(spark, sf, "papers_v").filter("owner_id < 'src15'"), [(-F.col("citations")).alias("a"), F.col("external_id").alias("b")])


@query(with_views(WORKS, FOUND + """, corpus AS (SELECT * FROM papers_v WHERE owner_id = 'src1'), ask AS (SELECT paper_id FROM corpus ORDER BY paper_id LIMIT 12), ty AS (SELECT work_id AS external_id, title, doi, citations, count(*) AS referenced_by_corpus FROM rr WHERE place <= 15 AND paper_id IN (SELECT paper_id FROM ask) GROUP BY ALL)
SELECT external_id, title, doi, citations, referenced_by_corpus FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') ORDER BY referenced_by_corpus DESC, citations DESC, external_id) AS r FROM ty
  WHERE doi NOT IN (SELECT doi FROM corpus WHERE doi IS NOT NULL) AND regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') NOT IN (SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') FROM corpus)) WHERE r = 1 ORDER BY referenced_by_corpus DESC, citations DESC, external_id LIMIT 20"""))
def missing_works(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-5"""
    papers = view(spark, sf, "papers_v").filter("owner_id = 'src1'")
    return X.missing_works(papers, view(spark, sf, "works_v"), papers)


@query("""SELECT 'W' || doc_id AS external_id, 'Work ' || doc_id AS title, list_transform(range(1, least(25, 1 + doc_id % 30) + 1), lambda i: 'Name ' || i) AS authors, CAST(2000 + doc_id % 20 AS INT) AS year, source AS venue, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id END AS doi,
  nullif(substr(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' '), 1, 4000), '') AS abstract, doc_id % 50 AS citations, CASE WHEN doc_id % 3 = 0 THEN 'http://pdf/' || doc_id ELSE 'http://page/' || doc_id END AS open_access_url, 'search' AS relation FROM documents WHERE doc_id % 11 <> 0""")
def works_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-4, SRC-5: nested works made of documents, each text as an inverted index."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    docs = table(spark, sf, "documents").select("*", F.posexplode(words).alias("p", "w"))
    index = docs.groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("abstract_inverted_index"))
    base = table(spark, sf, "documents").join(index, "doc_id", "left")
    id_ = F.col("doc_id").cast("string")
    works = base.select(
        F.concat(F.lit("https://example.org/W"), id_).alias("id"), F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.concat(F.lit("Work "), id_, F.lit(" "))).alias("display_name"), (F.lit(2000) + F.col("doc_id") % 20).cast("int").alias("publication_year"), (F.col("doc_id") % 50).alias("cited_by_count"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), id_)).alias("doi"), F.transform(F.sequence(F.lit(1), F.lit(1) + F.col("doc_id") % 30), lambda i: F.struct(F.struct(F.concat(F.lit(" Name "), i.cast("string")).alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"), F.struct(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("http://pdf/"), id_)).alias("pdf_url"), F.concat(F.lit("http://page/"), id_).alias("landing_page_url")).alias("best_oa_location"), "abstract_inverted_index",
    )
    return X.works_to_candidates(works, "search")
