"""Queries over results, listings, sources, sinks and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from corpusloom.operators import chunks as C
from corpusloom.operators import listings as L
from corpusloom.operators import reports as RP
from corpusloom.operators import results as R
from corpusloom.operators import retrieval as RT
from corpusloom.plans import documents as D_PLANS
from corpusloom.plans.views import table, view, with_views
from corpusloom.sources import tables as S
from corpusloom.storage import shared_dir
from corpusloom.streaming import jobs as J

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def items(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "payloads_v")
    return rows.withColumn("paper_ord", F.substring("paper_id", F.lit(2), F.length("paper_id")).cast("long"))


AGG = with_views(["payloads_v"], ", ag AS (SELECT field, lower(trim(name)) AS key, arg_min(name, CAST(paper_id[2:] AS BIGINT) * 1000 + ord) AS name, list_sort(list(DISTINCT paper_id)) AS papers, count(*) AS mentions FROM payloads_v GROUP BY ALL)")


@query(AGG + " SELECT * FROM ag")
def extract_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-2"""
    return R.aggregate_items(items(spark, sf))


@query(AGG + " SELECT * FROM (SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY len(papers) DESC, key) AS INT) AS place, name, CAST(len(papers) AS INT) AS n_papers, papers[1:4] AS appears_in FROM ag) WHERE place <= 25")
def entity_table(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-5"""
    return R.entity_table(items(spark, sf))


@query(with_views(["payloads_v"], """, o AS (SELECT paper_id, list(name ORDER BY ord, name) FILTER (field = 'methods') AS m, list(name ORDER BY ord, name) FILTER (field = 'datasets') AS d, list(name || CASE WHEN CAST(paper_id[2:] AS BIGINT) % 2 = 1 THEN ': ' || (ord * 10) ELSE '' END ORDER BY ord, name) FILTER (field = 'metrics') AS x FROM payloads_v GROUP BY paper_id),
k AS (SELECT 'o' || l_orderkey AS paper_id, list(split_part(p_type, ' ', 1) ORDER BY l_linenumber, p_type) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT paper_id, coalesce(array_to_string(t[1:2], ', '), '—') AS tasks, coalesce(array_to_string(m[1:3], ', '), '—') AS methods, coalesce(array_to_string(d[1:3], ', '), '—') AS datasets, coalesce(x[1], '—') AS metric FROM o LEFT JOIN k USING (paper_id)"""))
def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-4"""
    rows = items(spark, sf).withColumn("value", F.when(F.col("paper_ord") % 2 == 1, (F.col("ord") * 10).cast("string")))
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    tasks = li.select(F.concat(F.lit("o"), "l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("ord"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("task"))
    return R.comparison_table(rows, tasks)


@query("SELECT upper(split_part(p_type, ' ', 1)[1]) || lower(split_part(p_type, ' ', 1)[2:]) AS task, list_sort(list(DISTINCT 'o' || l_orderkey)) AS papers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def extract_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-3"""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return R.aggregate_tasks(li.select(F.concat(F.lit("o"), "l_orderkey").alias("paper_id"), F.concat(F.lit(" "), F.split_part("p_type", F.lit(" "), F.lit(1))).alias("task")))


ITEM = "array<struct<name:string,description:string>>"


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN list_value(source || ' set') WHEN 1 THEN list_value(lang) ELSE CAST([] AS VARCHAR[]) END AS names, doc_id % 3 = 2 AS failed FROM documents""")
def parse_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-1, EXT-1: fenced objects with a trailing comma, bare lists, and prose without either."""
    raw = """CASE doc_id % 3 WHEN 0 THEN concat('Sure:\n```json\n{"items": [{"name": "', source, ' set [S1]", "description": "d (S2)"}, {"name": " "},]}\n```') WHEN 1 THEN concat('[{"name": "[', lang, ']"}]') ELSE 'none found' END"""
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{raw} AS raw").withColumn("x", R.parse_json(F.col("raw"), f"items {ITEM}"))
    names = F.transform(R.normalise_items(F.col("x.items")), lambda i: i["name"])
    return rows.select("doc_id", F.coalesce(names, F.array().cast("array<string>")).alias("names"), F.col("x").isNull().alias("failed"))


@query("""SELECT doc_id, sha256('{"model":"m","prompt":' || to_json(text)::VARCHAR || ',"system":' || to_json(lang)::VARCHAR || ',"temperature":"0.2000"}') AS key FROM documents""")
def request_keys(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-2"""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", R.request_key(model=F.lit("m"), prompt=F.col("text"), temperature=F.lit(0.20001), system=F.col("lang")).alias("key"))


@query(with_views(["cache_v"], """, r AS (SELECT sha256(props) AS key FROM events), now AS (SELECT max(ts) AS t FROM events), f AS (SELECT cache_v.* FROM cache_v, now WHERE created_at >= t - INTERVAL 30 DAY)
SELECT (SELECT count(*) FROM r JOIN f USING (key)) AS hits, (SELECT count(DISTINCT key) FROM r WHERE key NOT IN (SELECT key FROM f)) AS misses"""))
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-3"""
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts")).first()[0]
    hits, misses = R.cached(events.select(F.sha2("props", 256).alias("key")), view(spark, sf, "cache_v"), F.lit(now))
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))


@query(with_views(["cache_v"], ", r AS (SELECT sha256(props) AS key, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT key, created_at, hit_count + coalesce(n, 0) AS hit_count FROM cache_v LEFT JOIN r USING (key)"))
def cache_counts(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-3: hit counts raised by the requests that the cache answers"""
    asked = table(spark, sf, "events").filter("event_type = 'view'").select(F.sha2("props", 256).alias("key"))
    cache = view(spark, sf, "cache_v")
    return R.count_hits(cache, R.cached(asked, cache, F.lit("1970-01-01").cast("timestamp"))[0].select("key"))


@query(with_views(["cache_v"], ", now AS (SELECT max(ts) AS t FROM events) SELECT key, hit_count FROM cache_v, now WHERE created_at >= t - INTERVAL 30 DAY"))
def cache_purge(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-3"""
    now = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return R.purge_expired(view(spark, sf, "cache_v"), F.lit(now)).select("key", "hit_count")


@query(with_views(["cache_v"], "SELECT count(*) AS entries, CAST(sum(hit_count) AS BIGINT) AS calls_saved, round(sum(hit_count) / (count(*) + sum(hit_count)), 4) AS hit_rate FROM cache_v"))
def cache_summary(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-3, STA-6"""
    return R.cache_summary(view(spark, sf, "cache_v"))


@query("""SELECT sha256(text) AS key, doc_id, CASE WHEN length(text) % 7 > 0 THEN length(text) || ' characters' END AS response, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: refused' END AS error FROM documents""")
def ask_model(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-4: a deterministic stand-in for a model that fails on some prompts."""

    def answer(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("refused")
        return f"{len(prompt)} characters"

    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.col("text").alias("prompt"))
    return R.ask(docs, answer).select("doc_id", "key", "response", "error")


@query(with_views(["claims_v"], """, w AS (SELECT *, CASE verdict WHEN 'supported' THEN 1.0 WHEN 'partially_supported' THEN 0.5 ELSE 0.0 END AS wt FROM claims_v),
g AS (SELECT verification_id, count(*) FILTER (checkable) AS checked, round(coalesce(avg(wt) FILTER (checkable), 0), 4)::DOUBLE AS score, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'partially_supported') AS partially_supported,
  count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'unverifiable') AS unverifiable FROM w GROUP BY verification_id)
SELECT verification_id, checked, score, CASE WHEN checked > 0 THEN supported ELSE 0 END AS supported, CASE WHEN checked > 0 THEN partially_supported ELSE 0 END AS partially_supported, CASE WHEN checked > 0 THEN unsupported ELSE 0 END AS unsupported,
  CASE WHEN checked > 0 THEN contradicted ELSE 0 END AS contradicted, CASE WHEN checked > 0 THEN unverifiable ELSE 0 END AS unverifiable, CASE WHEN checked > 0 THEN unsupported + contradicted ELSE 0 END AS problems,
  CASE WHEN score >= 0.85 THEN 'well supported' WHEN score >= 0.6 THEN 'partly supported' ELSE 'poorly supported' END AS label FROM g"""))
def verify_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """VER-4, VER-6"""
    return R.roll_up(view(spark, sf, "claims_v"))


@query("""WITH c AS (SELECT source AS verification_id, trim(split_part(text, '.', 1), ' ') AS claim, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, doc_id FROM documents WHERE length(trim(split_part(text, '.', 1), ' ')) >= 8)
SELECT verification_id, CAST(k AS INT) AS claim_index, claim, CASE WHEN doc_id % 5 = 0 THEN 'numeric' ELSE 'factual' END AS type, doc_id % 4 <> 0 AS checkable,
  CASE k % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'contradicted' ELSE 'unverifiable' END AS verdict, CASE k % 4 WHEN 3 THEN 'low' ELSE 'high' END AS confidence FROM c WHERE k < 25""")
def claim_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """VER-1, VER-3: claims from documents; judgements that are sometimes unknown, repeated or missing."""
    raw = table(spark, sf, "documents").select(F.col("source").alias("verification_id"), F.col("doc_id").alias("ord"), F.split_part("text", F.lit("."), F.lit(1)).alias("text"), F.when(F.col("doc_id") % 5 == 0, "numeric").alias("type"), F.when(F.col("doc_id") % 4 == 0, False).alias("checkable"))
    claims = R.normalise_claims(raw)
    k = F.col("claim_index") % 4
    first = claims.filter(k < 3).select("verification_id", "claim_index", F.lit(0).alias("ord"), F.when(k == 1, "maybe").when(k == 2, "supported").otherwise("supported").alias("verdict"), F.lit("high").alias("confidence"))
    later = claims.filter(k == 2).select("verification_id", "claim_index", F.lit(1).alias("ord"), F.lit("contradicted").alias("verdict"), F.lit("high").alias("confidence"))
    return R.judge_claims(claims, first.unionByName(later))


CLAIMS = "SELECT item_id, text FROM benchmark"
EVIDENCE = D_PLANS.search_sql(CLAIMS, "SELECT doc_id || '/' || i // 1000 AS chunk_id, substr(text, i + 1, 1200) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS i FROM documents)", 4) + """,
ev AS (SELECT 'v' || (item_id % 5) AS verification_id, item_id AS claim_index, place AS rank, chunk_id, 'd' || split_part(chunk_id, '/', 1) AS paper_id, score, substr(passages.text, 1, 700) AS passage FROM fused JOIN passages USING (chunk_id))"""


def claims_and_chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    claims = table(spark, sf, "benchmark").select(F.concat(F.lit("v"), F.col("item_id") % 5).alias("verification_id"), F.col("item_id").alias("claim_index"), F.col("text").alias("claim"))
    chunks = C.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text")
    return claims, chunks.select(F.concat_ws("/", "doc_id", "idx").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("paper_id"), "text")


@query(f"WITH {EVIDENCE} SELECT * FROM ev")
def claim_passages(spark: SparkSession, sf: str) -> DataFrame:
    """VER-2: each benchmark text as a claim, its best chunks by expanded and fused search for all claims at once."""
    return RT.gather_evidence(*claims_and_chunks(spark, sf))


@query(f"""WITH {EVIDENCE}, own AS (SELECT claim_index, string_agg('  - ' || passage, chr(10) ORDER BY rank) AS found FROM ev GROUP BY 1)
SELECT 'v' || (item_id % 5) AS verification_id, string_agg('[' || item_id || '] ' || text || chr(10) || coalesce(found, '  (nothing found)'), chr(10) || chr(10) ORDER BY item_id) AS prompt FROM benchmark LEFT JOIN own ON claim_index = item_id GROUP BY 1""")
def claim_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """VER-2, LLM-5: the claims of a verification with their passages, in one prompt."""
    claims, chunks = claims_and_chunks(spark, sf)
    return R.prompts_of(claims, RT.gather_evidence(claims, chunks))


@query("SELECT doc_id, 'An answer about ' || lang || chr(10) || 'small sample' || chr(10) || 'only ' || source || chr(10) || 'in short' AS prose FROM documents")
def checkable_prose(spark: SparkSession, sf: str) -> DataFrame:
    """VER-5"""
    result = """concat('{"answer": "An answer about ', lang, '", "caveats": ["small sample", "only ', source, '"], "summary": {"tldr": "in short"}}')"""
    return table(spark, sf, "documents").selectExpr("doc_id", f"{result} AS r").select("doc_id", R.checkable_text(F.col("r")).alias("prose"))


@query("""SELECT source AS run_id, doc_id AS place, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity, list_value('T1 of ' || source, 'S9', 'other') AS related_papers,
  CAST(row_number() OVER (PARTITION BY source ORDER BY CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END, doc_id) AS INT) AS position FROM documents""")
def gap_order(spark: SparkSession, sf: str) -> DataFrame:
    """GAP-1"""
    docs = table(spark, sf, "documents")
    severity = F.when(F.col("doc_id") % 4 == 0, "HIGH").when(F.col("doc_id") % 4 == 1, "low").when(F.col("doc_id") % 4 == 2, "medium").otherwise("dire")
    gaps = docs.select(F.col("source").alias("run_id"), F.col("doc_id").alias("place"), severity.alias("severity"), F.array(F.lit("S1"), F.lit("S9"), F.lit("other")).alias("related"))
    papers = docs.select(F.col("source").alias("run_id")).distinct().select("run_id", F.lit(1).alias("position"), F.concat(F.lit("T1 of "), "run_id").alias("title"))
    return R.order_gaps(gaps, papers)


@query("""WITH c AS (SELECT 'o' || o_orderkey AS paper_id, o_orderpriority AS pr, o_orderstatus AS st, o_orderkey AS k FROM orders)
SELECT paper_id, CASE WHEN trim(pr) = '' THEN 'not reported' ELSE trim(pr) END AS sample_size, CASE WHEN k % 3 = 0 THEN 'not reported' ELSE st END AS code_released, 'not reported' AS budget FROM c""")
def matrix_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """MTX-1, MTX-2, SNK-1"""
    keys = [k for k, _ in R.column_keys(["Sample size", "Code released?", "", "Budget"])]
    orders = table(spark, sf, "orders").dropDuplicates(["o_orderkey"])
    released = F.when(F.col("o_orderkey") % 3 == 0, " Not reported ").otherwise(F.col("o_orderstatus"))
    payload = F.create_map(F.lit("sample_size"), F.col("o_orderpriority"), F.lit("sample_size__evidence"), F.lit("as said"), F.lit("code_released"), released)
    return R.pivot_matrix(R.matrix_cells(orders.select(F.concat(F.lit("o"), "o_orderkey").alias("paper_id"), payload.alias("payload")), keys), keys)


@query("""SELECT doc_id AS run_id, i, marker, target, excerpt FROM (SELECT doc_id, 0 AS i, 'S1' AS marker, 'c1' AS target, substr(text, 1, 400) AS excerpt FROM documents UNION ALL SELECT doc_id, 2, 'G1', 'g1', lang FROM documents)""")
def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    """CIT-6"""
    docs = table(spark, sf, "documents")
    answers = docs.select(F.col("doc_id").alias("run_id"), F.array(F.lit("[S1]"), F.lit("S1, S3"), F.lit("G1"), F.lit("none")).alias("markers"))
    one = docs.select(F.col("doc_id").alias("run_id"), F.lit(1).alias("n"), F.lit("c1").alias("item_id"), "text")
    return R.resolve_markers(answers, one, one.withColumn("item_id", F.lit("g1")).drop("text").join(docs.select(F.col("doc_id").alias("run_id"), F.col("lang").alias("text")), "run_id"))


@query("""SELECT doc_id AS review_id, 'True of ' || lang || ' [S1][S2]. Invented. Also [S2], twice [S1].' AS text, list_value('S1', 'S2') AS used FROM documents""")
def review_citations(spark: SparkSession, sf: str) -> DataFrame:
    """CIT-7"""
    docs = table(spark, sf, "documents")
    text = F.concat(F.lit("True of "), "lang", F.lit(" [S1, S2 and S1]. Invented [S9]. Also  [S02 ; S7], twice [S1]. "))
    return R.clean_citations(docs.select(F.col("doc_id").alias("review_id"), text.alias("text")), docs.select(F.col("doc_id").alias("review_id"), F.array(F.lit("S1"), F.lit("S2")).alias("markers")))


P = with_views(["papers_v"], ", q AS (SELECT *, regexp_extract(paper_id, '\\d+')::BIGINT AS d FROM papers_v) ")


def cite(spark: SparkSession, sf: str, style: str) -> DataFrame:
    return S.citations(view(spark, sf, "papers_v"), style, "owner_id")


@query(P + "SELECT paper_id, (d % 50) || ', A., & Writer' || (d % 9) || ', A. B. (' || year || '). ' || title || '.' || CASE WHEN venue IS NULL THEN '' ELSE ' *' || venue || '*.' END || CASE WHEN doi IS NULL THEN '' ELSE ' https://doi.org/' || doi END AS citation FROM q WHERE title <> ''")
def bib_apa(spark: SparkSession, sf: str) -> DataFrame:
    return cite(spark, sf, "apa").filter("title <> ''").select("paper_id", "citation")


@query(P + "SELECT paper_id, (d % 50) || ', Author, et al. \"' || title || '.\"' || CASE WHEN venue IS NULL THEN '' ELSE ' *' || venue || '*,' END || ' ' || year || '.' || CASE WHEN doi IS NULL THEN '' ELSE ' https://doi.org/' || doi || '.' END AS citation FROM q WHERE title <> ''")
def bib_mla(spark: SparkSession, sf: str) -> DataFrame:
    return cite(spark, sf, "mla").filter("title <> ''").select("paper_id", "citation")


@query(P + """SELECT paper_id, CAST(row_number() OVER w AS INT) AS number, '[' || row_number() OVER w || '] A. ' || (d % 50) || ', and A. B. Writer' || (d % 9) || ', "' || title || ',"' || CASE WHEN venue IS NULL THEN '' ELSE ' *' || venue || '*,' END || ' ' || year || '.' || CASE WHEN doi IS NULL THEN '' ELSE ' doi: ' || doi || '.' END AS citation
FROM q WHERE title <> '' WINDOW w AS (PARTITION BY owner_id ORDER BY CAST(d % 50 AS VARCHAR), year, paper_id)""")
def bib_ieee(spark: SparkSession, sf: str) -> DataFrame:
    return S.citations(view(spark, sf, "papers_v").filter("title <> ''"), "ieee", "owner_id").select("paper_id", "number", "citation")


@query(P + """SELECT paper_id, concat_ws(chr(10), 'TY  - JOUR', 'AU  - ' || (d % 50) || ', Author', 'AU  - Writer' || (d % 9) || ', Ada B.', 'TI  - ' || title, 'PY  - ' || year, 'JO  - ' || venue, 'DO  - ' || doi, 'KW  - ' || keywords[1], 'KW  - ' || keywords[2], 'ER  - ') AS citation FROM q WHERE title <> ''""")
def bib_ris(spark: SparkSession, sf: str) -> DataFrame:
    return cite(spark, sf, "ris").filter("title <> ''").select("paper_id", "citation")


@query(P + """SELECT paper_id, '@' || CASE WHEN venue IS NULL THEN 'misc' ELSE 'article' END || '{unknown' || year || lower(coalesce(list_filter(regexp_extract_all(title, '[A-Za-z]{4,}'), lambda w: lower(w) NOT IN ('the', 'and', 'for', 'with', 'from', 'into', 'using'))[1], '')) || ',' || chr(10) ||
  concat_ws(',' || chr(10), '  author = {' || (d % 50) || ', Author and Writer' || (d % 9) || ', Ada B.}', '  title = {' || regexp_replace(replace(replace(regexp_replace(title, '([&%$#_{}])', '\\\\\\1', 'g'), '~', '\\textasciitilde{}'), '^', '\\textasciicircum{}'), 'x^', 'x', 'g') || '}', '  year = {' || year || '}', '  journal = {' || venue || '}', '  doi = {' || doi || '}', '  keywords = {' || array_to_string(keywords, ', ') || '}') || chr(10) || '}' AS citation FROM q WHERE title <> ''""")
def bib_bibtex(spark: SparkSession, sf: str) -> DataFrame:
    return cite(spark, sf, "bibtex").filter("title <> ''").select("paper_id", "citation")


@query(P + """SELECT paper_id, replace('**[S' || (d % 9) || ']** ' || array_to_string(authors, ', ') || '. (' || year || '). *' || title || '*' || CASE WHEN venue IS NULL THEN '' ELSE '. ' || venue END || CASE WHEN doi IS NULL THEN '' ELSE '. doi:' || doi END, '..', '.') AS reference FROM q""")
def review_references(spark: SparkSession, sf: str) -> DataFrame:
    """CIT-8"""
    d = F.regexp_extract("paper_id", r"\d+", 0).cast("long")
    line = R.reference_line(F.concat(F.lit("S"), (d % 9).cast("string")), F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("doi"))
    return view(spark, sf, "papers_v").select("paper_id", line.alias("reference"))


@query("""SELECT doc_id, greatest(1, CAST(round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 220.0) AS INT)) AS minutes, CAST(doc_id % 3 AS INT) AS n_citations FROM documents""")
def reading_times(spark: SparkSession, sf: str) -> DataFrame:
    """CIT-9"""
    cited = F.repeat(F.lit("[S4]"), (F.col("doc_id") % 3).cast("int"))
    return table(spark, sf, "documents").select("doc_id", R.reading_time(F.col("text")).alias("minutes"), R.n_citations(F.concat("text", cited)).alias("n_citations"))


@query(P + """, c AS (SELECT *, replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '|', '\\|') AS t FROM q)
SELECT paper_id, '| ' || CASE WHEN length(t) <= 90 THEN t ELSE rtrim(substr(t, 1, 89)) || '…' END || ' | ' || array_to_string(authors[1:3], ', ') || ' | ' || year || ' | ' || coalesce(venue, '—') || ' |' AS line FROM c""")
def corpus_table(spark: SparkSession, sf: str) -> DataFrame:
    """RPT-1"""
    return R.corpus_table(view(spark, sf, "papers_v"))


@query(P + "SELECT owner_id, CASE WHEN min(year) = max(year) THEN '' || min(year) ELSE min(year) || '–' || max(year) END AS years, count(*) AS n_papers FROM q GROUP BY owner_id")
def year_spans(spark: SparkSession, sf: str) -> DataFrame:
    """RPT-1"""
    return R.year_span(view(spark, sf, "papers_v"), "owner_id")


SEC = """s AS (SELECT doc_id AS report_id, CASE k WHEN 0 THEN 'introduction' WHEN 1 THEN 'themes' ELSE 'conclusion' END AS name, k, CASE WHEN (doc_id + k) % 3 = 0 THEN ' ' ELSE lang || k END AS text FROM documents, range(3) r(k))"""


@query(f"""WITH {SEC}, n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY k) AS i FROM s WHERE trim(text) <> '')
SELECT report_id, string_agg('## ' || i || '. ' || upper(name[1]) || name[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS markdown, count(*) AS n_sections, 'partial' AS status FROM n GROUP BY report_id""")
def review_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """RPT-2, RPT-3, RPT-5"""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), "lang", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    name = F.element_at(F.array(F.lit("introduction"), F.lit("themes"), F.lit("conclusion")), F.col("k") + 1)
    text = F.when((F.col("report_id") + F.col("k")) % 3 == 0, " ").otherwise(F.concat("lang", F.col("k").cast("string")))
    return R.assemble_review(docs.select("report_id", name.alias("name"), text.alias("text")), "report_id")


@query(P + "SELECT owner_id, paper_id, 'S' || n AS marker, title, array_to_string(authors[1:6], ', ') AS authors FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY year, title, paper_id) AS n FROM q) WHERE n <= 40")
def review_context(spark: SparkSession, sf: str) -> DataFrame:
    """RPT-4"""
    return R.review_context(view(spark, sf, "papers_v"), "owner_id")


@query(P + ", o AS (SELECT owner_id, paper_id, title, row_number() OVER (PARTITION BY owner_id ORDER BY paper_id) AS place FROM q) SELECT owner_id AS run_id, CASE WHEN count(*) = 1 THEN 'single' ELSE 'multi' END AS scope, list(paper_id ORDER BY place) AS paper_ids, list(title ORDER BY place) AS titles FROM o GROUP BY owner_id")
def summary_records(spark: SparkSession, sf: str) -> DataFrame:
    """SUM-1"""
    papers = view(spark, sf, "papers_v")
    runs = papers.select(F.col("owner_id").alias("run_id"), "paper_id", F.row_number().over(W.partitionBy("owner_id").orderBy("paper_id")).alias("place"))
    return R.summary_record(runs, papers)


@query("""SELECT page_id AS figure_id, CASE WHEN page_id % 2 = 0 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'skipped' WHEN page_id % 3 = 0 THEN 'analysed' ELSE 'failed' END AS status, CASE WHEN page_id % 3 = 0 THEN 'shows ' || page_id END AS description FROM pages""")
def figure_answers(spark: SparkSession, sf: str) -> DataFrame:
    """FIG-1"""
    pages = table(spark, sf, "pages")
    figures = pages.select(F.col("page_id").alias("figure_id"), F.when(F.col("page_id") % 2 == 0, "table").otherwise("figure").alias("kind"), F.when(F.col("page_id") % 2 == 0, "| a |").alias("table_markdown"))
    response = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"description": " shows '), F.col("page_id").cast("string"), F.lit('"}')))
    answers = pages.select(F.col("page_id").alias("figure_id"), response.alias("response"), F.when(F.col("page_id") % 3 != 0, "timeout").alias("error"))
    return R.normalise_figures(figures, answers, "description string")


# --- listings ---


@query(with_views(["papers_v"], ", r AS (SELECT source AS owner_id, 'p' || (doc_id + 3) AS paper_id FROM documents) SELECT r.owner_id, r.paper_id, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'indexed' THEN 'indexed' ELSE 'not indexed' END AS report FROM r LEFT JOIN papers_v p ON p.owner_id = r.owner_id AND p.paper_id = r.paper_id"))
def owner_scope(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-1"""
    asked = table(spark, sf, "documents").select(F.col("source").alias("owner_id"), F.concat(F.lit("p"), F.col("doc_id") + 3).alias("paper_id"))
    return L.owner_scope(view(spark, sf, "papers_v"), asked)


@query(P + "SELECT paper_id, title FROM q WHERE status = 'indexed' AND (contains(lower(title), 'er 4') OR len(list_filter(authors, lambda a: contains(lower(a), 'or 4'))) > 0)")
def paper_search(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-2"""
    return L.search_papers(view(spark, sf, "papers_v"), "OR 4", "indexed").select("paper_id", "title")


ORACLE["paper_search"] = P + "SELECT paper_id, title FROM q WHERE status = 'indexed' AND (contains(lower(title), 'or 4') OR len(list_filter(authors, lambda a: contains(lower(a), 'or 4'))) > 0)"


@query(P + "SELECT paper_id FROM q WHERE contains(lower(title), 'topic 1') OR len(list_filter(list_concat(authors, keywords), lambda a: contains(lower(a), 'topic 1'))) > 0")
def paper_search_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-3"""
    return L.search_papers(view(spark, sf, "papers_v"), "topic 1", with_keywords=True).select("paper_id")


def figures(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf, "pages").select(p.alias("figure_id"), F.concat(F.lit("p"), p).alias("paper_id"), F.when(p % 2 == 0, "table").otherwise("figure").alias("kind"), F.when(p % 3 == 0, "analysed").otherwise("pending").alias("status"), (p % 7).alias("page"), F.concat(F.lit("Figure "), p).alias("label"), F.when(p % 5 > 0, F.col("url")).alias("image_path"))


@query(with_views(["papers_v"], "SELECT page_id AS figure_id, title AS paper_title, page_id % 7 AS page, 'Figure ' || page_id AS label, page_id % 5 > 0 AND url IS NOT NULL AS has_image FROM pages LEFT JOIN papers_v ON paper_id = 'p' || page_id WHERE page_id % 2 <> 0 AND page_id % 3 <> 0"))
def figure_listing(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-4, FIL-16"""
    return L.figure_listing(figures(spark, sf), view(spark, sf, "papers_v"), "figure", "pending").select("figure_id", "paper_title", "page", "label", "has_image")


@query("SELECT count(*) FILTER (page_id % 3 <> 0 AND page_id % 5 > 0) AS pending, least(count(*) FILTER (page_id % 3 <> 0 AND page_id % 5 > 0), 20) AS this_run, count(*) FILTER (page_id % 3 = 0) AS readable FROM pages")
def pending_figures(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-5"""
    return L.pending_figures(figures(spark, sf), 20)


@query("SELECT event_id AS hypothesis_id, CASE WHEN event_type = 'click' THEN 'promising' ELSE 'plausible' END AS verdict FROM events WHERE event_type = 'click' AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 50")
def hypothesis_listing(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-6"""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("hypothesis_id"), F.when(F.col("event_type") == "click", "promising").otherwise("plausible").alias("verdict"), (F.col("user_id") % 2 == 0).alias("starred"), F.col("ts").alias("created_at"))
    return L.hypotheses(rows, "promising", True).select("hypothesis_id", "verdict")


@query(with_views(["runs_v"], "SELECT run_id, owner_id, intent, status FROM runs_v WHERE intent IN ('qa', 'summarize', 'extract', 'gap') ORDER BY created_at DESC, run_id LIMIT 50"))
def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-7, HIS-3: an intent that is not known means all of them."""
    return L.history(view(spark, sf, "runs_v"), ["nonsense"]).select("run_id", "owner_id", "intent", "status")


@query(with_views(["claims_v"], "SELECT verification_id, claim_index, verdict FROM claims_v WHERE verification_id = 'v7'"))
def past_verifications(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-8"""
    return L.verification_rows(view(spark, sf, "claims_v"), "v7").select("verification_id", "claim_index", "verdict")


@query("SELECT event_id AS report_id, 'u' || user_id AS owner_id, event_type AS kind, CAST(event_id % 4 AS INT) AS n_sections, 0 AS n_citations, 2 AS n_papers FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 50")
def saved_results(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-15"""
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("report_id"), F.concat(F.lit("u"), "user_id").alias("owner_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.array_repeat(F.lit("s"), (F.col("event_id") % 4).cast("int")).alias("sections"), F.lit(None).cast("array<string>").alias("citations"), F.array(F.lit("a"), F.lit("b")).alias("paper_ids"))
    return L.saved_results(rows, "view").drop("created_at")


@query(P + "SELECT paper_id, title, authors, keywords, CASE WHEN d % 2 = 0 THEN list_value('abstract', 'method') ELSE CAST([] AS VARCHAR[]) END AS section_names, CASE WHEN d % 3 = 0 THEN 'ocr' ELSE 'native' END AS text_source FROM q")
def paper_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-16"""
    d = F.regexp_extract("paper_id", r"\d+", 0).cast("long")
    papers = view(spark, sf, "papers_v").withColumn("sections", F.when(d % 2 == 0, F.create_map(F.lit("method"), F.lit("m"), F.lit("abstract"), F.lit("a")))).withColumn("text_source", F.when(d % 3 == 0, "ocr"))
    return L.paper_summary(papers)


@query("SELECT label, count(*) FILTER (length(trim(text)) >= 8) AS claims, count(*) FILTER (length(trim(text)) >= 20) AS verifiable, count(*) FILTER (length(trim(text)) >= 10) AS explainable FROM (SELECT text, lang AS label FROM documents) GROUP BY label")
def text_guards(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-13"""
    n = {"claims": R.CLAIM, "verifiable": R.VERIFIABLE, "explainable": R.EXPLAINABLE}
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("label")).agg(*(F.count_if(R.long_enough(F.col("text"), least)).alias(k) for k, least in n.items()))


@query(with_views(["papers_v"], """, c AS (SELECT source AS owner_id, count(*) AS chunks FROM (SELECT source, unnest(range((length(text) - 1) // 1000 + 1)) FROM documents WHERE length(text) > 0) GROUP BY source), r AS (SELECT source AS owner_id, count(*) AS runs FROM documents JOIN labels USING (doc_id) GROUP BY source), g AS (SELECT source AS owner_id, count(*) AS reports FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
SELECT owner_id, count(*) AS papers, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed, coalesce(any_value(chunks), 0) AS chunks, coalesce(any_value(runs), 0) AS runs, coalesce(any_value(reports), 0) AS reports FROM papers_v LEFT JOIN c USING (owner_id) LEFT JOIN r USING (owner_id) LEFT JOIN g USING (owner_id) GROUP BY owner_id"""))
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """STA-1"""
    from corpusloom.operators import chunks as C

    docs = table(spark, sf, "documents").withColumnRenamed("source", "owner_id")
    runs = docs.join(table(spark, sf, "labels"), "doc_id")
    return L.corpus_stats(view(spark, sf, "papers_v"), C.fixed_chunks(docs, "owner_id", "text"), runs, runs.filter("quality = 1"))


@query(P + "SELECT keyword, count(*) AS n FROM (SELECT array_to_string(list_transform(string_split(k, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS keyword FROM (SELECT unnest(keywords) AS k FROM q)) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 20")
def top_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """STA-2"""
    return L.top_keywords(view(spark, sf, "papers_v"))


@query(P + "SELECT year, count(*) AS n FROM q GROUP BY year")
def papers_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """STA-3"""
    return L.papers_by_year(view(spark, sf, "papers_v"))


@query(P + "SELECT count(*) AS papers, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (year % 5 = 0) AS ocr_assisted FROM q")
def health(spark: SparkSession, sf: str) -> DataFrame:
    """STA-4"""
    return L.health(view(spark, sf, "papers_v").withColumn("text_source", F.when(F.col("year") % 5 == 0, "mixed")))


@query(with_views(["job_items_v"], "SELECT state AS outcome, count(*) AS n FROM job_items_v WHERE state IN ('indexed', 'duplicate', 'failed') GROUP BY state"))
def upload_summary(spark: SparkSession, sf: str) -> DataFrame:
    """STA-5"""
    return L.upload_summary(view(spark, sf, "job_items_v").filter("state IN ('indexed', 'duplicate', 'failed')").withColumnRenamed("state", "outcome"))


ROLL = """SELECT job_id, total, completed, failed, round((completed + failed) / total, 3) AS progress, CASE WHEN completed + failed < total THEN 'running' WHEN failed = 0 THEN 'completed' WHEN completed > 0 THEN 'partial' ELSE 'failed' END AS status
FROM (SELECT job_id, count(*) AS total, count(*) FILTER (state IN ('indexed', 'duplicate')) AS completed, count(*) FILTER (state = 'failed') AS failed FROM {t} GROUP BY job_id)"""


@query(with_views(["job_items_v"], ROLL.format(t="job_items_v")))
def job_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """STA-7"""
    return L.job_rollup(view(spark, sf, "job_items_v"))


@query(with_views(["job_items_v"], ", s AS (SELECT job_id, CASE WHEN CAST(job_id[2:] AS INT) % 2 = 1 AND state IN ('queued', 'running') THEN 'failed' ELSE state END AS state FROM job_items_v) " + ROLL.format(t="s")))
def stale_reclaim(spark: SparkSession, sf: str) -> DataFrame:
    """STA-8"""
    rows = view(spark, sf, "job_items_v")
    live = rows.filter("cast(substring(job_id, 2) AS int) % 2 = 0").select("job_id").distinct()
    return L.job_rollup(L.reclaim_stale(rows, live))


@query(with_views(["runs_v"], """SELECT run_id, CASE WHEN nullif(trim(question), '') IS NOT NULL THEN trim(question) WHEN intent = 'summarize' THEN 'A title' WHEN intent = 'gap' THEN '2 gaps — Few data' ELSE '1 paper' END AS label FROM runs_v"""))
def run_labels(spark: SparkSession, sf: str) -> DataFrame:
    """HIS-1"""
    result = F.when(F.col("intent") == "summarize", '{"summary": {"title": "A title", "tldr": "short"}}').when(F.col("intent") == "gap", '{"gaps": [{"title": "Few data"}, {"title": "b"}]}')
    return view(spark, sf, "runs_v").select("run_id", L.run_label(F.col("question"), result, F.lit(1)).alias("label"))


@query(with_views(["runs_v"], "SELECT run_id, owner_id, intent, CAST(duration_ms % 3 AS INT) AS paper_count, status = 'partial' AS has_error, created_at FROM runs_v"))
def run_items(spark: SparkSession, sf: str) -> DataFrame:
    """HIS-2, SNK-4"""
    runs = view(spark, sf, "runs_v").withColumn("paper_ids", F.array_repeat(F.lit("p"), (F.col("duration_ms") % 3).cast("int"))).withColumn("error", F.when(F.col("status") == "partial", "x"))
    return L.run_items(runs)


@query(with_views(["runs_v"], "SELECT run_id, intent FROM runs_v WHERE NOT (owner_id = 'u1' AND intent IN ('qa', 'gap'))"))
def clear_history(spark: SparkSession, sf: str) -> DataFrame:
    """HIS-4"""
    return L.without_intents(view(spark, sf, "runs_v"), "u1", ["qa", "gap"]).select("run_id", "intent")


def traced(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda node, ms: F.struct(F.lit(node).alias("node"), F.col("status"), ms.alias("duration_ms"))
    return view(spark, sf, "runs_v").withColumn("trace", F.array(step("retrieve", F.col("duration_ms")), step("answer", F.col("duration_ms") + 1)))


@query(with_views(["runs_v"], "SELECT run_id, 0 AS step, 'retrieve' AS node, status, duration_ms FROM runs_v UNION ALL SELECT run_id, 1, 'answer', status, duration_ms + 1 FROM runs_v"))
def trace_steps(spark: SparkSession, sf: str) -> DataFrame:
    """HIS-5"""
    return L.trace_steps(traced(spark, sf))


@query(with_views(["runs_v"], "SELECT run_id, list_value('a' || run_id, 'b' || run_id) AS trace, CAST([] AS VARCHAR[]) AS errors, CAST(3 AS BIGINT) AS calls FROM runs_v"))
def merge_branches(spark: SparkSession, sf: str) -> DataFrame:
    """HIS-5"""
    runs = view(spark, sf, "runs_v").select("run_id")
    one = lambda b, n: runs.select("run_id", F.lit(b).alias("branch"), F.array(F.concat(F.lit(b), "run_id")).alias("trace"), F.array().cast("array<string>").alias("errors"), F.lit(n).alias("calls"))
    return L.merge_branches(one("a", 1).unionByName(one("b", 2)))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS turns, max(turn) AS last_turn, arg_min(substr(text, 1, 120), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id")
def conversation_list(spark: SparkSession, sf: str) -> DataFrame:
    """CNV-1"""
    return L.conversation_list(table(spark, sf, "conversations"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS b FROM conversations) WHERE b <= 4")
def conversation_memory(spark: SparkSession, sf: str) -> DataFrame:
    """CNV-2"""
    return L.memory_window(table(spark, sf, "conversations"), 2).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Researcher: ' ELSE 'You: ' END || trim(text, ' '), chr(10) ORDER BY turn, CASE WHEN role = 'user' THEN 'Researcher: ' ELSE 'You: ' END || trim(text, ' ')) AS transcript FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id")
def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """CNV-3"""
    return L.transcripts(table(spark, sf, "conversations"))


@query("SELECT conv_id, max(turn) + 2 AS last_turn, count(*) + 2 AS n FROM conversations GROUP BY conv_id")
def append_turn(spark: SparkSession, sf: str) -> DataFrame:
    """CNV-4"""
    messages = table(spark, sf, "conversations")
    new = messages.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("text"), F.lit(0).alias("ord")), F.struct(F.lit("assistant").alias("role"), F.lit("a").alias("text"), F.lit(1).alias("ord")))).alias("m")).select("conv_id", "m.*")
    return L.append_turn(messages, new).groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("SELECT 'papers' AS table_name, count(*) FILTER (doc_id % 5 = 0) AS adopted FROM documents UNION ALL SELECT 'runs', count(*) FILTER (event_id % 7 = 0) FROM events")
def adopt_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """OWN-1"""
    tables = {
        "papers": table(spark, sf, "documents").withColumn("owner_id", F.when(F.col("doc_id") % 5 > 0, F.col("source"))),
        "runs": table(spark, sf, "events").withColumn("owner_id", F.when(F.col("event_id") % 7 > 0, "u")),
    }
    return L.adopt_orphans(tables, "first")[1]


# --- sources and sinks ---


@query("SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new ' || text FROM documents WHERE doc_id % 3 = 0")
def replace_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-3, done twice."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    fresh = docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return S.replace_by_key(S.replace_by_key(docs, fresh, "doc_id"), fresh, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-5"""
    docs = table(spark, sf, "documents").select("doc_id")
    return S.cascade_delete({"papers": docs}, table(spark, sf, "labels").filter("toxic = 1"), "doc_id")["papers"]


@query("SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE lang END AS lang, CAST(0 AS BIGINT) AS pages FROM documents")
def evolve_schema(spark: SparkSession, sf: str) -> DataFrame:
    """EVO-1, done twice."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 2 > 0, F.col("lang")).alias("lang"))
    schema = TY.StructType.fromDDL("doc_id long, source string, lang string, pages long")
    defaults = {"lang": F.lit("unknown"), "pages": F.lit(0)}
    return S.with_defaults(S.with_defaults(docs, schema, defaults), schema, defaults)


@query(with_views(["kg_nodes_v", "kg_edges_v"], "SELECT source, target, type, list_sort(papers) AS papers FROM kg_edges_v"))
def graph_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-3: written and read again."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    S.write_graph(view(spark, sf, "kg_nodes_v"), view(spark, sf, "kg_edges_v"), path)
    return S.read_graph(spark, path)[1].withColumn("papers", F.array_sort("papers"))


@query("SELECT doc_id, text FROM documents WHERE n_chars > 1000")
def load_table(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2"""
    return S.load(spark, sf, "documents.parquet").filter("n_chars > 1000").select("doc_id", "text")


# --- sources and sinks, written and read back ---


@query("""SELECT reason, count(*) AS files, sum(n) AS n_bytes FROM (SELECT source, sum(strlen(text) + 1) + CASE WHEN regexp_extract(source, '[0-9]+')::INT % 3 > 0 THEN 6 ELSE 0 END AS n, CASE WHEN sum(strlen(text) + 1) + 6 > 150000 AND regexp_extract(source, '[0-9]+')::INT % 3 > 0 OR sum(strlen(text) + 1) > 150000 THEN 'too large' WHEN regexp_extract(source, '[0-9]+')::INT % 3 = 0 THEN 'wrong type' END AS reason FROM documents GROUP BY source) GROUP BY reason""")
def source_binaries(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1: a file for each source, two in three of which begin with the mark of their type"""
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    marked = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 3 > 0
    marks = docs.select("source").distinct().filter(marked).select("source", F.lit(-1).cast("long").alias("doc_id"), F.lit("%PDF-").alias("text"))
    path = new_folder(spark, "binaries")
    lines = docs.unionByName(marks).repartition("source").sortWithinPartitions("source", "doc_id")
    lines.select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    return S.scan_binaries(spark, path, 150_000 / 1024 / 1024).groupBy("reason").agg(F.count("*").alias("files"), F.sum("length").cast("decimal(38,0)").alias("n_bytes"))


@query("""SELECT 'Order ' || o_orderkey || ' of "' || o_orderstatus || '", late' AS Paper, o_orderpriority AS "Priority, stated", 'a' || o_custkey || '; b' || o_orderkey AS Names FROM orders""")
def sink_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1: a matrix as a file of comma-separated lines with lists and quotes"""
    orders = table(spark, sf, "orders").dropDuplicates(["o_orderkey"])
    paper = F.concat(F.lit("o"), "o_orderkey").alias("paper_id")
    titles = orders.select(paper, F.concat(F.lit("Order "), "o_orderkey", F.lit(' of "'), "o_orderstatus", F.lit('", late')).alias("title"))
    matrix = orders.select(paper, F.col("o_orderpriority").alias("priority"), F.array(F.concat(F.lit("a"), "o_custkey"), F.concat(F.lit("b"), "o_orderkey")).alias("names"))
    path = new_folder(spark, "matrix")
    S.matrix_to_csv(matrix, titles, [("priority", "Priority, stated"), ("names", "Names")], path)
    return spark.read.option("header", "true").option("escape", "\\").csv(path)


@query(P + """, c AS (SELECT paper_id, d, year, (d % 50) || ', A., & Writer' || (d % 9) || ', A. B. (' || year || '). T' || d || '.' || CASE WHEN venue IS NULL THEN '' ELSE ' *' || venue || '*.' END || CASE WHEN doi IS NULL THEN '' ELSE ' https://doi.org/' || doi END AS value FROM q)
SELECT row_number() OVER (ORDER BY (d % 50)::VARCHAR, year, paper_id) AS line_no, value FROM c""")
def sink_bibliography(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-2: a bibliography's lines in the order of its files"""
    path = new_folder(spark, "bibliography")
    S.write_bibliography(view(spark, sf, "papers_v").withColumn("title", F.concat(F.lit("T"), F.substring("paper_id", 2, 20))), "apa", path)
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).filter("value <> ''")
    return lines.withColumn("line_no", F.row_number().over(W.orderBy(F.regexp_extract("file", r"part-(\d+)", 1), "at")).cast("long")).select("line_no", "value")


@query(with_views(["runs_v"], "SELECT status, sum(n) AS n FROM (SELECT CASE WHEN duration_ms % 5 = 0 THEN 'failed' WHEN duration_ms % 2 = 0 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN duration_ms % 3 = 0 THEN 2 ELSE 1 END AS n FROM runs_v) GROUP BY status"))
def sink_runs(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-4: all runs are appended, then a third of them once more"""
    runs = view(spark, sf, "runs_v").select("run_id", "duration_ms", F.when(F.col("duration_ms") % 5 == 0, "x").alias("error"), F.when(F.col("duration_ms") % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    path = new_folder(spark, "runs")
    S.append_runs(runs, path)
    S.append_runs(runs.filter("duration_ms % 3 = 0"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").cast("decimal(38,0)").alias("n"))


# --- sections, details, prompts ---

#: A run for each source: its documents are gaps, themes and papers; every value comes from the rows.
GAP_ROWS = """g AS (SELECT source AS run_id, doc_id AS place, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'high' ELSE 'low' END AS severity, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'data_' || lang END AS category, substr(text, 1, 60) AS title, substr(text, 50, 120) AS description,
  CASE WHEN doc_id % 2 = 0 THEN list_value(substr(text, 1, 20), lang || ' | ' || n_chars) ELSE [] END AS evidence, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE 'try ' || lang END AS direction, CASE WHEN doc_id % 3 = 1 THEN list_value('d' || (doc_id + 1), 'd' || (doc_id + 2)) ELSE [] END AS related FROM documents WHERE source <> 'src3')"""
PLAIN = "replace(trim(regexp_replace(coalesce({}, ''), '[\\s\\x0B]+', ' ', 'g')), '|', '\\|')"


def plain_sql(value: str) -> str:
    return PLAIN.format(value)


BULLETS = "array_to_string(list_transform({}, lambda x: '- ' || " + plain_sql("x") + "), chr(10))"
LISTED = "array_to_string(list_transform({}, lambda x: " + plain_sql("x") + "), ', ')"


@query(f"""WITH {GAP_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place) AS i FROM g),
t AS (SELECT run_id, i, concat_ws(chr(10), '### Gap ' || i || ': ' || {plain_sql('title')}, '**Severity:** ' || upper(coalesce(severity, 'medium')) || ' · **Category:** ' || CASE WHEN category IS NULL THEN 'General' ELSE 'Data ' || upper(category[6]) || category[7:] END || chr(10), {plain_sql('description')} || chr(10),
  CASE WHEN len(evidence) > 0 THEN '**Evidence:**' || chr(10) || {BULLETS.format('evidence')} || chr(10) END, CASE WHEN direction <> '' THEN '**Proposed direction:** ' || {plain_sql('direction')} || chr(10) END, CASE WHEN len(related) > 0 THEN '**Related papers:** ' || {LISTED.format('related')} || chr(10) END) AS t FROM n),
b AS (SELECT run_id, string_agg(t, chr(10) ORDER BY i) AS body FROM t GROUP BY 1), l AS (SELECT source AS run_id, min(n_chars) AS lo, count(*) AS n FROM documents GROUP BY 1)
SELECT run_id, md5(CASE WHEN body IS NULL THEN '_No gaps are known yet._' ELSE concat_ws(chr(10), CASE WHEN n % 2 = 0 THEN 'Summary ' || lo || chr(10) END, body, '### Under-explored Intersections' || chr(10) || '- ' || run_id || ' x ' || n || chr(10), CASE WHEN lo % 2 = 0 THEN '### Open Questions' || chr(10) || '- why ' || lo || chr(10) END) END) AS text FROM l LEFT JOIN b USING (run_id)""")
def gap_sections(spark: SparkSession, sf: str) -> DataFrame:
    """RPT-2"""
    docs = table(spark, sf, "documents")
    none, d = F.array().cast("array<string>"), F.col("doc_id")
    text = lambda c: F.col(c).cast("string")
    gaps = docs.filter("source <> 'src3'").select(
        F.col("source").alias("run_id"), d.alias("place"), F.when(d % 4 == 0, None).when(d % 4 == 1, "high").otherwise("low").alias("severity"), F.when(d % 3 != 0, F.concat(F.lit("data_"), "lang")).alias("category"),
        F.substring("text", 1, 60).alias("title"), F.substring("text", 50, 120).alias("description"), F.when(d % 2 == 0, F.array(F.substring("text", 1, 20), F.concat("lang", F.lit(" | "), text("n_chars")))).otherwise(none).alias("evidence"),
        F.when(d % 5 == 0, None).when(d % 5 == 1, "").otherwise(F.concat(F.lit("try "), "lang")).alias("direction"), F.when(d % 3 == 1, F.array(*(F.concat(F.lit("d"), (d + k).cast("string")) for k in (1, 2)))).otherwise(none).alias("related"),
    )
    of_run = docs.groupBy(F.col("source").alias("run_id")).agg(F.min("n_chars").alias("lo"), F.count("*").alias("n"))
    landscapes = of_run.select("run_id", F.when(F.col("n") % 2 == 0, F.concat(F.lit("Summary "), text("lo"))).alias("summary"), F.array(F.concat("run_id", F.lit(" x "), text("n"))).alias("intersections"), F.when(F.col("lo") % 2 == 0, F.array(F.concat(F.lit("why "), text("lo")))).otherwise(none).alias("open_questions"))
    return RP.gap_sections(gaps, landscapes).withColumn("text", F.md5(F.col("text").cast("binary")))


@query(f"""WITH t AS (SELECT source AS run_id, doc_id AS place, concat_ws(chr(10), '### ' || {plain_sql("lang || ' ' || doc_id")}, {plain_sql('substr(text, 1, 90)')}, CASE WHEN doc_id % 3 > 0 THEN chr(10) || '_Papers:_ ' || {LISTED.format("list_value('d' || doc_id, source)")} END, '') AS t FROM documents WHERE doc_id % 4 > 0),
b AS (SELECT run_id, string_agg(t, chr(10) ORDER BY place) AS body FROM t GROUP BY 1), s AS (SELECT source AS run_id, max(n_chars) AS hi, count(*) AS n FROM documents GROUP BY 1)
SELECT run_id, md5(concat_ws(chr(10), CASE WHEN n % 2 = 1 THEN 'Overview of ' || n || chr(10) END, body, '### Points of Agreement' || chr(10) || '- at most ' || hi || chr(10), CASE WHEN hi % 2 = 0 THEN '### Methodological Trends' || chr(10) || '- longer' || chr(10) || '- by ' || hi || chr(10) END)) AS text,
  CASE WHEN n % 3 = 0 THEN '' ELSE '> **Incomplete report.**' || chr(10) || '>' || chr(10) || array_to_string(list_transform(range(1, least(10, n % 14) + 1), lambda i: '> - note ' || i), chr(10)) || chr(10) END AS notes FROM s LEFT JOIN b USING (run_id) WHERE n % 14 > 0 OR n % 3 = 0""")
def synthesis_sections(spark: SparkSession, sf: str) -> DataFrame:
    """RPT-2: synthesis and notes"""
    docs = table(spark, sf, "documents")
    none, d, text = F.array().cast("array<string>"), F.col("doc_id"), lambda c: F.col(c).cast("string")
    themes = docs.filter("doc_id % 4 > 0").select(F.col("source").alias("run_id"), d.alias("place"), F.concat_ws(" ", "lang", "doc_id").alias("name"), F.substring("text", 1, 90).alias("description"), F.when(d % 3 > 0, F.array(F.concat(F.lit("d"), text("doc_id")), "source")).otherwise(none).alias("papers"))
    runs = docs.groupBy(F.col("source").alias("run_id")).agg(F.max("n_chars").alias("hi"), F.count("*").alias("n"))
    summaries = runs.select("run_id", F.when(F.col("n") % 2 == 1, F.concat(F.lit("Overview of "), text("n"))).alias("overview"), F.array(F.concat(F.lit("at most "), text("hi"))).alias("agreements"), none.alias("disagreements"), F.when(F.col("hi") % 2 == 0, F.array(F.lit("longer"), F.concat(F.lit("by "), text("hi")))).otherwise(none).alias("trends"))
    out = RP.synthesis_sections(summaries, themes).withColumn("text", F.md5(F.col("text").cast("binary")))
    notes = F.when(F.col("n") % 3 != 0, F.transform(F.sequence(F.lit(1), (F.col("n") % 14).cast("int")), lambda i: F.concat(F.lit("note "), i.cast("string")))).otherwise(none)
    return out.join(runs.filter("n % 14 > 0 OR n % 3 = 0").select("run_id", RP.notes_block(notes).alias("notes")), "run_id")


@query(P + f"""SELECT owner_id, md5(string_agg('1. ' || CASE WHEN d % 6 = 0 THEN 'Unknown author' ELSE array_to_string(authors2[1:5], ', ') || CASE WHEN len(authors2) > 5 THEN ' et al.' ELSE '' END END || ' (' || CASE WHEN d % 7 = 0 THEN 'n.d.' ELSE '' || year END || '). ' || {plain_sql('title')} || '.' || CASE WHEN venue IS NULL THEN '' ELSE ' _' || venue || '_.' END || CASE WHEN doi IS NULL THEN '' ELSE ' https://doi.org/' || doi END, chr(10)
  ORDER BY CASE WHEN d % 6 = 0 THEN '' ELSE authors2[1] END, CASE WHEN d % 7 = 0 THEN 0 ELSE year END, paper_id)) AS "references", count(*) AS n_references FROM (SELECT *, list_transform(range(0, d % 8 + 1), lambda i: 'Author ' || (d + i) % 50) AS authors2 FROM q) GROUP BY owner_id""")
def report_references(spark: SparkSession, sf: str) -> DataFrame:
    """CIT-8: the references of a report"""
    d = F.regexp_extract("paper_id", r"\d+", 0).cast("long")
    many = F.transform(F.sequence(F.lit(0), (d % 8).cast("int")), lambda i: F.concat(F.lit("Author "), ((d + i) % 50).cast("string")))
    papers = view(spark, sf, "papers_v").withColumn("authors", F.when(d % 6 == 0, F.array().cast("array<string>")).otherwise(many)).withColumn("year", F.when(d % 7 == 0, None).otherwise(F.col("year")))
    return RP.report_references(papers, "owner_id").withColumn("references", F.md5(F.col("references").cast("binary")))


def matrix_answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each order; those of one customer are a run."""
    orders, k = table(spark, sf, "orders").dropDuplicates(["o_orderkey"]), F.col("o_orderkey")
    payload = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("priority__evidence"), F.lit("as said"), F.lit("state"), F.when(k % 3 == 0, " Not reported ").otherwise(F.col("o_orderstatus")))
    return orders.select(F.concat(F.lit("m"), "o_custkey").alias("run_id"), F.concat(F.lit("o"), k).alias("paper_id"), F.when(k % 5 > 0, F.concat(F.lit("Order "), k)).alias("title"), payload.alias("payload"), F.when(k % 4 == 0, F.concat(F.lit("no answer for "), k)).alias("error"))


@query("""SELECT 'm' || o_custkey AS run_id, 'o' || o_orderkey AS paper_id, CASE WHEN o_orderkey % 5 > 0 THEN 'Order ' || o_orderkey END AS title, CASE WHEN trim(o_orderpriority) = '' THEN 'not reported' ELSE trim(o_orderpriority) END AS priority, CASE WHEN o_orderkey % 3 = 0 THEN 'not reported' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 4 <> 0""")
def matrix_rows(spark: SparkSession, sf: str) -> DataFrame:
    """MTX-2: the rows of each run"""
    return RP.matrix_rows(matrix_answers(spark, sf), ["priority", "state"])


@query("""SELECT 'm' || o_custkey AS run_id, count(*) FILTER (o_orderkey % 4 <> 0) AS n_rows, coalesce(list(CASE WHEN o_orderkey % 5 > 0 THEN 'Order ' || o_orderkey ELSE 'o' || o_orderkey END || ': no answer for ' || o_orderkey ORDER BY 'o' || o_orderkey) FILTER (o_orderkey % 4 = 0), []) AS errors,
  CASE WHEN count(*) FILTER (o_orderkey % 4 <> 0) > 0 AND count(*) FILTER (o_orderkey % 4 = 0) = 0 THEN 'completed' ELSE 'partial' END AS status FROM orders GROUP BY o_custkey""")
def matrix_status(spark: SparkSession, sf: str) -> DataFrame:
    """MTX-2: errors and status of each run"""
    return RP.matrix_status(matrix_answers(spark, sf))


@query(with_views(["runs_v"], """SELECT run_id, intent, CASE WHEN nullif(trim(question), '') IS NOT NULL THEN trim(question) WHEN intent = 'summarize' THEN 'Title ' || duration_ms WHEN intent = 'gap' THEN '1 gap — T' || duration_ms ELSE (duration_ms % 3) || CASE WHEN duration_ms % 3 = 1 THEN ' paper' ELSE ' papers' END END AS label, question, list_transform(range(0, duration_ms % 3), lambda i: 'p') AS paper_ids, status, duration_ms, created_at,
  CASE WHEN intent = 'qa' THEN 'answer ' || duration_ms END AS answer, CASE WHEN intent = 'summarize' THEN '{"title":"Title ' || duration_ms || '"}' END AS summary, CAST(NULL AS VARCHAR) AS extraction, CASE WHEN intent = 'gap' THEN '[{"title":"T' || duration_ms || '"}]' END AS gaps, CAST(NULL AS VARCHAR) AS graph,
  CASE WHEN intent = 'qa' THEN '["c' || duration_ms || '"]' ELSE '[]' END AS retrieved, '[]' AS graph_facts, '[]' AS graph_matches, '[]' AS documents, CASE WHEN status = 'partial' THEN ['stopped'] ELSE [] END AS errors FROM runs_v WHERE CAST(run_id[2:] AS BIGINT) % 7 = 0"""))
def run_details(spark: SparkSession, sf: str) -> DataFrame:
    """HIS-2: every seventh run is asked for by its owner, every eleventh by another one"""
    ms, intent = F.col("duration_ms").cast("string"), F.col("intent")
    result = F.when(intent == "qa", F.concat(F.lit('{"answer":"answer '), ms, F.lit('","retrieved":["c'), ms, F.lit('"]}'))).when(intent == "summarize", F.concat(F.lit('{"summary":{"title":"Title '), ms, F.lit('"}}'))).when(intent == "gap", F.concat(F.lit('{"gaps":[{"title":"T'), ms, F.lit('"}]}')))
    runs = view(spark, sf, "runs_v").withColumn("result", result).withColumn("paper_ids", F.array_repeat(F.lit("p"), (F.col("duration_ms") % 3).cast("int"))).withColumn("error", F.when(F.col("status") == "partial", "stopped"))
    number = F.substring("run_id", 2, 20).cast("long")
    asked = runs.filter(number % 7 == 0).select("run_id", "owner_id").unionByName(runs.filter(number % 11 == 0).select("run_id", F.concat("owner_id", F.lit("x")).alias("owner_id")))
    return RP.run_details(runs, asked)


@query("""WITH c AS (SELECT source AS run_id, row_number() OVER (PARTITION BY source ORDER BY lang) AS place, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)),
l AS (SELECT run_id, string_agg('- `' || lang || '` — Share of ' || lang || '. ' || CASE WHEN n % 2 = 0 THEN 'Of ' || n || ' texts. ' ELSE '' END || CASE n % 3 WHEN 0 THEN 'Give the figure with its unit.' WHEN 1 THEN 'Give a list of short names.' ELSE 'Answer in a short phrase.' END || chr(10) || '- `' || lang || '__evidence` — the words that support it.', chr(10) ORDER BY place) AS body FROM c GROUP BY 1)
SELECT run_id, 'd' || doc_id AS paper_id, md5('# ' || CASE WHEN doc_id % 4 = 0 THEN 'd' || doc_id ELSE substr(text, 1, 40) END || chr(10) || chr(10) || '## Columns' || chr(10) || body || chr(10) || chr(10) || '## Text' || chr(10) || text) AS prompt FROM documents JOIN l ON l.run_id = source""")
def column_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-5: the columns of a matrix"""
    docs = table(spark, sf, "documents")
    per_lang = docs.groupBy(F.col("source").alias("run_id"), "lang").agg(F.count("*").alias("n"))
    kind = F.element_at(F.array(F.lit("number"), F.lit("LIST"), F.lit("other")), (F.col("n") % 3 + 1).cast("int"))
    columns = per_lang.select("run_id", F.row_number().over(W.partitionBy("run_id").orderBy("lang")).alias("place"), F.col("lang").alias("key"), F.concat(F.lit("Share of "), "lang").alias("name"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("Of "), F.col("n").cast("string"), F.lit(" texts."))).otherwise(" ").alias("description"), kind.alias("kind"))
    papers = docs.select(F.col("source").alias("run_id"), F.concat(F.lit("d"), "doc_id").alias("paper_id"), F.when(F.col("doc_id") % 4 != 0, F.substring("text", 1, 40)).alias("title"), "text")
    return RP.column_prompts(papers, columns).withColumn("prompt", F.md5(F.col("prompt").cast("binary")))


@query(f"""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), q AS (SELECT c.conv_id, any_value(text) AS question FROM conversations c JOIN l ON l.conv_id = c.conv_id AND turn = last GROUP BY 1),
b AS (SELECT c.conv_id, string_agg(CASE WHEN role = 'user' THEN 'Researcher: ' ELSE 'You: ' END || trim(text, {D_PLANS.WS}), chr(10) || chr(10) ORDER BY turn) AS before FROM conversations c JOIN l ON l.conv_id = c.conv_id AND turn < last WHERE trim(text, {D_PLANS.WS}) <> '' GROUP BY 1)
SELECT conv_id AS question_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN conv_id % 3 > 0 THEN '## Context' || chr(10) || 'about ' || conv_id END, CASE WHEN conv_id % 4 = 0 THEN '## Relationships' || chr(10) || '[G1] fact ' || conv_id END, '## Earlier' || chr(10) || before, '## Question' || chr(10) || question)) AS prompt FROM q LEFT JOIN b USING (conv_id)""")
def question_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """LLM-5: the last turn of each conversation after the ones before it"""
    turns = table(spark, sf, "conversations").withColumnRenamed("conv_id", "question_id")
    last = turns.groupBy("question_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("_last"))
    i = F.col("question_id")
    asked = last.select("question_id", "question", F.when(i % 3 > 0, F.concat(F.lit("about "), i.cast("string"))).otherwise(" ").alias("context"), F.when(i % 4 == 0, F.concat(F.lit("[G1] fact "), i.cast("string"))).alias("graph_context"))
    before = turns.join(last.select("question_id", "_last"), "question_id").filter("turn < _last").select("question_id", "turn", "role", F.col("text").alias("content"))
    return RP.question_prompts(asked, before).withColumn("prompt", F.md5(F.col("prompt").cast("binary")))


# --- streams ---


def source_folder(df: DataFrame, files: int = 4) -> str:
    """Rows of a table as a folder of files that a stream reads one by one."""
    path = f"{shared_dir(df.sparkSession)}/in-{uuid.uuid4().hex}"
    df.repartition(files).write.parquet(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query()
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """STR-1: the same chunks as the batch query chunk_recursive."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    root = new_folder(spark, "ingest")
    J.ingest(J.stream_of(spark, source_folder(docs), docs.schema), root, f"{root}-checkpoint", make=small_vectors).awaitTermination()
    return J.ingest_tables(spark, root)["chunks"].read()


def small_vectors():
    """Vectors of 64 numbers."""
    return C.hash_embedder(64)


def fixed_windows(text: str) -> list[tuple[int, str]]:
    """CHK-2 for one text; a text whose length is divisible by 7 is taken as one that fails."""
    if len(text) % 7 == 0:
        raise ValueError(f"cannot split {len(text)} characters")
    return [(at, text[at : at + 1200]) for at in range(0, len(text), 1000)]


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CAST(length(text) AS INT) AS char_count, CASE WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'indexed' END AS status,
  CASE WHEN length(text) % 7 = 0 THEN 'cannot split ' || length(text) || ' characters' END AS error, CAST(CASE WHEN length(text) % 7 = 0 THEN 0 ELSE len(range(0, length(text), 1000)) END AS INT) AS chunk_count,
  CAST(CASE WHEN length(text) % 7 = 0 THEN 0 ELSE len(range(0, length(text), 1000)) END AS BIGINT) AS n_vectors, CASE WHEN length(text) % 7 <> 0 THEN list_sum(list_transform(range(0, length(text), 1000), lambda a: length(substr(text, a + 1, 1200)))) END AS chunk_chars FROM documents""")
def stream_ingest_papers(spark: SparkSession, sf: str) -> DataFrame:
    """STR-1: metadata, chunks and vectors of a stream in which one text in seven fails, and which comes twice."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    root, folder = new_folder(spark, "ingest"), source_folder(docs, 2)
    for again in ("first", "second"):  # as if the stream had been read twice
        J.ingest(J.stream_of(spark, folder, docs.schema), root, f"{root}-{again}", split=fixed_windows, make=small_vectors).awaitTermination()
    tables = J.ingest_tables(spark, root)
    vectors = tables["vectors"].read().filter("size(embedding) = 64").groupBy("doc_id").agg(F.count("*").alias("n_vectors"))
    chars = tables["chunks"].read().groupBy("doc_id").agg(F.sum(F.length("text")).cast("decimal(38,0)").alias("chunk_chars"))
    papers = tables["papers"].read().select("doc_id", "content_hash", "char_count", "status", "error", "chunk_count")
    return papers.join(vectors, "doc_id", "left").join(chars, "doc_id", "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0)))


def run_once(df: DataFrame, mode: str) -> DataFrame:
    """A bounded run of a stream into Parquet, one folder per micro-batch."""
    spark = df.sparkSession
    root = new_folder(spark, "stream")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("SELECT source, sha256(text) AS content_hash, count(*) OVER (PARTITION BY source) AS n_of_source FROM (SELECT DISTINCT source, text FROM documents)")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2: the stream comes twice, the second time to a stream that has forgotten all but the stored hashes."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text", F.timestamp_seconds(F.col("doc_id")).alias("ts"))
    root = new_folder(spark, "unique")
    for part, days in (("first", 0), ("second", 30)):
        rows = docs.withColumn("ts", F.col("ts") + F.make_interval(days=F.lit(days)))
        J.keep_unique(J.stream_of(spark, source_folder(rows), rows.schema), f"{root}/hashes", f"{root}/out/{part}", f"{root}/{part}", "source", "text", "ts").awaitTermination()
    every = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out").select("source", "content_hash")
    return every.withColumn("n_of_source", F.count("*").over(W.partitionBy("source")))


@query(with_views(["job_items_v"], "SELECT job_id, count(*) AS items, count(*) FILTER (state = 'failed') AS failed FROM job_items_v GROUP BY job_id"))
def stream_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3: the last update of each item, counted per job, equals the batch result."""
    rows = view(spark, sf, "job_items_v")
    fed = run_once(J.job_feed(J.stream_of(spark, source_folder(rows), rows.schema)), "update")
    last = fed.groupBy("job_id", "item_no").agg(F.max_by("state", "batch").alias("state"))
    return last.groupBy("job_id").agg(F.count("*").alias("items"), F.count_if(F.col("state") == "failed").alias("failed"))


@query(with_views(["job_items_v"], """, c AS (SELECT job_id, CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (state IN ('indexed', 'duplicate')) AS INT) AS completed, CAST(count(*) FILTER (state = 'failed') AS INT) AS failed FROM job_items_v GROUP BY 1)
SELECT *, round((completed + failed) / total, 3) AS progress, completed + failed = total AS terminal FROM c"""))
def stream_job_changes(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3: only jobs whose roll-up changed; the last change of each is the batch roll-up."""
    rows = view(spark, sf, "job_items_v")
    changes = run_once(J.job_changes(J.stream_of(spark, source_folder(rows), rows.schema), delay="10000 days", keep_ms=1 << 50), "update")
    return changes.groupBy("job_id").agg(F.max_by(F.struct("total", "completed", "failed", "progress", "terminal"), "batch").alias("x")).select("job_id", "x.*")


def line_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts of order lines, and the uses of one by the other."""
    ends = lines.select(F.explode(F.array(F.struct(F.concat(F.lit("s:"), "l_suppkey").alias("id"), F.lit("Method").alias("type")), F.struct(F.concat(F.lit("p:"), "l_partkey").alias("id"), F.lit("Dataset").alias("type")))).alias("e"), F.concat(F.lit("o"), "l_orderkey").alias("paper"))
    nodes = ends.groupBy("e.id", "e.type").agg(F.array_sort(F.collect_set("paper")).alias("papers"))
    edges = lines.select(F.concat(F.lit("s:"), "l_suppkey").alias("source"), F.concat(F.lit("p:"), "l_partkey").alias("target"), F.when(F.col("l_linenumber") % 2 == 0, "USES").otherwise("APPLIED_TO").alias("type"), F.concat(F.lit("o"), "l_orderkey").alias("paper"))
    return nodes, edges.groupBy("source", "target", "type").agg(F.array_sort(F.collect_set("paper")).alias("papers"))


@query("""WITH e AS (SELECT 's:' || l_suppkey AS s, 'p:' || l_partkey AS p, CASE WHEN l_linenumber % 2 = 0 THEN 'USES' ELSE 'APPLIED_TO' END AS t, 'o' || l_orderkey AS o FROM lineitem)
SELECT 'node' AS part, s AS id, 'Method' AS type, count(DISTINCT o) AS n_papers, md5(string_agg(DISTINCT o, ',' ORDER BY o)) AS papers FROM e GROUP BY s UNION ALL SELECT 'node', p, 'Dataset', count(DISTINCT o), md5(string_agg(DISTINCT o, ',' ORDER BY o)) FROM e GROUP BY p
UNION ALL SELECT 'edge', s || '|' || p, t, count(DISTINCT o), md5(string_agg(DISTINCT o, ',' ORDER BY o)) FROM e GROUP BY s, p, t""")
def stream_graph(spark: SparkSession, sf: str) -> DataFrame:
    """STR-4: the graph of all micro-batches is that of one fold."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    root = new_folder(spark, "graph")
    J.merge_graph(J.stream_of(spark, source_folder(lines), lines.schema), root, f"{root}-checkpoint", line_graph).awaitTermination()
    nodes, edges = (t.read() for t in J.graph_tables(spark, root, *line_graph(lines)))
    both = nodes.select(F.lit("node").alias("part"), "id", "type", "papers").unionByName(edges.select(F.lit("edge").alias("part"), F.concat_ws("|", "source", "target").alias("id"), "type", "papers"))
    return both.select("part", "id", "type", F.size("papers").cast("long").alias("n_papers"), F.md5(F.array_join("papers", ",")).alias("papers"))


@query()
def stream_stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """STR-5"""
    rows = view(spark, sf, "job_items_v").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_once(J.stale_jobs(J.stream_of(spark, source_folder(rows), rows.schema)), "append").drop("batch")
