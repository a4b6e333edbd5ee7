"""Queries over documents, chunks and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import documents as D
from corpusloom.operators import vector_index as VI
from corpusloom.operators import vectors as V
from corpusloom.plans.views import table, view, with_views

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT source, sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def dedup_documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.unique_documents(table(spark, sf, "documents").select("source", "text", "doc_id"), "source", "text", "doc_id")


FRONT = """concat('arXiv:', CASE WHEN doc_id % 3 = 0 THEN '2105.12345' ELSE 'none' END, chr(10), 'A study of item number ', doc_id, chr(10), 'Ada Lovelace1, Alan Turing2 and Grace Hopper*', chr(10),
  'Proceedings of the ', 1990 + doc_id % 30, ' Workshop', chr(10), 'Abstract', chr(10), text, chr(10), 'Keywords: deep parsing; ', source, ', graphs', chr(10), chr(10), '1 Introduction', chr(10), 'See 10.1000/d', doc_id, '.')"""


def front(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", f"{FRONT} AS t")


@query(f"""WITH f AS (SELECT doc_id, {FRONT} AS t FROM documents)
SELECT doc_id, rtrim(nullif(regexp_extract(substr(t, 1, 20000), '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b'), ''), '.') AS doi,
  CASE WHEN doc_id % 3 = 0 THEN 2021 ELSE 1990 + doc_id % 30 END AS year, 'Proceedings of the ' || (1990 + doc_id % 30) || ' Workshop' AS venue FROM f""")
def doc_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    return front(spark, sf).select("doc_id", T.doi(t).alias("doi"), T.year(t, title_=T.title(t, F.lit(""))).alias("year"), T.venue(t).alias("venue"))


@query("""SELECT doc_id, 'A study of item number ' || doc_id AS title, list_value('Ada Lovelace', 'Alan Turing', 'Grace Hopper') AS authors,
  list_value('Deep Parsing', upper(source[1]) || source[2:], 'Graphs') AS keywords FROM documents""")
def doc_front_matter(spark: SparkSession, sf: str) -> DataFrame:
    meta = D.metadata(front(spark, sf), "doc_id", "t")
    return meta.select("doc_id", "title", "authors", "keywords")


@query(f"""WITH f AS (SELECT doc_id, substr({FRONT}, 1, 20000) AS t FROM documents), s AS (SELECT doc_id, regexp_extract(t, '(?is)abstract\\b[\\s\\x0B:.\\-—]*(.*)$', 1) AS s FROM f),
e AS (SELECT doc_id, s, regexp_extract(substr(s, 81), '(?is)^(.*?)(\\n\\s*(\\d+\\.?\\s*)?(introduction|keywords|index terms|categories and subject)\\b|\\n\\s*\\n\\s*\\n)', ['a', 'b']) AS m FROM s),
a AS (SELECT doc_id, CASE WHEN m.b <> '' AND length(m.a) <= 3920 THEN substr(s, 1, 80) || m.a WHEN length(s) >= 80 THEN substr(s, 1, 2500) END AS a FROM e)
SELECT doc_id, nullif(trim(regexp_replace(a, '[\\s\\x0B]+', ' ', 'g'), ' -—·|'), '') AS abstract FROM a""")
def doc_abstract(spark: SparkSession, sf: str) -> DataFrame:
    return front(spark, sf).select("doc_id", T.abstract(F.substring("t", 1, 20000)).alias("abstract"))


@query(with_views(["sectioned_v"], """
, b AS (SELECT 'p' || doc_id AS paper_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS body FROM documents)
SELECT paper_id, 'abstract' AS section, body FROM b WHERE body <> '' UNION ALL SELECT paper_id, 'introduction', body FROM b WHERE body <> '' UNION ALL SELECT paper_id, 'references', 'none' FROM b"""))  # fmt: skip
def doc_sections(spark: SparkSession, sf: str) -> DataFrame:
    return D.sections(view(spark, sf, "sectioned_v"), "paper_id", "full_text")


@query("""SELECT doc_id, CAST(i AS INT) AS idx, CAST(i * 1000 AS INT) AS start, substr(text, i * 1000 + 1, 1200) AS text, CAST(greatest(1, length(substr(text, i * 1000 + 1, 1200)) // 4) AS INT) AS token_estimate
FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 1000 + 1)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    out = C.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("token_estimate", C.token_estimate(F.col("text")))


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return C.recursive_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query()
def chunk_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-1 as a table function in SQL."""
    C.register_splitter(spark)
    return spark.sql("SELECT doc_id, c.* FROM {documents}, LATERAL split_text(text, 1200, 200) c", documents=table(spark, sf, "documents"))


@query("SELECT url AS paper_id, page_id AS page_no, html AS text, strlen(html) % 100 / 100 AS confidence FROM pages")
def recognise_pages(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-3, STA-6: raw pages as images, a stand-in for an engine, a cache that knows every second page."""
    html = F.encode("html", "utf-8")
    pages = table(spark, sf, "pages").select(F.col("url").alias("paper_id"), F.col("page_id").alias("page_no"), html.alias("image"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    none = spark.createDataFrame([], "key string, text string, confidence double")
    engine = lambda image, w, h: (image.decode("utf-8", "replace"), len(image) % 100 / 100)
    _, known = D.recognise(pages.filter("page_no % 2 = 0"), none, engine, "stub")
    return D.recognise(pages, known, engine, "stub")[0].select("paper_id", "page_no", "text", "confidence")


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 900 characters."""
    out = C.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text", 900, 0)
    return out.select("doc_id", (F.col("idx") + 1).alias("page_no"), "text")


PAGES = "pg AS (SELECT doc_id, CAST(i + 1 AS INT) AS page_no, substr(text, i * 900 + 1, 900) AS text, i * 901 AS off FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 900 + 1)) AS i FROM documents WHERE length(text) > 0))"
FIXED = "ch AS (SELECT doc_id, i AS idx, i * 1000 AS start, i * 1000 + length(substr(text, i * 1000 + 1, 1200)) AS stop FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 1000 + 1)) AS i FROM documents WHERE length(text) > 0))"


@query(f"WITH {PAGES}, {FIXED} SELECT ch.doc_id, CAST(idx AS INT) AS idx, (SELECT max(page_no) FROM pg WHERE pg.doc_id = ch.doc_id AND off <= start) AS page_start, (SELECT max(page_no) FROM pg WHERE pg.doc_id = ch.doc_id AND off <= stop) AS page_end FROM ch")
def chunk_page(spark: SparkSession, sf: str) -> DataFrame:
    pieces = C.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "idx", "start", (F.col("start") + F.length("text")).alias("chunk_end"))
    offsets = C.page_offsets(pages_of(spark, sf), "doc_id").select("doc_id", "page_no", "offset")
    return C.page_of(pieces, offsets, "doc_id").select("doc_id", "idx", "page_start", "page_end")


@query(with_views(["sectioned_v"], """
, ch AS (SELECT paper_id, full_text, i AS idx, i * 1000 AS start, substr(full_text, i * 1000 + 1, 1200) AS t FROM (SELECT paper_id, full_text, unnest(range((length(full_text) - 1) // 1000 + 1)) AS i FROM sectioned_v)),
m AS (SELECT 'p' || doc_id AS paper_id, length(text) AS n FROM documents),
h AS (SELECT *, list_filter(list_transform(string_split(t, chr(10))[1:3], lambda x: CASE WHEN trim(x) = 'Abstract' THEN 'abstract' WHEN trim(x) = '1 Introduction' THEN 'introduction' WHEN trim(x) = 'References' THEN 'references' END), lambda y: y IS NOT NULL) AS own FROM ch JOIN m USING (paper_id))
SELECT paper_id, CAST(idx AS INT) AS idx, CASE WHEN len(own) > 0 THEN own[1] WHEN start >= 9 + n + 1 + 14 + 1 + n + 1 THEN 'references' WHEN start >= 9 + n + 1 THEN 'introduction' ELSE 'abstract' END AS section FROM h"""))  # fmt: skip
def chunk_section(spark: SparkSession, sf: str) -> DataFrame:
    papers = view(spark, sf, "sectioned_v")
    pieces = C.fixed_chunks(papers, "paper_id", "full_text")
    return C.section_of(pieces, D.heading_marks(papers, "paper_id", "full_text"), "paper_id", T.heading).select("paper_id", "idx", "section")


TERMS = """
w AS (SELECT id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM src),
f AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
s AS (SELECT id, CAST(CAST('0x' || md5(f)[1:8] AS BIGINT) % 384 AS INT) AS bucket, sum(CASE WHEN CAST('0x' || md5(f)[9:10] AS INT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM f GROUP BY ALL HAVING s <> 0)"""


@query(f"WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {TERMS} SELECT id AS doc_id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) AS weight FROM s")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    out = C.hashed_terms(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query()
def embed_model(spark: SparkSession, sf: str) -> DataFrame:
    """EMB-2, UDF-1 with the BLAKE2b embedder."""
    return C.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", lambda: C.hash_embedder(384), "hash").select("doc_id", "embedding", "backend")


@query("SELECT CASE WHEN label % 2 = 0 THEN 'hash' ELSE 'model' END AS backend, count(*) AS n, backend <> 'hash' AS mismatch FROM embeddings GROUP BY ALL")
def vector_backends(spark: SparkSession, sf: str) -> DataFrame:
    return C.foreign_vectors(table(spark, sf, "embeddings").withColumn("backend", F.when(F.col("label") % 2 == 0, "hash").otherwise("model")), "hash")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").cast("string").alias("paper_id"))
    return items.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding"), items


NEAR = """SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS INT) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0{where})"""


@query(f"SELECT * FROM ({NEAR.format(where='')}) WHERE rank < 8")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, items = vectors(spark, sf)
    return V.top_k(q, items, 8)


@query(f"SELECT * FROM ({NEAR.format(where=' AND e.label % 3 = 0')}) WHERE rank < 8")
def vector_topk_scoped(spark: SparkSession, sf: str) -> DataFrame:
    q, items = vectors(spark, sf)
    return V.top_k(q, items, 8, scope=items.filter("cast(paper_id as int) % 3 = 0").select("paper_id"))


@query()
def vector_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-3: the best 8 of the queries of ``vector_topk``, from an index of cells and product codes"""
    q, items = vectors(spark, sf)
    return VI.approximate_top_k(q, items, 8)


#: The name it had while it searched by random projections.
QUERIES["vector_topk_lsh"] = vector_topk_cells


@query("""SELECT conv_id, turn, role, total FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE r > 1 AND r <= 4""")
def chunk_listing(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-4, VEC-5"""
    return V.chunk_page(table(spark, sf, "conversations"), "conv_id", "turn", 1, 3).select("conv_id", "turn", "role", "total")


@query("""SELECT 'd' || doc_id AS item_id, 'text' AS kind, CAST(NULL AS VARCHAR) AS label FROM documents UNION ALL SELECT 'figure:g' || page_id, 'figure', url FROM pages""")
def mixed_index(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-6"""
    text = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text")
    figures = table(spark, sf, "pages").select(F.concat(F.lit("g"), "page_id").alias("figure_id"), F.col("url").alias("label"))
    return V.mixed_index(text, figures).select("item_id", "kind", "label")


VARIANTS = """
q AS (SELECT item_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS v0, trim(rtrim(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), '?')) AS low FROM benchmark),
k AS (SELECT *, list_filter(regexp_split_to_array(low, '\\s+'), lambda x: length(x) > 3)[1:12] AS ws FROM q),
k2 AS (SELECT *, CASE WHEN len(ws) >= 3 THEN array_to_string(ws, ' ') END AS v2 FROM k),
v AS (SELECT item_id, 0 AS variant, v0 AS t FROM k2 WHERE v0 <> '' UNION ALL SELECT item_id, 1, v2 FROM k2 WHERE v2 IS NOT NULL AND lower(v2) <> lower(v0))"""


def variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(V.query_variants(F.col("text"))).alias("variant", "t"))
    return rows


@query(f"WITH {VARIANTS} SELECT item_id, CAST(variant AS INT) AS variant, t FROM v")
def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, sf)


SEARCH = f"""{VARIANTS},
src AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'q' || item_id || '/' || variant, t FROM v), {TERMS},
e AS (SELECT id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS weight FROM s),
p AS (SELECT a.id AS qv, CAST(b.id[2:] AS BIGINT) AS doc_id, round(sum(a.weight * b.weight), 6) AS score FROM e a JOIN e b ON a.bucket = b.bucket AND a.id[1] = 'q' AND b.id[1] = 'd' GROUP BY ALL),
r AS (SELECT CAST(split_part(qv[2:], '/', 1) AS BIGINT) AS item_id, CAST(split_part(qv, '/', 2) AS INT) AS variant, doc_id, score, row_number() OVER (PARTITION BY qv ORDER BY score DESC, doc_id) - 1 AS rank FROM p),
h AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_min(score, variant * 1000 + rank) AS score, min(variant * 1000 + rank) AS first FROM r WHERE rank < 8 GROUP BY ALL),
fused AS (SELECT item_id, doc_id, round(rrf, 9) AS rrf, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, first, doc_id) - 1 AS INT) AS place FROM h)"""


WS = "chr(32) || chr(9) || chr(10) || chr(13)"


def search_sql(asked: str, passages: str, k: int) -> str:
    """RET-1 and RET-2 in SQL: ``fused`` (item_id, chunk_id, score, place) for ``asked`` (item_id, text) and ``passages`` (chunk_id, text)."""
    bare = " ".join(f"WHEN starts_with(low, '{prefix}') THEN low[{len(prefix) + 1}:]" for prefix in V.PREFIXES)
    return f"""asked AS ({asked}), passages AS ({passages}),
q0 AS (SELECT item_id, trim(text, {WS}) AS v0, trim(rtrim(lower(trim(text, {WS})), '?'), {WS}) AS low FROM asked),
k0 AS (SELECT *, list_filter(regexp_split_to_array(low, '\\s+'), lambda x: length(x) > 3)[1:12] AS ws, CASE {bare} END AS v1 FROM q0),
raw AS (SELECT item_id, unnest([0, 1, 2]) AS i, unnest([v0, v1, CASE WHEN len(ws) >= 3 THEN array_to_string(ws, ' ') END]) AS t FROM k0),
v AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS variant, t FROM (SELECT item_id, i, trim(t) AS t, row_number() OVER (PARTITION BY item_id, lower(trim(t)) ORDER BY i) AS dup FROM raw WHERE trim(t) <> '') WHERE dup = 1),
src AS (SELECT 'd' || chunk_id AS id, text AS t FROM passages UNION ALL SELECT 'q' || item_id || '~' || variant, t FROM v), {TERMS},
e AS (SELECT id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS weight FROM s),
p AS (SELECT a.id AS qv, b.id[2:] AS chunk_id, round(sum(a.weight * b.weight), 6) AS score FROM e a JOIN e b ON a.bucket = b.bucket AND a.id[1] = 'q' AND b.id[1] = 'd' GROUP BY ALL),
r AS (SELECT CAST(split_part(qv[2:], '~', 1) AS BIGINT) AS item_id, CAST(split_part(qv, '~', 2) AS INT) AS variant, chunk_id, score, row_number() OVER (PARTITION BY qv ORDER BY score DESC, chunk_id) - 1 AS rank FROM p),
h AS (SELECT item_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_min(score, variant * 1000 + rank) AS score, min(variant * 1000 + rank) AS first FROM r WHERE rank < {k} GROUP BY ALL),
fused AS (SELECT * FROM (SELECT item_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, first, chunk_id) - 1 AS INT) AS place FROM h) WHERE place < {k})"""


def search(spark: SparkSession, sf: str) -> DataFrame:
    asked = variants(spark, sf).withColumn("query_id", F.struct("item_id", "variant"))
    q = C.hashed_terms(asked, "query_id", "t")
    items = C.hashed_terms(table(spark, sf, "documents"), "doc_id", "text")
    hits = V.sparse_top_k(q, items, 8, item_id="doc_id").select("query_id.item_id", "query_id.variant", "doc_id", "score", "rank")
    return V.fuse(hits, 8, "item_id", "doc_id").withColumn("rrf", F.round("rrf", 9))


@query(f"WITH {SEARCH} SELECT * FROM fused WHERE place < 8")
def rrf_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(spark, sf)


PACKED = f"""WITH {SEARCH}, b AS (SELECT item_id, place, '[S' || (place + 1) || '] d' || doc_id || ' (n/a)' || chr(10) || trim(d.text, chr(32) || chr(9) || chr(10) || chr(13)) AS block FROM fused JOIN documents d USING (doc_id) WHERE place < 8),
c AS (SELECT *, sum(length(block)) OVER (PARTITION BY item_id ORDER BY place) AS n FROM b)
SELECT item_id, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS context, count(*) AS n_blocks FROM c WHERE n <= BUDGET GROUP BY item_id"""


@query(PACKED.replace("BUDGET", "12000"))
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packed_hits(spark, sf, 12000)


@query(PACKED.replace("BUDGET", "220000"))
def context_pack_full(spark: SparkSession, sf: str) -> DataFrame:
    """RET-3 with the whole budget"""
    return packed_hits(spark, sf, 220_000)


def packed_hits(spark: SparkSession, sf: str, budget: int) -> DataFrame:
    rows = search(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    none = F.lit(None).cast("string")
    block = V.chunk_block(F.col("place") + 1, F.concat(F.lit("d"), "doc_id"), none, none, F.lit("text"), none, F.col("text"))
    out = V.pack_blocks(rows.withColumn("block", block), "item_id", "place", "block", budget, "\n\n---\n\n")
    return out.withColumn("context", F.md5(F.col("context").cast("binary")))


@query(with_views(["papers_v"], """
, i AS (SELECT *, count(*) OVER (PARTITION BY owner_id) AS n, row_number() OVER (PARTITION BY owner_id ORDER BY year, title, paper_id) AS place FROM papers_v WHERE status = 'indexed'),
b AS (SELECT *, CASE WHEN n <= 1 THEN 90000 WHEN n <= 3 THEN 45000 WHEN n <= 6 THEN 25000 WHEN n <= 12 THEN 14000 ELSE 8000 END AS budget FROM i)
SELECT owner_id, paper_id, title, CAST(place AS INT) AS place, md5(CASE WHEN length(full_text) <= budget THEN full_text ELSE substr(full_text, 1, CAST(floor(budget * 0.65) AS INT)) || chr(10) || chr(10) || '[... middle omitted ...]' || chr(10) || chr(10) || right(full_text, CAST(floor(budget * 0.35) AS INT)) END) AS text FROM b"""))  # fmt: skip
def load_documents(spark: SparkSession, sf: str) -> DataFrame:
    """RET-5, RET-6, RET-7"""
    papers = view(spark, sf, "papers_v")
    none = papers.select("paper_id", F.create_map().cast("map<string,string>").alias("sections"))
    return V.load_documents(papers, none).withColumn("text", F.md5(F.col("text").cast("binary")))


PAPER_PACK = with_views(["papers_v"], """
, b AS (SELECT owner_id, year, paper_id, '[S' || row_number() OVER w || '] TITLE: ' || title || chr(10) || 'Authors: ' || array_to_string(authors[1:8], ', ') || ' | Year: ' || year || CASE WHEN venue IS NULL THEN '' ELSE ' | Venue: ' || venue END || chr(10) || chr(10) || substr(trim(full_text, chr(32) || chr(9) || chr(10) || chr(13)), 1, EACH) AS block, row_number() OVER w AS n FROM papers_v WINDOW w AS (PARTITION BY owner_id ORDER BY year, paper_id)),
c AS (SELECT *, sum(length(block)) OVER (PARTITION BY owner_id ORDER BY n) AS used FROM b)
SELECT owner_id, md5(string_agg(block, chr(10) || chr(10) || '========' || chr(10) || chr(10) ORDER BY n)) AS context, count(*) AS n_blocks FROM c WHERE used <= BUDGET GROUP BY owner_id""")  # fmt: skip


@query(PAPER_PACK.replace("EACH", "500").replace("BUDGET", "20000"))
def paper_pack(spark: SparkSession, sf: str) -> DataFrame:
    """RET-4"""
    return packed_papers(spark, sf, 500, 20000)


@query(PAPER_PACK.replace("EACH", "60000").replace("BUDGET", "220000"))
def paper_pack_full(spark: SparkSession, sf: str) -> DataFrame:
    """RET-4 with the whole budgets of a paper and of the pack"""
    return packed_papers(spark, sf, 60_000, 220_000)


def packed_papers(spark: SparkSession, sf: str, most: int, budget: int) -> DataFrame:
    from pyspark.sql import Window as W

    papers = view(spark, sf, "papers_v").withColumn("n", F.row_number().over(W.partitionBy("owner_id").orderBy("year", "paper_id")))
    block = V.paper_block(F.col("n"), F.col("title"), F.col("authors"), F.col("year"), F.col("venue"), F.col("full_text"), most)
    return V.pack_blocks(papers.withColumn("block", block), "owner_id", "n", "block", budget, "\n\n========\n\n").withColumn("context", F.md5(F.col("context").cast("binary")))


@query(f"""WITH {PAGES}, ps AS (SELECT doc_id, substr(text, CAST(floor(length(text) * 0.4) AS INT) + 1, 300) AS text, CAST(floor((CAST(floor(length(text) * 0.4) AS INT) + 1) / 900) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS hint FROM documents WHERE length(text) > 40),
x AS (SELECT doc_id, hint, trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g')) AS x FROM ps),
s AS (SELECT doc_id, hint, x, string_split(x, ' ') AS w, list_filter(string_split(regexp_replace(x, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda y: length(y) > 30)[1:6] AS ss FROM x),
c AS (SELECT doc_id, hint, list_concat(list_transform(ss, lambda y: CASE WHEN len(string_split(y, ' ')) >= 4 THEN array_to_string(string_split(y, ' ')[1:8], ' ') END), [CASE WHEN len(w) >= 4 THEN array_to_string(w[1:8], ' ') END, CASE WHEN len(w) > 16 THEN array_to_string(w[len(w) // 2 + 1:len(w) // 2 + 8], ' ') END]) AS every FROM s),
ph AS (SELECT doc_id, hint, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS phrase_no FROM (SELECT doc_id, hint, i, phrase, row_number() OVER (PARTITION BY doc_id, lower(phrase) ORDER BY i) AS dup FROM (SELECT doc_id, hint, unnest(every) AS phrase, unnest(range(1, len(every) + 1)) AS i FROM c) WHERE length(phrase) > 12) WHERE dup = 1),
np AS (SELECT doc_id, count(*) AS n FROM pg GROUP BY 1),
ht AS (SELECT doc_id, page_no, phrase, phrase_no, strpos(lower(regexp_replace(pg.text, '[\\s\\x0B]+', ' ', 'g')), lower(phrase)) - 1 AS spot, CASE WHEN hint BETWEEN 1 AND n THEN CASE WHEN page_no > hint THEN 2 * (page_no - hint) - 1 ELSE 2 * (hint - page_no) END ELSE page_no END AS o FROM ph JOIN np USING (doc_id) JOIN pg USING (doc_id) WHERE phrase_no < 6 AND (hint NOT BETWEEN 1 AND n OR abs(page_no - hint) <= 1)),
b AS (SELECT doc_id, arg_min(struct_pack(p := page_no, f := phrase, spot := spot), o * 10 + phrase_no) AS b FROM ht WHERE spot >= 0 GROUP BY 1)
SELECT doc_id AS passage_id, CAST(coalesce(b.p, hint) AS INT) AS page_no, b.f AS phrase, CAST(b.spot AS INT) AS "offset", b IS NOT NULL AS found FROM ps LEFT JOIN b USING (doc_id)""")
def locate_passage(spark: SparkSession, sf: str) -> DataFrame:
    """RET-9, RET-10: a passage from the middle of each document, hinted one page off."""
    docs = table(spark, sf, "documents").filter("length(text) > 40")
    at = F.floor(F.length("text") * 0.4).cast("int") + 1
    passages = docs.select(F.col("doc_id").alias("passage_id"), F.col("doc_id").alias("paper_id"), F.substring("text", at, F.lit(300)).alias("text"), (F.floor(at / 900) + F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)).cast("int").alias("hint"))
    return V.locate(passages, pages_of(spark, sf).withColumnRenamed("doc_id", "paper_id"))


@query("""WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<nav\\b[^>]*>.*?</nav>', '', 'g') AS h FROM pages),
t AS (SELECT *, list_filter(list_transform(regexp_extract_all(h, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS ps,
  list_filter(list_transform(regexp_extract_all(h, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS hs,
  list_filter(list_transform(regexp_extract_all(h, '(?is)<title\\b[^>]*>(.*?)</title>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS ts FROM b)
SELECT page_id, url, ts[1] AS title, hs[1] AS heading, array_to_string(ps, chr(10)) AS text, CAST(len(ps) AS INT) AS n_paragraphs FROM t""")
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return D.html_text(table(spark, sf, "pages"))


PROVENANCE = f"""WITH {PAGES}, n AS (SELECT doc_id AS paper_id, page_no, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) < 120 AND page_no % 2 = 0 OR page_no % 5 = 0 AS ocr, (page_no % 10) / 10.0::DOUBLE AS c FROM pg),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, ocr ORDER BY page_no) AS k FROM n), x AS (SELECT *, ocr AND k <= MOST AS done FROM r)
SELECT paper_id, CASE WHEN count(*) FILTER (done) = 0 THEN 'native' WHEN count(*) FILTER (done) = count(*) THEN 'ocr' ELSE 'mixed' END AS text_source, count(*) AS page_count,
  coalesce(list(page_no ORDER BY page_no) FILTER (done), []) AS ocr_pages, coalesce(list(page_no ORDER BY page_no) FILTER (ocr AND NOT done), []) AS skipped_pages, round(avg(c) FILTER (done), 4) AS ocr_confidence FROM x GROUP BY paper_id"""


@query(PROVENANCE.replace("MOST", "3"))
def page_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-9, DOC-10"""
    return provenance(spark, sf, 3)


@query(PROVENANCE.replace("MOST", "40"))
def page_provenance_full(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-9, DOC-10 with all 40 pages"""
    return provenance(spark, sf, 40)


def provenance(spark: SparkSession, sf: str, most: int) -> DataFrame:
    pages = pages_of(spark, sf).withColumnRenamed("doc_id", "paper_id")
    wants = D.needs_ocr(F.col("text"), F.when(F.col("page_no") % 2 == 0, 0.5).otherwise(0.0)) | (F.col("page_no") % 5 == 0)
    return D.page_provenance(pages.withColumn("needs_ocr", wants).withColumn("confidence", (F.col("page_no") % 10) / 10.0), most)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS paper_id, CAST(l_linenumber AS INT) AS page_no FROM lineitem),
b AS (SELECT l_orderkey AS paper_id, l_linenumber AS page_no, sum(CASE WHEN l_partkey % 3 = 0 THEN l_quantity * 1000 END)::DOUBLE AS a, sum(least(l_quantity * 10, 600) * 50)::DOUBLE AS b FROM lineitem GROUP BY ALL)
SELECT p.paper_id, p.page_no, least(1.0::DOUBLE, CASE WHEN coalesce(a, 0) <= 0 THEN b ELSE a END / (600.0 * 800.0)) AS coverage FROM p JOIN b USING (paper_id, page_no)""")
def image_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-10: pages and boxes made of order lines."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").cast("int").alias("page_no"), F.col("l_quantity").cast("double").alias("q"), "l_partkey")
    pages = li.select("paper_id", "page_no").distinct().select("*", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    zero = F.lit(0.0)
    blocks = li.filter("l_partkey % 3 = 0").select("paper_id", "page_no", F.lit("image").alias("kind"), zero.alias("x0"), zero.alias("y0"), F.col("q").alias("x1"), F.lit(1000.0).alias("y1"))
    images = li.select("paper_id", "page_no", zero.alias("x0"), zero.alias("y0"), (F.col("q") * 10).alias("x1"), F.lit(50.0).alias("y1"))
    return D.image_coverage(pages, blocks, images)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
k AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE trim(t, ' ') <> '')
SELECT doc_id AS paper_id, 1 AS page_no, CASE WHEN max(n) >= 6 THEN string_agg(t, chr(10) ORDER BY i % 2, i) ELSE string_agg(CASE WHEN i % 2 = 0 AND i > 0 THEN chr(10) ELSE CASE WHEN i = 0 THEN '' ELSE ' ' END END || t, '' ORDER BY i) END AS text,
  CASE WHEN max(n) >= 6 THEN 2 ELSE 1 END AS n_columns FROM k GROUP BY doc_id""")
def ocr_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """DOC-11: each document's lines dealt into two columns of a page, in no order, with a line of low confidence."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x) != "")).alias("i", "text"))
    x0 = F.when(F.col("i") % 2 == 0, 60.0).otherwise(340.0)
    y0 = F.floor(F.col("i") / 2) * 20.0
    boxes = lines.select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("page_no"), "text", x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 12).alias("y1"), F.lit(0.9).alias("confidence"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    noise = boxes.withColumn("confidence", F.lit(0.2)).withColumn("text", F.lit("smudge"))
    return D.reading_order(boxes.unionByName(noise))


CAPTION = """CASE doc_id % 6 WHEN 0 THEN concat('Fig. ', doc_id % 90 + 1, '. The ', lang, ' results  of run') WHEN 1 THEN concat('TABLE iv: Scores for ', source) WHEN 2 THEN concat('Figure ', doc_id % 90 + 1, ' shows the loss')
 WHEN 3 THEN concat('Algorithm 2 Training of ', source) WHEN 4 THEN concat('Fig. ', doc_id % 90 + 1, '), as before') ELSE concat('Chart 7 – ', repeat('word ', 70), 'end. ', repeat('more ', 30)) END"""


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 3 THEN 'algorithm' ELSE 'chart' END AS kind,
  CASE doc_id % 6 WHEN 0 THEN 'Figure ' || (doc_id % 90 + 1) WHEN 1 THEN 'Table IV' WHEN 3 THEN 'Algorithm 2' ELSE 'Chart 7' END AS label,
  CASE doc_id % 6 WHEN 0 THEN 'Figure ' || (doc_id % 90 + 1) || '. The ' || lang || ' results of run' WHEN 1 THEN 'Table IV. Scores for ' || source WHEN 3 THEN 'Algorithm 2. Training of ' || source
    ELSE 'Chart 7. ' || repeat('word ', 70) || 'end. […]' END AS caption
FROM documents WHERE doc_id % 6 IN (0, 1, 3, 5)""")
def caption_classify(spark: SparkSession, sf: str) -> DataFrame:
    """DOC-13, DOC-14"""
    return D.captions(table(spark, sf, "documents").selectExpr("doc_id", f"{CAPTION} AS text"))


@query()
def caption_regions(spark: SparkSession, sf: str) -> DataFrame:
    """DOC-15, DOC-16: a page per order, its lines as captions with artwork above or a table below."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").cast("int").alias("caption_no"), "l_partkey", F.col("l_quantity").cast("double").alias("q")).dropDuplicates(["paper_id", "caption_no"])
    y0 = F.col("caption_no") * 105.0
    kind = F.when(F.col("l_partkey") % 2 == 0, "figure").otherwise("table")
    captions = li.select("paper_id", "page_no", "caption_no", kind.alias("kind"), F.concat(F.initcap(kind), F.lit(" "), F.col("caption_no").cast("string")).alias("label"), F.lit(60.0).alias("x0"), y0.alias("y0"), F.lit(400.0).alias("x1"), (y0 + 12).alias("y1"))
    graphics = li.select("paper_id", "page_no", F.lit(80.0).alias("x0"), (y0 - 40 - F.col("q") / 2).alias("y0"), F.lit(350.0).alias("x1"), (y0 - 5).alias("y1"))
    tables = li.select("paper_id", "page_no", F.col("caption_no").alias("table_no"), (F.col("l_partkey") % 20).cast("int").alias("n_cols"), F.lit(5).alias("n_rows"), F.lit(70.0).alias("x0"), (y0 + 15).alias("y0"), F.lit(390.0).alias("x1"), (y0 + 75).alias("y1"))
    pages = li.select("paper_id", "page_no").distinct().select("*", F.lit(600.0).alias("width"), F.lit(900.0).alias("height"))
    return D.figure_regions(captions, graphics, D.plausible_tables(tables, captions, pages), pages)


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, '| ' || l_linenumber || ' | a\\|' || l_partkey || ' |  |' AS line FROM lineitem)
SELECT l_orderkey AS table_id, '| line | col2 | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS markdown, count(*) + 1 AS n_rows, 3 AS n_cols FROM r GROUP BY l_orderkey""")
def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """DOC-17"""
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    body = li.select(F.col("l_orderkey").alias("table_id"), n.alias("row_no"), F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit(" a|"), F.col("l_partkey").cast("string"))).alias("values"))
    head = li.select(F.col("l_orderkey").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row_no"), F.array(F.lit("line"), F.lit(" "), F.lit("note")).alias("values"))
    return D.tables_to_markdown(body.unionByName(head))


@query("""SELECT doc_id, concat_ws(chr(10), 'Figure ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN doc_id % 3 = 0 THEN 'up' END, 'find ' || lang) AS search_text FROM documents""")
def figure_text(spark: SparkSession, sf: str) -> DataFrame:
    """DOC-18"""
    blank = F.lit("")
    text = D.figure_text(F.concat(F.lit("Figure "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.when(F.col("doc_id") % 3 == 0, "up"), F.array(blank, F.concat(F.lit("find "), "lang")), blank, F.lit(None).cast("string"))
    return table(spark, sf, "documents").select("doc_id", text.alias("search_text"))


@query("""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(text, '[.!?]\\s+'), lambda x: trim(x) <> '') AS s FROM documents)
SELECT doc_id, len(w) >= 24 AND len(list_filter(w, lambda x: regexp_matches(x, '\\d'))) / len(w) <= 0.25 AND len(w) / greatest(1, len(s)) >= 11 AS prose FROM w""")
def prose_text(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-14"""
    return table(spark, sf, "documents").select("doc_id", T.looks_like_prose(F.col("text")).alias("prose"))
