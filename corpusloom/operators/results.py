"""Operators over model outputs: extraction, matrix, gaps, verification, answers, reviews (LLM-*, EXT-*, MTX-*, GAP-1, VER-*, CIT-6…9, RPT-*, SUM-1, FIG-1)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

WEIGHTS = {"supported": 1.0, "partially_supported": 0.5, "unsupported": 0.0, "contradicted": 0.0, "unverifiable": 0.0}
NOT_REPORTED = "not reported"
SECTION_ORDER = ["introduction", "background", "themes", "methods", "datasets", "findings", "debates", "gaps", "conclusion"]


def parse_json(raw: Column, schema: str) -> Column:
    """LLM-1: the payload of an answer: out of its fence and prose, trailing commas dropped, a list under ``items``.

    Null where there is no object or list."""
    fenced = F.coalesce(T.first_match(raw, r"(?is)```(?:json)?\s*(.*?)```", 1), raw)
    braces, list_ = F.regexp_extract(fenced, r"(?s)(\{.*\})", 1), F.regexp_extract(fenced, r"(?s)(\[.*\])", 1)
    starts_list = F.ltrim(fenced).startswith("[")
    body = F.when(starts_list & (list_ != ""), F.concat(F.lit('{"items": '), list_, F.lit("}"))).otherwise(T.or_null(braces))
    return F.from_json(F.regexp_replace(body, r",(\s*[}\]])", "$1"), schema)


def request_key(**inputs: Column) -> Column:
    """LLM-2: one hash of all that affects an answer; the temperature counts to four places."""
    columns = [(F.format_number(c, 4) if name == "temperature" else c.cast("string")).alias(name) for name, c in sorted(inputs.items())]
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def cached(requests: DataFrame, cache: DataFrame, now: Column, ttl_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """LLM-3: the requests that a fresh cache row answers, and the distinct keys that none does."""
    fresh = cache.filter(F.col("created_at") >= now - F.make_interval(days=F.lit(ttl_days)))
    hits = requests.join(fresh, "key")
    return hits, requests.select("key").distinct().join(fresh, "key", "left_anti")


def purge_expired(cache: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """LLM-3: the cache without the rows that have outlived their time; no limit (0) keeps all."""
    return cache.filter(F.col("created_at") >= now - F.make_interval(days=F.lit(ttl_days))) if ttl_days > 0 else cache


def count_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """LLM-3: the cache with its hit counts raised."""
    new = hits.groupBy("key").agg(F.count("*").alias("_n"))
    return cache.join(new, "key", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def cache_summary(cache: DataFrame) -> DataFrame:
    """LLM-3, STA-6: entries, calls saved, share of requests that the cache answered."""
    hits, n = F.coalesce(F.sum("hit_count"), F.lit(0)), F.count("*")
    return cache.agg(n.alias("entries"), hits.alias("calls_saved"), F.round(F.when(n + hits > 0, hits / (n + hits)).otherwise(0.0), 4).alias("hit_rate"))


def ask(prompts: DataFrame, answer: Callable[[str], str], key: str = "key", prompt: str = "prompt") -> DataFrame:
    """LLM-4, UDF-2: answers of any function; equal keys are asked once; a failure is a row with ``error``, the rest goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[prompt], strict=True):
                try:
                    rows.append((k, answer(text), None))
                except Exception as problem:  # noqa: BLE001  whatever the user's function raises
                    rows.append((k, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=[key, "response", "error"])

    once = prompts.dropDuplicates([key]).select(key, prompt)
    return prompts.join(once.mapInPandas(run, f"{key} string, response string, error string"), key)


def prompts_of(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """LLM-5: one prompt per verification: its claims, each with its passages or a line that says there are none."""
    found = F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda x: F.concat(F.lit("  - "), x["passage"]))
    own = passages.groupBy("verification_id", "claim_index").agg(F.array_join(found, "\n").alias("found"))
    rows = claims.join(own, ["verification_id", "claim_index"], "left")
    block = F.concat(F.lit("["), F.col("claim_index").cast("string"), F.lit("] "), "claim", F.lit("\n"), F.coalesce("found", F.lit("  (nothing found)")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("claim_index", block.alias("b")))), lambda x: x["b"])
    return rows.groupBy("verification_id").agg(F.array_join(ordered, "\n\n").alias("prompt"))


def summary_record(summaries: DataFrame, papers: DataFrame) -> DataFrame:
    """SUM-1: ``run_id``, ``paper_id``, ``place`` → scope, paper ids and titles in order."""
    rows = summaries.join(papers.select("paper_id", "title"), "paper_id")
    items = F.array_sort(F.collect_list(F.struct("place", "paper_id", "title")))
    out = rows.groupBy("run_id").agg(items.alias("x"))
    return out.select("run_id", F.when(F.size("x") == 1, "single").otherwise("multi").alias("scope"), F.transform("x", lambda i: i["paper_id"]).alias("paper_ids"), F.transform("x", lambda i: i["title"]).alias("titles"))


def normalise_items(items: Column) -> Column:
    """EXT-1: items as structs with clean names, the nameless dropped, markers cut from their other fields."""
    clean = F.transform(items, lambda x: F.struct(T.clean_name(x["name"]).alias("name"), T.strip_markers(x["description"]).alias("description")))
    return F.filter(clean, lambda x: x["name"] != "")


def aggregate_items(items: DataFrame) -> DataFrame:
    """EXT-2: ``paper_id``, ``paper_ord``, ``field``, ``ord``, ``name`` → one row per name in any case."""
    rows = items.withColumn("key", F.lower(F.btrim("name"))).filter("key <> ''")
    return rows.groupBy("field", "key").agg(F.min_by("name", F.struct("paper_ord", "ord")).alias("name"), F.array_sort(F.collect_set("paper_id")).alias("papers"), F.count("*").alias("mentions"))


def aggregate_tasks(tasks: DataFrame) -> DataFrame:
    """EXT-3"""
    return tasks.withColumn("task", F.initcap(F.btrim("task"))).filter("task <> ''").groupBy("task").agg(F.array_sort(F.collect_set("paper_id")).alias("papers"))


def comparison_table(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """EXT-4: two tasks, three methods, three datasets and the first metric of each paper with its value, a dash for none.

    ``items``: ``paper_id``, ``field``, ``ord``, ``name``, ``value``; ``tasks``: ``paper_id``, ``ord``, ``task``.
    """
    valued = F.when((F.col("field") == "metrics") & (F.col("value") != ""), F.concat("name", F.lit(": "), "value")).otherwise(F.col("name"))
    items = items.withColumn("name", valued).select("paper_id", "field", "ord", "name").unionByName(tasks.select("paper_id", F.lit("tasks").alias("field"), "ord", F.col("task").alias("name")))
    first = lambda field, n: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("ord", "name")))), lambda x: x["name"]), 1, n)
    dash = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("—")
    return items.groupBy("paper_id").agg(dash(first("tasks", 2)).alias("tasks"), dash(first("methods", 3)).alias("methods"), dash(first("datasets", 3)).alias("datasets"), dash(first("metrics", 1)).alias("metric"))


def entity_table(items: DataFrame, most: int = 25) -> DataFrame:
    """EXT-5: the names in most papers of each field, with the first four papers."""
    rows = aggregate_items(items).withColumn("n_papers", F.size("papers"))
    place = F.row_number().over(W.partitionBy("field").orderBy(F.col("n_papers").desc(), "key"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("field", "place", "name", "n_papers", F.slice("papers", 1, 4).alias("appears_in"))


def column_keys(names: list[str], most: int = 12) -> list[tuple[str, str]]:
    """MTX-2's planning parameters: a distinct key for each named column."""
    out: dict[str, str] = {}
    for name in filter(None, (str(n or "").strip() for n in names)):
        base = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "column"
        key = next(k for k in (base, *(f"{base}_{i}" for i in range(2, len(names) + 2))) if k not in out)
        out[key] = name
    return list(out.items())[:most]


def matrix_cells(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """MTX-1: ``paper_id``, ``payload`` (a map) → one row per cell with value, evidence and whether it was reported."""
    cells = payloads.select("paper_id", "payload", F.explode(F.array(*map(F.lit, keys))).alias("col_key"))
    value = F.btrim(F.element_at("payload", F.col("col_key")))
    reported = F.coalesce((value != "") & (F.lower(value) != NOT_REPORTED), F.lit(False))
    evidence = F.when(reported, F.btrim(F.element_at("payload", F.concat("col_key", F.lit("__evidence"))))).otherwise("")
    return cells.select("paper_id", "col_key", F.when(reported, value).otherwise(NOT_REPORTED).alias("value"), F.coalesce(evidence, F.lit("")).alias("evidence"), reported.alias("reported"))


def pivot_matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """MTX-2, SNK-1's table: one row per paper, one column per key."""
    return cells.groupBy("paper_id").pivot("col_key", keys).agg(F.first("value", ignorenulls=True))


def order_gaps(gaps: DataFrame, papers: DataFrame) -> DataFrame:
    """GAP-1: gaps by severity (unknown: medium), then place; ``S#`` among their papers become titles by position."""
    rank = F.create_map(*[F.lit(x) for x in ("high", 0, "medium", 1, "low", 2)])
    named = gaps.select("run_id", "place", F.posexplode("related").alias("i", "ref")).withColumn("n", F.regexp_extract("ref", r"^\[?S(\d+)\]?$", 1).try_cast("int"))
    titles = named.join(papers.select("run_id", F.col("position").alias("n"), F.col("title").alias("t")), ["run_id", "n"], "left")
    listed = titles.groupBy("run_id", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("t", "ref").alias("r")))), lambda x: x["r"]).alias("related_papers"))
    severity = F.when(F.lower("severity").isin("high", "medium", "low"), F.lower("severity")).otherwise("medium")
    rows = gaps.drop("related").withColumn("severity", severity).join(listed, ["run_id", "place"], "left")
    return rows.withColumn("position", F.row_number().over(W.partitionBy("run_id").orderBy(rank[F.col("severity")], "place")))


#: The fewest characters of a claim, of a text to verify, of a passage to explain.
CLAIM, VERIFIABLE, EXPLAINABLE = 8, 20, 10


def long_enough(text: Column, least: int) -> Column:
    """FIL-13: whether a text has ``least`` characters or more between its blanks; null has none."""
    return F.coalesce(F.length(F.btrim(text)) >= least, F.lit(False))


def normalise_claims(raw: DataFrame, most: int = 25) -> DataFrame:
    """VER-1, FIL-13: claims of 8 characters or more, 25 per verification; type factual and checkable unless said."""
    rows = raw.withColumn("claim", F.btrim("text")).filter(long_enough(F.col("claim"), CLAIM))
    n = F.row_number().over(W.partitionBy("verification_id").orderBy("ord"))
    rows = rows.withColumn("claim_index", n - 1).filter(F.col("claim_index") < most)
    return rows.select("verification_id", "claim_index", "claim", F.coalesce("type", F.lit("factual")).alias("type"), F.coalesce("checkable", F.lit(True)).alias("checkable"))


def judge_claims(claims: DataFrame, judgements: DataFrame) -> DataFrame:
    """VER-3: each claim's last judgement; an unknown verdict is unsupported, none is unverifiable."""
    last = judgements.groupBy("verification_id", "claim_index").agg(F.max_by(F.struct("verdict", "confidence"), "ord").alias("j"))
    rows = claims.join(last, ["verification_id", "claim_index"], "left")
    known = F.col("j.verdict").isin(list(WEIGHTS))
    verdict = F.when(F.col("j").isNull(), "unverifiable").when(known, F.col("j.verdict")).otherwise("unsupported")
    return rows.withColumn("verdict", verdict).withColumn("confidence", F.coalesce("j.confidence", F.lit("low"))).drop("j")


def roll_up(claims: DataFrame) -> DataFrame:
    """VER-4, VER-6: score over checkable claims, counts over all, problems; nothing checkable: no counts, score 0."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("verdict")]
    out = claims.groupBy("verification_id").agg(
        F.count_if("checkable").alias("checked"), F.round(F.coalesce(F.avg(F.when(F.col("checkable"), F.coalesce(weight, F.lit(0.0)))), F.lit(0.0)), 4).alias("score"),
        *(F.count_if(F.col("verdict") == v).alias(v) for v in WEIGHTS),
    )
    zero = lambda v: F.when(F.col("checked") > 0, F.col(v)).otherwise(0).alias(v)
    label = F.when(F.col("score") >= 0.85, "well supported").when(F.col("score") >= 0.6, "partly supported").otherwise("poorly supported")
    return out.select("verification_id", "checked", "score", *map(zero, WEIGHTS), F.when(F.col("checked") > 0, F.col("unsupported") + F.col("contradicted")).otherwise(0).alias("problems"), label.alias("label"))


def checkable_text(result: Column) -> Column:
    """VER-5: the prose of a stored result: answer, caveats, summary, themes, gaps."""
    one = lambda path: T.or_null(F.get_json_object(result, path))
    many = lambda path: F.array_join(F.from_json(F.get_json_object(result, path), "array<string>"), "\n")
    return F.concat_ws("\n", one("$.answer"), T.or_null(many("$.caveats")), one("$.summary.tldr"), one("$.landscape_summary"), T.or_null(many("$.themes[*].description")), T.or_null(many("$.gaps[*].description")))


def resolve_markers(answers: DataFrame, retrieved: DataFrame, facts: DataFrame) -> DataFrame:
    """CIT-6: an answer's markers as rows of what they stand for; all digits of a marker are one number; others are dropped."""
    marks = answers.select("run_id", F.posexplode("markers").alias("i", "m")).withColumn("n", F.regexp_replace("m", r"\D", "").try_cast("int")).filter("n is not null")
    graph = F.upper(F.ltrim(F.btrim("m"), F.lit("["))).startswith("G")
    s = marks.filter(~graph).join(retrieved, ["run_id", "n"]).select("run_id", "i", F.concat(F.lit("S"), F.col("n").cast("string")).alias("marker"), F.col("item_id").alias("target"), F.substring("text", 1, 400).alias("excerpt"))
    g = marks.filter(graph).join(facts, ["run_id", "n"]).select("run_id", "i", F.concat(F.lit("G"), F.col("n").cast("string")).alias("marker"), F.col("item_id").alias("target"), F.substring("text", 1, 400).alias("excerpt"))
    return s.unionByName(g)


def clean_citations(texts: DataFrame, valid: DataFrame) -> DataFrame:
    """CIT-7: grouped markers apart, unknown ones and repeats within a group dropped, spaces tidied; the markers used, in order.

    ``texts``: review_id, text. ``valid``: review_id, markers (array).
    """
    group = r"\[\s*S\d+(?:\s*(?:,|;|&|and)\s*S?\d+)*\s*\]"
    rows = texts.join(valid, "review_id", "left").withColumn("markers", F.coalesce("markers", F.array().cast("array<string>")))
    groups = F.regexp_extract_all("text", F.lit(f"({group})"), F.lit(1))
    gaps = F.split("text", group, -1)
    kept = F.transform(groups, lambda g: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("S"), n.cast("int").cast("string"))), lambda m: F.array_contains(F.col("markers"), m))))
    rows = rows.withColumn("_k", kept).withColumn("_g", gaps)
    shown = F.transform("_k", lambda ms: F.array_join(F.transform(ms, lambda m: F.concat(F.lit("["), m, F.lit("]"))), ""))
    joined = F.array_join(F.transform(F.col("_g"), lambda part, i: F.concat(part, F.coalesce(F.get(shown, i), F.lit("")))), "")
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(joined, " +([.,;:])", "$1"), "[ \t]{2,}", " "), F.lit(" \t\r\n"))
    return rows.select("review_id", tidy.alias("text"), F.array_distinct(F.flatten("_k")).alias("used"))


def reference_line(marker: Column, authors: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    """CIT-8: a review's reference; more than three authors become the first and others."""
    who = F.when(F.size(authors) > 3, F.concat(F.get(authors, F.lit(0)), F.lit(" et al."))).when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise("Unknown authors")
    line = F.concat_ws(". ", F.concat(F.lit("**["), marker, F.lit("]** "), who), F.concat(F.lit("("), year.cast("string"), F.lit(")")), F.concat(F.lit("*"), title, F.lit("*")), venue, F.concat(F.lit("doi:"), doi))
    return F.regexp_replace(line, r"\.\.", ".")


def reading_time(text: Column) -> Column:
    """CIT-9: minutes at 220 words each, at least one."""
    return F.greatest(F.lit(1), F.round(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) / 220).cast("int"))


def n_citations(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\[S\d+\])"), F.lit(1)))


def cell(value: Column, most: int = 90) -> Column:
    """RPT-1: a table cell: blanks squeezed, bars escaped, cut to ``most`` characters."""
    x = F.regexp_replace(T.squeezed(value), r"\|", r"\\|")
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…")))


def corpus_table(papers: DataFrame) -> DataFrame:
    """RPT-1: one line per paper."""
    who = F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(F.size("authors") > 3, " et al.").otherwise(""))
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    return papers.select("paper_id", F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("title")), cell(who), dash("year"), cell(dash("venue"))), F.lit(" |")).alias("line"))


def year_span(papers: DataFrame, key: str) -> DataFrame:
    lo, hi = F.min("year"), F.max("year")
    span = F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit("–"), hi.cast("string")))
    return papers.groupBy(key).agg(F.coalesce(span, F.lit("n/a")).alias("years"), F.count("*").alias("n_papers"))


def assemble(sections: DataFrame, key: str, titles: Column | None = None) -> DataFrame:
    """RPT-2, RPT-3, RPT-5: ordered sections as one Markdown text, those without text left out, numbered as they come."""
    rows = sections.filter(F.btrim("text") != "")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("ord")))
    block = F.concat(F.lit("## "), F.col("_n").cast("string"), F.lit(". "), "title", F.lit("\n\n"), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", block.alias("b")))), lambda x: x["b"])
    return rows.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("markdown"), F.count("*").alias("n_sections"))


def assemble_review(sections: DataFrame, key: str) -> DataFrame:
    """RPT-5: sections in their fixed order; completed with all, partial with some, failed with none."""
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("name"))
    known = sections.withColumn("ord", place).filter("ord > 0").withColumn("title", F.initcap(F.regexp_replace("name", "_", " ")))
    out = sections.select(key).distinct().join(assemble(known, key), key, "left").fillna(0, ["n_sections"])
    return out.withColumn("status", F.when(F.col("n_sections") == 0, "failed").when(F.col("n_sections") < len(SECTION_ORDER), "partial").otherwise("completed"))


def review_context(papers: DataFrame, key: str, most: int = 40) -> DataFrame:
    """RPT-4: at most 40 numbered papers per review with at most six authors."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.coalesce("year", F.lit(0)), "title", "paper_id"))
    return papers.withColumn("_n", n).filter(F.col("_n") <= most).select(key, "paper_id", F.concat(F.lit("S"), F.col("_n").cast("string")).alias("marker"), "title", F.array_join(F.slice("authors", 1, 6), ", ").alias("authors"))


def normalise_figures(figures: DataFrame, answers: DataFrame, schema: str) -> DataFrame:
    """FIG-1: answers written back to figures: analysed, failed, or skipped where a table has its Markdown."""
    rows = figures.join(answers, "figure_id", "left").withColumn("x", parse_json(F.col("response"), schema))
    status = F.when((F.col("kind") == "table") & (F.coalesce("table_markdown", F.lit("")) != ""), "skipped").when(F.col("x.description").isNotNull(), "analysed").when(F.col("response").isNotNull() | F.col("error").isNotNull(), "failed").otherwise("pending")
    return rows.select("figure_id", "kind", status.alias("status"), F.btrim("x.description").alias("description"))
