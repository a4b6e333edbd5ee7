"""Listings, histories, statistics and conversations (FIL-*, STA-*, HIS-*, CNV-*, OWN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

REOPENABLE = ["qa", "summarize", "extract", "gap"]


def newest(rows: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    """The last rows by time, then id: a bounded top-k, never a full sort."""
    return rows.orderBy(F.col(at).desc(), tie).limit(limit)


def owner_scope(papers: DataFrame, requested: DataFrame) -> DataFrame:
    """FIL-1: each requested paper with what it is to its owner: indexed, not indexed, or unknown."""
    own = papers.select("owner_id", "paper_id", "status")
    rows = requested.join(own, ["owner_id", "paper_id"], "left")
    return rows.select("owner_id", "paper_id", F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "indexed", "indexed").otherwise("not indexed").alias("report"))


def search_papers(papers: DataFrame, needle: str, status: str | None = None, with_keywords: bool = False) -> DataFrame:
    """FIL-2, FIL-3: status, and a part of the title, the file name or any author (or keyword), in any case."""
    low = needle.lower()
    hit = F.lower("title").contains(low) | F.exists("authors", lambda a: F.lower(a).contains(low))
    if "filename" in papers.columns:
        hit = hit | F.lower("filename").contains(low)
    if with_keywords:
        hit = hit | F.exists("keywords", lambda k: F.lower(k).contains(low))
    return papers.filter(hit if status is None else hit & (F.col("status") == status))


def figure_listing(figures: DataFrame, papers: DataFrame, kind: str | None = None, status: str | None = None) -> DataFrame:
    """FIL-4, FIL-16: figures of a kind and status with their paper's title, by title, page and label."""
    rows = figures
    for name, value in (("kind", kind), ("status", status)):
        rows = rows.filter(F.col(name) == value) if value else rows
    out = rows.join(papers.select("paper_id", F.col("title").alias("paper_title")), "paper_id", "left")
    return out.withColumn("has_image", F.col("image_path").isNotNull()).orderBy("paper_title", "page", "label", "figure_id")


def pending_figures(figures: DataFrame, cap: int) -> DataFrame:
    """FIL-5: figures still to read (with an image), how many one run reads, and how many are readable already."""
    pending = F.count_if((F.col("status") == "pending") & F.col("image_path").isNotNull())
    return figures.agg(pending.alias("pending"), F.least(pending, F.lit(cap)).alias("this_run"), F.count_if(F.col("status") == "analysed").alias("readable"))


def hypotheses(rows: DataFrame, verdict: str | None = None, starred: bool | None = None, limit: int = 50) -> DataFrame:
    """FIL-6"""
    if verdict:
        rows = rows.filter(F.col("verdict") == verdict)
    if starred is not None:
        rows = rows.filter(F.col("starred") == F.lit(starred))
    return newest(rows, "created_at", "hypothesis_id", limit)


def history(runs: DataFrame, intents: list[str] | None = None, limit: int = 50) -> DataFrame:
    """FIL-7, HIS-3: the last runs of re-openable intents; intents that are not known mean all of them."""
    wanted = [i for i in intents or [] if i in REOPENABLE] or REOPENABLE
    return newest(runs.filter(F.col("intent").isin(wanted)), "created_at", "run_id", limit)


def run_items(runs: DataFrame) -> DataFrame:
    """HIS-2"""
    return runs.select("run_id", "owner_id", "intent", F.coalesce(F.size("paper_ids"), F.lit(0)).alias("paper_count"), F.col("error").isNotNull().alias("has_error"), "created_at")


def run_label(question: Column, result: Column, n_papers: Column) -> Column:
    """HIS-1: the question, else the summary's title, else its gist, else its gaps, else the number of papers."""
    path = lambda p: T.or_null(F.get_json_object(result, p))
    gaps = F.size(F.from_json(F.get_json_object(result, "$.gaps"), "array<struct<title:string>>"))
    gap = F.when(gaps > 0, F.concat(gaps.cast("string"), F.when(gaps == 1, " gap — ").otherwise(" gaps — "), F.coalesce(path("$.gaps[0].title"), F.lit(""))))
    count = F.concat(n_papers.cast("string"), F.when(n_papers == 1, " paper").otherwise(" papers"))
    return F.coalesce(T.or_null(F.btrim(question)), path("$.summary.title"), F.substring(path("$.summary.tldr"), 1, 120), gap, count)


def without_intents(runs: DataFrame, owner: str, intents: list[str]) -> DataFrame:
    """HIS-4: the history without one owner's runs of some intents."""
    return runs.filter(~F.coalesce((F.col("owner_id") == owner) & F.col("intent").isin(intents), F.lit(False)))


def trace_steps(runs: DataFrame) -> DataFrame:
    """HIS-5: one row per step."""
    return runs.select("run_id", F.posexplode("trace").alias("step", "t")).select("run_id", "step", "t.node", "t.status", "t.duration_ms")


def merge_branches(branches: DataFrame) -> DataFrame:
    """HIS-5: sibling branches of a run as one: traces and errors one after the other, calls summed."""
    ordered = F.array_sort(F.collect_list(F.struct("branch", "trace", "errors")))
    out = branches.groupBy("run_id").agg(ordered.alias("x"), F.sum("calls").alias("calls"))
    return out.select("run_id", F.flatten(F.transform("x", lambda b: b["trace"])).alias("trace"), F.flatten(F.transform("x", lambda b: b["errors"])).alias("errors"), "calls")


def saved_results(reports: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """FIL-15: saved results with the sizes of what they hold."""
    rows = reports.filter(F.col("kind") == kind) if kind else reports
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return newest(rows, "created_at", "report_id", limit).select("report_id", "owner_id", "kind", "created_at", n("sections").alias("n_sections"), n("citations").alias("n_citations"), n("paper_ids").alias("n_papers"))


def paper_summary(papers: DataFrame) -> DataFrame:
    """FIL-16: lists instead of nulls, section names in order, native where no source is stated."""
    none = F.array().cast("array<string>")
    return papers.select("paper_id", "title", F.coalesce("authors", none).alias("authors"), F.coalesce("keywords", none).alias("keywords"), F.array_sort(F.coalesce(F.map_keys("sections"), none)).alias("section_names"), F.coalesce("text_source", F.lit("native")).alias("text_source"))


def verification_rows(claims: DataFrame, verification_id: str) -> DataFrame:
    """FIL-8: the judged claims of one past verification."""
    return claims.filter(F.col("verification_id") == verification_id)


def corpus_stats(papers: DataFrame, chunks: DataFrame, runs: DataFrame, reports: DataFrame) -> DataFrame:
    """STA-1: per owner."""
    own = papers.groupBy("owner_id").agg(F.count("*").alias("papers"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"))
    n = lambda d, name: d.groupBy("owner_id").agg(F.count("*").alias(name))
    return own.join(n(chunks, "chunks"), "owner_id", "left").join(n(runs, "runs"), "owner_id", "left").join(n(reports, "reports"), "owner_id", "left").fillna(0, ["chunks", "runs", "reports"])


def top_keywords(papers: DataFrame, most: int = 20) -> DataFrame:
    """STA-2"""
    words = papers.select(F.explode("keywords").alias("k")).select(F.initcap(F.btrim("k")).alias("keyword")).filter("keyword <> ''")
    return words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keyword").limit(most)


def papers_by_year(papers: DataFrame) -> DataFrame:
    """STA-3"""
    return papers.filter("year > 0").groupBy("year").agg(F.count("*").alias("n"))


def health(papers: DataFrame) -> DataFrame:
    """STA-4"""
    return papers.agg(F.count("*").alias("papers"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.coalesce(F.col("text_source"), F.lit("native")) != "native").alias("ocr_assisted"))


def upload_summary(rows: DataFrame) -> DataFrame:
    """STA-5"""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def job_rollup(items: DataFrame) -> DataFrame:
    """STA-7: progress and state of each job."""
    done, failed, n = F.count_if(F.col("state").isin("indexed", "duplicate")), F.count_if(F.col("state") == "failed"), F.count("*")
    rows = items.groupBy("job_id").agg(n.alias("total"), done.alias("completed"), failed.alias("failed"))
    ended = F.col("completed") + F.col("failed")
    status = F.when(ended < F.col("total"), "running").when(F.col("failed") == 0, "completed").when(F.col("completed") > 0, "partial").otherwise("failed")
    return rows.select("*", F.round(ended / F.col("total"), 3).alias("progress"), status.alias("status"))


def reclaim_stale(items: DataFrame, live: DataFrame, message: str = "Interrupted by a restart.") -> DataFrame:
    """STA-8: items that were under way in jobs that nobody runs any more have failed."""
    rows = items.join(live.select("job_id", F.lit(True).alias("_live")), "job_id", "left")
    stale = F.col("_live").isNull() & F.col("state").isin("queued", "running")
    return rows.withColumn("detail", F.when(stale, message)).withColumn("state", F.when(stale, "failed").otherwise(F.col("state"))).drop("_live")


def conversation_list(messages: DataFrame) -> DataFrame:
    """CNV-1: turns (messages of the user) and the title that CNV-4 gives."""
    first = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 120)), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.max("turn").alias("last_turn"), first.alias("title"))


def memory_window(messages: DataFrame, turns: int = 6) -> DataFrame:
    """CNV-2: the last 2 x turns messages of each conversation."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("role").desc(), F.col("text").desc()))
    return messages.withColumn("_b", back).filter(F.col("_b") <= 2 * turns).drop("_b")


def transcripts(messages: DataFrame) -> DataFrame:
    """CNV-3: messages that are not blank, each under its speaker."""
    who = F.when(F.col("role") == "user", "Researcher: ").otherwise("You: ")
    rows = messages.filter(F.btrim("text") != "").select("conv_id", "turn", F.concat(who, F.btrim("text")).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return rows.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("transcript"))


def append_turn(messages: DataFrame, new: DataFrame) -> DataFrame:
    """CNV-4: new messages (conv_id, role, text, ord) after the last turn of their conversations."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("ord"))
    added = new.join(last, "conv_id", "left").select("conv_id", (F.coalesce("_last", F.lit(-1)) + n).cast(messages.schema["turn"].dataType).alias("turn"), "role", "text")
    return messages.select("conv_id", "turn", "role", "text").unionByName(added)


def adopt_orphans(tables: dict[str, DataFrame], owner: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """OWN-1: rows without an owner get one; how many in each table."""
    counts = None
    for name, df in tables.items():
        n = df.agg(F.lit(name).alias("table_name"), F.count_if(F.col("owner_id").isNull()).alias("adopted"))
        counts = n if counts is None else counts.unionByName(n)
    return {k: d.withColumn("owner_id", F.coalesce("owner_id", F.lit(owner))) for k, d in tables.items()}, counts
