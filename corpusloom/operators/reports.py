"""Sections of reports, matrices with their errors, saved results in detail, and prompts (RPT-2, CIT-8, MTX-2, HIS-2, LLM-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import results as R
from corpusloom.operators.listings import run_label

# The labels of a report's parts, and the parts of a saved result.
GAP_LABELS = {"severity": "**Severity:** ", "category": " · **Category:** ", "evidence": "**Evidence:**", "direction": "**Proposed direction:** ", "related": "**Related papers:** "}
GAP_TAIL = {"intersections": "### Under-explored Intersections", "open_questions": "### Open Questions"}
SYNTHESIS_TAIL = {"agreements": "### Points of Agreement", "disagreements": "### Points of Disagreement", "trends": "### Methodological Trends"}
NOTES_HEAD = "> **Incomplete report.**"
RESULT_OBJECTS, RESULT_LISTS = ("answer", "summary", "extraction", "gaps", "graph"), ("retrieved", "graph_facts", "graph_matches", "documents")


def plain(value: Column) -> Column:
    """One line: blanks squeezed, bars escaped; null is empty."""
    return F.regexp_replace(F.coalesce(T.squeezed(value.cast("string")), F.lit("")), r"\|", r"\\|")


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), plain(x))), "\n")


def listed(items: Column) -> Column:
    return F.array_join(F.transform(items, plain), ", ")


def part(present: Column, *pieces: Column | str) -> Column:
    """A part of a text, or null, which ``concat_ws`` leaves out."""
    return F.when(F.coalesce(present, F.lit(False)), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces)))


def some(items: Column) -> Column:
    return F.size(items) > 0


def said(value: Column) -> Column:
    return value != ""


def in_order(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key`` and ``body``: the texts of a key by ``order``, a line break between them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return rows.groupBy(key).agg(F.array_join(ordered, "\n").alias("body"))


def gap_sections(gaps: DataFrame, landscapes: DataFrame) -> DataFrame:
    """RPT-2: the gap section of each run: ``run_id``, ``text``.

    ``gaps``: run_id, place, severity, category, title, description, evidence, direction, related. ``landscapes``, one
    row for each run: run_id, summary, intersections, open_questions. Gaps are numbered by place; what is empty
    is left out; a run without gaps gets a line that says so.
    """
    number = F.row_number().over(W.partitionBy("run_id").orderBy("place"))
    category = F.initcap(F.regexp_replace(F.coalesce("category", F.lit("general")), "_", " "))
    text = F.concat_ws(
        "\n", F.concat(F.lit("### Gap "), F.col("_n").cast("string"), F.lit(": "), plain(F.col("title"))),
        F.concat(F.lit(GAP_LABELS["severity"]), F.upper(F.coalesce("severity", F.lit("medium"))), F.lit(GAP_LABELS["category"]), category, F.lit("\n")), F.concat(plain(F.col("description")), F.lit("\n")),
        part(some(F.col("evidence")), GAP_LABELS["evidence"] + "\n", bullets(F.col("evidence")), "\n"), part(said(F.col("direction")), GAP_LABELS["direction"], plain(F.col("direction")), "\n"),
        part(some(F.col("related")), GAP_LABELS["related"], listed(F.col("related")), "\n"),
    )
    body = in_order(gaps.withColumn("_n", number).withColumn("_t", text), "run_id", "_n", "_t")
    tail = [part(some(F.col(c)), title + "\n", bullets(F.col(c)), "\n") for c, title in GAP_TAIL.items()]
    whole = F.concat_ws("\n", part(said(F.col("summary")), plain(F.col("summary")), "\n"), "body", *tail)
    return landscapes.join(body, "run_id", "left").select("run_id", F.when(F.col("body").isNull(), "_No gaps are known yet._").otherwise(whole).alias("text"))


def synthesis_sections(summaries: DataFrame, themes: DataFrame) -> DataFrame:
    """RPT-2: the synthesis of each run: ``run_id``, ``text``.

    ``summaries``: run_id, overview, agreements, disagreements, trends. ``themes``: run_id, place, name, description, papers.
    """
    text = F.concat_ws("\n", F.concat(F.lit("### "), plain(F.col("name"))), plain(F.col("description")), part(some(F.col("papers")), "\n_Papers:_ ", listed(F.col("papers"))), F.lit(""))
    body = in_order(themes.withColumn("_t", text), "run_id", "place", "_t")
    tail = [part(some(F.col(c)), title + "\n", bullets(F.col(c)), "\n") for c, title in SYNTHESIS_TAIL.items()]
    return summaries.join(body, "run_id", "left").select("run_id", F.concat_ws("\n", part(said(F.col("overview")), plain(F.col("overview")), "\n"), "body", *tail).alias("text"))


def notes_block(notes: Column, most: int = 10) -> Column:
    """RPT-2: quoted lines that say what is missing; empty without notes."""
    lines = F.transform(F.slice(notes, 1, most), lambda n: F.concat(F.lit("> - "), plain(n)))
    return F.coalesce(part(some(notes), NOTES_HEAD + "\n>\n", F.array_join(lines, "\n"), "\n"), F.lit(""))


def report_references(papers: DataFrame, key: str) -> DataFrame:
    """CIT-8: the references of each report by first author and year: ``key``, ``references``, ``n_references``."""
    who = F.when(some(F.col("authors")), F.concat(F.array_join(F.slice("authors", 1, 5), ", "), F.when(F.size("authors") > 5, " et al.").otherwise(""))).otherwise("Unknown author")
    year = F.when(F.col("year") != 0, F.col("year").cast("string"))
    line = F.concat(
        F.lit("1. "), plain(who), F.lit(" ("), F.coalesce(year, F.lit("n.d.")), F.lit("). "), plain(F.col("title")), F.lit("."),
        F.coalesce(part(said(F.col("venue")), " _", F.col("venue"), "_."), F.lit("")), F.coalesce(part(said(F.col("doi")), " https://doi.org/", F.col("doi")), F.lit("")),
    )
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    entry = F.struct(first.alias("a"), F.coalesce("year", F.lit(0)).alias("b"), F.col("paper_id").alias("c"), line.alias("line"))
    return papers.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"]), "\n").alias("references"), F.count("*").alias("n_references"))


def matrix_rows(answers: DataFrame, keys: list[str]) -> DataFrame:
    """MTX-2: ``run_id``, ``paper_id``, ``title`` and a column for each key; papers whose answer failed have no row.

    ``answers``: run_id, paper_id, title, payload (a map), error.
    """
    good = answers.filter("error IS NULL").withColumn("_key", F.struct("run_id", "paper_id"))
    cells = R.matrix_cells(good.select(F.col("_key").alias("paper_id"), "payload"), keys)
    return R.pivot_matrix(cells, keys).join(good.select(F.col("_key").alias("paper_id"), "title"), "paper_id").select("paper_id.*", "title", *keys)


def matrix_status(answers: DataFrame) -> DataFrame:
    """MTX-2: one row for each run: ``n_rows``, ``errors`` (a line for each paper that failed, by paper) and ``status``."""
    line = F.concat(F.coalesce("title", "paper_id"), F.lit(": "), F.col("error"))
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("paper_id", line.alias("line")))))
    out = answers.groupBy("run_id").agg(F.count_if(F.col("error").isNull()).alias("n_rows"), F.transform(failed, lambda x: x["line"]).alias("errors"))
    return out.withColumn("status", F.when((F.col("n_rows") > 0) & (F.size("errors") == 0), "completed").otherwise("partial"))


def run_details(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """HIS-2: the saved results that owners ask for (``run_id``, ``owner_id``), one column for each part of the result.

    A part that the result lacks is null, a list that it lacks is ``[]``; a run of another owner is not found.
    """
    rows = runs.join(asked.select("run_id", "owner_id").distinct(), ["run_id", "owner_id"], "left_semi")
    own = lambda key: F.get_json_object("result", f"$.{key}")
    return rows.select(
        "run_id", "intent", run_label(F.col("question"), F.col("result"), F.coalesce(F.size("paper_ids"), F.lit(0))).alias("label"), "question", F.coalesce("paper_ids", F.array().cast("array<string>")).alias("paper_ids"), "status", "duration_ms", "created_at",
        *(own(k).alias(k) for k in RESULT_OBJECTS), *(F.coalesce(own(k), F.lit("[]")).alias(k) for k in RESULT_LISTS),
        F.when(F.col("error") != "", F.array("error")).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


# --- prompts ---


def chain_prompts(candidates: DataFrame, most: int = 5) -> DataFrame:
    """LLM-5: a prompt for each implied connection of ``open_discovery``: its ends, its first ``most`` chains, what the graph says."""
    links = F.flatten(F.transform("chains", lambda x: F.transform(x["links"], lambda y: F.concat(F.lit("- "), F.col("a_name"), F.lit(" —"), y["a_to_b"], F.lit("→ "), x["b_name"], F.lit(" ("), x["b_type"], F.lit(") —"), y["b_to_c"], F.lit("→ "), F.col("c_name")))))
    lines = F.when(F.size(links) > 0, F.array_join(F.slice(links, 1, most), "\n")).otherwise("- (no chains)")
    counts = F.concat(F.lit("Intermediates: "), F.col("support").cast("string"), F.lit("; papers: "), F.col("a_count").cast("string"), F.lit(" and "), F.col("c_count").cast("string"))
    prompt = F.concat(F.lit("## A\n"), F.col("a_name"), F.lit("\n\n## C\n"), F.col("c_name"), F.lit(" ("), F.col("c_type"), F.lit(")\n\n## Paths\n"), lines, F.lit("\n\n## Graph\n"), counts, F.lit("\n\nIs the link between A and C worth a study?"))
    return candidates.select("a", "c", prompt.alias("prompt"))


#: How an answer of each kind is asked for.
KIND_HINTS = {"number": "Give the figure with its unit.", "boolean": "Answer yes, no or not reported.", "list": "Give a list of short names.", "text": "Answer in a short phrase."}


def column_prompts(papers: DataFrame, columns: DataFrame) -> DataFrame:
    """LLM-5: a prompt for each paper (``run_id``, ``paper_id``, ``title``, ``text``) with the columns of its run
    (``run_id``, ``place``, ``key``, ``name``, ``description``, ``kind``), each with its evidence."""
    hints = F.create_map(*(F.lit(x) for pair in KIND_HINTS.items() for x in pair))
    hint = F.coalesce(hints[F.lower("kind")], F.lit(KIND_HINTS["text"]))
    line = F.concat(F.lit("- `"), F.col("key"), F.lit("` — "), F.concat_ws(" ", F.concat("name", F.lit(".")), T.or_null(F.btrim("description")), hint), F.lit("\n- `"), F.col("key"), F.lit("__evidence` — the words that support it."))
    asked = in_order(columns.withColumn("_t", line), "run_id", "place", "_t")
    prompt = F.concat(F.lit("# "), F.coalesce("title", "paper_id"), F.lit("\n\n## Columns\n"), F.coalesce("body", F.lit("")), F.lit("\n\n## Text\n"), F.coalesce("text", F.lit("")))
    return papers.join(asked, "run_id", "left").select("run_id", "paper_id", prompt.alias("prompt"))


def question_prompts(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """LLM-5: a prompt for each question (``question_id``, ``question``, ``context``, ``graph_context``) with what was said
    before (``question_id``, ``turn``, ``role``, ``content``); parts that are blank are left out."""
    content = F.btrim("content", F.lit(" \t\r\n"))
    line = F.concat(F.when(F.col("role") == "user", "Researcher: ").otherwise("You: "), content)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"])
    before = turns.filter(content != "").groupBy("question_id").agg(F.array_join(ordered, "\n\n").alias("before"))
    block = lambda title, c: part(F.btrim(c) != "", f"## {title}\n", F.col(c))
    prompt = F.concat_ws("\n\n", block("Context", "context"), block("Relationships", "graph_context"), block("Earlier", "before"), F.concat(F.lit("## Question\n"), F.coalesce("question", F.lit(""))))
    return questions.join(before, "question_id", "left").select("question_id", prompt.alias("prompt"))
