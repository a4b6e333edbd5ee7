"""Documents as tables: metadata, sections, pages, layout, identity (DOC-*, FIL-9, FIL-10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.storage import cut


def metadata(docs: DataFrame, id_col: str, text_col: str, stem: Column | None = None) -> DataFrame:
    """DOC-1 … DOC-7 in one projection; metadata of the file, where known, can be coalesced over it."""
    t = F.col(text_col)
    out = docs.withColumn("title", T.title(t, stem if stem is not None else F.col(id_col).cast("string")))
    return out.select(
        id_col, "title", T.authors(t, F.col("title")).alias("authors"), T.doi(t).alias("doi"), T.year(t).alias("year"),
        T.venue(t).alias("venue"), T.abstract(F.substring(t, 1, 20000)).alias("abstract"), T.keywords(t).alias("keywords"),
    )


def heading_marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``line_no`` (from 0), ``start`` (code point of the line's first character), ``inset`` (of its first one that is no blank) and ``section`` of each heading line."""
    rows = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    before = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    rows = rows.withColumn("inset", F.col("start") + F.length("line") - F.length(F.ltrim("line", F.lit(" \t\r"))))
    return rows.withColumn("section", T.heading(F.col("line")))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """DOC-8: one row per section: the lines from its heading to the next; the first body that is not empty wins."""
    rows = heading_marks(docs, id_col, text_col)
    upto = W.partitionBy(id_col).orderBy("line_no")
    rows = rows.withColumn("part", F.sum(F.when(F.col("section").isNotNull(), 1).otherwise(0)).over(upto)).filter("part > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = rows.groupBy(id_col, "part").agg(F.max("section").alias("section"), F.btrim(body, F.lit(" \t\r\n")).alias("body")).filter("body <> ''")
    first = F.row_number().over(W.partitionBy(id_col, "section").orderBy("part"))
    return parts.withColumn("_n", first).filter("_n = 1").select(id_col, "section", "body")


def section_map(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return sections(docs, id_col, text_col).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("sections"))


def image_coverage(pages: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """FIL-10: share of a page under image blocks, else under listed images clipped to the page; at most 1."""
    key = ["paper_id", "page_no"]
    own = blocks.filter("kind = 'image'").groupBy(*key).agg(F.sum(F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("a"))
    clipped = images.join(pages, key).withColumn("w", F.least("x1", "width") - F.greatest("x0", F.lit(0))).withColumn("h", F.least("y1", "height") - F.greatest("y0", F.lit(0)))
    listed = clipped.groupBy(*key).agg(F.sum(F.when((F.col("w") > 0) & (F.col("h") > 0), F.col("w") * F.col("h")).otherwise(0)).alias("b"))
    area = F.col("width") * F.col("height")
    covered = F.when(F.coalesce("a", F.lit(0)) <= 0, F.coalesce("b", F.lit(0))).otherwise(F.col("a"))
    joined = pages.join(own, key, "left").join(listed, key, "left")
    return joined.select(*key, F.when(area > 0, F.least(F.lit(1.0), covered / area)).otherwise(0.0).alias("coverage"))


def needs_ocr(text: Column, coverage: Column, min_chars: int = 120, min_coverage: float = 0.25) -> Column:
    """FIL-9"""
    return (F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))) < min_chars) & (coverage >= min_coverage)


def page_provenance(pages: DataFrame, most: int = 40) -> DataFrame:
    """DOC-10: where a paper's text came from; at most ``most`` pages are recognised, in page order, the others skipped."""
    wanted = F.row_number().over(W.partitionBy("paper_id", F.col("needs_ocr")).orderBy("page_no"))
    rows = pages.withColumn("_n", wanted).withColumn("_ocr", F.col("needs_ocr") & (F.col("_n") <= most))
    done, skipped = F.when(F.col("_ocr"), F.col("page_no")), F.when(F.col("needs_ocr") & ~F.col("_ocr"), F.col("page_no"))
    out = rows.groupBy("paper_id").agg(
        F.count("*").alias("page_count"), F.count_if("_ocr").alias("n_ocr"), F.array_sort(F.collect_list(done)).alias("ocr_pages"),
        F.array_sort(F.collect_list(skipped)).alias("skipped_pages"), F.round(F.avg(F.when(F.col("_ocr"), F.col("confidence"))), 4).alias("ocr_confidence"),
    )
    source = F.when(F.col("n_ocr") == 0, "native").when(F.col("n_ocr") == F.col("page_count"), "ocr").otherwise("mixed")
    return out.select("paper_id", source.alias("text_source"), "page_count", "ocr_pages", "skipped_pages", "ocr_confidence")


def recognise(pages: DataFrame, cache: DataFrame, engine: Callable[[bytes, float, float], tuple[str, float]], name: str, dpi: int = 200) -> tuple[DataFrame, DataFrame]:
    """UDF-3: the text and confidence of page images by any engine, asked only for what the cache lacks.

    ``pages``: paper_id, page_no, image, width, height. ``cache``: key, text, confidence. Returns the
    pages with their text, and the cache rows to add. Equal images on equal terms are read once.
    """
    keyed = pages.withColumn("key", F.sha2(F.concat_ws("|", F.sha2("image", 256), "width", "height", F.lit(dpi), F.lit(name)), 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [engine(bytes(i), w, h) for i, w, h in zip(b["image"], b["width"], b["height"], strict=True)]
            yield pd.DataFrame([(k, t, float(c)) for k, (t, c) in zip(b["key"], read, strict=True)], columns=["key", "text", "confidence"])

    todo = keyed.select("key", "image", "width", "height").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = cut(todo.mapInPandas(run, "key string, text string, confidence double"), "recognised")
    return keyed.join(cache.select("key", "text", "confidence").unionByName(fresh), "key").drop("image"), fresh


def reading_order(lines: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """DOC-11: the recognised text of each page in reading order, and its number of columns.

    ``lines``: paper_id, page_no, text, x0, y0, x1, y1, confidence, width, height. All windows are
    within a page.
    """
    page = ["paper_id", "page_no"]
    rows = lines.filter((F.col("confidence") >= min_confidence) & (F.btrim("text") != "")).withColumn("xc", (F.col("x0") + F.col("x1")) / 2)
    by_x = W.partitionBy(*page).orderBy("xc")
    gap = F.col("xc") - F.lag("xc").over(by_x)
    rows = rows.withColumn("gap", F.coalesce(gap, F.lit(0.0))).withColumn("mid", F.col("xc") - F.col("gap") / 2)
    whole = W.partitionBy(*page)
    widest = F.max(F.struct("gap", (-F.col("mid")).alias("m"))).over(whole)
    rows = rows.withColumn("best", widest["gap"]).withColumn("split", -widest["m"]).withColumn("n", F.count("*").over(whole))
    left = F.count_if(F.col("xc") <= F.col("split")).over(whole)
    rows = rows.withColumn("left", left)
    share = F.least("left", F.col("n") - F.col("left")) / F.col("n")
    two = (F.col("n") >= 6) & (F.col("width") > 0) & (F.col("best") >= 0.06 * F.col("width")) & (share >= 0.2)
    rows = rows.withColumn("two", two).withColumn("col", F.when(F.col("two") & (F.col("xc") > F.col("split")), 1).otherwise(0))
    tolerance = F.greatest(F.lit(4.0), F.col("height") * 0.012)
    band = F.rint(F.col("y0") / tolerance)
    order = W.partitionBy(*page, "col").orderBy(band, "x0", "y0", "text")
    rows = rows.withColumn("new", F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(order)) > tolerance).cast("int"), F.lit(0)))
    rows = rows.withColumn("row", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    items = F.array_sort(F.collect_list(F.struct("x0", "y0", "text")))
    by_row = rows.groupBy(*page, "col", "row").agg(F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("line"), F.first("two").alias("two"))
    ordered = F.array_sort(F.collect_list(F.struct("col", "row", "line")))
    return by_row.groupBy(*page).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), F.max(F.when(F.col("two"), 2).otherwise(1)).alias("n_columns"))


def html_text(pages: DataFrame) -> DataFrame:
    """DOC-12: title, first heading, headings and paragraphs of raw pages without scripts, styles and navigation."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav)\b[^>]*>.*?</\1>", "")
    tags = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", ""), r"\s+", " "))
    every = lambda tag: F.filter(F.transform(F.regexp_extract_all(F.col("_b"), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), tags), lambda x: x != "")
    return pages.withColumn("_b", bare).select(
        "page_id", "url", F.get(every("title"), F.lit(0)).alias("title"), F.get(every("h1"), F.lit(0)).alias("heading"),
        F.array_join(every("p"), "\n").alias("text"), F.size(every("p")).alias("n_paragraphs"),
    )


def captions(blocks: DataFrame) -> DataFrame:
    """DOC-13/14 over text blocks: those that are captions, with kind, label and caption."""
    return blocks.withColumn("c", T.caption(F.col("text"))).filter("c is not null").select(*[c for c in blocks.columns if c != "text"], "c.kind", "c.label", "c.caption")


def overlap(a: str, b: str) -> Column:
    """Shared width of two boxes by the width of the narrower."""
    width = F.least(F.col(f"{a}.x1") - F.col(f"{a}.x0"), F.col(f"{b}.x1") - F.col(f"{b}.x0"))
    return F.when(width > 0, (F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")) / width).otherwise(0.0)


def plausible_tables(tables: DataFrame, captions_: DataFrame, pages: DataFrame) -> DataFrame:
    """DOC-16: at least 2 x 2, at most 16 columns and 75 % of the page, around at most one caption."""
    key = ["paper_id", "page_no"]
    sized = tables.join(pages, key).filter("n_rows >= 2 AND n_cols BETWEEN 2 AND 16 AND (x1 - x0) * (y1 - y0) <= 0.75 * width * height").drop("width", "height")
    t, c = sized.alias("t"), captions_.alias("c")
    inside = (F.col("t.x0") <= F.col("c.x0")) & (F.col("t.y0") <= F.col("c.y0")) & (F.col("t.x1") >= F.col("c.x1")) & (F.col("t.y1") >= F.col("c.y1"))
    same = (F.col("t.paper_id") == F.col("c.paper_id")) & (F.col("t.page_no") == F.col("c.page_no"))
    crowded = t.join(c, same & inside).groupBy("t.paper_id", "t.page_no", "t.table_no").count().filter("count > 1")
    return sized.join(crowded.select("paper_id", "page_no", "table_no"), ["paper_id", "page_no", "table_no"], "left_anti")


def figure_regions(captions_: DataFrame, graphics: DataFrame, tables: DataFrame, pages: DataFrame, most: int = 60) -> DataFrame:
    """DOC-15: the region of each caption's figure or table.

    A figure is the graphics above its caption, up to the next caption that overlaps it by a fourth
    of the width; without graphics it is that whole band. A table is the nearest one within 160
    points that overlaps its caption; where two captions are nearest to one table, the closer
    caption has it. At least 60 by 45 points; at most ``most`` per paper in reading order. All joins
    are within a page.
    """
    key = ["paper_id", "page_no"]
    on_page = lambda a, b: (F.col(f"{a}.paper_id") == F.col(f"{b}.paper_id")) & (F.col(f"{a}.page_no") == F.col(f"{b}.page_no"))
    me, other = captions_.alias("c"), captions_.alias("o")
    above = F.max(F.when(F.col("o.y1") <= F.col("c.y0"), F.col("o.y1")))
    bound = me.join(other, on_page("c", "o") & (F.col("c.caption_no") != F.col("o.caption_no")) & (overlap("c", "o") > 0.25), "left")
    bound = bound.groupBy("c.paper_id", "c.page_no", "c.caption_no").agg(above.alias("ceiling"))
    base = captions_.join(bound, [*key, "caption_no"]).join(pages, key)
    figures = base.filter("kind NOT IN ('table', 'algorithm')").withColumn("ceiling", F.greatest(F.coalesce("ceiling", F.lit(0.0)), F.col("y0") - 0.62 * F.col("height"), F.lit(0.0)))
    figures = figures.withColumn("bx0", F.col("x0") - 14).withColumn("bx1", F.col("x1") + 14).withColumn("by0", F.col("ceiling")).withColumn("by1", F.col("y0") - 1).filter("by1 - by0 >= 45")
    f, g = figures.alias("f"), graphics.alias("g")
    wide = F.least("f.bx1", "g.x1") - F.greatest("f.bx0", "g.x0")
    high = F.least("f.by1", "g.y1") - F.greatest("f.by0", "g.y0")
    fits = on_page("f", "g") & (wide > 0) & (high > 0) & (wide * high > 120) & (overlap("f", "g") > 0.25)
    merged = f.join(g, fits, "left").groupBy(*[f"f.{c}" for c in figures.columns]).agg(F.min("g.x0").alias("gx0"), F.min("g.y0").alias("gy0"), F.max("g.x1").alias("gx1"), F.max("g.y1").alias("gy1"))
    clip = lambda lo, hi, v: F.greatest(lo, F.least(hi, v))
    fig = merged.select(
        *key, "caption_no", "kind", "label", "width", "height", F.coalesce(F.greatest("gx0", "bx0"), "bx0").alias("rx0"), F.coalesce(F.greatest("gy0", "by0"), "by0").alias("ry0"),
        F.coalesce(F.least("gx1", "bx1"), "bx1").alias("rx1"), F.coalesce(F.least("gy1", "by1"), "by1").alias("ry1"), F.lit(None).cast("int").alias("table_no"),
    )
    c, t = base.filter("kind IN ('table', 'algorithm')").alias("c"), tables.alias("t")
    far = F.greatest(F.lit(0.0), F.col("t.y0") - F.col("c.y1"), F.col("c.y0") - F.col("t.y1"))
    pairs = c.join(t, on_page("c", "t") & (overlap("c", "t") >= 0.25) & (far <= 160)).select("c.paper_id", "c.page_no", "c.caption_no", "c.kind", "c.label", "c.width", "c.height", "t.x0", "t.y0", "t.x1", "t.y1", "t.table_no", far.alias("far"))
    nearest = F.row_number().over(W.partitionBy(*key, "caption_no").orderBy("far", "table_no"))
    closest = F.row_number().over(W.partitionBy(*key, "table_no").orderBy("far", "caption_no"))
    tab = pairs.withColumn("_a", nearest).filter("_a = 1").withColumn("_b", closest).filter("_b = 1")
    tab = tab.select(*key, "caption_no", "kind", "label", "width", "height", F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1"), "table_no")
    zero = F.lit(0.0)
    out = fig.unionByName(tab).select(
        *key, "caption_no", "kind", "label", "table_no", clip(zero, F.col("width"), F.col("rx0") - 4).alias("x0"), clip(zero, F.col("height"), F.col("ry0") - 4).alias("y0"),
        clip(zero, F.col("width"), F.col("rx1") + 4).alias("x1"), clip(zero, F.col("height"), F.col("ry1") + 4).alias("y1"),
    ).filter("x1 - x0 >= 60 AND y1 - y0 >= 45")
    nth = F.row_number().over(W.partitionBy("paper_id").orderBy("page_no", "caption_no"))
    return out.withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n")


def tables_to_markdown(cells: DataFrame) -> DataFrame:
    """DOC-17: ``cells`` (table_id, row_no, values) as Markdown; rows are padded or cut to the header's width."""
    clean = lambda v: F.regexp_replace(T.squeezed(v), r"\|", r"\\|")
    rows = cells.withColumn("v", F.transform("values", clean))
    width = F.max(F.when(F.col("row_no") == 0, F.size("values"))).over(W.partitionBy("table_id"))
    rows = rows.withColumn("w", width)
    named = F.transform("v", lambda x, i: F.when((F.col("row_no") == 0) & (x == ""), F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(x))
    padded = F.slice(F.concat(named, F.array_repeat(F.lit(""), F.col("w"))), F.lit(1), F.col("w"))
    rows = rows.withColumn("line", F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |")))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), " | "), F.lit(" |"))
    rows = rows.withColumn("line", F.when(F.col("row_no") == 0, F.concat("line", rule)).otherwise(F.col("line")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"])
    return rows.groupBy("table_id").agg(F.array_join(ordered, "\n").alias("markdown"), F.count("*").alias("n_rows"), F.max("w").alias("n_cols"))


def figure_text(label: Column, caption: Column, description: Column, findings: Column, takeaway: Column, table: Column) -> Column:
    """DOC-18: what there is, joined by newlines."""
    some = lambda c: F.when(F.btrim(c) != "", c)
    return F.concat_ws("\n", some(label), some(caption), some(description), F.filter(findings, lambda x: F.btrim(x) != ""), some(takeaway), some(table))


def unique_documents(docs: DataFrame, owner: str, content: str, order: str) -> DataFrame:
    """DOC-19: the first document of each owner and content hash; another owner's copy is a document of its own.

    A minimum per key, partly before the shuffle, so copies of one text in any number are no burden.
    """
    hashed = docs.withColumn("content_hash", F.sha2(F.col(content), 256))
    return hashed.groupBy(owner, "content_hash").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def safe_name(name: Column) -> Column:
    return F.coalesce(T.or_null(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))), F.lit("document"))
