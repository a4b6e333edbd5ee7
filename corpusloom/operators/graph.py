"""The knowledge graph as two tables, ``nodes`` and ``edges`` (GRF-4 … GRF-15, FIL-11, FIL-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.storage import cut, scratch

# Closed vocabularies.
ENTITY_TYPES = ["Concept", "Method", "Dataset", "Metric", "Task", "Tool", "Model", "Author"]
RELATIONS = ["USES", "EVALUATED_ON", "IMPROVES", "COMPARES_WITH", "PROPOSES", "PART_OF", "APPLIED_TO", "MEASURES", "CITES", "RELATED_TO"]
STRUCTURAL = ["MENTIONS", "AUTHORED_BY", "CONTAINS"]
SCIENTIFIC = ["Concept", "Method", "Dataset", "Metric", "Task", "Tool", "Model"]
NON_FACTUAL = ["Paper", "Figure", "Author"]


def union_all(arrays: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(arrays))))


def endpoints(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select(F.col(id_col).alias("_id")).distinct()
    out = edges.join(ids, F.col("source") == F.col("_id"), "left_semi")
    return out.join(ids, F.col("target") == F.col("_id"), "left_semi")


def spelled(names: DataFrame) -> DataFrame:
    """Each distinct ``name`` as ``raw``, its ``clean`` form, its ``key`` and the key of the clean form: worked out once, however many rows have it."""
    clean, key = T.clean_name(F.col("raw")), T.canonical_key(F.col("raw"))
    once = cut(names.filter("name is not null").select(F.col("name").alias("raw")).distinct(), "names")
    return cut(cut(once.select("raw", clean.alias("clean"), key.alias("key")), "clean").select("*", T.canonical_key(F.col("clean")).alias("clean_key")), "spelled")


def fold(entities: DataFrame, relations: DataFrame, papers: DataFrame, with_authors: bool = True, corpus_wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """GRF-4/5: fragments of all papers as nodes and edges.

    ``entities``: paper_id, paper_ord, ord, name, type, description. ``relations``: paper_id,
    paper_ord, ord, source, target, type, evidence. ``papers``: paper_id, paper_ord, title, authors.
    The first name and type of a key win, by paper and position, as does the first description that
    is not empty. A relation's end is an entity of the same or an earlier paper (of any paper if
    ``corpus_wide``) or a paper's title; other relations are dropped.
    """
    place = F.struct("paper_ord", "ord")
    authors = papers.select("paper_id", "paper_ord", F.posexplode(F.slice("authors", 1, 12)).alias("i", "name"))
    names = [entities.select("name"), relations.select(F.col("source").alias("name")), relations.select(F.col("target").alias("name"))] + ([authors.select("name")] if with_authors else [])
    forms = spelled(reduce(DataFrame.unionByName, names))
    form = lambda rows, name: rows.join(forms.withColumnRenamed("raw", name), name, "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    own = form(entities, "name").select("paper_id", "paper_ord", "ord", blank("clean").alias("name"), "type", "description", blank("clean_key").alias("key"))
    own = own.filter(F.length("name").between(1, 120)).withColumn("type", F.when(F.col("type").isin(ENTITY_TYPES), F.col("type")).otherwise("Concept"))
    own = cut(own, "own")
    wrote = form(authors, "name").select("paper_id", "paper_ord", (F.col("i") + 1_000_000).alias("ord"), blank("clean").alias("name"), F.lit("Author").alias("type"), F.lit(None).cast("string").alias("description"), blank("clean_key").alias("key")).filter("name <> ''")
    every = own.unionByName(wrote) if with_authors else own
    keyed = every.filter("key <> ''")
    text = F.when(F.col("description") != "", F.substring("description", 1, 400))
    nodes = keyed.groupBy("key").agg(
        F.min_by("name", place).alias("name"), F.min_by("type", place).alias("type"), F.min_by(text, F.when(text.isNotNull(), place)).alias("description"),
        F.array_sort(F.collect_set("paper_id")).alias("papers"), F.min("paper_ord").alias("first_ord"),
    ).withColumn("id", F.concat(F.lit("entity:"), "key"))
    titles = papers.select(F.concat(F.lit("paper:"), "paper_id").alias("id"), F.col("title").alias("name"), F.lit("Paper").alias("type"), F.lit(None).cast("string").alias("description"), F.array("paper_id").alias("papers"), T.canonical_key(F.col("title")).alias("key"), F.col("paper_ord").alias("first_ord"))
    ends = nodes.select("key", "id", "first_ord").unionByName(titles.select("key", "id", "first_ord"))
    ends = ends.groupBy("key").agg(F.min_by("id", F.struct(F.col("id").startswith("entity:").cast("int"), "first_ord")).alias("id"), F.min("first_ord").alias("first_ord"))
    ends = cut(ends, "ends")
    of = lambda rows, name, out: form(rows, name).withColumn(out, blank("key")).drop("clean", "key", "clean_key")
    rel = of(of(relations, "source", "sk"), "target", "tk")
    known = F.lit(True) if corpus_wide else F.col("f") <= F.col("paper_ord")
    side = lambda d, key, out: d.join(ends.select(F.col("key").alias(key), F.col("id").alias(out), F.col("first_ord").alias("f")), key).filter(known).drop("f")
    rel = side(side(rel, "sk", "s"), "tk", "t").filter("s <> t")
    kind = F.upper(F.regexp_replace(F.btrim(F.coalesce("type", F.lit(""))), r"[\s-]+", "_"))
    stated = rel.select(F.col("s").alias("source"), F.col("t").alias("target"), F.when(kind.isin(RELATIONS), kind).otherwise("RELATED_TO").alias("type"), "paper_id", "paper_ord", "ord", F.substring(F.coalesce("evidence", F.lit("")), 1, 300).alias("evidence"))
    link = lambda rows, kind_: rows.select(F.concat(F.lit("paper:"), "paper_id").alias("source"), F.concat(F.lit("entity:"), "key").alias("target"), F.lit(kind_).alias("type"), "paper_id", "paper_ord", "ord", F.lit("").alias("evidence")).filter("target <> 'entity:'")
    links = stated.unionByName(link(own, "MENTIONS"))
    if with_authors:
        links = links.unionByName(link(wrote, "AUTHORED_BY"))
    edges = links.groupBy("source", "target", "type").agg(F.array_sort(F.collect_set("paper_id")).alias("papers"), F.min_by("evidence", place).alias("evidence"))
    columns = ["id", "name", "type", "description", "papers"]
    return nodes.select(columns).unionByName(titles.select(columns)), edges


def figure_edges(figures: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-7: nodes of analysed figures, edges from their papers and to entities that the graph already has."""
    done = figures.filter("status = 'analysed'").withColumn("id", F.concat(F.lit("figure:"), "figure_id"))
    own = done.select("id", F.col("label").alias("name"), F.lit("Figure").alias("type"), F.array("paper_id").alias("papers"))
    held = done.select(F.concat(F.lit("paper:"), "paper_id").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("type"), F.array("paper_id").alias("papers"))
    relation = F.create_map(*[F.lit(x) for x in ("datasets", "EVALUATED_ON", "methods", "USES", "metrics", "MEASURES")])
    named = done.select("id", "paper_id", F.explode("entities").alias("kind", "names")).select("id", "paper_id", relation[F.col("kind")].alias("type"), F.explode("names").alias("name")).filter("type is not null")
    named = named.withColumn("target", F.concat(F.lit("entity:"), T.canonical_key(F.col("name"))))
    met = named.join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return own, held.unionByName(met.groupBy(F.col("id").alias("source"), "target", "type").agg(F.array_sort(F.collect_set("paper_id")).alias("papers")))


def remove_papers(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-6: without some papers (``paper_id``): lists lose their ids; what had a list and has none left goes, as do
    the papers' own nodes and edges without an end. Lists that were empty from the start stay."""

    def without(df: DataFrame, key: list[str]) -> DataFrame:
        held = df.filter(F.size("papers") > 0).select(*key, F.explode("papers").alias("paper_id")).join(gone, "paper_id", "left_anti")
        left = held.groupBy(*key).agg(F.array_sort(F.collect_list("paper_id")).alias("papers"))
        kept = df.filter(F.size("papers") > 0).drop("papers").join(left, key).select(df.columns)
        return kept.unionByName(df.filter(F.coalesce(F.size("papers"), F.lit(0)) <= 0))

    own = gone.select(F.concat(F.lit("paper:"), "paper_id").alias("id"))
    n = without(nodes, ["id"]).join(own, "id", "left_anti")
    return n, endpoints(without(edges, ["source", "target", "type"]), n)


def merge_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Papers are united, the new value of another attribute wins."""
    rest = [c for c in old.columns if c not in key and c != "papers"]
    b = new.select(*key, F.col("papers").alias("_papers"), *(F.col(c).alias(f"_{c}") for c in rest))
    none = F.array().cast("array<string>")
    both = old.join(b, key, "full_outer")
    united = F.array_sort(F.array_union(F.coalesce("papers", none), F.coalesce("_papers", none)))
    return both.select(*key, *(F.coalesce(f"_{c}", c).alias(c) for c in rest), united.alias("papers")).select(old.columns)


def upsert(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-8: nodes and edges merged by ``merge_rows``; edges without an end are dropped."""
    n = merge_rows(nodes, new_nodes, ["id"])
    return n, endpoints(merge_rows(edges, new_edges, ["source", "target", "type"]), n)


def scoped(nodes: DataFrame, edges: DataFrame, papers: DataFrame, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """GRF-9: nodes of the given papers, at most ``limit`` by id, and the edges between them."""
    held = nodes.select("id", F.explode("papers").alias("paper_id")).join(papers, "paper_id", "left_semi").select("id")
    own = nodes.select("id").join(papers.select(F.concat(F.lit("paper:"), "paper_id").alias("id")), "id", "left_semi")
    ids = held.unionByName(own).distinct().orderBy("id").limit(limit)
    n = nodes.join(ids, "id", "left_semi")
    return n, endpoints(edges, n)


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-10"""
    one = nodes.groupBy(F.lit("node").alias("part"), F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))
    return one.unionByName(edges.groupBy(F.lit("edge").alias("part"), F.coalesce("type", F.lit("RELATED_TO")).alias("type")).agg(F.count("*").alias("n")))


def of_types(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """FIL-11"""
    n = nodes.filter(F.col("type").isin(types))
    return n, endpoints(edges, n)


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))


def min_degree(nodes: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """FIL-12: one pass, not a k-core: degrees are those of the given edges."""
    many = ends_of(edges).groupBy("id").count().filter(F.col("count") >= least)
    n = nodes.join(many, "id", "left_semi") if least > 0 else nodes
    return n, endpoints(edges, n)


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """GRF-11: nodes within ``depth`` steps of the start (``id``), with their distance, and the edges between them."""
    both = cut(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "both")
    seen = frontier = start.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    n = nodes.join(seen, "id")
    return n, endpoints(edges, n)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each end of ``edges`` (a, b).

    By contraction: each node hooks on to its neighbour with the smallest hash, if that is below its own, and
    on to what that one hooks on to; links between what is left, without loops and repeats, are the next
    round's. So the tables shrink by a factor each round, whatever the shape; they are deleted at the end.
    """
    with scratch(edges.sparkSession, "components") as keep:
        links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links, steps = cut(links, "links"), []
        while not links.isEmpty():
            rank = lambda c: F.xxhash64(c, F.lit(len(steps)))  # noqa: B023, E731
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), "b")).alias("m"))
            hook = cut(least.select("a", F.when(F.col("m.h") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("p")), "hooks")
            step = cut(hook.join(hook.select(F.col("a").alias("p"), F.col("p").alias("to")), "p").select("a", "to"), "step")
            steps.append(step)
            moved = links.join(step.select("a", F.col("to").alias("u")), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("v")), "b")
            links = cut(moved.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links")
        if not steps:
            return keep(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
        found = steps.pop()
        while steps:
            found = steps.pop().join(found.select(F.col("a").alias("to"), F.col("to").alias("last")), "to", "left").select("a", F.coalesce("last", "to").alias("to"))
        found = cut(found, "found")
        smallest = cut(found.groupBy("to").agg(F.min("a").alias("root")), "roots")
        return keep(found.join(smallest, "to").select(F.col("a").alias("node"), "root"), "components")


def surface_forms(nodes: DataFrame, least: int = 2) -> DataFrame:
    """``id`` and ``form``: every way a node's name may be written, in lower case."""
    return nodes.select("id", F.explode(T.name_variants(F.col("name"))).alias("v")).select("id", F.lower(F.btrim("v")).alias("form")).filter(F.length("form") >= least).distinct()


def resolve_entities(nodes: DataFrame) -> DataFrame:
    """GRF-12: ``id`` and ``canonical``: nodes that share a surface form are one entity, named by the node with most papers, then by id."""
    forms = cut(surface_forms(nodes), "forms")
    first = forms.groupBy("form").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    linked = components(forms.join(first, "form").select(F.col("id").alias("a"), "b").filter("a <> b"))
    sized = linked.join(nodes.select(F.col("id").alias("node"), F.coalesce(F.size("papers"), F.lit(0)).alias("n")), "node")
    best = sized.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), "node"))["node"].alias("canonical"))
    alias = cut(linked.join(best, "root").select(F.col("node").alias("id"), "canonical"), "alias")
    return nodes.select("id").join(alias, "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))


def collapse(nodes: DataFrame, alias: DataFrame) -> DataFrame:
    """GRF-13: one row per entity: papers united, aliases listed, the longest name as its label."""
    rows = nodes.join(alias, "id")
    longest = F.max(F.struct(F.length("name").alias("n"), (F.col("id") == F.col("canonical")).alias("own"), "name"))["name"]
    own = F.max(F.when(F.col("id") == F.col("canonical"), F.col("type")))
    return rows.groupBy(F.col("canonical").alias("id")).agg(longest.alias("name"), own.alias("type"), union_all("papers").alias("papers"), F.array_sort(F.collect_set("name")).alias("aliases"))


def canonical_edges(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """GRF-14: edges between entities, without structural ones and loops; of equal ones the first keeps its papers.

    First means by source, target before the collapse."""
    a = lambda end, out: alias.select(F.col("id").alias(end), F.col("canonical").alias(out))
    rows = edges.filter(~F.coalesce("type", F.lit("RELATED_TO")).isin(STRUCTURAL)).join(a("source", "s"), "source").join(a("target", "t"), "target").filter("s <> t")
    first = F.min_by("papers", F.struct("source", "target"))
    return rows.groupBy(F.col("s").alias("source"), F.col("t").alias("target"), F.coalesce("type", F.lit("RELATED_TO")).alias("type")).agg(first.alias("papers"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Two rows per edge: ``id``, ``other``, ``type``, ``papers``, ``direction``."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "type", "papers", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "type", "papers", F.lit("in").alias("direction")))


def degrees(adjacent: DataFrame) -> DataFrame:
    """GRF-15: parallel relations and both directions count; the hub weight falls with the degree."""
    return adjacent.groupBy("id").agg(F.count("*").alias("degree")).withColumn("hub_weight", 1 / F.log2(F.col("degree") + 2))
