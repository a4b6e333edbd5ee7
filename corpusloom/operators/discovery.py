"""Implied connections, facts for questions, and works that a corpus lacks (GRF-16 … GRF-27, DSC-*, SRC-4/5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators.titles import likest_titles
from corpusloom.storage import cut, scratch

# Words that alone name no entity.
STOP_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have how i if in into is it its may might must of on or should "
    "than that the their then there these they this those to use used uses using was we were what when where which while who why will with "
    "would you your about across after also any because before between both during each more most other over same some such only own very"
).split()


#: Links of an intermediate beyond which its links are dealt over several keys.
HUB_LINKS = 10_000
#: Pairs of a source and what it reaches that one task makes.
PAIRS = 1_000_000


def entity_table(nodes: DataFrame, types: list[str] = G.SCIENTIFIC, merge_aliases: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entities, and which one each node is: GRF-12 and 13 as written tables."""
    with scratch(nodes.sparkSession, "entity-table") as keep:
        raw = cut(nodes.filter(F.col("type").isin(types) & (F.col("name") != "")), "raw")
        alias = G.resolve_entities(raw) if merge_aliases else raw.select("id", F.col("id").alias("canonical"))
        alias = keep(alias, "alias")
        return keep(G.collapse(raw, alias), "entities"), alias


def entity_graph(nodes: DataFrame, edges: DataFrame, types: list[str] = G.SCIENTIFIC, merge_aliases: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entities and their adjacency, ready for the operators below: GRF-12, 13, 14 in turn, as written tables."""
    entities, alias = entity_table(nodes, types, merge_aliases)
    with scratch(nodes.sparkSession, "entity-graph") as keep:
        return entities, keep(G.adjacency(cut(G.canonical_edges(edges, alias), "canonical")), "adjacent")


def containing(terms: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """``low``, ``id``, ``name`` of the names (``id``, ``name``, lower case) that contain a term (``low``).

    A term meets names on the rarest of its runs of ``gram`` characters, so it is compared with those names only;
    a shorter term is a run of its own length.
    """
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))
    out = None
    for n in range(1, gram + 1):
        own = cut(terms.filter(F.length("low") >= n if n == gram else F.length("low") == n).select("low", F.explode(runs(F.col("low"), n)).alias("g")), "runs")
        if n < gram and own.isEmpty():
            continue
        held = names.filter(F.length("name") >= n).select("id", "name", F.explode(runs(F.col("name"), n)).alias("g"))
        held = cut(held.join(own.select("g").distinct(), "g", "left_semi"), "held")
        counts = held.groupBy("g").agg(F.count("*").alias("n"))
        # a run that no name has rules its term out
        rarest = own.join(counts, "g", "left").groupBy("low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).filter("r.n > 0").select("low", "r.g")
        met = rarest.join(held, "g").filter(F.contains("name", "low")).select("low", "id", "name")
        out = met if out is None else out.unionByName(met)
    return out


def resolve_terms(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """GRF-16: ``term`` → ``id``: the id itself, else the exact name, else the shortest name that contains the term."""
    t = cut(terms.select("term", F.lower(F.btrim("term")).alias("low")).filter("low <> ''").distinct(), "terms")
    names = entities.select("id", F.lower("name").alias("name"))
    by_id = t.join(entities.select("id"), F.col("low") == F.col("id")).select("term", "id", F.lit(0).alias("how"))
    by_name = t.join(names.select("id", F.btrim("name").alias("low")), "low").select("term", "id", F.lit(1).alias("how"))
    exact = cut(by_id.unionByName(by_name).groupBy("term").agg(F.min_by("id", F.struct("how", "id")).alias("id")), "exact")
    rest = cut(t.join(exact, "term", "left_anti"), "rest")
    if rest.isEmpty():
        return exact
    inside = containing(rest.select("low").distinct(), names).groupBy("low").agg(F.min_by("id", F.struct(F.length("name"), "id")).alias("id"))
    return exact.unionByName(rest.join(inside, "low").select("term", "id"))


def numbered(entities: DataFrame) -> DataFrame:
    """``id`` and ``code`` of the entities; the numbers ascend with name and id."""
    return cut(entities.select("id", "name").orderBy("name", "id").select("id", F.monotonically_increasing_id().alias("code")), "codes")


def implied(sources: DataFrame, entities: DataFrame, adjacent: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a``, ``c``, ``n_links``, ``score``, ``support``, ``linked``, ``shares``: what each source reaches over one intermediate; and the links.

    ``n_links`` counts pairs of relations, ``support`` distinct intermediates, ``score`` sums their hub weights.
    Entities are the numbers of ``codes``. What an intermediate is linked to lies in lists of at most ``HUB_LINKS``
    numbers, and so do the source's own links and those it shares a paper with. The lists, not the pairs, are
    dealt by source; pairs are made and summed where they arrive. A source with more than ``PAIRS`` is dealt in slices of ``c``.
    """
    number = lambda c, out: codes.select(F.col("id").alias(c), F.col("code").alias(out))
    a = cut(sources.select("id").distinct().join(number("id", "a"), "id").select("a"), "sources")
    ends = adjacent.select("id", "other").join(number("id", "b"), "id").join(number("other", "c"), "other")
    links = cut(ends.groupBy("b", "c").agg(F.count("*").alias("n")), "links")
    hubs = links.groupBy("b").agg(F.sum("n").alias("degree"), F.count("*").alias("others"), F.ceil(F.count("*") / HUB_LINKS).cast("int").alias("deals"))
    hubs = cut(hubs.withColumn("w", 1 / F.log2(F.col("degree") + 2)), "hubs")
    deal = F.pmod(F.xxhash64("c"), F.col("deals")).cast("int")
    lists = cut(links.join(hubs.select("b", "deals"), "b").groupBy("b", deal.alias("deal"), "n").agg(F.collect_list("c").alias("cs")), "lists")
    a_b = cut(a.join(links.select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("n").alias("n_a")), "a").join(hubs, "b"), "a_b")
    slices = cut(a_b.groupBy("a").agg(F.sum("others").alias("pairs")).withColumn("slices", F.ceil(F.col("pairs") / PAIRS).cast("int")), "slices")
    pairs = slices.agg(F.sum("pairs")).first()[0] or 0
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    listed = lambda df, n, w, kind, cs: df.select("a", "b", n.cast("long").alias("n"), w.cast("double").alias("w"), F.lit(kind).alias("kind"), cs.alias("cs"))
    none = F.lit(0)
    over = a_b.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).join(lists, ["b", "deal"])
    papers = entities.join(codes, "id").select("code", F.explode("papers").alias("paper"))
    wrote = cut(papers.join(a, F.col("code") == F.col("a")).select("a", "paper"), "wrote")
    shared = wrote.join(papers, "paper").withColumn("b", F.col("a"))
    every = listed(over, F.col("n_a") * F.col("n"), F.col("w"), 0, F.col("cs")).unionByName(listed(lists.join(a, F.col("b") == F.col("a")), none, none, 1, F.col("cs"))).unionByName(listed(shared, none, none, 2, F.array("code")))
    part = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    own = F.filter("cs", lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.col("slices")) == F.col("slice"))
    every = every.join(slices.select("a", "slices"), "a").withColumn("slice", part).withColumn("cs", F.when(F.col("slices") > 1, own).otherwise(F.col("cs")))
    met = every.repartition(tasks, "a", "slice").select("a", "slice", "b", "n", "w", "kind", F.explode("cs").alias("c")).filter("c <> a AND c <> b")
    out = met.groupBy("a", "slice", "c").agg(F.sum("n").alias("n_links"), F.sum("w").alias("score"), F.count_if(F.col("kind") == 0).alias("support"), F.max(F.col("kind") == 1).alias("linked"), F.max(F.col("kind") == 2).alias("shares"))
    return out.filter("support > 0").drop("slice"), links


def open_discovery(sources: DataFrame, entities: DataFrame, adjacent: DataFrame, limit: int = 25, min_support: int = 1, disjoint: bool = True) -> DataFrame:
    """GRF-17: for each source entity the entities it is connected to only through others.

    The score is the sum over distinct intermediates of their hub weights, the support their number. Chains,
    which are looked up for the best ``limit`` only, come by weight, then intermediate and relations.
    """
    with scratch(entities.sparkSession, "open") as keep:
        codes = numbered(entities)
        found, links = implied(sources, entities, adjacent, codes)
        found = found.filter("NOT linked").filter(F.lit(not disjoint) | ~F.col("shares")).filter(F.col("support") >= min_support)
        place = F.row_number().over(W.partitionBy("a").orderBy(F.col("score").desc(), F.col("support").desc(), "c"))  # numbers go by name and id
        top = cut(found.select("a", "c", F.round("score", 6).alias("score"), "support").withColumn("place", place).filter(F.col("place") <= limit), "top")
        own = entities.select("id", "name", "type", F.size("papers").alias("n")).join(codes, "id")
        of = lambda end, *columns: own.select(F.col("code").alias(end), F.col("id").alias(f"{end}_id"), *(F.col(k).alias(f"{end}_{out}") for k, out in columns))
        ab = top.select("a", "c").join(links.select(F.col("b").alias("a"), F.col("c").alias("b")), "a").join(links.select("b", "c"), ["b", "c"], "left_semi").filter("b <> a AND b <> c")
        best = cut(top.join(of("c", ("name", "name"), ("type", "type"), ("n", "count")), "c").join(of("a", ("name", "name"), ("n", "count")), "a"), "best")
        weights = links.groupBy("b").agg(F.sum("n").alias("degree")).select("b", (1 / F.log2(F.col("degree") + 2)).alias("w"))
        ab = cut(ab.join(best.select("a", "c", "a_id", "c_id"), ["a", "c"]).join(of("b", ("name", "name"), ("type", "type")), "b").join(weights, "b").drop("a", "b", "c"), "chains")
        sorted_ = F.array_sort("papers")
        to_b = adjacent.select(F.col("id").alias("a_id"), F.col("other").alias("b_id"), F.col("type").alias("a_to_b"), sorted_.alias("a_papers"))
        to_c = adjacent.select(F.col("id").alias("b_id"), F.col("other").alias("c_id"), F.col("type").alias("b_to_c"), sorted_.alias("c_papers"))
        rows = cut(ab.join(to_b, ["a_id", "b_id"]), "to-b").join(to_c, ["b_id", "c_id"])
        per_b = rows.groupBy("a_id", "c_id", "b_id", "b_name", "b_type", "w").agg(F.array_sort(F.collect_list(F.struct("a_to_b", "b_to_c", "a_papers", "c_papers"))).alias("links")).withColumnRenamed("b_id", "b")
        chains = per_b.groupBy("a_id", "c_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("order"), "b", "b_name", "b_type", "w", "links"))).alias("chains"))
        out = best.drop("a", "c").join(chains, ["a_id", "c_id"]).withColumnsRenamed({"a_id": "a", "c_id": "c"})
        return keep(out, "discovery")


def open_diagnostics(sources: DataFrame, entities: DataFrame, adjacent: DataFrame, disjoint: bool = True) -> DataFrame:
    """GRF-18: how many chains were examined and why they were rejected, and a reason where nothing was found."""
    with scratch(entities.sparkSession, "diagnostics") as keep:
        codes = numbered(entities)
        rows, _ = implied(sources, entities, adjacent, codes)
        good = F.lit(True) if not disjoint else ~F.col("shares")
        total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n_links"))), F.lit(0))
        counts = rows.groupBy("a").agg(
            F.sum("n_links").alias("c_examined"), total(F.col("linked")).alias("rejected_already_linked"), total(~F.col("linked") & ~good).alias("rejected_shared_paper"),
            F.count_if(~F.col("linked") & good).alias("candidates_found"),
        )
        counts = keep(counts.withColumnRenamed("a", "code").join(codes, "code").drop("code").withColumnRenamed("id", "a"), "counts")
    b_terms = adjacent.groupBy(F.col("id").alias("a")).agg(F.count("*").alias("b_terms"))
    n = entities.agg(F.count("*").alias("entities"))
    out = sources.select(F.col("id").alias("a")).distinct().join(b_terms, "a", "left").join(counts, "a", "left").crossJoin(F.broadcast(n))
    zero = [c for c in ("b_terms", "c_examined", "rejected_already_linked", "rejected_shared_paper", "candidates_found")]
    reason = F.when(F.col("b_terms") == 0, "no connections").when(F.col("candidates_found") == 0, "every chain was rejected")
    return out.fillna(0, zero).withColumn("reason", reason)


def closed_discovery(pairs: DataFrame, entities: DataFrame, adjacent: DataFrame) -> DataFrame:
    """GRF-19: the intermediates between given entities ``a`` and ``c``; of parallel A-B relations the last by name counts.

    Only the links, papers and degrees of entities that are asked for, or found, are grouped and joined.
    """
    with scratch(entities.sparkSession, "closed") as keep:
        among = lambda df, key, some: df.join(some.toDF(key).distinct(), key, "left_semi")
        asked = cut(pairs.select("a", "c"), "asked")
        by_a, by_c = (cut(among(adjacent, "id", asked.select(end)), f"by-{end}") for end in ("a", "c"))
        last = by_a.groupBy(F.col("id").alias("a"), F.col("other").alias("b")).agg(F.max_by(F.struct(F.col("type").alias("a_to_b"), F.array_sort("papers").alias("a_papers")), F.struct("type", "direction")).alias("x"))
        to_c = by_c.select(F.col("id").alias("c"), F.col("other").alias("b"), F.col("type").alias("b_to_c"), F.array_sort("papers").alias("c_papers"))
        rows = cut(asked.join(last, "a").join(to_c, ["c", "b"]).filter("b <> a AND b <> c"), "rows")
        found = cut(rows.select("b").distinct(), "found")
        weights = G.degrees(among(adjacent.select("id"), "id", found)).select(F.col("id").alias("b"), F.round("hub_weight", 6).alias("weight"))
        own = entities.select("id", "papers")
        stated = by_a.select(F.col("id").alias("a"), F.col("other").alias("c")).distinct().withColumn("linked", F.lit(True))
        rows = rows.join(weights, "b").join(among(entities.select("id", "name"), "id", found).select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b").join(stated, ["a", "c"], "left")
        rows = rows.join(among(own, "id", asked.select("a")).select(F.col("id").alias("a"), F.col("papers").alias("pa")), "a").join(among(own, "id", asked.select("c")).select(F.col("id").alias("c"), F.col("papers").alias("pc")), "c")
        return keep(rows.select("a", "c", "b", "b_name", "x.a_to_b", "b_to_c", "x.a_papers", "c_papers", "weight", F.coalesce("linked", F.lit(False)).alias("already_linked"), F.array_sort(F.array_intersect("pa", "pc")).alias("shared_papers")), "closed")


def start_terms(entities: DataFrame, adjacent: DataFrame, limit: int = 40) -> DataFrame:
    """GRF-20"""
    rows = entities.join(G.degrees(adjacent), "id").select("id", "name", "type", "degree", F.size("papers").alias("n_papers"))
    return rows.orderBy(F.col("degree").desc(), "name", "id").limit(limit)


def question_terms(questions: DataFrame, id_col: str, text_col: str, most: int = 4) -> DataFrame:
    """GRF-21: word n-grams that may name an entity, longest first: ``n_words``, ``place``, ``term``."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([A-Za-z0-9][A-Za-z0-9\-/+.]*)"), F.lit(1))
    rows = questions.select(id_col, words.alias("w")).select(id_col, "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w")))).alias("n_words")).filter(F.size("w") > 0)
    rows = rows.select(id_col, "w", "n_words", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n_words"))).alias("place"))
    rows = rows.select(id_col, "n_words", "place", F.array_join(F.slice("w", F.col("place") + 1, F.col("n_words")), " ").alias("term"))
    return rows.filter((F.length("term") >= 3) & ~((F.col("n_words") == 1) & F.lower("term").isin(STOP_WORDS)))


def link_entities(questions: DataFrame, nodes: DataFrame, id_col: str, text_col: str, most: int = 6, similar: DataFrame | None = None, floor: float = 0.55) -> DataFrame:
    """GRF-22: entities that a question names: longer matches are surer. ``similar`` (question, id, score) may add
    entities by vectors where places are left. Of nodes with one surface form the smallest id is meant."""
    forms = G.surface_forms(nodes.filter(~F.col("type").isin(G.NON_FACTUAL)), 3).groupBy("form").agg(F.min("id").alias("id"))
    terms = question_terms(questions, id_col, text_col).withColumn("form", F.lower("term"))
    met = terms.join(forms, "form").join(nodes.select("id", "name", "type"), "id")
    first = F.min_by(F.struct("form", "n_words"), F.struct((-F.col("n_words")).alias("n"), "place"))
    found = met.groupBy(id_col, "id", "name", "type").agg(first.alias("m"))
    sure = F.round(F.least(F.lit(1.0), 0.75 + 0.05 * F.col("m.n_words")), 3)
    found = found.select(id_col, "id", "name", "type", sure.alias("confidence"), F.when(F.col("m.form") == F.lower(F.btrim("name")), "exact").otherwise("alias").alias("method"))
    if similar is not None:
        extra = similar.filter(F.col("score") >= floor).join(found, [id_col, "id"], "left_anti").join(nodes.select("id", "name", "type"), "id")
        found = found.unionByName(extra.select(id_col, "id", "name", "type", F.round("score", 3).alias("confidence"), F.lit("embedding").alias("method")))
    place = F.row_number().over(W.partitionBy(id_col).orderBy(F.col("confidence").desc(), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= most)


def expand_facts(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str, hops: int = 2, most: int = 60) -> DataFrame:
    """GRF-23: the facts within ``hops`` of each question's seeds, nearest first, under canonical names.

    ``seeds``: question, ``id``. One round of joins per hop for all questions together.
    """
    alias = cut(G.resolve_entities(nodes.filter(~F.col("type").isin(G.NON_FACTUAL))), "alias")
    names = nodes.select("id", "name").join(alias, "id", "left").withColumn("c", F.coalesce("canonical", "id"))
    label = names.groupBy("c").agg(F.max(F.struct(F.length("name").alias("n"), "name"))["name"].alias("label"))
    ids = names.select("id", "c")
    rows = edges.filter(~F.col("type").isin(G.STRUCTURAL)).join(ids.select(F.col("id").alias("source"), F.col("c").alias("s")), "source").join(ids.select(F.col("id").alias("target"), F.col("c").alias("t")), "target").filter("s <> t")
    evidence = F.substring(F.coalesce("evidence", F.lit("")), 1, 200) if "evidence" in edges.columns else F.lit("")
    facts = cut(rows.select("s", "t", "type", F.array_sort("papers").alias("papers"), evidence.alias("evidence"), "source", "target").groupBy("s", "t", "type").agg(F.min_by(F.struct("papers", "evidence"), F.struct("source", "target")).alias("f")), "facts")
    both = facts.select(F.col("s").alias("c"), F.col("t").alias("other"), "s", "t", "type").unionByName(facts.select(F.col("t").alias("c"), F.col("s").alias("other"), "s", "t", "type"))
    seen = frontier = seeds.select(id_col, "id").join(ids, "id").select(id_col, "c").distinct()
    out = None
    for hop in range(1, hops + 1):
        step = cut(frontier.join(both, "c"), "step")
        own = step.select(id_col, "s", "t", "type").distinct().withColumn("hops", F.lit(hop))
        out = own if out is None else out.unionByName(own)
        frontier = step.select(id_col, F.col("other").alias("c")).distinct().join(seen, [id_col, "c"], "left_anti")
        seen = seen.unionByName(frontier)
    near = out.groupBy(id_col, "s", "t", "type").agg(F.min("hops").alias("hops"))
    place = F.row_number().over(W.partitionBy(id_col).orderBy("hops", "s", "t", "type"))
    near = near.withColumn("place", place).filter(F.col("place") <= most).join(facts, ["s", "t", "type"])
    names_of = lambda c, out: label.select(F.col("c").alias(c), F.col("label").alias(out))
    return near.join(names_of("s", "source"), "s").join(names_of("t", "target"), "t").select(id_col, "place", "source", F.col("type").alias("relation"), "target", "hops", "f.papers", "f.evidence")


def fact_line(number: Column, source: Column, relation: Column, target: Column, titles: Column, evidence: Column) -> Column:
    """GRF-24"""
    origin = F.when(F.size(titles) > 0, F.array_join(F.slice(titles, 1, 2), ", ")).otherwise("unattributed")
    quote = F.when(evidence != "", F.concat(F.lit(" — “"), evidence, F.lit("”"))).otherwise("")
    return F.concat(F.lit("[G"), number.cast("string"), F.lit("] "), source, F.lit(" "), F.lower(F.regexp_replace(relation, "_", " ")), F.lit(" "), target, F.lit(" (from: "), origin, F.lit(")"), quote)


def graph_retrieval(questions: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """GRF-25: how many facts each question has, or why it has none."""
    seeds = cut(link_entities(questions, nodes, id_col, text_col), "seeds")
    facts = expand_facts(seeds, nodes, edges, id_col).groupBy(id_col).agg(F.count("*").alias("n_facts"))
    linked = seeds.groupBy(id_col).agg(F.count("*").alias("n_seeds"))
    out = questions.select(id_col).join(linked, id_col, "left").join(facts, id_col, "left").fillna(0, ["n_seeds", "n_facts"])
    empty = nodes.isEmpty()
    reason = F.when(F.lit(empty), "the graph is empty").when(F.col("n_seeds") == 0, "no entity was named").when(F.col("n_facts") == 0, "the entities are isolated")
    return out.withColumn("reason", reason)


def rank_hypotheses(found: DataFrame, judged: DataFrame) -> DataFrame:
    """GRF-26: by verdict, then score; a missing or unknown verdict is plausible."""
    order = F.create_map(*[F.lit(x) for x in ("promising", 0, "plausible", 1, "trivial", 2, "implausible", 3)])
    rows = found.join(judged, ["a", "c"], "left")
    known = F.lower(F.btrim("verdict"))
    verdict = F.when(known.isin("promising", "plausible", "trivial", "implausible"), known).otherwise("plausible")
    rows = rows.withColumn("verdict", verdict)
    links = F.flatten(F.transform("chains", lambda x: F.flatten(F.transform(x["links"], lambda y: F.array_union(y["a_papers"], y["c_papers"])))))
    place = F.row_number().over(W.partitionBy("a").orderBy(order[F.col("verdict")], F.col("score").desc(), "c"))
    return rows.select("a", "c", "verdict", "score", place.alias("place"), F.array_sort(F.array_distinct(links)).alias("paper_ids"))


def chain_text(a_name: Column, chains: Column, c_name: Column, most: int = 5) -> Column:
    """GRF-27"""
    low = lambda r: F.lower(F.regexp_replace(r, "_", " "))
    lines = F.flatten(F.transform(chains, lambda x: F.transform(x["links"], lambda y: F.concat(a_name, F.lit(" —"), low(y["a_to_b"]), F.lit("→ "), x["b_name"], F.lit(" —"), low(y["b_to_c"]), F.lit("→ "), c_name))))
    return F.array_join(F.slice(lines, 1, most), "\n")


# --- works ---


def rebuild_text(index: Column, most: int = 4000) -> Column:
    """SRC-5: a text from its inverted index (word → positions)."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    text = F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " ")
    return T.or_null(F.substring(F.btrim(F.regexp_replace(text, r"\s+", " ")), 1, most))


def works_to_candidates(works: DataFrame, relation: str) -> DataFrame:
    """SRC-4: flat candidate rows of a works snapshot; untitled works are dropped."""
    names = F.filter(F.transform(F.coalesce("authorships", F.array()), lambda a: F.btrim(a["author"]["display_name"])), lambda n: F.coalesce(n != "", F.lit(False)))
    return works.filter(F.btrim("display_name") != "").select(
        F.element_at(F.split("id", "/"), -1).alias("external_id"), F.btrim("display_name").alias("title"), F.slice(names, 1, 25).alias("authors"), F.col("publication_year").alias("year"),
        F.col("primary_location.source.display_name").alias("venue"), T.or_null(F.regexp_replace("doi", "^https://doi.org/", "")).alias("doi"), rebuild_text(F.col("abstract_inverted_index")).alias("abstract"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.coalesce("best_oa_location.pdf_url", "best_oa_location.landing_page_url").alias("open_access_url"), F.lit(relation).alias("relation"),
    )


def title_key(title: Column) -> Column:
    """Letters and digits of a title; without any it is null and matches nothing."""
    return T.or_null(F.regexp_replace(F.lower(title), "[^a-z0-9]+", ""))


#: What a work is found by: rank, column, key.
KEYS = [(0, "doi", F.lower), (1, "title", title_key)]


def find_works(papers: DataFrame, works: DataFrame, least: float = 0.6) -> DataFrame:
    """DSC-2: a paper's work by DOI, else by title, else the work whose title's words are likest (``least`` or more); of several the smallest id.

    A key's first work is found before papers are joined, so works and papers that share a key in any number never meet as pairs.
    """
    number = F.struct(F.length("external_id").alias("n"), "external_id")
    asked = papers.select("paper_id", F.explode(F.array(*(F.struct(F.lit(how).alias("how"), key(F.col(c)).alias("k")) for how, c, key in KEYS))).alias("x")).select("paper_id", "x.*").filter("k is not null")
    held = works.select("external_id", F.explode(F.array(*(F.struct(F.lit(how).alias("how"), key(F.col(c)).alias("k")) for how, c, key in KEYS))).alias("x")).select("external_id", "x.*").filter("k is not null")
    first = cut(held.groupBy("how", "k").agg(F.min(number).alias("w")), "first")  # one work per key, however many share it
    met = asked.join(first, ["how", "k"]).groupBy("paper_id").agg(F.min(F.struct("how", "w")).alias("b"))
    found = met.select("paper_id", "b.w.external_id", F.when(F.col("b.how") == 0, "doi").otherwise("title").alias("matched_by"))
    found = cut(found, "found")
    rest = cut(papers.select("paper_id", "title").filter(title_key(F.col("title")).isNotNull()).join(found, "paper_id", "left_anti"), "rest")
    if rest.isEmpty():
        return found
    return found.unionByName(likest_titles(rest, works, least).select("paper_id", "external_id", F.lit("words").alias("matched_by")))


def related_works(papers: DataFrame, works: DataFrame, limit: int = 15) -> DataFrame:
    """DSC-1: the related and the referenced works of each paper's work, most cited first."""
    own = find_works(papers, works).join(works.select("external_id", "related_works", "referenced_works"), "external_id")
    ids = lambda col, relation: own.select("paper_id", F.explode(F.slice(col, 1, limit)).alias("work_id"), F.lit(relation).alias("relation")).distinct()
    every = ids("related_works", "related").unionByName(ids("referenced_works", "references"))
    rows = every.join(works.select(F.col("external_id").alias("work_id"), "title", "doi", "citations"), "work_id")
    place = F.row_number().over(W.partitionBy("paper_id").orderBy(F.col("citations").desc(), "title", "work_id", "relation"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def new_works(candidates: DataFrame, papers: DataFrame, order: list[Column]) -> DataFrame:
    """DSC-4: candidates that the corpus lacks by DOI and title; of equal titles the first by ``order``."""
    keyed = candidates.withColumn("_d", F.lower("doi")).withColumn("_t", title_key(F.col("title")))
    rest = keyed.join(papers.select(F.lower("doi").alias("_d")).distinct(), "_d", "left_anti")
    rest = rest.join(papers.select(title_key(F.col("title")).alias("_t")).distinct(), "_t", "left_anti")
    first = rest.groupBy(F.coalesce("_t", F.concat(F.lit("\0"), "external_id")).alias("_g")).agg(F.min_by(F.struct(*candidates.columns), F.struct(*order)).alias("x"))
    return first.select("x.*")


def missing_works(papers: DataFrame, works: DataFrame, corpus: DataFrame, limit: int = 20, asked: int = 12) -> DataFrame:
    """DSC-5: works that relate to most of the asked papers and that the corpus lacks."""
    some = papers.orderBy("paper_id").limit(asked)
    tally = related_works(some, works).groupBy(F.col("work_id").alias("external_id"), "title", "doi", "citations").agg(F.count("*").alias("referenced_by_corpus"))
    order = [(-F.col("referenced_by_corpus")).alias("a"), (-F.col("citations")).alias("b"), F.col("external_id").alias("c")]
    return new_works(tally, corpus, order).orderBy(F.col("referenced_by_corpus").desc(), F.col("citations").desc(), "external_id").limit(limit)
