"""URL rules met by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules as host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BROADCAST_RULES = 10_000
PREFIX_DIGITS = 8  # of a digest, met by the join; the rest is compared afterwards


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host ends at ``/``, ``?`` or ``#`` and has A-Z in lower case; without ``://`` both are empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def lower_ascii(col: Column) -> Column:
    return F.translate(col, ascii_uppercase, ascii_lowercase)


def directory(path: Column) -> Column:
    """A path up to its last slash, that included."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def how_many(col: Column, what: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(what), F.lit("")))


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Every host suffix of at most ``labels`` labels with every path prefix that ends at one of the first ``slashes`` slashes, and with none."""
    head = lambda text, mark, n: F.call_function("substring_index", text, F.lit(mark), n)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), how_many(host, ".") + 1)), lambda i: head(host, ".", -i))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.lit(slashes), how_many(path, "/"))), lambda i: F.when(i == 0, "").otherwise(F.concat(head(path, "/", i), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and the hosts below it where
    the url's path starts with the rule's. The longest fit (host and path together) wins, then the
    longer host, then ``block``. Without a fit ``rule`` is null and the verdict is ``default``. A null
    url or one without ``://`` has an empty host and path. Repeated rows come back as often as they
    are; an empty table gives an empty result; other columns are ignored.

    Each url is expanded into expressions that meet the rules on a short prefix of a digest; the
    full digest and the whole path are then compared. Up to ``BROADCAST_RULES`` rules (counted) go to all tasks, more
    are joined by shuffle. No rule can fit an expression with more labels
    or slashes than any rule has, so a url of any length gives few. What fits is reduced per row as a
    maximum, partly before the shuffle, so that a host with most pages is no burden.
    """
    digest = lambda x: F.sha2(x, 256)
    host, path = url_parts(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    deep = rules.agg(F.max(how_many(F.col("host"), ".") + 1).alias("labels"), F.max(how_many(F.col("path"), "/")).alias("slashes"), F.count("*").alias("n")).first()
    own = F.array_distinct(expressions(F.col("host"), F.col("path"), deep["labels"] or 1, deep["slashes"] or 0))
    keyed = base.select("*", F.explode(own).alias("_x")).withColumn("_digest", digest(F.col("_x"))).drop("_x")
    keyed = keyed.withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    known = rules.select(lower_ascii(F.col("host")).alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    known = known.withColumn("_full", digest(F.concat("_host", F.lit("\n"), directory(F.col("_path"))))).withColumn("_prefix", F.substring("_full", 1, PREFIX_DIGITS))
    met = keyed.join(F.broadcast(known) if deep["n"] <= BROADCAST_RULES else known, "_prefix")
    fit = F.struct((F.length("_host") + F.length("_path")).alias("n"), F.length("_host").alias("h"), F.col("_verdict").alias("verdict"), F.concat("_host", "_path").alias("rule"))
    met = met.filter((F.col("_digest") == F.col("_full")) & F.col("path").startswith(F.col("_path"))).select("page_id", "host", "path", fit.alias("_fit"), F.lit(0).alias("_row"))
    every = base.select("page_id", "host", "path", F.lit(None).cast(met.schema["_fit"].dataType).alias("_fit"), F.lit(1).alias("_row")).unionByName(met)
    per_page = every.groupBy("page_id", "host", "path").agg(F.max("_fit").alias("_fit"), F.sum("_row").alias("_rows"))
    once = F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int"))).alias("_copy")
    return per_page.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", F.lit(default)).alias("verdict"), once).drop("_copy")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
