"""Sources, sinks and schema evolution (SRC-*, SNK-*, EVO-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import STYLES, family
from corpusloom.storage import cut


def scan_binaries(spark: SparkSession, path: str, max_mb: float = 50, magic: bytes = b"%PDF-") -> DataFrame:
    """SRC-1: files with what is wrong with them, null for accepted ones.

    Spark's file sources leave empty files out, so these come from the listing of the folder.
    """
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") > max_mb * 1024 * 1024, "too large").when(F.substring("content", 1, len(magic)) != F.lit(magic), "wrong type")
    out = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", reason.alias("reason"), F.sha2("content", 256).alias("content_hash"), "content")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, False)
    empty = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0 and status.getPath().getName()[0] not in "_.":  # Spark reads no hidden files either
            empty.append((status.getPath().getName(), 0, "empty file", None, None))
    return out.unionByName(spark.createDataFrame(empty, out.schema)) if empty else out


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-2"""
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SRC-3: edges carry their identity."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.withColumn("edge_key", F.concat_ws("|", "source", "type", "target")).write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").drop("edge_key")


def matrix_to_csv(matrix: DataFrame, titles: DataFrame, columns: list[tuple[str, str]], path: str) -> None:
    """SNK-1: one line per paper under ``Paper`` and the columns' names; lists are joined by semicolons."""
    plain = lambda c: F.array_join(c, "; ") if isinstance(matrix.schema[c].dataType, T.ArrayType) else F.col(c)
    out = matrix.join(titles, "paper_id").select(F.col("title").alias("Paper"), *(plain(key).alias(name) for key, name in columns))
    out.write.mode("overwrite").option("header", "true").csv(path)


def citations(papers: DataFrame, style: str, group: str | None = None) -> DataFrame:
    """CIT-1 … CIT-5 for all papers, by first author and year; IEEE numbers them within ``group``."""
    if style not in STYLES:
        raise ValueError(f"unknown citation style {style!r}; choose from {', '.join(STYLES)}")
    names = ("title", "authors", "year", "venue", "doi", "keywords", "abstract")
    none = {"authors": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>")}
    p = {n: F.coalesce(F.col(n), none[n]) if n in none and n in papers.columns else F.col(n) if n in papers.columns else none.get(n, F.lit(None).cast("string")) for n in names}
    line = STYLES[style](p)
    first = F.lower(F.coalesce(family(F.get(p["authors"], F.lit(0))), F.lit("")))
    rows = papers.withColumn("first_author", first)
    if style == "ieee" and group:
        n = F.row_number().over(W.partitionBy(group).orderBy("first_author", F.coalesce("year", F.lit(0)), "paper_id"))
        return rows.withColumn("number", n).withColumn("citation", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), line))
    return rows.withColumn("citation", line)


def write_bibliography(papers: DataFrame, style: str, path: str) -> None:
    """SNK-2: a text of all citations in order, range-partitioned so that no task sorts them all."""
    rows = citations(papers, style).orderBy("first_author", F.coalesce("year", F.lit(0)), "paper_id")
    rows.select(F.concat("citation", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def replace_by_key(target: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """SNK-3: the target with all rows of the fresh keys replaced; doing it again changes nothing."""
    return target.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def run_status(error: Column, errors: Column) -> Column:
    """SNK-4"""
    return F.when(error.isNotNull(), "failed").when(F.size(errors) > 0, "partial").otherwise("completed")


def append_runs(runs: DataFrame, path: str) -> None:
    """SNK-4: audit rows are only ever added."""
    runs.withColumn("status", run_status(F.col("error"), F.col("errors"))).write.mode("append").parquet(path)


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "paper_id") -> dict[str, DataFrame]:
    """SNK-5: every table without the rows of some papers; the graph has ``graph.remove_papers``."""
    gone = cut(ids.select(key).distinct(), "gone")
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    """EVO-1: absent columns are added, nulls take the default; doing it again changes nothing."""
    out = []
    for f in schema.fields:
        col = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(col, defaults[f.name].cast(f.dataType)) if f.name in defaults else col).alias(f.name))
    return df.select(*out, *(c for c in df.columns if c not in schema.names))
