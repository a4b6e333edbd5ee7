"""Tables written between the steps of a job.

A written table cuts the lineage: an executor that is lost later costs a re-read, not a
recomputation, and an aggregate that is read back can take part in a skew-split join.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()  # folder: where this thread's cut() writes; sets: the folder of each set


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder takes its place;
    on a cluster that is an error, since executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def table_set(spark: SparkSession, name: str) -> Iterator[None]:
    """What ``cut`` writes inside belongs to the set ``name``; the last set of that name is deleted first.

    For jobs whose steps write their results before the next step begins: entering the next step
    frees what the one before has left. Sets belong to the thread.
    """
    sets = _here.__dict__.setdefault("sets", {})
    if name in sets:
        delete(spark, sets.pop(name))
    outer = getattr(_here, "folder", None)
    _here.folder = sets[name] = f"{outer or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        _here.folder = outer


def drop_set(spark: SparkSession, name: str) -> None:
    """Delete what the set ``name`` of this thread holds."""
    if (folder := _here.__dict__.get("sets", {}).pop(name, None)) is not None:
        delete(spark, folder)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What ``cut`` writes inside is deleted at the end; what outlives it goes through the function given, a ``cut`` to the folder outside."""
    outer = getattr(_here, "folder", None)
    _here.folder = own = f"{outer or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str = "step") -> DataFrame:
        _here.folder = outer
        try:
            return cut(df, name)
        finally:
            _here.folder = own

    try:
        yield keep
    finally:
        _here.folder = outer
        delete(spark, own)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a job that begins inside go when it ends; else they stay until the driver happens to collect its garbage.

    For jobs that write their results: nothing reads a shuffle again after its job. The session's own setting comes back at the end.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: same rows, no lineage, and no shuffle files left of the job that wrote them."""
    spark = df.sparkSession
    path = f"{getattr(_here, 'folder', None) or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with short_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
