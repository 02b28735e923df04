"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Spark's switch for removing a query's shuffle files when the query has ended.
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}
_scopes = threading.local()


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pricebench")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one is made up only in local mode."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pricebench-checkpoint-")
    return _local_dirs[app]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files: nothing but the write reads them."""
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP_KEY) if before is None else spark.conf.set(SHUFFLE_CLEANUP_KEY, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` stores inside, in this thread, are removed at the end: nothing that is used later may read them."""
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _store(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/pricebench/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder as a table and go on from there.

    Loops use this so that a lost executor re-reads files instead of re-running
    every earlier round; the table's real size also guides the next joins.
    """
    table, path = _store(df)
    scopes = _scopes.__dict__.get("open")
    if scopes:
        scopes[-1].append(path)
    return table


def only_result(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes, stored to stay; the tables it was made from are removed."""
    with scratch(spark):
        return _store(build())[0]


def cut_lineage_spread(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` in as many files as there are cores: for small tables whose few rows are then taken apart into many."""
    return cut_lineage(df.repartition(df.sparkSession.sparkContext.defaultParallelism))
