"""Stored benchmarks: every snapshot can be opened again, and a new one only costs what has changed.

Parts of different makes never meet, so a benchmark falls into blocks of makes.  A
block is stored under the settings and a fingerprint of its lines; a snapshot is a
list of blocks.  Saving a snapshot groups and writes only blocks that no earlier
snapshot holds in the same state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricebench.config import MatchConfig
from pricebench.operators.clusters import build_clusters
from pricebench.operators.fingerprint import snapshot_id
from pricebench.operators.grouping import assign_clusters
from pricebench.session import cut_lineage

#: Blocks of makes: the most folders and list entries of a snapshot.
BLOCKS = 256
#: What the statistics of a part follow from, besides its make; ``seq`` because groups follow the order of lines.
_FIELDS = ("seq", "make", "model", "cat", "grade", "unit_basis", "part_name", "part_number", "npn", "supplier", "unit", "bill_dt", "ltype", "review")


def block_of(make: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(make, F.lit(""))), F.lit(BLOCKS)).cast("int")


def require_blocks(cfg: MatchConfig) -> None:
    """Only groups that keep makes apart can be worked out block by block."""
    if not cfg.same_make or cfg.mode not in ("fuzzy-name", "category"):
        raise ValueError("snapshots need same_make and a mode that groups within a make")
    if cfg.half_life_months is not None or cfg.window_months is not None or cfg.ex_gst:
        raise ValueError("snapshots store plain benchmarks; see recency and tax")


def block_fingerprints(lines: DataFrame) -> DataFrame:
    """(block, fingerprint), equal for equal lines of a block however they are spread; one small row per task and block."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in _FIELDS])
    hashed = lines.select(block_of(F.col("make")).alias("block"), F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    sums = hashed.groupBy("block").agg(F.count("*").alias("n"), F.sum("h").alias("s"))
    return sums.select("block", F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256), 1, 16).alias("fingerprint"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _kept_blocks(spark: SparkSession, root: str, cfg: MatchConfig) -> DataFrame:
    """(block, fingerprint) of the blocks that snapshots of these settings list; a block is listed after it is written."""
    lists = _stored(spark, f"{root}/snapshots")
    if lists is None:
        return spark.createDataFrame([], "block int, fingerprint string")
    return lists.where(F.col("config") == cfg.fingerprint()).select("block", "fingerprint").distinct()


def save_snapshot(lines: DataFrame, cfg: MatchConfig, root: str) -> tuple[str, list[int]]:
    """Stores the benchmark of ``lines``; returns its snapshot id and the blocks that had to be worked out.

    A run that is lost before its list is written leaves blocks that no snapshot
    lists; the next run writes them again.  Saving an equal state changes nothing.
    """
    require_blocks(cfg)
    spark = lines.sparkSession
    name = snapshot_id(lines, cfg).first()[0]
    prints = cut_lineage(block_fingerprints(lines))  # at most BLOCKS rows
    changed = cut_lineage(prints.join(_kept_blocks(spark, root, cfg), ["block", "fingerprint"], "left_anti"))
    todo = sorted(r["block"] for r in changed.collect())
    if todo:
        # The states of at most BLOCKS blocks are known here, so lines of other blocks are not even read beyond their make.
        rows = lines.where(block_of(F.col("make")).isin(todo))
        clusters = build_clusters(assign_clusters(rows, cfg), cfg).withColumn("block", block_of(F.col("make")))
        clusters = clusters.join(F.broadcast(changed), "block").withColumn("config", F.lit(cfg.fingerprint()))
        clusters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "block", "fingerprint").parquet(f"{root}/blocks")
    listed = prints.withColumns({"config": F.lit(cfg.fingerprint()), "snapshot": F.lit(name)})
    listed.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(f"{root}/snapshots")
    return name, todo


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot, config, blocks) of what is stored."""
    lists = _stored(spark, f"{root}/snapshots")
    if lists is None:
        return spark.createDataFrame([], "snapshot string, config string, blocks long")
    return lists.groupBy("snapshot", "config").agg(F.count("*").alias("blocks"))


def load_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The benchmark as it was saved; an unknown name is an error.  Only the folders of its blocks are read."""
    lists = _stored(spark, f"{root}/snapshots")
    wanted = None if lists is None else lists.where(F.col("snapshot") == name).select("config", "block", "fingerprint")
    if wanted is None or not wanted.limit(1).count():
        raise ValueError(f"no snapshot {name}")
    blocks = _stored(spark, f"{root}/blocks")
    if blocks is None:  # all its blocks are without a usable line
        raise ValueError(f"snapshot {name} has no parts")
    return blocks.join(F.broadcast(wanted), ["config", "block", "fingerprint"]).drop("config", "block", "fingerprint")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parts by key whose quotes or median differ between two snapshots; keys that repeat are told apart by their order."""
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("cluster_order")
    rows = [c.withColumn("nth", F.row_number().over(order)).select("key", "nth", F.col("n").alias(f"n_{w}"), F.col("med").alias(f"med_{w}")) for c, w in ((before, "before"), (after, "after"))]
    both = rows[0].join(rows[1], ["key", "nth"], "full")
    return both.where(~F.col("n_before").eqNullSafe(F.col("n_after")) | ~F.col("med_before").eqNullSafe(F.col("med_after")))
