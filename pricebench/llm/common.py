"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricebench.session import cut_lineage

__all__ = ["beside_keys", "cut_lineage", "cut_sized", "key_columns", "released", "share_of", "text_batches", "with_key", "without_keys"]


#: Texts that are handed to Python at a time; the default of 10,000 would hold tens of megabytes, or gigabytes of long ones.
TEXTS_PER_BATCH = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands texts to Python in small batches, unless the deployment sets a size itself."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, str(TEXTS_PER_BATCH))
    return df


def released(function: Callable) -> Callable:
    """A partition function that gives back what its batches took.

    Python workers live on from task to task, and their allocators keep freed
    memory; several idle workers of an executor would each keep a task's worth.
    """

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library offers it
            ctypes.CDLL(None).malloc_trim(0)

    return run


#: Narrow rows that one task writes when a table's size is known.
ROWS_PER_TASK = 20_000


def cut_sized(df: DataFrame, rows: int) -> DataFrame:
    """``cut_lineage`` of a narrow table of at most ``rows`` rows, in as many tasks as they need: rounds on small tables stay short."""
    return cut_lineage(df.coalesce(max(1, -(-rows // ROWS_PER_TASK))))


def key_columns(*columns: str) -> tuple[Column, Column]:
    """A 128-bit content key as two longs; a null and an empty value differ."""
    parts = [x for c in columns for x in (F.isnull(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.xxhash64(F.lit(17), *parts), F.xxhash64(F.lit(71), *parts)


def with_key(df: DataFrame, *columns: str, names: tuple[str, str] = ("__k1", "__k2")) -> DataFrame:
    a, b = key_columns(*columns)
    return df.withColumns({names[0]: a, names[1]: b})


def share_of(hash64: Column, part: float) -> Column:
    """Whether a 64-bit hash is in the lowest ``part`` of its range; all 63 bits count, so small parts of large tables aren't empty."""
    return hash64.bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(min((1 << 63) - 1, int(part * (1 << 63)))) if part < 1 else F.lit(True)


#: Rejected keys up to which they are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 100_000
SALTS = 16


def without_keys(df: DataFrame, rejected: DataFrame, salt_by: Column) -> DataFrame:
    """``df`` without the rows whose key (__k1, __k2) is in ``rejected``.

    Thousands of copies share one key, so beyond the broadcast bound the rows
    are salted and the distinct rejected keys repeated once per salt.
    """
    rejected = rejected.select("__k1", "__k2").distinct()
    if rejected.count() <= BROADCAST_KEYS:
        return df.join(F.broadcast(rejected), ["__k1", "__k2"], "left_anti")
    salted = rejected.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).join(salted, ["__k1", "__k2", "__salt"], "left_anti").drop("__salt")


def beside_keys(df: DataFrame, table: DataFrame, salt_by: Column) -> DataFrame:
    """Left join of ``df`` with ``table``, which has one row per key (__k1, __k2).

    Salted on both sides, since thousands of copies share one key.  Both are
    shuffled whatever their size, so that the work grows in proportion.
    """
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = df.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return df.join(salted.hint("merge"), ["__k1", "__k2", "__salt"], "left").drop("__salt")
