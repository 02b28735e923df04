"""A stored order of rows: dense numbers, whatever the values and counts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricebench.session import cut_lineage

_IN_PARTITION = (1 << 33) - 1


def stored_order(df: DataFrame, *order: str | Column, out: str = "seq") -> DataFrame:
    """``df`` stored with the position of each row in ``order``, from 0.

    One range shuffle; a row's number is its place in its partition plus the size
    of the partitions before it, of which there is one row each.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_.withColumns({
        "__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)),
    }))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").count()
    base = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    return placed.join(F.broadcast(base), "__part").withColumn(out, (F.col("__base") + F.col("__at")).cast("long")).drop("__part", "__at", "__base")


def require_order(lines: DataFrame) -> DataFrame:
    """``lines``, or an error if a line has no ``seq`` or shares it: groups follow the order of lines."""
    missing = lines.where(F.col("seq").isNull()).limit(1).count()
    if missing:
        raise ValueError("lines without a stored order (seq); see stored_order")
    if lines.groupBy("seq").count().where("count > 1").limit(1).count():
        raise ValueError("lines that share their place (seq) in the stored order")
    return lines
