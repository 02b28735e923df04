"""Chained price index: how prices of a segment move from quarter to quarter.

Adjacent quarters are compared on the parts that have a median in both (a matched
sample), so a cheap part that enters or leaves is no change of price.  The median
of the ratios is the step of a quarter, and steps are multiplied from the first
quarter that has one.  Quarters with too few matched parts carry the index on and
say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricebench.functions.numeric import to_fixed
from pricebench.operators.quantiles import grouped_quantiles

SEGMENT = ("cat", "grade")
BASE = 100.0


def quarter_number(date: Column) -> Column:
    """Quarters since the year 0."""
    return F.year(date) * 4 + F.quarter(date) - 1


def quarter_label(number: Column) -> Column:
    return F.concat(F.floor(number / 4).cast("string"), F.lit("-Q"), (number % 4 + 1).cast("string"))


def quarter_medians(lines: DataFrame, segment: tuple[str, ...] = SEGMENT, value: str = "unit", min_quotes: int = 1) -> DataFrame:
    """(*segment, cluster_id, quarter, med, n): positive medians of at least ``min_quotes`` dated quotes."""
    dated = lines.where(F.col("bill_dt").isNotNull() & F.col(value).isNotNull()).withColumn("quarter", quarter_number(F.col("bill_dt")))
    keys = [*segment, "cluster_id", "quarter"]
    counts = dated.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_quotes)
    return counts.join(grouped_quantiles(dated, keys, value, {"med": 0.5}), keys).where("med > 0")


def matched_ratios(medians: DataFrame, segment: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Of each part its median over that of the quarter before, where it has both."""
    keys = [*segment, "cluster_id"]
    before = medians.select(*keys, (F.col("quarter") + 1).alias("quarter"), F.col("med").alias("med_before"))
    return medians.join(before, [*keys, "quarter"]).withColumn("ratio", F.col("med") / F.col("med_before"))


def chained_index(lines: DataFrame, segment: tuple[str, ...] = SEGMENT, value: str = "unit", min_quotes: int = 1, min_matched: int = 3) -> DataFrame:
    """(*segment, quarter, label, index, step, matched, thin), a row for each quarter of a segment from its base to its last quote.

    The base is the quarter before the first one with ``min_matched`` matched parts
    and stands at 100; segments that never have them are left out.  ``step`` is the
    median ratio of a quarter, null where it is thin; ``matched`` counts the parts
    behind it.  ``lines``: ``segment``, cluster_id, bill_dt and ``value``; undated
    and unpriced lines take no part, segment columns must not be NULL.
    """
    medians = quarter_medians(lines, segment, value, min_quotes)
    ratios = matched_ratios(medians, segment)
    keys = [*segment, "quarter"]
    steps = ratios.groupBy(*keys).agg(F.count("*").alias("matched")).join(grouped_quantiles(ratios, keys, "ratio", {"step": 0.5}), keys)
    enough = F.col("matched") >= min_matched
    spans = steps.where(enough).groupBy(*segment).agg((F.min("quarter") - 1).alias("first")).join(
        medians.groupBy(*segment).agg(F.max("quarter").alias("last")), list(segment))
    quarters = spans.select(*segment, "first", F.explode(F.sequence("first", "last")).alias("quarter"))
    rows = quarters.join(steps, keys, "left").withColumns({"matched": F.when(F.col("quarter") > F.col("first"), F.coalesce("matched", F.lit(0))), "thin": (F.col("quarter") > F.col("first")) & ~F.coalesce(enough, F.lit(False))})
    rows = rows.withColumn("step", F.when(~F.col("thin") & (F.col("quarter") > F.col("first")), F.col("step")))
    # A segment has as many rows as quarters, whatever its lines are: multiplied in their order, so that the product is always the same.
    series = rows.groupBy(*segment).agg(F.array_sort(F.collect_list(F.struct("quarter", "step", "matched", "thin"))).alias("q"))
    chain = F.aggregate("q", F.array().cast("array<double>"), lambda done, x: F.concat(
        done, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(BASE)), done), F.lit(-1)) * F.coalesce(x["step"], F.lit(1.0)), F.lit(BASE)))))
    series = series.select(*segment, F.inline(F.arrays_zip("q", chain.alias("index"))))
    return series.select(*segment, "q.quarter", quarter_label(F.col("q.quarter")).alias("label"), to_fixed(F.col("index"), 4).alias("index"), "q.step", "q.matched", "q.thin")
