"""Supplier scorecards: what a supplier asks above the median of everybody else.

The median without a supplier's own quotes is found for all suppliers of a part
in one pass over its sorted quotes.  If r is the wanted place among the others,
the quote stands at place r plus the number of own quotes before it; and an own
quote is before it exactly if its place less the number of own quotes ahead of it
is at most r.  So every supplier's place follows from running counts, and the
value there is looked up: suppliers are never joined with the quotes of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricebench.functions.numeric import to_fixed
from pricebench.operators.quantiles import grouped_quantiles, price_bucket

#: Suppliers with fewer comparable quotes are advisory only.
LEAST_LINES = 5
#: Premiums (per cent) up to which a supplier is neutral or amber.
BANDS = (5.0, 15.0)
#: Places of one block in which a value is looked up.
_BLOCK = 64


def _runs(quotes: DataFrame) -> DataFrame:
    """Quotes collapsed to (cluster_id, supplier, unit, f) with ``start``, the place of the first of them in the part, and ``own``, the supplier's quotes before it.

    Places are counted inside coarse buckets of prices and added up over buckets,
    so no task sorts a whole part.
    """
    runs = quotes.groupBy("cluster_id", "supplier", "unit").agg(F.count("*").alias("f")).withColumn("_b", price_bucket(F.col("unit")))

    def before(keys: list[str], order: list[str]) -> Column:
        return F.coalesce(F.sum("f").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    buckets = runs.groupBy("cluster_id", "_b").agg(F.sum("f").alias("f"))
    buckets = buckets.select("cluster_id", "_b", before(["cluster_id"], ["_b"]).alias("_base"), F.sum("f").over(Window.partitionBy("cluster_id")).alias("n"))
    own = runs.withColumns({"own": before(["cluster_id", "supplier"], ["unit"]), "m": F.sum("f").over(Window.partitionBy("cluster_id", "supplier"))})
    placed = own.join(buckets, ["cluster_id", "_b"])
    return placed.withColumn("start", F.col("_base") + before(["cluster_id", "_b"], ["unit", "supplier"])).drop("_b", "_base")


def others_medians(quotes: DataFrame) -> DataFrame:
    """(cluster_id, supplier, n, m, others): of each supplier the median of the other suppliers' quotes of the part.

    ``quotes``: cluster_id, supplier, unit, none of them NULL.  Suppliers that are
    alone with a part are left out.
    """
    runs = _runs(quotes)
    rest = F.col("n") - F.col("m")
    ranked = runs.where(rest > 0).withColumns({"r1": F.floor((rest - 1) / 2), "r2": F.floor(rest / 2)})
    shift = lambda r: F.sum(F.when(F.col("start") - F.col("own") <= F.col(r), F.col("f")).otherwise(0))
    wanted = ranked.groupBy("cluster_id", "supplier").agg(
        F.max("n").alias("n"), F.max("m").alias("m"), (F.max("r1") + shift("r1")).alias("p1"), (F.max("r2") + shift("r2")).alias("p2"))
    # Each place is met by the one run that covers it; both sides are dealt by blocks of places.
    asked = wanted.select("cluster_id", "supplier", "n", "m", F.inline(F.array(F.struct(F.lit(1).alias("which"), F.col("p1").alias("p")), F.struct(F.lit(2).alias("which"), F.col("p2").alias("p")))))
    asked = asked.withColumn("block", F.floor(F.col("p") / _BLOCK))
    stop = F.col("start") + F.col("f")
    covers = runs.select("cluster_id", "unit", "start", stop.alias("stop"), F.explode(F.sequence(F.floor(F.col("start") / _BLOCK), F.floor((stop - 1) / _BLOCK))).alias("block"))
    met = asked.join(covers, ["cluster_id", "block"]).where((F.col("p") >= F.col("start")) & (F.col("p") < F.col("stop")))
    both = met.groupBy("cluster_id", "supplier").agg(
        F.max("n").alias("n"), F.max("m").alias("m"), F.max(F.when(F.col("which") == 1, F.col("unit"))).alias("_low"), F.max(F.when(F.col("which") == 2, F.col("unit"))).alias("_high"))
    return both.select("cluster_id", "supplier", "n", "m", ((F.col("_low") + F.col("_high")) / 2).alias("others"))


def comparisons(grouped: DataFrame, min_quotes: int = 4) -> DataFrame:
    """Every quote that can be compared, with the others' median and its deviation from it in per cent.

    Only parts of at least ``min_quotes`` quotes and two suppliers count.  A
    supplier without a name is one like others; a median of 0 has no deviation.
    """
    quotes = grouped.where(F.col("unit").isNotNull()).withColumn("supplier", F.coalesce("supplier", F.lit("")))
    medians = others_medians(quotes.select("cluster_id", "supplier", "unit")).where(F.col("n") >= min_quotes)
    deviation = F.when(F.col("others") != 0, (F.col("unit") - F.col("others")) / F.col("others") * 100)
    return quotes.join(medians.select("cluster_id", "supplier", "others"), ["cluster_id", "supplier"]).withColumn("deviation", deviation)


def band(premium: Column) -> Column:
    neutral, amber = BANDS
    return F.when(premium > amber, "red").when(premium > neutral, "amber").when(premium < -neutral, "below").otherwise("neutral")


def scorecards(grouped: DataFrame, min_quotes: int = 4, least_lines: int = LEAST_LINES) -> DataFrame:
    """One row per supplier with comparable quotes.

    ``premium_pct`` is the median of the deviations, ``premium_iqr`` their
    interquartile range; ``lines`` and ``clusters`` say how many quotes of how many
    parts were compared, ``makes``, ``cats`` and ``known_grades`` what they cover, and
    ``coverage`` how much of the supplier's quotes that is.  ``advisory``: too few
    quotes to say anything.
    """
    compared = comparisons(grouped, min_quotes).where("deviation IS NOT NULL")
    counts = compared.groupBy("supplier").agg(F.count("*").alias("lines"), F.count_if(F.col("grade") != "Unknown").alias("known_grades"))
    for name, column in (("clusters", "cluster_id"), ("makes", "make"), ("cats", "cat")):
        # Distinct values first, so that a supplier's set isn't held in one task.
        distinct = compared.select("supplier", column).distinct().groupBy("supplier").agg(F.count("*").alias(name))
        counts = counts.join(distinct, "supplier")
    all_quotes = grouped.where(F.col("unit").isNotNull()).groupBy(F.coalesce("supplier", F.lit("")).alias("supplier")).agg(F.count("*").alias("quotes"))
    quartiles = grouped_quantiles(compared, ["supplier"], "deviation", {"_q1": 0.25, "_med": 0.5, "_q3": 0.75})
    return counts.join(all_quotes, "supplier").join(quartiles, "supplier").select(
        "supplier", "lines", "clusters", "makes", "cats", "known_grades", (F.col("lines") / F.col("quotes")).alias("coverage"),
        to_fixed(F.col("_med"), 2).alias("premium_pct"), to_fixed(F.col("_q3") - F.col("_q1"), 2).alias("premium_iqr"),
        band(F.col("_med")).alias("band"), (F.col("lines") < least_lines).alias("advisory"))


def evidence(grouped: DataFrame, min_quotes: int = 4) -> DataFrame:
    """What a premium rests on: per supplier and part the supplier's own median, the others', and the deviation of the one from the other."""
    compared = comparisons(grouped, min_quotes).where("deviation IS NOT NULL")
    own = grouped_quantiles(compared, ["supplier", "cluster_id"], "unit", {"own": 0.5})
    rows = compared.groupBy("supplier", "cluster_id").agg(F.count("*").alias("lines"), F.max("others").alias("others")).join(own, ["supplier", "cluster_id"])
    return rows.select("supplier", "cluster_id", "lines", to_fixed(F.col("own"), 2).alias("own"), to_fixed(F.col("others"), 2).alias("others"),
                       to_fixed((F.col("own") - F.col("others")) / F.col("others") * 100, 2).alias("deviation"))
