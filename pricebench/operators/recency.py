"""Recent quotes count more: date window and weighted median of each part.

Ages are whole months at a stated day, so a snapshot can be repeated.  Weights are
whole numbers: running totals of them don't depend on how rows are spread, and
the half of all weight is met exactly.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricebench.config import MatchConfig
from pricebench.functions.numeric import to_fixed
from pricebench.operators.quantiles import grouped_quantiles, price_bucket

#: The weight of a quote that is not a month old.
WEIGHT_UNITS = 1_000_000_000


def age_months(date: Column, as_of: dt.date) -> Column:
    """Whole months from ``date`` to ``as_of``; later dates are of age 0, an unknown date has none."""
    day = F.lit(as_of)
    months = (F.year(day) - F.year(date)) * 12 + F.month(day) - F.month(date) - (F.dayofmonth(day) < F.dayofmonth(date)).cast("int")
    return F.greatest(months, F.when(date.isNotNull(), F.lit(0)))


def recency_weight(age: Column, half_life: int) -> Column:
    """WEIGHT_UNITS halved every ``half_life`` months, at least 1; no age, no weight."""
    return F.when(age.isNotNull(), F.greatest(F.lit(1), F.round(F.pow(F.lit(0.5), age / F.lit(half_life)) * WEIGHT_UNITS)).cast("long"))


def in_window(date: Column, months: int | None, as_of: dt.date) -> Column:
    """Whether a quote is younger than ``months`` (None: no window).  Undated quotes are outside any window."""
    return F.lit(True) if months is None else F.coalesce(age_months(date, as_of) < months, F.lit(False))


def weighted_medians(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``keys``, low, high, median, total: the values at which half of all weight is reached and passed, and their mean.

    With equal weights ``low`` is the plain lower median and ``median`` the plain
    one.  Weights are positive whole numbers; rows without value or weight take no
    part; keys must not be NULL.  Like ``grouped_quantiles`` a group is collapsed
    to (value, weight), then to coarse buckets of values, and only the buckets in
    which half of the weight lies are sorted.
    """
    counted = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.sum(F.col(weight).cast("decimal(38,0)")).alias("_w")).withColumn("_b", price_bucket(F.col("_v")))
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = counted.groupBy(*keys, "_b").agg(F.sum("_w").alias("_bw")).withColumns({
        "_upto": F.sum("_bw").over(along), "_all": F.sum("_bw").over(Window.partitionBy(*keys))})
    before = F.col("_upto") - F.col("_bw")
    # ``low`` lies where twice the running weight first reaches the total, ``high`` where it first passes it.
    hit = buckets.where((2 * before < F.col("_all")) & (2 * F.col("_upto") >= F.col("_all")) | (2 * before <= F.col("_all")) & (2 * F.col("_upto") > F.col("_all")))
    hit = hit.select(*keys, "_b", "_all", before.alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.join(hit, [*keys, "_b"]).withColumn("_cum", F.col("_before") + F.sum("_w").over(inside))
    found = ranked.groupBy(*keys).agg(
        F.min(F.when(2 * F.col("_cum") >= F.col("_all"), F.col("_v"))).alias("low"), F.min(F.when(2 * F.col("_cum") > F.col("_all"), F.col("_v"))).alias("high"),
        F.max("_all").cast("long").alias("total"))
    return found.select(*keys, "low", "high", ((F.col("low") + F.col("high")) / 2).alias("median"), "total")


def with_weights(grouped: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Lines of parts with ``age_months``, ``in_window``, ``dated`` and ``weight``.

    An undated quote gets the least weight of the dated quotes of its part that are
    used (WEIGHT_UNITS if there are none), and is marked by ``dated``; it is neither
    left out nor given full weight.  A quote outside the window has weight null.
    """
    as_of = cfg.as_of_date()
    age = age_months(F.col("bill_dt"), as_of)
    rows = grouped.withColumns({"age_months": age, "dated": F.col("bill_dt").isNotNull(), "in_window": in_window(F.col("bill_dt"), cfg.window_months, as_of)})
    full = F.lit(WEIGHT_UNITS).cast("long")
    weight = full if cfg.half_life_months is None else recency_weight(F.col("age_months"), cfg.half_life_months)
    rows = rows.withColumn("weight", F.when(F.col("in_window") & F.col("dated"), weight))
    undated = F.col("in_window") & ~F.col("dated")
    # Only parts that have undated quotes meet the least weights: one row a part.
    least = rows.where("weight IS NOT NULL").groupBy("cluster_id").agg(F.min("weight").alias("_least"))
    late = rows.where(undated).drop("weight").join(least, "cluster_id", "left").withColumn("weight", F.coalesce("_least", full)).drop("_least")
    return rows.where(~undated).unionByName(late)


def recency_benchmark(grouped: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Per part: how many quotes count, the weighted median beside the plain one, and how old the quotes are.

    ``med`` is the median of the quotes in use with their weights, ``med_raw`` the
    one without weights and ``med_all`` that of all quotes.  A part of which every
    quote is outside the window stays, with null medians.  Spread stays unweighted
    and is not part of this table.
    """
    rows = with_weights(grouped, cfg)
    used = rows.where("in_window")
    counts = rows.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.count_if("in_window").alias("n_used"), F.count_if(~F.col("dated")).alias("n_undated"),
        F.min(F.when(F.col("in_window"), F.col("age_months"))).alias("newest_months"), F.max(F.when(F.col("in_window"), F.col("age_months"))).alias("oldest_months"))
    weighted = weighted_medians(used, ["cluster_id"], "unit", "weight").select("cluster_id", F.col("low").alias("med_low"), F.col("median").alias("_med"), F.col("total").alias("weight"))
    raw = grouped_quantiles(used, ["cluster_id"], "unit", {"_raw": 0.5})
    everything = grouped_quantiles(rows, ["cluster_id"], "unit", {"_all": 0.5})
    return counts.join(weighted, "cluster_id", "left").join(raw, "cluster_id", "left").join(everything, "cluster_id", "left").select(
        "cluster_id", "n", "n_used", "n_undated", "newest_months", "oldest_months", "weight", to_fixed(F.col("med_low"), 2).alias("med_low"),
        to_fixed(F.col("_med"), 2).alias("med"), to_fixed(F.col("_raw"), 2).alias("med_raw"), to_fixed(F.col("_all"), 2).alias("med_all"))


def with_recent_medians(clusters: DataFrame, grouped: DataFrame, cfg: MatchConfig) -> DataFrame:
    """A benchmark table whose ``med`` is the weighted one; ``med_raw`` keeps the plain median of the quotes in use.

    Parts without a quote in the window have a null ``med``.  Dispersion and the fences stay as they are.
    """
    recent = recency_benchmark(grouped, cfg).select("cluster_id", F.col("med").alias("_m"), "med_raw", "n_used", "n_undated")
    return clusters.join(recent, "cluster_id").withColumn("med", F.col("_m")).drop("_m")
