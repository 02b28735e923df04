"""The benchmark table: price summary, spread and identity of each part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricebench.config import MatchConfig
from pricebench.functions.numeric import exact_sum, to_fixed
from pricebench.operators.quantiles import grouped_quantiles

QUARTILES = {"q1_raw": 0.25, "med_raw": 0.5, "q3_raw": 0.75}


def cluster_variants(grouped: DataFrame) -> DataFrame:
    """Every distinct spelling, number, supplier, grade and model of each part.

    Long form (``cluster_id kind value first_rank n``): a part may have any
    number of them, so they are not kept as arrays.
    """
    kinds = {
        "name": F.col("part_name"),
        "pn": F.nullif(F.col("npn"), F.lit("")),
        "raw_pn": F.nullif(F.col("part_number"), F.lit("")),
        "supplier": F.col("supplier"),
        "grade": F.col("grade"),
        "model": F.when(~F.col("model").isin("", "—"), F.col("model")),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
    return (
        grouped.select("cluster_id", "member_rank", F.inline(entries))
        .where(F.col("value").isNotNull())
        .groupBy("cluster_id", "kind", "value")
        .agg(F.min("member_rank").alias("first_rank"), F.count(F.lit(1)).alias("n"))
    )


def _identity(variants: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).cast("int")

    def first(kind: str) -> Column:
        return F.min_by("value", F.when(F.col("kind") == kind, F.col("first_rank")))

    known = (F.col("kind") == "grade") & (F.col("value") != "Unknown")
    return variants.groupBy("cluster_id").agg(
        count("name").alias("n_names"),
        count("pn").alias("n_pns"),
        count("supplier").alias("n_suppliers"),
        count("model").alias("n_models"),
        F.count_if(known).cast("int").alias("n_known_grades"),
        F.max(F.when(known, F.col("value"))).alias("known_grade"),
        first("pn").alias("first_pn"),
        first("raw_pn").alias("first_raw_pn"),
    )


def spread_columns(q1: Column, q3: Column, sd: Column, mean: Column, n: Column, min_quotes: int) -> dict[str, Column]:
    """A2.  Fences come from the unrounded quartiles; fewer than two quotes have no deviation."""
    iqr = q3 - q1
    return {
        "q1": to_fixed(q1, 2),
        "q3": to_fixed(q3, 2),
        "iqr": to_fixed(iqr, 2),
        "sd": to_fixed(sd, 2),
        "cv": F.when(mean > 0, to_fixed(sd / mean * 100, 1)),
        "lower_fence": to_fixed(q1 - iqr * 1.5, 2),
        "upper_fence": to_fixed(q3 + iqr * 1.5, 2),
        "reliable": n >= F.lit(min_quotes),
    }


def _moments(value: str) -> list[Column]:
    return [
        F.count(value).alias("n"),
        F.min(value).alias("min_unit"),
        F.max(value).alias("max_unit"),
        (exact_sum(F.col(value)) / F.count(value)).alias("_mean"),
        F.stddev_samp(value).alias("_sd"),
    ]


def _price_columns(min_quotes: int) -> list[Column]:
    spread = spread_columns(F.col("q1_raw"), F.col("q3_raw"), F.col("_sd"), F.col("_mean"), F.col("n"), min_quotes)
    return [
        F.col("n"), F.col("min_unit"), to_fixed(F.col("med_raw"), 2).alias("med"),
        to_fixed(F.col("_mean"), 2).alias("avg"), F.col("max_unit"),
        to_fixed(F.col("max_unit") - F.col("min_unit"), 2).alias("spread"),
        *[c.alias(k) for k, c in spread.items()],
    ]


def price_summary(df: DataFrame, keys: list[str], value: str, min_quotes: int = 4) -> DataFrame:
    """A1 and A2 for any grouping of a price column."""
    joined = df.groupBy(*keys).agg(*_moments(value)).join(grouped_quantiles(df, keys, value, QUARTILES), keys)
    return joined.select(*keys, *_price_columns(min_quotes))


def build_clusters(
    grouped: DataFrame, cfg: MatchConfig = MatchConfig(), variants: DataFrame | None = None
) -> DataFrame:
    """One row per part.  Order by ``n`` descending, then ``cluster_order``.

    The three aggregates are joined on the key they are already partitioned by.
    """
    variants = cluster_variants(grouped) if variants is None else variants
    heads = grouped.groupBy("cluster_id").agg(
        F.min_by(F.struct("make", "model", "cat", "unit_basis", "part_name"), "member_rank").alias("head"),
        F.min(F.struct("ord_class", "ord_first")).alias("cluster_order"),
        F.min("bill_dt").alias("first_date"),
        F.max("bill_dt").alias("last_date"),
        F.count("bill_dt").alias("n_dated"),
        *_moments("unit"),
    )
    quartiles = grouped_quantiles(grouped, ["cluster_id"], "unit", QUARTILES)
    rows = heads.join(_identity(variants), "cluster_id").join(quartiles, "cluster_id")
    name = F.nullif(F.col("head.part_name"), F.lit(""))
    grade = F.when(F.col("n_known_grades") == 1, F.col("known_grade")).when(F.col("n_known_grades") > 1, "Mixed")
    return rows.select(
        "cluster_id",
        "cluster_order",
        F.concat(F.coalesce("first_pn", name, F.lit("?")), F.lit("|"), F.col("head.make")).alias("key"),
        F.coalesce(name, "first_raw_pn", F.lit("?")).alias("label"),
        "head.make", "head.model", "head.cat", "head.unit_basis",
        F.coalesce(grade, F.lit("Unknown")).alias("grade"),
        (F.col("n_known_grades") > 1).alias("grade_mixed"),
        (F.col("n_models") > 1).alias("model_mixed"),
        (F.col("n_pns") > 1).alias("bridged"),
        "n_names", "n_pns", "n_suppliers", "n_models",
        *_price_columns(cfg.min_quotes),
        "first_date", "last_date", "n_dated",
    )


def in_cluster_order(clusters: DataFrame) -> DataFrame:
    """Most quotes first, then first seen."""
    return clusters.orderBy(F.col("n").desc(), "cluster_order")


def variant_list(variants: DataFrame, kind: str, name: str) -> DataFrame:
    """``cluster_id`` → distinct values of one kind in member order, for reports with one cell per part."""
    pairs = F.array_sort(F.collect_list(F.struct("first_rank", "value")))
    return (
        variants.where(F.col("kind") == kind)
        .groupBy("cluster_id")
        .agg(F.transform(pairs, lambda p: p.getField("value")).alias(name))
    )
