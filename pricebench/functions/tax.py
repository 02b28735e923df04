"""Prices without goods and services tax, at the rate of the day of the bill."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# From which day which rate (per cent) holds.
RATES = (("2007-07-01", 7), ("2023-01-01", 8), ("2024-01-01", 9))


def rate_on(date: Column, rates: tuple[tuple[str, float], ...] = RATES) -> Column:
    """The rate of the latest entry that is not after ``date``; the last rate for an unknown date or one before the first entry."""
    ordered = sorted((dt.date.fromisoformat(day), rate) for day, rate in rates)
    held = F.when(date < F.lit(ordered[0][0]), float(ordered[-1][1]))
    for (_, rate), (end, _) in zip(ordered, ordered[1:]):
        held = held.when(date < F.lit(end), float(rate))
    return held.otherwise(float(ordered[-1][1]))


def tax_flag(gst: Column, date: Column, rates: tuple[tuple[str, float], ...] = RATES) -> Column:
    """Why a price without tax is uncertain: ``unknown`` treatment, or tax included on an ``undated`` bill or ``before rates``; else empty."""
    first = F.lit(min(dt.date.fromisoformat(day) for day, _ in rates))
    included = gst == "incl"
    return F.when(~F.coalesce(gst.isin("incl", "excl"), F.lit(False)), "unknown").when(included & date.isNull(), "undated").when(included & (date < first), "before rates").otherwise("")


def unit_without_tax(unit: Column, gst: Column, date: Column, rates: tuple[tuple[str, float], ...] = RATES) -> Column:
    """Prices that include tax are divided by one plus the rate; others, also of unknown treatment, stay."""
    return F.when(gst == "incl", unit / (F.lit(1.0) + rate_on(date, rates) / F.lit(100.0))).otherwise(unit)


def with_tax_columns(lines: DataFrame, rates: tuple[tuple[str, float], ...] = RATES) -> DataFrame:
    """Lines (unit, gst, bill_dt) with ``unit_ex`` and ``gst_flag``; a projection."""
    unit, gst, date = F.col("unit"), F.col("gst"), F.col("bill_dt")
    return lines.withColumns({"unit_ex": unit_without_tax(unit, gst, date, rates), "gst_flag": tax_flag(gst, date, rates)})


def priced(lines: DataFrame, ex_gst: bool | None, rates: tuple[tuple[str, float], ...] = RATES) -> DataFrame:
    """Lines whose ``unit`` is the price a benchmark is made of: without tax if ``ex_gst``, else as billed."""
    if not ex_gst:
        return lines
    return with_tax_columns(lines, rates).withColumn("unit", F.col("unit_ex")).drop("unit_ex")


def basis_label(ex_gst: bool | None) -> str:
    return "prices ex-GST" if ex_gst else "prices as billed"


def flag_counts(lines: DataFrame, rates: tuple[tuple[str, float], ...] = RATES) -> DataFrame:
    """How many lines have which treatment and which doubt."""
    return with_tax_columns(lines, rates).groupBy("gst", "gst_flag").agg(F.count("*").alias("lines"))
