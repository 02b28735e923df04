"""Raw lines to stored lines (E1–E11) and the upgrade of older rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricebench.functions import parts as P, rules
from pricebench.functions.numeric import number, number_or, to_fixed
from pricebench.model import PART_COLUMNS


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _line_id(df: DataFrame) -> Column:
    """The given id, else one derived from the line, so a re-run repeats it."""
    seeds = [_col(df, c).cast("string") for c in
             ("seq", "supplier", "bill_no", "part_name", "part_number", "qty", "unit_cost", "total_cost")]
    made = F.sha2(F.to_json(F.array(*[F.coalesce(s, F.lit("")) for s in seeds])), 256)
    return F.coalesce(F.nullif(_col(df, "id").cast("string"), F.lit("")), made)


def enrich_lines(raw: DataFrame) -> DataFrame:
    """One projection, no shuffle; unused columns are pruned away by the reader of the result.

    ``raw`` needs a stored ``seq`` if it is to be grouped: groups depend on the order of lines.
    """
    qty = number_or(number(raw, "qty"), F.lit(1.0))
    given_unit = number_or(number(raw, "unit_cost"), F.lit(0.0))
    base = raw.select(
        "*",
        P.normal_part_number(_col(raw, "part_number")).alias("_npn"),
        P.category(_col(raw, "part_name")).alias("_cat"),
        qty.alias("_qty"),
        given_unit.alias("_unit"),
        number_or(number(raw, "total_cost"), given_unit * qty).alias("_total"),
    )
    unit = F.when((F.col("_unit") == 0) & (F.col("_total") != 0),
                  to_fixed(F.col("_total") / F.col("_qty"), 2)).otherwise(F.col("_unit"))
    out = {
        "id": _line_id(raw),
        "bill_no": P.text(_col(raw, "bill_no")),
        "supplier": P.text(_col(raw, "supplier")),
        "bill_date": P.text(_col(raw, "bill_date")),
        "make": P.make_of(F.col("_npn"), _col(raw, "make")),
        "model": P.non_blank(_col(raw, "model"), "—"),
        "part_name": P.text(_col(raw, "part_name")),
        "part_number": P.text(_col(raw, "part_number")),
        "npn": F.col("_npn"),
        "cat": F.col("_cat"),
        "qty": F.col("_qty"),
        "unit": unit,
        "total": F.col("_total"),
        "ltype": P.line_type(_col(raw, "doc_type"), F.col("_cat")),
        "doc_type": P.non_blank(_col(raw, "doc_type"), "Tax Invoice"),
        "src": P.non_blank(_col(raw, "src"), "excel"),
        "grade": P.grade_of(_col(raw, "part_name"), _col(raw, "grade")),
        "unit_basis": P.basis_of(_col(raw, "part_name"), _col(raw, "unit_basis")),
        "gst": P.gst_of(_col(raw, "gst")),
        "review": F.coalesce(_col(raw, "review", "boolean"), F.lit(False)),
        "review_reason": P.text(_col(raw, "review_reason")),
    }
    return base.select(
        *[out[c].alias(c) for c in PART_COLUMNS],
        _col(raw, "seq", "long").cast("long").alias("seq"),
        P.bill_date_of(_col(raw, "bill_date")).alias("bill_dt"),
    )


def upgrade_lines(old: DataFrame) -> DataFrame:
    """Fill what an older writer left out; present valid values win."""
    name, pn = _col(old, "part_name"), _col(old, "part_number")
    base = old.select(
        "*",
        number_or(number(old, "qty"), F.lit(1.0)).alias("_qty"),
        number_or(number(old, "unit"), F.lit(0.0)).alias("_unit"),
        number_or(number(old, "total"), F.lit(0.0)).alias("_total"),
        F.coalesce(_col(old, "npn"), P.normal_part_number(pn)).alias("_npn"),
        F.coalesce(F.nullif(_col(old, "cat"), F.lit("")), P.category(name)).alias("_cat"),
    )
    stored_make = P.text(_col(old, "make"))
    make = F.when(
        ~stored_make.isin("", "Unknown"), P.canonical_make(stored_make)
    ).otherwise(P.make_of(P.normal_part_number(pn), F.lit("")))
    grade, basis = _col(old, "grade"), _col(old, "unit_basis")
    out = {
        "id": _line_id(old),
        "make": make,
        "npn": F.col("_npn"),
        "cat": F.col("_cat"),
        "ltype": F.coalesce(F.nullif(_col(old, "ltype"), F.lit("")), P.line_type(_col(old, "doc_type"), F.col("_cat"))),
        "qty": F.col("_qty"),
        "unit": F.when((F.col("_unit") == 0) & (F.col("_total") != 0),
                       to_fixed(F.col("_total") / F.col("_qty"), 2)).otherwise(F.col("_unit")),
        "total": F.col("_total"),
        "grade": F.when(grade.isin(*rules.GRADES), grade).otherwise(P.grade_of(name, grade)),
        "unit_basis": F.when(basis.isin(*rules.UNIT_BASES), basis).otherwise(P.basis_of(name, basis)),
        "gst": P.gst_of(_col(old, "gst")),
        "review": F.coalesce(_col(old, "review", "boolean").cast("boolean"), F.lit(False)),
        "review_reason": P.text(_col(old, "review_reason")),
    }
    return base.select(
        *[out.get(c, _col(old, c)).alias(c) for c in PART_COLUMNS],
        _col(old, "seq", "long").cast("long").alias("seq"),
        P.bill_date_of(_col(old, "bill_date")).alias("bill_dt"),
    )
