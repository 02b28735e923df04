"""Schemas of the tables that enter and leave the engine (M1, M2, M3, M8)."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the text fields of a line as it arrives.
RAW_TEXT = ("supplier", "bill_no", "bill_date", "make", "model", "doc_type", "part_name", "part_number")

# M1: a line as it arrives; everything may be missing.
RAW_LINE = T.StructType(
    [T.StructField(c, T.StringType()) for c in RAW_TEXT]
    + [T.StructField(c, T.DoubleType()) for c in ("qty", "unit_cost", "total_cost")]
    + [T.StructField(c, T.StringType()) for c in ("grade", "unit_basis", "gst")]
    + [T.StructField("review", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in ("review_reason", "src", "id")]
    + [T.StructField("seq", T.LongType())]
)

# M2: the stored dataset.  ``seq`` is the total order of lines that grouping
# follows and ``bill_dt`` the parsed date; both are additions to the 21 stored fields.
# Names of the stored fields.
PART_COLUMNS = (
    "id", "bill_no", "supplier", "bill_date", "make", "model", "part_name", "part_number", "npn", "cat",
    "qty", "unit", "total", "ltype", "doc_type", "src", "grade", "unit_basis", "gst", "review", "review_reason",
)
_DOUBLES = {"qty", "unit", "total"}
PART_LINE = T.StructType(
    [
        T.StructField(
            c,
            T.DoubleType() if c in _DOUBLES else T.BooleanType() if c == "review" else T.StringType(),
        )
        for c in PART_COLUMNS
    ]
    + [T.StructField("seq", T.LongType()), T.StructField("bill_dt", T.DateType())]
)

# M8: one event of the activity log; ``detail`` is JSON text at rest.  Fixed values: its field names.
ACTIVITY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "ts", "kind", "action", "message", "source")]
    + [T.StructField("count", T.LongType()), T.StructField("status", T.StringType()), T.StructField("detail", T.StringType())]
)
