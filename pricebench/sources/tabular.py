"""Spreadsheet-like text files: S1, S13, S14."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricebench.functions.numeric import strip
from pricebench.functions.parts import text
from pricebench.operators.ordering import stored_order
from pricebench.session import cut_lineage, shuffles_dropped

# For each field the word groups to look for in the headers, in
# order; the first header that holds all words of a group is taken.
HEADER_WORDS = {
    "part_name": (("part", "name"), ("particular",), ("descript",)),
    "part_number": (("part", "number"), ("part", "no"), ("stockid",), ("part no",)),
    "qty": (("qty",), ("quant",)),
    "unit_cost": (("unit",), ("u/price",), ("u.price",)),
    "total_cost": (("total",), ("amount",), ("line",)),
    "supplier": (("supplier",),),
    "make": (("make",),),
    "model": (("model",),),
    "bill_no": (("bill", "no"), ("invoice", "no"), ("bill ref",)),
    "bill_date": (("date",),),
    "doc_type": (("doc", "type"), ("line", "type")),
    "grade": (("grade",),),
    "unit_basis": (("unit", "basis"),),
    "gst": (("gst",),),
    "review_reason": (("review", "reason"),),
}
_FIELDS = (*HEADER_WORDS, "review")


def _header_matches(cells: Column) -> Column:
    """(field, rank, position) of each header cell that could hold a field; ``rank`` is the word group's place."""
    groups = [(f, rank, words) for f, all_ in HEADER_WORDS.items() for rank, words in enumerate(all_)]

    def of_cell(cell: Column, at: Column) -> Column:
        lower = F.lower(F.coalesce(cell, F.lit("")))

        def hit(words) -> Column:
            return reduce(lambda x, y: x & y, [F.contains(lower, F.lit(w)) for w in words])

        found = [F.when(hit(words), F.struct(F.lit(f).alias("field"), F.lit(rank).alias("rank"), at.alias("at"))) for f, rank, words in groups]
        found.append(F.when(hit(("review",)), F.struct(F.lit("review").alias("field"), F.lit(0).alias("rank"), at.alias("at"))))
        return F.filter(F.array(*found), lambda m: m.isNotNull())

    return F.flatten(F.transform(cells, of_cell))


def header_layout(headers: DataFrame) -> DataFrame:
    """(path, layout): for each file the position of every field, from its header row (path, cells).

    A field takes the first column of its first word group that occurs at all; the review mark takes
    the first column that is not the review reason.
    """
    rows = headers.select("path", F.inline(_header_matches(F.col("cells"))))
    best = rows.where("field <> 'review'").groupBy("path", "field").agg(F.min(F.struct("rank", "at")).alias("m")).select("path", "field", F.col("m.at").alias("at"))
    reasons = best.where("field = 'review_reason'").select("path", F.col("at").alias("reason"))
    marks = rows.where("field = 'review'").join(reasons, "path", "left").where(F.col("reason").isNull() | (F.col("at") != F.col("reason")))
    marks = marks.groupBy("path").agg(F.min("at").alias("at")).select("path", F.lit("review").alias("field"), "at")
    # At most one entry per field and file.
    return best.union(marks).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("field", "at"))).alias("layout"))


def _is_header(cells: Column) -> Column:
    return F.exists(cells, lambda c: c.rlike("(?i)part")) & F.exists(cells, lambda c: c.rlike(r"(?i)number|no\.?|part no"))


def read_bill_sheet(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Raw lines from CSV files, each with its own layout, in the order of files and lines (``seq``).

    A file's header is its first row that names a part and a number, wherever it stands; rows above it
    are titles.  Files stay splittable: a line's place is its split and its place in the split.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    ).where("value <> ''")
    rows = stored_order(rows, "path", "block", "at", out="seq")
    # No line has more cells than separators and one.
    width = rows.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(separator), F.lit(""))))).first()[0] or 0
    schema = ", ".join(f"c{i} string" for i in range(width // len(separator) + 1))
    parsed = F.from_csv(F.col("value"), schema, {"sep": separator, "quote": '"', "escape": '"'})
    rows = rows.select("path", "seq", parsed.alias("c")).select("path", "seq", F.array("c.*").alias("cells"))
    first = rows.where(_is_header(F.col("cells"))).groupBy("path").agg(F.min("seq").alias("header"))
    first = cut_lineage(first)
    headers = rows.join(first.select(F.col("header").alias("seq")), "seq", "left_semi")
    layouts = cut_lineage(header_layout(headers).join(first, "path").where(
        F.map_contains_key("layout", F.lit("part_name")) | F.map_contains_key("layout", F.lit("part_number"))))
    lacking = rows.select("path").distinct().join(layouts, "path", "left_anti").limit(1).collect()
    if lacking:
        raise ValueError(f"no header row with part names or numbers in {lacking[0]['path']}")
    body = rows.join(layouts, "path").where(F.col("seq") > F.col("header"))

    def field(name: str, default: str = "") -> Column:
        at = F.element_at("layout", F.lit(name))
        return F.when(at.isNull(), F.lit(default)).otherwise(text(F.get("cells", at)))

    sheet = F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\.[^.]*$", "")
    review = F.lower(strip(field("review"))).isin("y", "yes", "true", "1")
    return body.select(
        F.when(F.map_contains_key("layout", F.lit("supplier")), field("supplier")).otherwise(sheet).alias("supplier"),
        *[field(c).alias(c) for c in ("bill_no", "bill_date", "make", "model")],
        field("doc_type", "Tax Invoice").alias("doc_type"),
        field("part_name").alias("part_name"), field("part_number").alias("part_number"),
        field("qty", "1").alias("qty"), field("unit_cost", "0").alias("unit_cost"), field("total_cost", "0").alias("total_cost"),
        *[field(c).alias(c) for c in ("grade", "unit_basis", "gst")],
        review.alias("review"), F.when(review, field("review_reason")).otherwise("").alias("review_reason"),
        F.lit("excel").alias("src"), "seq", "path",
    ).where((F.col("part_name") != "") | (F.col("part_number") != ""))


# Columns of the file of labelled pairs.
PAIR_COLUMNS = (
    "pair_id", "similarity", "label", "part_name_a", "part_number_a", "supplier_a", "unit_a", "part_name_b",
    "part_number_b", "supplier_b", "unit_b", "make", "category_a", "category_b",
)


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields may hold commas, quotes and line breaks."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """A table for people; blank cells stay blank.  Large tables can be written as ``gzip``."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", compression=compression)
