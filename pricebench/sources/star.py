"""Bill lines derived from the order tables (``lineitem orders part supplier``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebench.operators.ordering import stored_order

# What is added to a part name by (l_partkey*3 + l_linenumber*5 + l_suppkey) % 14.
SUFFIXES = (" ASSY", " LH", " RH", " FR", " REAR", " A", " A B", " GEN", " APM", " UPR", " LOWER", " PAIR", " SET", "")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One raw part line per ``lineitem`` row; ``seq`` is its place in the order of bill, part, supplier and line number."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity"]
    line = stored_order(read_table(spark, folder, "lineitem").select(*keys), *keys)
    part_key, line_no, supp_key = (F.col(c).cast("long") for c in ("l_partkey", "l_linenumber", "l_suppkey"))
    rows = (
        line.join(read_table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read_table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    slot = ((part_key * 3 + line_no * 5 + supp_key) % 14).cast("int")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), slot + 1)
    return rows.select(
        F.col("seq").cast("string").alias("id"),
        F.col("s_name").alias("supplier"),
        F.concat(F.lit("B"), F.col("l_orderkey").cast("string")).alias("bill_no"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("bill_date"),
        F.col("p_brand").alias("make"),
        F.col("p_type").alias("model"),
        F.when(F.col("o_orderstatus") == "P", "Repair Estimate").otherwise("Tax Invoice").alias("doc_type"),
        F.concat(F.upper("p_name"), suffix).alias("part_name"),
        F.concat(F.lit("PN-"), F.col("l_partkey").cast("string"), F.lit(".00 9999")).alias("part_number"),
        F.col("l_quantity").alias("qty"),
        F.lit(None).cast("double").alias("unit_cost"),
        F.col("l_extendedprice").alias("total_cost"),
        "seq",
    )
