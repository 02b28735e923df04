"""Stored tables: the dataset (S4–S6, S15) and the activity log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from pricebench.functions.numeric import number, number_or
from pricebench.functions.parts import bill_date_of
from pricebench.model import ACTIVITY, PART_LINE
from pricebench.operators.enrich import enrich_lines
from pricebench.operators.ordering import stored_order
from pricebench.session import shuffles_dropped

#: Events shown and kept by default; both are arguments, None means all.
ACTIVITY_CAP = 500

# What a missing column of a stored line reads as.
LINE_DEFAULTS = {
    "bill_no": "", "supplier": "", "bill_date": "", "make": "Unknown", "model": "—", "part_name": "", "part_number": "",
    "npn": "", "cat": "Other", "ltype": "Supplier Part", "doc_type": "Tax Invoice", "src": "excel", "grade": "Unknown",
    "unit_basis": "each", "gst": "unknown", "review_reason": "",
}


def with_line_defaults(stored: DataFrame) -> DataFrame:
    """A stored row with every blank filled in."""
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in LINE_DEFAULTS.items()}
    fill |= {c: number_or(number(stored, c), F.lit(d)) for c, d in (("qty", 1.0), ("unit", 0.0), ("total", 0.0))}
    fill["review"] = F.coalesce(F.col("review"), F.lit(False))
    fill["bill_dt"] = F.coalesce("bill_dt", bill_date_of(F.col("bill_date")))
    return stored.withColumns(fill)


def last_per_id(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last version of each row; ``order`` decides between any two versions."""
    newest = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


#: Numbers that a stream leaves free between two of its batches, for corrections by hand.
STRIDE = 1 << 20


def stream_batch(batch_id: int) -> int:
    """The batch number of a micro-batch; seeds and replacements are batch 0."""
    return (batch_id + 1) * STRIDE


@dataclass(frozen=True)
class BatchTable:
    """Rows with a key as Parquet files partitioned by ``batch``.

    A batch replaces itself when it is written again, so a retry changes nothing;
    of a key that several batches hold, the highest batch counts, in a batch the
    highest ``position`` and then the later row.  Writers give the numbers and take
    turns.
    """

    path: str
    schema: T.StructType
    key: str = "id"

    def rows(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """What batches (below ``before``) hold, every version, with ``batch``, ``position`` and ``place``."""
        layout = T.StructType(self.schema.fields + [T.StructField(c, T.LongType()) for c in ("position", "place", "batch")])
        try:
            stored = spark.read.schema(layout).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = spark.createDataFrame([], layout)
        return stored if before is None else stored.where(F.col("batch") < before)

    def load(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The last version of each row."""
        newest = last_per_id(self.rows(spark, before), self.key, F.col("batch"), F.col("position"), F.col("place"))
        return newest.select(*self.schema.names)

    def next_batch(self, spark: SparkSession) -> int:
        """The first number after all that were used."""
        last = self.rows(spark).agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def _shaped(self, rows: DataFrame, batch: int) -> DataFrame:
        return rows.select(
            *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields],
            (F.col("position") if "position" in rows.columns else F.lit(0)).cast("long").alias("position"),
            F.monotonically_increasing_id().alias("place"), F.lit(batch).cast("long").alias("batch"))

    def _write(self, rows: DataFrame, batch: int, overwrite: str) -> None:
        with shuffles_dropped(rows.sparkSession):
            self._shaped(rows, batch).write.mode("overwrite").option("partitionOverwriteMode", overwrite).option("compression", "zstd").partitionBy("batch").parquet(self.path)

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """S6, S7."""
        self._write(rows, batch, "dynamic")

    def replace(self, rows: DataFrame) -> None:
        """Also with no rows at all.  ``rows`` must not be read from this table; see ``cut_lineage``."""
        self._write(rows, 0, "static")


class LineTable(BatchTable):
    """Part lines, in the order of batches and, within one, in the order they had."""

    def _shaped(self, rows: DataFrame, batch: int) -> DataFrame:
        rows = rows.select(*[c for c in self.schema.names if c in rows.columns])
        # Ids of a sorted table rise with its order; places need not be dense, so nothing is stored before the table itself.
        ordered = rows.repartitionByRange("seq", "id").sortWithinPartitions("seq", "id")
        return super()._shaped(ordered.withColumn("position", F.monotonically_increasing_id()), batch)

    def load(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """A changed line keeps the place it first had; ``seq`` is dense."""
        # Rows without a key count as one; a key that is never NULL lets versions and places meet in one shuffle.
        rows = self.rows(spark, before).withColumn("_key", F.when(F.col(self.key).isNull(), "").otherwise(F.concat(F.lit("k"), self.key)))
        first = rows.groupBy("_key").agg(F.min(F.struct("batch", "position")).alias("_first"))
        # Only keys are put in order and stored; whole rows are read when they are asked for.
        placed = stored_order(first, "_first.batch", "_first.position", "_key").select("_key", "seq")
        newest = last_per_id(rows.drop("seq"), "_key", F.col("batch"), F.col("position"), F.col("place"))
        return newest.join(placed, "_key").select(*self.schema.names)


def line_table(path: str) -> LineTable:
    return LineTable(path, PART_LINE)


def load_lines(spark: SparkSession, table: LineTable) -> DataFrame:
    return with_line_defaults(table.load(spark))


def seed_lines(table: LineTable, raw: DataFrame, force: bool = False) -> bool:
    """Fill an empty dataset; a filled one is left alone unless forced."""
    spark = raw.sparkSession
    if not force and not table.rows(spark).isEmpty():
        return False
    table.replace(enrich_lines(raw))
    return True


def append_lines(stored: DataFrame, new: DataFrame) -> DataFrame:
    """U1."""
    return stored.unionByName(new, allowMissingColumns=True)


def activity_table(path: str) -> BatchTable:
    return BatchTable(path, ACTIVITY)


def normal_events(events: DataFrame) -> DataFrame:
    """What is stored of an event: ``count`` as a number, ``detail`` as JSON text."""
    fields = {"count": number_or(number(events, "count"), F.lit(0.0)).cast("long")}
    if "detail" in events.columns and events.schema["detail"].dataType.typeName() in ("struct", "map", "array"):
        fields["detail"] = F.to_json("detail")
    return events.withColumns(fields)


def newest_events(events: DataFrame, limit: int | None = ACTIVITY_CAP, kind: str | None = None) -> DataFrame:
    """The newest ``limit`` events (None: all), newest first; detail that is not JSON becomes ``{"raw": …}``."""
    rows = events if kind is None else events.where(F.col("kind") == kind)
    raw = F.to_variant_object(F.struct(F.col("detail").alias("raw")))
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.coalesce(F.try_parse_json("detail"), raw))
    ordered = rows.orderBy(F.col("ts").desc(), F.col("id").desc())
    return (ordered if limit is None else ordered.limit(max(1, int(limit)))).withColumns({
        "kind": F.coalesce(F.nullif("kind", F.lit("")), F.lit("info")),
        "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("info")),
        "count": F.coalesce("count", F.lit(0)),
        "detail": detail,
    })


def keep_newest(events: DataFrame, cap: int = ACTIVITY_CAP, per: str = "source") -> DataFrame:
    """The newest events of each source.

    A source is first cut down in slices, each of which can only lose events that are too old
    anyway, so no task sorts a whole source.
    """
    newest = [F.col("ts").desc(), F.col("id").desc()]
    slices = max(1, events.sparkSession.sparkContext.defaultParallelism)
    slice_ = F.pmod(F.xxhash64("id"), F.lit(slices))
    local = Window.partitionBy(per, "_slice").orderBy(*newest)
    rows = events.withColumn("_slice", slice_).withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= cap)
    final = Window.partitionBy(per).orderBy(*newest)
    return rows.withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= cap).drop("_rn", "_slice")
