"""The activity log as a stream; an event sent twice is stored once, the later write wins.

A batch writes its own partition and reads nothing; ids are merged when the log is read.
``dropDuplicates`` would have to remember every id forever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pricebench.model import ACTIVITY
from pricebench.sources.store import activity_table, normal_events, stream_batch


def store_batch(events: DataFrame, batch: int, path: str) -> None:
    """The write decides, within a batch the time an event states, then its place in the batch."""
    rows = normal_events(events).withColumn("position", F.unix_micros(F.col("ts").try_cast("timestamp")))
    activity_table(path).upsert(rows.fillna(-1, ["position"]), stream_batch(batch))


def start(spark: SparkSession, landing: str, path: str, available_now: bool = True) -> StreamingQuery:
    """Follow a folder of JSON-lines events."""
    writer = spark.readStream.schema(ACTIVITY).json(landing).writeStream.option("checkpointLocation", f"{path}-checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda df, batch: store_batch(df, batch, path)).start()


def by_kind(events: DataFrame) -> DataFrame:
    """What the log holds, per kind."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.sum("count").alias("count"))
