"""Streaming counts over the events table (an extension; the batch form gives the same rows).

Files are read as a stream, late events are bounded by a watermark, state is kept per window.
Sink and checkpoint lie in the shared folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docketry.registry import query
from docketry.session import shared_folder


def events_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # As a pattern, so that the table may be one file or a folder of part files.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, events, total): tumbling windows with a watermark."""
    grouped = events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(38,4)")).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "total")


def run_available(result: DataFrame, keys: list[str]) -> DataFrame:
    """Process everything that is there, then return the final table.

    The query only hands on what a batch has changed, and drops the state of windows that the
    watermark has passed; the latest row of each key counts. Batches are written under their
    number, so one that is repeated after a failure replaces itself.
    """
    spark = result.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={number}")

    stream = result.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    stream.awaitTermination()
    changed = spark.read.schema(StructType([*result.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/table")
    rest = [c for c in result.columns if c not in keys]
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, "__r.*")


@query("stream_hourly", "select date_trunc('hour', ts) as window_start, event_type, count(*) as events, sum(value::decimal(38,4)) as total from events group by 1, 2")
def stream_hourly(spark, folder):
    return run_available(windowed(events_stream(spark, folder)), ["window_start", "event_type"])


@query("events_by_key", "select json_extract(props, '$.k')::int as k, count(*) as events, count(distinct user_id) as users from events group by 1")
def events_by_key(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query("latest_event", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_event(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.event_type")


@query("usage_rates", "select date_trunc('minute', ts) as minute, count(*) as queries, count(*) filter (event_type <> 'error') as ok, count(*) filter (event_type = 'error') as failed, round(sum(value::decimal(38,4)), 4)::decimal(38,4) as total from events group by 1")
def usage_rates(spark, folder):
    return usage(spark.read.parquet(f"{folder}/events.parquet"), "ts", "value", F.col("event_type") != "error", "minute")


@query("usage_totals", "select count(*) as queries, count(*) filter (event_type <> 'error') as ok, count(*) filter (event_type = 'error') as failed, sum(value::decimal(38,4)) as total from events")
def usage_totals(spark, folder):
    return usage(spark.read.parquet(f"{folder}/events.parquet"), "ts", "value", F.col("event_type") != "error")


def usage(log: DataFrame, at: str, seconds: str, ok: Column, every: str | None = None) -> DataFrame:
    """Queries, successes, failures and total time of a log, in all or for ``every`` minute, hour or day."""
    parts = [F.count("*").alias("queries"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum(F.col(seconds).cast("decimal(38,4)")).alias("total")]
    return log.agg(*parts) if every is None else log.groupBy(F.date_trunc(every, at).cast("timestamp_ntz").alias(every)).agg(*parts)
