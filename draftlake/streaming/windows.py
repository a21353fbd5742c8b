"""Windowed counts over streams of events, with late data bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.runtime import remove_at_end, shared_folder

#: How long a window stays open for late rows.
LATE = "1 day"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time needs an instant; times without a zone are taken as UTC."""
    return events.withColumn("ts", instant(F.col("ts"))).withWatermark("ts", late)


def instant(ts: Column) -> Column:
    """A time without a zone as the instant of the same clock in UTC, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")))


def _plain(c: str) -> Column:
    """The clock of an instant in UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(c)), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Count and sum per window and event type. Rows without a time are in no window."""
    return (
        _timed(events, late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(_plain("w.start").alias("window_start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Count per overlapping window."""
    return _timed(events, late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(_plain("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions of each user: rows without a pause longer than the gap."""
    return (
        _timed(events, late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", _plain("w.start").alias("session_start"), _plain("w.end").alias("session_end"), "n")
    )


#: A time behind all others, whose row closes the windows before it and is in none that is written.
END = "9999-01-01 00:00:00"


def run_available(spark: SparkSession, path: str, plan) -> DataFrame:
    """All files under `path` read as a stream through `plan`; the written result.

    What is there is read in append mode: a window is written once, when the
    watermark closes it, so its state is freed and nothing is rewritten; rows
    later than the watermark are left out. A last row far in the future closes
    what is still open. State and output lie in the
    shared folder and go when the session ends.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    source = spark.read.parquet(path)
    last = [F.lit(END if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in source.schema.fields]
    spark.range(1).coalesce(1).select(*last).write.parquet(f"{folder}/end")
    # as a pattern the path may be a file as well as a folder of files; the last row comes in a second run of the same query
    for place in (f"{path[:-1]}[{path[-1]}]", f"{folder}/end"):
        stream = plan(spark.readStream.schema(source.schema).parquet(place))
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
