"""Streaming rates and histograms over event time, with a bound on lateness."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions.histogram import cumulative_counts
from shelfmark.operators.metrics import windowed_rate, with_rate

LATENESS = "10 minutes"
_UNITS = {
    "microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6,
    "day": 86400 * 10**6, "week": 7 * 86400 * 10**6,
}


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def in_event_time(df: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Zoned event time with a watermark; rows later than ``lateness`` are dropped."""
    return df.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", lateness)


def rates(
    events: DataFrame, labels: Sequence[str], lookback: str, step: str | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """The batch ``windowed_rate`` on a stream; a window is emitted once it is closed.

    Sliding windows are summed from tumbling ones, so an event makes one row of state and not one per window that
    it lies in.
    """
    timed = in_event_time(events, lateness=lateness)
    if step is None:
        return windowed_rate(timed, labels, lookback)
    pieces = timed.groupBy(F.window("ts", common_width(lookback, step)).alias("piece"), *labels).agg(
        F.count("*").alias("events")
    )
    summed = pieces.groupBy(F.window("piece", lookback, step).alias("w"), *labels).agg(
        F.sum("events").alias("events")
    )
    return with_rate(summed, labels)


def common_width(lookback: str, step: str) -> str:
    """The widest tumbling window that windows of ``lookback`` every ``step`` are made of."""
    wide, narrow = (microseconds_of(x) for x in (lookback, step))
    return f"{math.gcd(wide, narrow)} microseconds"


def microseconds_of(duration: str) -> int:
    """Microseconds of a duration as Spark's windows take it: pairs of a number and a unit up to weeks."""
    words = duration.lower().removeprefix("interval ").split()
    if not words or len(words) % 2:
        raise ValueError(f"no duration: {duration!r}")
    total = 0
    for number, unit in zip(words[::2], words[1::2]):
        total += int(number) * _UNITS[unit.removesuffix("s")]
    return total


def histograms(
    events: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float], window: str,
    lateness: str = LATENESS,
) -> DataFrame:
    """Cumulative bucket counts per window and label set."""
    timed = in_event_time(events, lateness=lateness)
    return (
        timed.groupBy(F.window("ts", window).alias("w"), *labels)
        .agg(
            cumulative_counts(F.col(value), bounds).alias("cumulative"),
            F.count(value).alias("total"),
            F.sum(value).alias("sum"),
        )
        .select(F.col("w.start").alias("window_start"), *labels, "cumulative", "total", "sum")
    )


@contextmanager
def state_partitions(spark: SparkSession, count: int | None) -> Iterator[None]:
    """Start streams with ``count`` state partitions. A stream keeps this number for good, so it
    is chosen for the stream and not left to the setting that batch jobs use."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if count:
        spark.conf.set(key, str(count))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None
) -> StreamingQuery:
    """Process everything there is now into a Parquet folder and stop.

    Started again with the same checkpoint it takes only what is new.
    """
    writer = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with state_partitions(stream.sparkSession, partitions):
        query = writer.start()
        query.awaitTermination()
    return query
