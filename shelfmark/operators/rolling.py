"""Rolling latency statistics over the last samples of each stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark import settings
from shelfmark.operators.ranking import rank_within, top_rows

SEGMENT = 10_000  # rows per window task; each segment also carries the rows before it


def _summary(samples: Column, n: Column) -> tuple[Column, Column]:
    """Upper median and the 95th percentile by position in the sorted samples."""
    last = n - 1
    p95 = F.least(F.floor(n * F.lit(0.95)).cast("int"), last)
    return samples[F.floor(n / 2).cast("int")], samples[p95]


def rolling_stats(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    window: int = settings.ROLLING_WINDOW,
    segment: int = SEGMENT,
) -> DataFrame:
    """p50, p95 and mean over the current and the ``window - 1`` preceding rows of the group.

    ``order`` must be unique within a group. Groups are cut into segments of fixed length by
    rank; the last ``window - 1`` rows of a segment are repeated in front of the next one, so a
    group of any size is spread over many tasks and every row still sees its full window.
    """
    ranked = rank_within(df, group, order)
    own = F.floor(F.col("_rank") / segment)
    tail = F.col("_rank") % segment >= segment - (window - 1)
    if window > segment:
        raise ValueError("segment must be at least as long as the window")
    spread = ranked.withColumn("_own", own).withColumn(
        "_segment", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = Window.partitionBy(*group, "_segment").orderBy("_rank").rowsBetween(-(window - 1), 0)
    samples = F.sort_array(F.collect_list(value).over(frame))
    withs = (
        spread.withColumn("_samples", samples)
        .withColumn("mean", F.avg(value).over(frame))
        .filter(F.col("_own") == F.col("_segment"))
        .withColumn("samples", F.size("_samples"))
    )
    p50, p95 = _summary(F.col("_samples"), F.col("samples"))
    return withs.select(*df.columns, p50.alias("p50"), p95.alias("p95"), "mean", "samples")


def latency_summary(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    window: int = settings.ROLLING_WINDOW,
) -> DataFrame:
    """The rolling statistics as they stand after the newest row of each group.

    Only the newest ``window`` rows of a group are shuffled.
    """
    newest = top_rows(df.select(*group, *order, value), group, [F.col(c).desc() for c in order], window)
    stats = newest.groupBy(*group).agg(
        F.sort_array(F.collect_list(value)).alias("_samples"),
        F.avg(value).alias("mean"),
        F.count(value).cast("int").alias("samples"),
    )
    p50, p95 = _summary(F.col("_samples"), F.col("samples"))
    return stats.select(*group, p50.alias("p50"), p95.alias("p95"), "mean", "samples")
