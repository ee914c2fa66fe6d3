"""Bucketed histograms and quantiles interpolated from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def cumulative_counts(value: Column, bounds: Sequence[float]) -> Column:
    """Aggregate: observations at or below each bound, as one array, in a single pass."""
    return F.array(*[F.count_if(value <= F.lit(float(b))) for b in bounds])


def with_bucket_quantile(
    df: DataFrame, name: str, q: Column | float, bounds: Column, counts: Sequence[Column], total: Column
) -> DataFrame:
    """Add a quantile by linear interpolation inside the first bucket that reaches the rank.

    ``counts`` are cumulative, one per bound. The first bucket starts at 0, or is taken at its
    bound when that is not positive. A rank beyond the last bound gives that bound; ``bounds``
    may be shorter than ``counts``, whose further entries then hold the total. No observations
    give null. Filters on the result are best put on ``total``: pushed below, they would repeat
    the whole computation.
    """
    rank = (q if isinstance(q, Column) else F.lit(q)) * total
    # Cumulative counts never fall, so the place of the bucket is how many of them are too small.
    place = sum(((c < F.col("_rank")).cast("int") for c in counts), F.lit(0))
    at, all_counts = F.col("_place"), F.array(*counts)
    upper, count = F.get(bounds, at), F.get(all_counts, at)
    lower = F.when(at > 0, F.get(bounds, at - 1)).otherwise(0.0)
    below = F.when(at > 0, F.get(all_counts, at - 1)).otherwise(0)
    inside = lower + (upper - lower) * (F.col("_rank") - below) / F.greatest(count - below, F.lit(1))
    value = (
        F.when(at >= F.size(bounds), F.element_at(bounds, -1))
        .when((at == 0) & (upper <= 0), upper)
        .otherwise(inside)
    )
    return (
        df.withColumn("_rank", F.when(total > 0, rank))
        .withColumn("_place", place)
        .withColumn(name, F.when(F.col("_rank").isNotNull(), value))
        .drop("_rank", "_place")
    )
