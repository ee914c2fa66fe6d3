"""Drift of embedding distributions: Jensen-Shannon divergence per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

BINS = 20  # equal bins on [-1, 1] per dimension


def bin_shares(df: DataFrame, groups: list[str], share: str, bins: int = BINS) -> DataFrame:
    """Share of values per (groups, dimension, bin). Counts combine before the shuffle, so the
    shuffled size follows groups x dimensions x bins, not the rows."""
    place = F.floor((F.col("_x").cast("double") + 1) / 2 * bins).cast("int")
    counted = (
        df.select(*groups, F.posexplode("embedding").alias("_dim", "_x"))
        .groupBy(*groups, "_dim", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).alias("_bin"))
        .agg(F.count("*").alias("_n"))
    )
    everything = F.sum("_n").over(Window.partitionBy(*groups, "_dim"))
    return counted.select(*groups, "_dim", "_bin", (F.col("_n") / everything).alias(share))


def embedding_drift(
    current: DataFrame, baseline: DataFrame, category: str = "category", bins: int = BINS
) -> DataFrame:
    """Base-2 divergence of ``current`` from ``baseline`` per category, mean over dimensions.

    ``baseline`` is matched by category when it has that column, else it serves every category.
    Bins without current values add half of their baseline share, which is what the matched
    bins leave of it, so a left join is enough. A category that only the baseline has diverges
    by 1, as does one that only ``current`` has.
    """
    matched = [category] if category in baseline.columns else []
    p = bin_shares(current, [category], "_p", bins)
    q = bin_shares(baseline, matched, "_q", bins)

    def half_kl(share: str) -> Column:
        mean = (F.col("_p") + F.col("_q")) / 2
        return F.when(F.col(share) > 0, F.col(share) / 2 * F.log2(F.col(share) / mean)).otherwise(0.0)

    joined = p.join(q, [*matched, "_dim", "_bin"], "left").withColumn("_q", F.coalesce("_q", F.lit(0.0)))
    per_dim = joined.groupBy(category, "_dim").agg(
        (F.sum(half_kl("_p") + half_kl("_q")) + (1 - F.sum("_q")) / 2).alias("_js")
    )
    drift = per_dim.groupBy(category).agg(F.avg("_js").alias("js_divergence"))
    if not matched:
        return drift
    gone = q.select(category).distinct().join(p.select(category).distinct(), category, "left_anti")
    return drift.unionByName(gone.withColumn("js_divergence", F.lit(1.0)))
