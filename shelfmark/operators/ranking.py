"""Order statistics that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import materialize

ROW_BITS = 33  # monotonically_increasing_id keeps the row of a partition in its low 33 bits


def in_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Globally sort by ``keys`` and number the rows: ``_pid`` (partition) and ``_row``.

    The range shuffle splits on the whole key, so a hot leading value spreads over several
    partitions as long as the later keys differ. The result is materialised, because the
    partition numbers must be the same wherever they are used.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    position = F.monotonically_increasing_id()
    return materialize(ordered.withColumn("_pos", position)).select(
        *df.columns,
        F.shiftright("_pos", ROW_BITS).alias("_pid"),
        F.col("_pos").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )


def join_groups(rows: DataFrame, info: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``info``, one row per ``keys``, to ``rows``; a null key is a key too."""
    renamed = info.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in info.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return rows.join(renamed, same).drop(*[f"_k_{k}" for k in keys])


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_rank``: the 0-based position of a row within its group.

    A group is numbered piece by piece: its rows of one range partition are contiguous, so the
    rank is the size of the earlier pieces plus the offset inside the piece. The pieces number
    at most one per (group, partition), and no group passes through one task.
    """
    rows = in_order(df, [*group, *order])
    pieces = rows.groupBy(*group, "_pid").agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first")
    )
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *group, "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        join_groups(rows, offsets, [*group, "_pid"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - F.col("_first"))
        .drop("_pid", "_row", "_first", "_before")
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of a column in one row, a column per entry of ``probabilities``.

    Equal values are counted first (map-side), the distinct values are range-partitioned, and
    only the partitions that hold a wanted rank are walked. Nulls are ignored.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(
        F.count("*").alias("_n")
    )
    rows = in_order(counted, ["_v"])
    parts = rows.groupBy("_pid").agg(F.sum("_n").alias("_size"))
    # One row per range partition: a few thousand at the most, whatever the table holds.
    running = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(1))
    spans = parts.select(
        "_pid",
        (F.sum("_size").over(running) - F.col("_size")).alias("_from"),
        F.sum("_size").over(running).alias("_to"),
        F.sum("_size").over(everything).alias("_total"),
    )

    def target(p: float) -> Column:
        return F.lit(p) * (F.col("_total") - 1)

    def wanted(low: str, high: str) -> Column:
        hit = F.lit(False)
        for p in probabilities.values():
            for rank in (F.floor(target(p)), F.ceil(target(p))):
                hit = hit | ((rank >= F.col(low)) & (rank < F.col(high)))
        return hit

    walk = Window.partitionBy("_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        rows.join(F.broadcast(spans.filter(wanted("_from", "_to"))), "_pid")
        .withColumn("_hi", F.col("_from") + F.sum("_n").over(walk))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .filter(wanted("_lo", "_hi"))
    )

    def at(rank: Column) -> Column:
        inside = (rank >= F.col("_lo")) & (rank < F.col("_hi"))
        return F.max(F.when(inside, F.col("_v").cast("double")))

    def quantile(p: float) -> Column:
        t = target(p)
        low, high = at(F.floor(t)), at(F.ceil(t))
        return low + (high - low) * F.max(t - F.floor(t))

    return ranked.agg(*[quantile(p).alias(name) for name, p in probabilities.items()])


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group; ``_pos`` is the 1-based place.

    Spark limits each group before the shuffle, so a hot group sends n rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(window)).filter(F.col("_pos") <= n)


def last_by(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``sequence``.

    An aggregate, not a window: repeats of a hot key combine before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*sequence))
    return df.groupBy(*keys).agg(picked.alias("_last")).select(
        *keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest]
    ).select(*df.columns)
