"""Metric definitions and plain aggregates over observations.

An observation is a row (ts timestamp, metric string, labels map<string,string>, value double):
one measured value of a histogram, one increment of a counter or one setting of a gauge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from shelfmark.functions.histogram import cumulative_counts, with_bucket_quantile
from shelfmark.operators.ranking import in_order, join_groups


@dataclass(frozen=True)
class Metric:
    kind: str  # histogram, counter or gauge
    labels: tuple[str, ...]
    bounds: tuple[float, ...] = ()


_SCAN = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
_SCORE = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

# Names, labels and bucket bounds of the recorded metrics.
METRICS: dict[str, Metric] = {
    "db_query_seconds": Metric(
        "histogram", ("query_type",), (0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
    ),
    "hnsw_stage1_scan_seconds": Metric("histogram", ("top_k",), _SCAN),
    "hnsw_stage2_rerank_seconds": Metric("histogram", ("top_k",), _SCAN),
    "llm_time_to_first_token_seconds": Metric(
        "histogram", ("model_name",), (0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 15.0, 30.0)
    ),
    "llm_generation_seconds": Metric(
        "histogram", ("model_name",), (0.5, 1.0, 2.0, 4.0, 8.0, 15.0, 30.0, 60.0)
    ),
    "llm_faithfulness_score": Metric("histogram", ("model_name",), _SCORE),
    "llm_answer_relevance_score": Metric("histogram", ("model_name",), _SCORE),
    "search_execution_seconds": Metric(
        "histogram", ("has_vector", "category_filter"), (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
    ),
    "embedding_encode_seconds": Metric(
        "histogram", ("model_name",), (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25)
    ),
    "search_results_returned": Metric(
        "histogram", ("search_type",), (0.0, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0, 50.0)
    ),
    "http_request_duration_seconds": Metric(
        "histogram",
        ("method", "endpoint", "status_code"),
        (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0),
    ),
    "llm_tokens_total": Metric("counter", ("model_name", "token_type")),
    "llm_errors_total": Metric("counter", ("model_name", "error_type")),
    "search_requests_total": Metric("counter", ("search_type",)),
    "search_errors_total": Metric("counter", ("search_type", "error_type")),
    "http_requests_total": Metric("counter", ("method", "endpoint", "status_code")),
    "hnsw_recall_rate": Metric("gauge", ("k",)),
    "pg_buffer_hit_ratio": Metric("gauge", ()),
    "embedding_drift_score": Metric("gauge", ("category",)),
}


def histogram(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """One row per label set: cumulative bucket counts, number and sum of the values."""
    return df.groupBy(*labels).agg(
        cumulative_counts(F.col(value), bounds).alias("cumulative"),
        F.count(value).alias("total"),
        F.sum(value).alias("sum"),
    )


def histogram_rows(hist: DataFrame, labels: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """The buckets of ``histogram`` as rows (labels, le, bucket_count, total, sum)."""
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    return hist.select(
        *labels, F.explode(F.arrays_zip(edges.alias("le"), F.col("cumulative").alias("n"))).alias("b"),
        "total", "sum",
    ).select(*labels, F.col("b.le").alias("le"), F.col("b.n").alias("bucket_count"), "total", "sum")


def histogram_quantiles(
    hist: DataFrame, labels: Sequence[str], bounds: Sequence[float], quantiles: dict[str, float]
) -> DataFrame:
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    counts = [F.get("cumulative", F.lit(i)) for i in range(len(bounds))]
    for name, q in quantiles.items():
        hist = with_bucket_quantile(hist, name, q, edges, counts, F.col("total"))
    return hist.select(*labels, *quantiles)


def counter_totals(df: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(value).alias("total"))


def latest_by(df: DataFrame, labels: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last known value per label set; nulls do not replace a value."""
    newest = F.max_by(F.col(value), F.struct(*order))
    return df.filter(F.col(value).isNotNull()).groupBy(*labels).agg(newest.alias("value"))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows that meet ``condition``."""
    return F.count_if(condition) / F.count("*")


def windowed_rate(
    df: DataFrame, labels: Sequence[str], lookback: str, step: str | None = None
) -> DataFrame:
    """Events per second in tumbling or sliding windows of ``lookback``; batch or streaming."""
    window = F.window("ts", lookback, step) if step else F.window("ts", lookback)
    return with_rate(df.groupBy(window.alias("w"), *labels).agg(F.count("*").alias("events")), labels)


def with_rate(counted: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Events per second of ``events`` counted per window ``w`` and label set."""
    seconds = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *labels,
        "events",
        (F.col("events") / seconds).alias("per_second"),
    )


def counter_increase(
    samples: DataFrame, labels: Sequence[str], order: Sequence[str], value: str, slot: str = "1 hour"
) -> DataFrame:
    """Growth of a sampled counter with resets, per label set and time slot.

    A value below its predecessor means the counter restarted, so all of it is new. ``order``
    starts with the time and is unique within a label set. The samples are walked in pieces of
    one range partition; the first sample of a piece is compared with the last one of the piece
    before, found among one row per piece, so no label set is walked in one task.
    """
    rows = in_order(samples.select(*labels, *order, value), [*labels, *order])
    lasts = rows.groupBy(*labels, "_pid").agg(F.max_by(value, "_row").alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(*labels).orderBy("_pid"))
    lasts = lasts.select(*labels, "_pid", earlier.alias("_before"))
    piece = Window.partitionBy(*labels, "_pid").orderBy("_row")
    previous = F.coalesce(F.lag(value).over(piece), F.col("_before"))
    grown = (
        F.when(previous.isNull(), 0.0)
        .when(F.col(value) < previous, F.col(value))
        .otherwise(F.col(value) - previous)
    )
    return (
        join_groups(rows, lasts, [*labels, "_pid"])
        .withColumn("_grown", grown)
        .groupBy(*labels, F.window(order[0], slot)["start"].alias("slot_start"))
        .agg(F.sum("_grown").alias("increase"))
    )
