"""The dashboard panels as series: one job evaluates any set of them in a single scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.operators.metrics import counter_totals, latest_by
from shelfmark.operators.series import Series, evaluate, label_text

STEP = 300  # seconds between two points of a panel


def _q(panel: str, metric: str, quantiles: Sequence[int], by: tuple[str, ...], lookback: int = 300):
    return [
        Series(f"{panel}_p{q}", "quantile", metric, by, {}, lookback, STEP, q / 100)
        for q in quantiles
    ]


def _tokens(kind: str, name: str, lookback: int, scale: float, by: tuple[str, ...]) -> Series:
    return Series(name, "rate", "llm_tokens_total", by, {"token_type": kind}, lookback, STEP, scale=scale)


MODEL = ("model_name",)

# What each panel shows. Points lie a lookback apart at most.
PANELS: list[Series] = [
    *_q("first_token", "llm_time_to_first_token_seconds", (50, 95, 99), MODEL),
    *_q("generation", "llm_generation_seconds", (50, 95), MODEL),
    _tokens("input", "tokens_in", 300, 1.0, MODEL),
    _tokens("output", "tokens_out", 300, 1.0, MODEL),
    _tokens("input", "tokens_in_last_hour", 3600, 3600.0, ()),
    _tokens("output", "tokens_out_last_hour", 3600, 3600.0, ()),
    *_q("faithfulness", "llm_faithfulness_score", (50, 10), MODEL, 600),
    *_q("relevance", "llm_answer_relevance_score", (50, 10), MODEL, 600),
    Series("llm_error_rate", "rate", "llm_errors_total", ("model_name", "error_type"), interval=STEP),
    Series(
        "llm_success", "complement", "llm_errors_total", MODEL, interval=STEP,
        total_metric="llm_generation_seconds", epsilon=1e-9,
    ),
    *_q("search", "search_execution_seconds", (50, 95, 99), ("has_vector",)),
    Series("search_rate", "rate", "search_requests_total", ("search_type",), interval=60, lookback=60),
    *_q("stage1", "hnsw_stage1_scan_seconds", (95,), ("top_k",)),
    *_q("stage2", "hnsw_stage2_rerank_seconds", (95,), ("top_k",)),
    *_q("db", "db_query_seconds", (95, 50), ("query_type",)),
    Series("search_error_rate", "rate", "search_errors_total", ("search_type", "error_type"), interval=STEP),
    *_q("http", "http_request_duration_seconds", (95,), ("endpoint",)),
    Series("http_rate", "rate", "http_requests_total", ("status_code",), interval=60, lookback=60),
    Series("recall", "gauge", "hnsw_recall_rate", ("k",), interval=STEP),
    Series("drift", "gauge", "embedding_drift_score", ("category",), interval=STEP),
]

# Colour bands as (colour below all limits, [(lower limit, colour), ...]).
BANDS: dict[str, tuple[str, list[tuple[float, str]]]] = {
    "first_token": ("green", [(4.0, "yellow"), (10.0, "red")]),
    "faithfulness": ("red", [(0.70, "yellow"), (0.85, "green")]),
    "relevance": ("red", [(0.70, "yellow"), (0.85, "green")]),
    "recall": ("red", [(0.80, "yellow"), (0.90, "green")]),
    "buffer_hit": ("red", [(0.85, "yellow"), (0.95, "green")]),
    "drift": ("green", [(0.10, "yellow"), (0.20, "red")]),
}


def panel_series(observations: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Points of the named panels (all by default): (series, labels, tick, value)."""
    known = {s.name: s for s in PANELS}
    unknown = [n for n in names or [] if n not in known]
    if unknown:
        raise ValueError(f"unknown panel(s) {unknown}")
    return evaluate(observations, [known[n] for n in names] if names else PANELS)


def cumulative_tokens(observations: DataFrame) -> DataFrame:
    """Tokens so far by type and model."""
    tokens = observations.filter(F.col("metric") == "llm_tokens_total").select(
        F.col("labels")["token_type"].alias("token_type"),
        F.col("labels")["model_name"].alias("model_name"),
        "value",
    )
    return counter_totals(tokens, ["token_type", "model_name"], "value")


def current_gauges(observations: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """Last non-null setting of a gauge per label set."""
    rows = observations.filter(F.col("metric") == metric).select(
        label_text(by).alias("labels"), "ts", "value"
    )
    return latest_by(rows, ["labels"], "value", ["ts", "value"])


def band(value: Column, name: str) -> Column:
    """Colour of the highest limit that ``value`` reaches."""
    base, limits = BANDS[name]
    colour = F.lit(base)
    for limit, above in limits:
        colour = F.when(value >= limit, F.lit(above)).otherwise(colour)
    return F.when(value.isNotNull(), colour)
