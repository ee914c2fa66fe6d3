"""Alert rules: threshold, hold time, routing. Batch evaluation over observations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from shelfmark.operators.series import Series, gauge_series, slot_counts, windowed_values
from shelfmark.session import scratch_path


@dataclass(frozen=True)
class Rule:
    name: str
    series: Series
    compare: str  # ">", "<" or "=="
    threshold: float
    hold: int  # seconds the condition must last
    severity: str
    team: str
    channel: str


_SEARCH = "#alerts-semantic-search"
_LLM = "#alerts-llm"
_DATA, _ML = "data-engineering", "ml-engineering"


def _quantile(name, metric, q, by=(), where=None, lookback=300, interval=30) -> Series:
    return Series(name, "quantile", metric, tuple(by), where or {}, lookback, interval, q)


SEARCH_P95 = _quantile("search_p95", "search_execution_seconds", 0.95, where={"has_vector": "True"})
STAGE1_P95 = _quantile("stage1_p95", "hnsw_stage1_scan_seconds", 0.95)
DB_P95 = _quantile("db_p95", "db_query_seconds", 0.95, by=["query_type"])
RECALL = Series("recall", "gauge", "hnsw_recall_rate", ("k",), interval=60)
BUFFER_HIT = Series("buffer_hit", "gauge", "pg_buffer_hit_ratio", interval=60)
TTFT_P95 = _quantile("ttft_p95", "llm_time_to_first_token_seconds", 0.95, by=["model_name"])
GENERATION_P95 = _quantile("generation_p95", "llm_generation_seconds", 0.95, by=["model_name"])
LLM_ERRORS = Series(
    "llm_errors", "ratio", "llm_errors_total", ("model_name",), interval=30,
    total_metric="llm_generation_seconds", epsilon=1e-9,
)
INPUT_TOKENS = Series(
    "input_tokens_per_minute", "rate", "llm_tokens_total", ("model_name",), {"token_type": "input"},
    interval=60, scale=60.0,
)
FAITHFULNESS_P10 = _quantile(
    "faithfulness_p10", "llm_faithfulness_score", 0.10, by=["model_name"], lookback=1800, interval=300
)
RELEVANCE_P10 = _quantile(
    "relevance_p10", "llm_answer_relevance_score", 0.10, by=["model_name"], lookback=1800, interval=300
)
DRIFT = Series("drift", "gauge", "embedding_drift_score", ("category",), interval=300)
HTTP_ERRORS = Series(
    "http_errors", "ratio", "http_requests_total", where={"status_code": "5.."}, interval=15
)
HTTP_SILENCE = Series("http_silence", "silence", "http_requests_total", interval=15)

# Thresholds, hold times in seconds and routing of the alert rules.
RULES: list[Rule] = [
    Rule("SearchLatencyHighCritical", SEARCH_P95, ">", 2.0, 180, "critical", _DATA, _SEARCH),
    Rule("SearchLatencyHighWarning", SEARCH_P95, ">", 1.0, 300, "warning", _DATA, _SEARCH),
    Rule("HNSWScanLatencyHigh", STAGE1_P95, ">", 0.5, 300, "warning", _DATA, _SEARCH),
    Rule("DBQueryLatencyHigh", DB_P95, ">", 1.0, 300, "warning", _DATA, _SEARCH),
    Rule("HNSWRecallRateLow", RECALL, "<", 0.85, 600, "warning", _DATA, _SEARCH),
    Rule("HNSWRecallRateCritical", RECALL, "<", 0.75, 300, "critical", _DATA, _SEARCH),
    Rule("PGBufferHitRatioLow", BUFFER_HIT, "<", 0.90, 600, "warning", _DATA, _SEARCH),
    Rule("LLMTTFTHigh", TTFT_P95, ">", 5.0, 300, "warning", _ML, _LLM),
    Rule("LLMGenerationLatencyHigh", GENERATION_P95, ">", 30.0, 300, "critical", _ML, _LLM),
    Rule("LLMErrorRateHigh", LLM_ERRORS, ">", 0.05, 300, "critical", _ML, _LLM),
    Rule("TokenConsumptionSpike", INPUT_TOKENS, ">", 10000.0, 180, "warning", _ML, _LLM),
    Rule("LLMFaithfulnessLow", FAITHFULNESS_P10, "<", 0.60, 900, "warning", _ML, _LLM),
    Rule("LLMAnswerRelevanceLow", RELEVANCE_P10, "<", 0.60, 900, "warning", _ML, _LLM),
    Rule("EmbeddingDriftWarning", DRIFT, ">", 0.10, 0, "warning", _DATA, _SEARCH),
    Rule("EmbeddingDriftCritical", DRIFT, ">", 0.20, 0, "critical", _DATA, _SEARCH),
    Rule("APIHighErrorRate", HTTP_ERRORS, ">", 0.01, 120, "critical", _DATA, _SEARCH),
    Rule("APINoTraffic", HTTP_SILENCE, "==", 0.0, 300, "warning", _DATA, _SEARCH),
]


def holds(value: Column, compare: Column, threshold: Column) -> Column:
    return (
        F.when(compare == ">", value > threshold)
        .when(compare == "<", value < threshold)
        .otherwise(value == threshold)
    )


def under_rules(ticks: DataFrame, rules: Sequence[Rule], *keep: str) -> DataFrame:
    """Each tick once per rule on its series, with ``_true`` for the condition."""
    table = ticks.sparkSession.createDataFrame(
        [(r.series.name, r.name, r.compare, float(r.threshold), r.hold) for r in rules],
        "series string, rule string, compare string, threshold double, hold int",
    )
    return ticks.join(F.broadcast(table), "series").select(
        *keep, "rule", "labels", "interval", "tick", "value", "hold",
        holds(F.col("value"), F.col("compare"), F.col("threshold")).alias("_true"),
    )


def _runs_of_ticks(ticks: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Unbroken runs of ticks at which the condition is true. A tick without a value breaks a run.

    The window walks ticks of one rule and label set: its length is the time span over the
    interval, whatever the traffic.
    """
    true = under_rules(ticks, rules).filter("_true")
    place = F.row_number().over(Window.partitionBy("rule", "labels").orderBy("tick"))
    numbered = true.withColumn("_run", F.expr("tick div interval") - place)
    return _fired(numbered, F.col("tick"))


def _steps() -> Column:
    """Ticks from the start of a run to its firing: the hold, rounded up to the interval."""
    return F.ceil(F.col("hold") / F.col("interval")).cast("bigint")


def _fired(rows: DataFrame, until: Column) -> DataFrame:
    """Runs that last as long as their hold, with the value seen at the firing tick.

    ``rows`` carry ``_run`` next to (rule, labels); the earlier window over (rule, labels) has
    already placed a run in one task, so neither the window nor the aggregate shuffles again.
    """
    run = Window.partitionBy("rule", "labels", "_run")
    fire = F.col("started") + _steps() * F.col("interval")
    seen = F.when(F.col("tick") <= F.col("fired"), F.struct("tick", "value"))
    return (
        rows.withColumn("started", F.min("tick").over(run))
        .withColumn("fired", fire)
        .groupBy("rule", "labels", "_run", "started", "fired")
        .agg(F.max(until).alias("ended"), F.max(seen)["value"].alias("value"))
        .filter(F.col("fired") <= F.col("ended"))
        .select("rule", "labels", "started", "fired", "ended", "value")
    )


def _runs_of_gauges(ticks: DataFrame, rules: Sequence[Rule], end: Column) -> DataFrame:
    """Runs for gauges: a setting lasts until the next one, the newest until ``end``."""
    order = Window.partitionBy("rule", "labels").orderBy("tick")
    judged = (
        under_rules(ticks, rules)
        .withColumn("_end", F.col("interval") * F.floor(end / F.col("interval")))
        .withColumn("_until", F.coalesce(F.lead("tick").over(order) - F.col("interval"), "_end"))
        .withColumn("_until", F.greatest("_until", "tick"))
        .withColumn("_prior", F.lag("_true").over(order))
        .withColumn(
            "_run",
            F.sum(F.when(F.col("_true") & ~F.coalesce("_prior", F.lit(False)), 1).otherwise(0)).over(
                order.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .filter("_true")
    )
    return _fired(judged, F.col("_until"))


def silent_runs(observations: DataFrame, s: Series, until: Column | None = None) -> DataFrame:
    """Stretches of ticks whose lookback holds no observation of the series.

    A silence that still lasts ends at the tick after ``until`` (in seconds; by default the newest
    observation of any metric). Works on distinct interval slots, so silence needs no time spine.
    """
    if until is None:
        until = observations.agg(F.max(F.unix_seconds("ts"))).scalar()
    return _silent(slot_counts(observations, [s]), s, until)


def _silent(slots: DataFrame, s: Series, until: Column) -> DataFrame:
    after = F.lit(s.interval) * (F.floor(until / F.lit(s.interval)) + 2)
    nxt = F.lead("slot").over(Window.partitionBy("labels").orderBy("slot"))
    return (
        slots.select("labels", "slot").distinct()
        .withColumn("_next", F.coalesce(nxt, after))
        .filter(F.col("_next") - F.col("slot") > s.lookback)
        .select(
            "labels",
            (F.col("slot") + s.lookback).alias("started"),
            (F.col("_next") - s.interval).alias("ended"),
        )
    )


def _runs_of_silence(slots: DataFrame, rule: Rule, until: Column) -> DataFrame:
    interval = rule.series.interval
    fired = F.col("started") + -(-rule.hold // interval) * interval
    return (
        _silent(slots, rule.series, until)
        .withColumn("fired", fired)
        .filter(F.col("fired") <= F.col("ended"))
        .select(
            F.lit(rule.name).alias("rule"), "labels", "started", "fired", "ended",
            F.lit(0.0).alias("value"),
        )
    )


def route(fired: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Add severity, team, channel and a message to firing rows."""
    info = F.create_map(
        *[
            x
            for r in rules
            for x in (
                F.lit(r.name),
                F.struct(
                    F.lit(r.severity).alias("severity"), F.lit(r.team).alias("team"),
                    F.lit(r.channel).alias("channel"), F.lit(r.compare).alias("compare"),
                    F.lit(float(r.threshold)).alias("threshold"),
                ),
            )
        ]
    )
    message = F.format_string(
        "%s%s: %.4f %s %.4f", F.col("rule"),
        F.when(F.col("labels") == "", "").otherwise(F.concat(F.lit(" ["), F.col("labels"), F.lit("]"))),
        F.col("value"), F.col("i.compare"), F.col("i.threshold"),
    )
    rest = [c for c in fired.columns if c not in ("rule", "labels", "value")]
    return fired.withColumn("i", F.element_at(info, F.col("rule"))).select(
        "rule", "labels", *rest, "value", "i.severity", "i.team", "i.channel", message.alias("message")
    )


def _stored_slots(observations: DataFrame, series: Sequence[Series]) -> tuple[DataFrame, Column]:
    """The ``slot_counts`` of the series, stored, and the second of the newest observation of any metric, seen on the way."""
    spark = observations.sparkSession
    seen, path = Observation(), scratch_path(spark, "slots")
    watched = observations.observe(seen, F.max(F.unix_seconds("ts")).alias("newest"))
    slots = slot_counts(watched, series)
    slots.write.parquet(path)
    return spark.read.schema(slots.schema).parquet(path), F.lit(seen.get["newest"]).cast("bigint")


def alerts_fired(observations: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Every firing of every rule: when its condition began, when it fired, when it last held.

    The observations are read once for all windowed and silence rules, and once more for the gauges. Runs the job of
    the first reading, whose sums are stored: they follow the time span and not the traffic.
    """

    def of(kinds) -> tuple[list[Rule], list[Series]]:
        chosen = [r for r in rules if kinds(r.series.kind)]
        return chosen, list({r.series.name: r.series for r in chosen}.values())

    windowed, series = of(lambda k: k not in ("gauge", "silence"))
    silent, quiet = of(lambda k: k == "silence")
    gauges, settings = of(lambda k: k == "gauge")
    if series or quiet:
        slots, newest = _stored_slots(observations, [*series, *quiet])
    else:
        newest = observations.agg(F.max(F.unix_seconds("ts"))).scalar()
    parts = []
    if windowed:
        names = [s.name for s in series]
        parts.append(_runs_of_ticks(windowed_values(slots.filter(F.col("series").isin(names)), series), windowed))
    if gauges:
        parts.append(_runs_of_gauges(gauge_series(observations, settings), gauges, newest))
    parts += [_runs_of_silence(slots.filter(F.col("series") == r.series.name), r, newest) for r in silent]
    fired = parts[0]
    for p in parts[1:]:
        fired = fired.unionByName(p)
    times = [F.timestamp_seconds(c).alias(f"{c}_at") for c in ("started", "fired", "ended")]
    return route(fired.select("rule", "labels", *times, "value"), rules)
