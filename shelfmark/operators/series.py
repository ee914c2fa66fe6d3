"""Time series computed from observations: rates, ratios and bucket quantiles at fixed ticks.

At tick t a lookback of d covers the observations with t - d <= ts < t, as in a Spark time
window that ends at t. Ticks are multiples of the interval since the epoch. A series has a value
only at ticks whose lookback holds an observation; gauges keep their last value up to the newest observation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, SparkSession, Window

from shelfmark.operators.metrics import METRICS
from shelfmark.operators.ranking import in_order, join_groups


@dataclass(frozen=True)
class Series:
    """``kind``: quantile, rate, ratio, complement (1 - ratio), gauge or silence."""

    name: str
    kind: str
    metric: str
    by: tuple[str, ...] = ()
    where: dict[str, str] = field(default_factory=dict)  # label -> regular expression
    lookback: int = 300
    interval: int = 30
    quantile: float | None = None
    scale: float = 1.0
    total_metric: str | None = None  # denominator of a ratio; the same metric when absent
    epsilon: float = 0.0

    def __post_init__(self):
        if self.lookback % self.interval:
            raise ValueError(f"{self.name}: lookback must be a multiple of the interval")
        if self.metric not in METRICS:
            raise ValueError(f"{self.name}: unknown metric {self.metric}")


def label_text(by: Sequence[str]) -> Column:
    """Label values as ``name=value`` pairs in the given order."""
    if not by:
        return F.lit("")
    return F.concat_ws(
        ",", *[F.concat(F.lit(f"{b}="), F.coalesce(F.col("labels")[b], F.lit(""))) for b in by]
    )


def _matches(series: Sequence[Series]) -> Column:
    """Whether an observation passes the label filters of the series it was joined to."""
    cond = F.lit(True)
    for s in series:
        kept = F.lit(True)
        for name, pattern in s.where.items():
            kept = kept & F.coalesce(F.col("labels")[name].rlike(f"^(?:{pattern})$"), F.lit(False))
        if s.where:
            here = (F.col("series") == s.name) & (F.col("role") == "part")
            cond = cond & (~here | kept)
    return cond


def _labels(series: Sequence[Series]) -> Column:
    text = F.lit("")
    for by in {s.by for s in series if s.by}:
        names = [s.name for s in series if s.by == by]
        text = F.when(F.col("series").isin(names), label_text(by)).otherwise(text)
    return text


def _widest(series: Sequence[Series]) -> int:
    return max((len(METRICS[s.metric].bounds) for s in series if s.kind == "quantile"), default=0)


def _bound_values(s: Series, width: int) -> list[float]:
    bounds = list(METRICS[s.metric].bounds) if s.kind == "quantile" else []
    return bounds + [float("inf")] * (width - len(bounds))


def _bound_columns(width: int) -> str:
    return "".join(f", b{i} double" for i in range(width))


def _sources(spark: SparkSession, series: Sequence[Series]) -> DataFrame:
    """Which metric feeds which series, with what role: one or two rows per series."""
    width = _widest(series)
    rows = []
    for s in series:
        sources = [(s.metric, "part")]
        if s.kind in ("ratio", "complement"):
            sources.append((s.total_metric or s.metric, "whole"))
        for metric, role in sources:
            counter = METRICS[metric].kind == "counter"
            rows.append((metric, s.name, role, s.interval, s.lookback, counter, *_bound_values(s, width)))
    return spark.createDataFrame(
        rows,
        "metric string, series string, role string, interval int, lookback int, counter boolean"
        + _bound_columns(width),
    )


def _settings(spark: SparkSession, series: Sequence[Series]) -> DataFrame:
    rows = [
        (s.name, s.kind, float(s.scale), float(s.epsilon), s.quantile, list(METRICS[s.metric].bounds))
        for s in series
    ]
    return spark.createDataFrame(
        rows, "series string, kind string, scale double, epsilon double, q double, bounds array<double>"
    )


def feed(observations: DataFrame, series: Sequence[Series], *keep: str) -> DataFrame:
    """A row per observation and series it feeds, ready to be summed: one scan for all series.

    The table of series has a row or two per series, so it is broadcast.
    """
    sources = _sources(observations.sparkSession, series)
    amount = F.when(F.col("counter"), F.col("value")).otherwise(F.lit(1.0))
    bounds = [f"b{i}" for i in range(_widest(series))]
    return (
        observations.join(F.broadcast(sources), "metric")
        .filter(_matches(series))
        .select(
            *keep, "value", amount.alias("_amount"), "series", _labels(series).alias("labels"),
            "interval", "lookback", "role", *bounds,
        )
    )


def sums() -> dict[str, Column]:
    """Aggregates over fed rows that later add up: count, numerator and whole."""
    part, whole = F.col("role") == "part", F.col("role") == "whole"
    return {
        "n": F.count_if(part),
        "part": F.sum(F.when(part, F.col("_amount")).otherwise(0.0)),
        "whole": F.sum(F.when(whole, F.col("_amount")).otherwise(0.0)),
    }


def cumulative_sums(series: Sequence[Series]) -> dict[str, Column]:
    """Observations at or below each bucket bound, a column per bound."""
    return {f"c{i}": F.count_if(F.col("value") <= F.col(f"b{i}")) for i in range(_widest(series))}


def plain_value() -> Column:
    """Value of a rate, ratio or complement from the sums of its lookback."""
    rate = F.col("part") / F.col("lookback")
    ratio = F.try_divide(rate, F.col("whole") / F.col("lookback") + F.col("epsilon"))
    kind = F.col("kind")
    return (
        F.when(kind == "rate", rate * F.col("scale"))
        .when(kind == "ratio", ratio)
        .when(kind == "complement", 1 - ratio)
    )


def with_settings(df: DataFrame, series: Sequence[Series]) -> DataFrame:
    return df.join(F.broadcast(_settings(df.sparkSession, series)), "series")


def slot_counts(observations: DataFrame, series: Sequence[Series]) -> DataFrame:
    """Sums per series, label set, interval slot and bucket, in one scan and one combining
    shuffle. The result follows the time span, not the number of observations.

    ``bucket`` is the number of bounds below the value, so three sums serve every histogram:
    a sum per bound would make a method too long for the JVM to compile.
    """
    fed = feed(observations.withColumn("_sec", F.unix_seconds("ts")), series, "_sec")
    slot = F.col("interval") * (F.floor(F.col("_sec") / F.col("interval")) + 1)
    above = [(F.col("value") > F.col(f"b{i}")).cast("int") for i in range(_widest(series))]
    bucket = sum(above, F.lit(0))
    return fed.groupBy(
        "series", "labels", "interval", "lookback", slot.alias("slot"), bucket.alias("bucket")
    ).agg(*[c.alias(n) for n, c in sums().items()])


def windowed_series(observations: DataFrame, series: Sequence[Series]) -> DataFrame:
    """Values of the quantile, rate and ratio series: (series, labels, interval, tick, value)."""
    return windowed_values(slot_counts(observations, series), series)


def windowed_values(slots: DataFrame, series: Sequence[Series]) -> DataFrame:
    """``windowed_series`` from the ``slot_counts`` of its series.

    A quantile is read off in the one bucket of a tick that the rank falls into; the other kinds
    have a single bucket.
    """
    last = F.col("slot") + F.col("lookback") - F.col("interval")
    reached = F.sequence(F.col("slot"), last, F.col("interval").cast("bigint"))
    ticks = (
        slots.withColumn("tick", F.explode(reached))
        .groupBy("series", "labels", "interval", "lookback", "tick", "bucket")
        .agg(*[F.sum(c).alias(c) for c in sums()])
    )
    tick = Window.partitionBy("series", "labels", "tick")
    upto = tick.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counted = ticks.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(tick))
    ranked = with_settings(counted, series).withColumn("_rank", F.col("q") * F.col("_all"))
    below, bucket = F.col("_upto") - F.col("n"), F.col("bucket")
    reaching = (F.col("_upto") >= F.col("_rank")) & (below < F.col("_rank"))
    upper = F.get("bounds", bucket)
    lower = F.when(bucket > 0, F.get("bounds", bucket - 1)).otherwise(0.0)
    inside = lower + (upper - lower) * (F.col("_rank") - below) / F.col("n")
    quantile = (
        F.when(bucket >= F.size("bounds"), F.element_at("bounds", -1))
        .when((bucket == 0) & (upper <= 0), upper)
        .otherwise(inside)
    )
    value = F.when(F.col("kind") == "quantile", quantile).otherwise(plain_value())
    return ranked.filter((F.col("kind") != "quantile") | reaching).select(
        "series", "labels", "interval", "tick", value.alias("value")
    )


def gauge_series(observations: DataFrame, series: Sequence[Series]) -> DataFrame:
    """Last gauge setting seen by each tick: (series, labels, interval, tick, value)."""
    fed = feed(observations, series, "ts")
    tick = F.col("interval") * (F.floor(F.unix_seconds("ts") / F.col("interval")) + 1)
    return fed.groupBy("series", "labels", "interval", tick.alias("tick")).agg(
        F.max_by("value", F.struct("ts", "value")).alias("value")
    )


def carried(points: DataFrame, newest: Column) -> DataFrame:
    """Gauge points at every tick: a value stands until the next setting, the last one until ``newest``
    (in seconds).

    The next setting is looked up within pieces of a sorted order, and a piece knows the first tick of the piece after
    it; so the settings of one label set are not gathered in one task.
    """
    keys = ["series", "labels"]
    rows = in_order(points, [*keys, "tick"])
    firsts = rows.groupBy(*keys, "_pid").agg(F.min("tick").alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_pid"))
    placed = join_groups(rows, firsts.select(*keys, "_pid", after.alias("_after")), [*keys, "_pid"])
    inside = F.lead("tick").over(Window.partitionBy(*keys, "_pid").orderBy("_row"))
    interval = F.col("interval").cast("bigint")
    end = placed.withColumn("_next", F.coalesce(inside, F.col("_after"), interval * (F.floor(newest / interval) + 1)))
    ticks = F.sequence(F.col("tick"), F.greatest(F.col("tick"), F.col("_next") - interval), interval)
    return end.withColumn("tick", F.explode(ticks)).select(*points.columns)


def evaluate(observations: DataFrame, series: Sequence[Series]) -> DataFrame:
    """Series values at ticks, as (series, labels, tick timestamp, value)."""
    windowed = [s for s in series if s.kind not in ("gauge", "silence")]
    gauges = [s for s in series if s.kind == "gauge"]
    parts = []
    if windowed:
        parts.append(windowed_series(observations, windowed))
    if gauges:
        newest = observations.agg(F.max(F.unix_seconds("ts"))).scalar()
        parts.append(carried(gauge_series(observations, gauges), newest))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.select("series", "labels", F.timestamp_seconds("tick").alias("tick"), "value")
