"""Alert rules on a stream: windowed values, then the hold of each rule as keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.functions.histogram import with_bucket_quantile
from shelfmark.operators.alerts import Rule, under_rules
from shelfmark.operators.series import (
    Series, cumulative_sums, feed, plain_value, sums, with_settings,
)
from shelfmark.streaming.windows import LATENESS, in_event_time

FIRED = "rule string, labels string, started bigint, fired bigint, value double"
SILENT = "rule string, labels string, started bigint, fired bigint"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def stream_values(observations: DataFrame, series: Sequence[Series], lateness: str = LATENESS) -> DataFrame:
    """Series values per tick from a stream. All series share one lookback and interval."""
    spans = {(s.lookback, s.interval) for s in series}
    if len(spans) != 1:
        raise ValueError("one stream serves one lookback and interval")
    lookback, interval = spans.pop()
    fed = feed(in_event_time(observations, lateness=lateness), series, "ts")
    # A stream cannot rank buckets in a window, so it sums each bound in a column of its own.
    counts = cumulative_sums(series)
    added = {**counts, **sums()}
    keys = ["series", "labels", "interval", "lookback"]
    # Slots of an interval first, then the lookback over slots: state doesn't grow with lookback / interval.
    slots = fed.groupBy(F.window("ts", f"{interval} seconds").alias("slot"), *keys).agg(
        *[c.alias(n) for n, c in added.items()]
    )
    window = F.window("slot", f"{lookback} seconds", f"{interval} seconds")
    summed = slots.groupBy(window.alias("w"), *keys).agg(*[F.sum(n).alias(n) for n in added])
    ticks = with_settings(summed, series).withColumn("value", plain_value())
    if counts:
        cumulative = [F.col(c) for c in counts]
        ticks = with_bucket_quantile(ticks, "_q", F.col("q"), F.col("bounds"), cumulative, F.col("n"))
        quantile = F.when(F.col("kind") == "quantile", F.col("_q"))
        ticks = ticks.withColumn("value", F.coalesce(quantile, F.col("value")))
    return ticks.select(
        F.window_time("w").alias("ts"), "series", "labels", "interval",
        F.unix_seconds("w.end").alias("tick"), "value",
    )


class Hold(StatefulProcessor):
    """Fires once when a condition has been true at consecutive ticks for its hold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "started bigint, last bigint, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = sorted(
            (t for chunk in rows for t in chunk[["tick", "holds", "interval", "hold", "value"]].itertuples(index=False)),
            key=lambda t: t.tick,
        )
        held = self.run.get() if self.run.exists() else None
        started, last, done = held if held else (None, None, False)
        out = []
        for t in ticks:
            if not t.holds:
                started, last, done = None, t.tick, False
                continue
            if started is None or t.tick != last + t.interval:
                started, done = t.tick, False
            last = t.tick
            if not done and last >= started + -(-t.hold // t.interval) * t.interval:
                done = True
                out.append((*key, started, last, t.value))
        if started is None:
            self.run.clear()
        else:
            self.run.update((int(started), int(last), done))
        if out:
            yield pd.DataFrame(out, columns=["rule", "labels", "started", "fired", "value"])

    def close(self) -> None:
        pass


def alert_stream(observations: DataFrame, rules: Sequence[Rule], lateness: str = LATENESS) -> DataFrame:
    """Firings of windowed rules that share one lookback and interval."""
    series = list({r.series.name: r.series for r in rules}.values())
    judged = under_rules(stream_values(observations, series, lateness), rules, "ts").select(
        "ts", "rule", "labels", "interval", "tick", "value", "hold", F.col("_true").alias("holds")
    )
    return judged.groupBy("rule", "labels").transformWithStateInPandas(
        Hold(), outputStructType=FIRED, outputMode="append", timeMode="none"
    )


class Silence(StatefulProcessor):
    """Fires when no slot arrives for the lookback plus the hold; a timer covers the wait."""

    def __init__(self, rule: Rule):
        self.name = rule.name
        self.interval, self.lookback = rule.series.interval, rule.series.lookback
        self.hold = -(-rule.hold // self.interval) * self.interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "slot bigint, done boolean")

    def _row(self, labels: str, slot: int) -> tuple:
        return self.name, labels, slot + self.lookback, slot + self.lookback + self.hold

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots = sorted({slot for chunk in rows for slot in chunk["slot"]})
        last, done = self.seen.get() if self.seen.exists() else (None, False)
        out = []
        for slot in slots:
            if last is not None and slot <= last:
                continue
            # The silent ticks run from last + lookback to slot - interval.
            if last is not None and not done and slot - self.interval >= last + self.lookback + self.hold:
                out.append(self._row(key[0], last))
            last, done = slot, False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last + self.lookback + self.hold + self.interval) * 1000)
        self.seen.update((int(last), done))
        if out:
            yield pd.DataFrame(out, columns=["rule", "labels", "started", "fired"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, done = self.seen.get()
        if not done:
            self.seen.update((last, True))
            yield pd.DataFrame([self._row(key[0], last)], columns=["rule", "labels", "started", "fired"])

    def close(self) -> None:
        pass


HEARTBEAT = "heartbeat"


def heartbeats(spark: SparkSession) -> DataFrame:
    """The clock as observations of their own metric, one row a second."""
    return as_heartbeats(spark.readStream.format("rate").option("rowsPerSecond", 1).load())


def as_heartbeats(beats: DataFrame) -> DataFrame:
    """The ``timestamp`` of a stream as observations that no rule reads."""
    return beats.select(
        F.col("timestamp").alias("ts"), F.lit(HEARTBEAT).alias("metric"),
        F.create_map().cast("map<string,string>").alias("labels"), F.lit(1.0).alias("value"),
    )


def silence_stream(
    observations: DataFrame, rule: Rule, lateness: str = LATENESS, beats: DataFrame | None = None
) -> DataFrame:
    """Firings of a silence rule. Traffic is reduced to its distinct slots before the state.

    Event time stands still while nothing arrives. ``beats``, a stream of ``heartbeats``, carries it on: the two
    are one stream before the watermark, so silence fires although no request of any kind comes any more. With a clock
    in the stream, requests that arrive later than ``lateness`` after it are dropped.
    """
    interval = rule.series.interval
    if beats is not None:
        observations = observations.select("ts", "metric", "labels", "value").unionByName(beats)
    fed = feed(in_event_time(observations, lateness=lateness), [rule.series], "ts")
    slots = (
        fed.groupBy(F.window("ts", f"{interval} seconds").alias("w"), "labels")
        .agg(F.count("*").alias("n"))
        .select(F.window_time("w").alias("ts"), "labels", F.unix_seconds("w.end").alias("slot"))
    )
    return slots.groupBy("labels").transformWithStateInPandas(
        Silence(rule), outputStructType=SILENT, outputMode="append", timeMode="eventtime"
    )
