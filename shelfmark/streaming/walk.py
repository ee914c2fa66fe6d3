"""All alert rules on one stream: one scan, one windowed sum, one keyed walk over time.

Observations are summed to slots of the greatest interval that divides all intervals of the rules. A processor
per series and label set then goes forward in time with the watermark: it puts slots together over the lookback,
carries gauges, sees silence, and holds the runs of the rules on its series. A rule's run gives a row when it
fires and a row when it has ended. State per key: the slots of one lookback and a row per rule, whatever the traffic.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators.alerts import Rule, route
from shelfmark.operators.metrics import METRICS
from shelfmark.operators.series import Series, cumulative_sums, feed, sums
from shelfmark.streaming.windows import LATENESS, in_event_time

CHANGED = "rule string, labels string, status string, started bigint, fired bigint, ended bigint, value double"
FIRING, RESOLVED = "firing", "resolved"

PIECE_SLOTS = 10_000  # slots of a key that a micro-batch brings and that are walked through at a time

# A stretch of ticks with one value: first tick, last tick, value.
Stretch = tuple[int, int, float | None]


def slots_of_stream(observations: DataFrame, series: Sequence[Series], lateness: str = LATENESS) -> DataFrame:
    """``ts, series, labels, slot, sums, at, setting`` per closed slot; a slot is named by its end in seconds.

    ``sums`` holds count, part, whole and a count per bucket bound; ``setting`` is a gauge's last one, made at
    ``at`` microseconds.
    """
    width = math.gcd(*(s.interval for s in series))
    fed = feed(in_event_time(observations, lateness=lateness), series, "ts")
    gauges = F.col("series").isin([s.name for s in series if s.kind == "gauge"])
    aggregates = {**sums(), **cumulative_sums(series)}
    return (
        fed.groupBy(F.window("ts", f"{width} seconds").alias("w"), "series", "labels")
        .agg(
            *[c.alias(n) for n, c in aggregates.items()],
            F.max(F.when(gauges, F.struct("ts", "value"))).alias("set"),
        )
        .select(
            F.window_time("w").alias("ts"), "series", "labels", F.unix_seconds("w.end").alias("slot"),
            F.array(*[F.col(n).cast("double") for n in aggregates]).alias("sums"),
            F.coalesce(F.unix_micros("set.ts"), F.lit(0)).alias("at"),
            F.coalesce("set.value", F.lit(0.0)).alias("setting"),
        )
    )


def value_of(s: Series, total: np.ndarray) -> float | None:
    """Value of a quantile, rate, ratio or complement from the sums of its lookback; None where it has none."""
    if s.kind == "quantile":
        bounds, rank = METRICS[s.metric].bounds, s.quantile * total[0]
        counts = total[3:3 + len(bounds)]
        i = int(np.argmax(counts >= rank))
        if counts[i] < rank:
            return bounds[-1]
        if i == 0 and bounds[0] <= 0:
            return bounds[0]
        low, below = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0.0)
        return float(low + (bounds[i] - low) * (rank - below) / (counts[i] - below))
    rate = float(total[1]) / s.lookback
    if s.kind == "rate":
        return rate * s.scale
    per = float(total[2]) / s.lookback + s.epsilon
    if per == 0:
        return None
    return rate / per if s.kind == "ratio" else 1 - rate / per


def stretches(s: Series, slots: dict[int, tuple], seen: int | None, upto: int) -> Iterator[Stretch]:
    """Values of the ticks after ``seen`` up to ``upto``, both multiples of the interval, in order.

    ``slots`` maps slot ends to (at, setting, sums). Ticks without a value are in no stretch.
    """
    after = seen + s.interval if seen is not None else None

    def cut(first: int) -> int:
        return first if after is None else max(first, after)

    points = sorted(slots)
    if s.kind in ("gauge", "silence"):
        wait = s.lookback if s.kind == "silence" else 0
        for p, following in zip(points, [*points[1:], None]):
            first = cut(p + wait)
            last = upto if following is None else min(upto, following - s.interval)
            if first <= last:
                yield first, last, 0.0 if s.kind == "silence" else slots[p][1]
        return
    reach = range(0, s.lookback, s.interval)
    ticks = {p + r for p in points for r in reach}
    for t in sorted(t for t in ticks if t <= upto and (after is None or t >= after)):
        total = sum(slots[t - r][2] for r in reach if t - r in slots)
        yield t, t, value_of(s, total)


def still_needed(s: Series, slots: dict[int, tuple], upto: int) -> list[int]:
    """Slots that ticks after ``upto`` depend on."""
    if s.kind in ("gauge", "silence"):
        newest = max((p for p in slots if p <= upto), default=None)
        return [p for p in slots if p > upto or p == newest]
    return [p for p in slots if p + s.lookback - s.interval > upto]


def _true(rule: Rule, value: float | None) -> bool:
    if value is None:
        return False
    if rule.compare == ">":
        return value > rule.threshold
    return value < rule.threshold if rule.compare == "<" else value == rule.threshold


def fires_at(rule: Rule, started: int) -> int:
    """The tick at which a run fires: its hold after the start, rounded up to the interval."""
    return started + -(-rule.hold // rule.series.interval) * rule.series.interval


def hold(rule: Rule, run: tuple | None, found: Sequence[Stretch], upto: int) -> tuple[tuple | None, list[tuple]]:
    """Take the run of a rule through stretches up to ``upto``; the run then, and its changes.

    A run is (started, last, fired, value), with ``fired`` 0 until it has fired. A change is (status, started,
    fired, ended, value); the value is the one seen when it fired.
    """
    out = []

    def end() -> None:
        if run is not None and run[2]:
            out.append((RESOLVED, run[0], run[2], run[1], run[3]))

    for first, last, value in found:
        if run is not None and first != run[1] + rule.series.interval:
            end()
            run = None
        if not _true(rule, value):
            end()
            run = None
            continue
        started, _, fired, kept = run or (first, first, 0, 0.0)
        if not fired and fires_at(rule, started) <= last:
            fired, kept = fires_at(rule, started), value
            out.append((FIRING, started, fired, None, kept))
        run = started, last, fired, kept
    if run is not None and run[1] < upto:
        end()
        run = None
    return run, out


def wakes(s: Series, rules: Sequence[Rule], slots: dict[int, tuple], runs: dict[str, tuple], upto: int) -> list[int]:
    """Ticks after ``upto`` at which something can happen although nothing more arrives."""
    following = upto + s.interval
    times = [p for p in slots if p > upto]
    if s.kind not in ("gauge", "silence"):
        return [following] if runs or len(slots) > len(times) else times
    if s.kind == "silence":
        times += [max(p + s.lookback, following) for p in slots if p + s.lookback > upto]
    return times + [fires_at(r, runs[r.name][0]) for r in rules if r.name in runs and not runs[r.name][2]]


def pieces(rows: Iterator[pd.DataFrame], step: int) -> Iterator[list[tuple]]:
    """Slots of a key as (end, at, setting, sums), in order of their ends and some at a time; ends are multiples of ``step``.

    What has arrived is held in arrays, a fifth of what it takes as objects. Slots of one end are in one piece.
    """
    chunks = [
        (c["slot"].to_numpy(np.int64), c["at"].to_numpy(np.int64), c["setting"].to_numpy(float), np.stack(c["sums"].to_list()))
        for c in rows if len(c)
    ]
    if not chunks:
        return
    ends = -(-np.concatenate([c[0] for c in chunks]) // step) * step
    starts = np.cumsum([0, *(len(c[0]) for c in chunks)])
    order = np.argsort(ends, kind="stable")
    first = 0
    while first < len(order):
        last = min(first + PIECE_SLOTS, len(order)) - 1
        after = int(np.searchsorted(ends, ends[order[last]], side="right", sorter=order))
        at = order[first:after]
        which = np.searchsorted(starts, at, side="right") - 1
        yield [
            (int(ends[i]), int(chunks[c][1][r]), float(chunks[c][2][r]), chunks[c][3][r].astype(float))
            for i, c, r in zip(at.tolist(), which.tolist(), (at - starts[which]).tolist())
        ]
        first = after


class Walk(StatefulProcessor):
    """Goes forward in time with the watermark for one series and label set."""

    def __init__(self, rules: Sequence[Rule]):
        self.series = {r.series.name: r.series for r in rules}
        self.rules = {n: [r for r in rules if r.series.name == n] for n in self.series}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "upto bigint")
        self.slots = handle.getListState("slots", "slot bigint, at bigint, setting double, sums array<double>")
        self.runs = handle.getListState("runs", "rule string, started bigint, last bigint, fired bigint, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._forward(key, pieces(rows, self.series[key[0]].interval), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._forward(key, (), timerValues)

    def _slots(self) -> dict[int, tuple]:
        return {r[0]: (r[1], r[2], np.asarray(r[3], dtype=float)) for r in self.slots.get()}

    def _forward(self, key, arrived: Iterable[list[tuple]], timerValues) -> Iterator[pd.DataFrame]:
        s, rules = self.series[key[0]], self.rules[key[0]]
        upto = int(timerValues.getCurrentWatermarkInMs() // 1000 // s.interval * s.interval)
        seen = self.seen.get()[0] if self.seen.exists() else None
        slots = self._slots()
        runs = {r[0]: tuple(r[1:]) for r in self.runs.get()}
        out = []

        def walk(to: int) -> None:
            found = list(stretches(s, slots, seen, to))
            for rule in rules:
                run, changes = hold(rule, runs.pop(rule.name, None), found, to)
                if run is not None:
                    runs[rule.name] = run
                out.extend((rule.name, key[1], *c) for c in changes)
            needed = set(still_needed(s, slots, to))
            for p in [p for p in slots if p not in needed]:
                del slots[p]

        for piece in arrived:
            for end, *new in piece:
                held = slots.get(end)
                if held is not None:
                    new = (*max(held[:2], tuple(new[:2])), held[2] + new[2])
                slots[end] = tuple(new)
            # Later pieces hold later slots only, which no tick up to the end of this one depends on.
            to = min(upto, piece[-1][0])
            if seen is None or to > seen:
                walk(to)
                seen = to
        walk(upto)
        self.seen.update((upto,))
        self._store(self.slots, [(p, at, setting, amounts.tolist()) for p, (at, setting, amounts) in slots.items()])
        self._store(self.runs, [(name, *run) for name, run in runs.items()])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = wakes(s, rules, slots, runs, upto)
        if times:
            self.handle.registerTimer(min(times) * 1000)
        if out:
            changed = pd.DataFrame(out, columns=["rule", "labels", "status", "started", "fired", "ended", "value"])
            yield changed.astype({"ended": "Int64"})

    @staticmethod
    def _store(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def alert_changes(
    observations: DataFrame, rules: Sequence[Rule], lateness: str = LATENESS, beats: DataFrame | None = None
) -> DataFrame:
    """A row when a rule fires and a row when the condition has ended, routed and with a message.

    Rules of any kind, lookback and interval together. With ``beats``, a stream of ``heartbeats``, time goes on
    although no observation comes.
    """
    if beats is not None:
        observations = observations.select("ts", "metric", "labels", "value").unionByName(beats)
    series = list({r.series.name: r.series for r in rules}.values())
    slots = slots_of_stream(observations, series, lateness)
    changed = slots.groupBy("series", "labels").transformWithStateInPandas(
        Walk(rules), outputStructType=CHANGED, outputMode="append", timeMode="eventtime"
    )
    times = [F.timestamp_seconds(c).alias(f"{c}_at") for c in ("started", "fired", "ended")]
    return route(changed.select("rule", "labels", "status", *times, "value"), rules)
