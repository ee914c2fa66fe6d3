from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import alerts, dashboards, metrics, series
from shelfmark.operators.series import Series, evaluate
from shelfmark.streaming import alerts as stream_alerts, walk, windows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SHAPE = "ts timestamp, metric string, labels map<string,string>, value double"


def observed(spark, rows):
    return spark.createDataFrame([(START + timedelta(seconds=s), m, l, float(v)) for s, m, l, v in rows], SHAPE)


def seconds(stamp):
    return int((stamp.replace(tzinfo=timezone.utc) - START).total_seconds())


def quantile(values, bounds, q):
    """Bucket interpolation, written as a loop."""
    counts = [sum(v <= b for v in values) for b in bounds]
    rank = q * len(values)
    for i, c in enumerate(counts):
        if c >= rank:
            low, below = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0)
            return bounds[i] if i == 0 and bounds[0] <= 0 else low + (bounds[i] - low) * (rank - below) / (c - below)
    return bounds[-1]


@pytest.mark.parametrize("values", [[0.3], [9, 9, 9], [0.01, 0.2, 0.7, 3.0, 99.0], [0.0, 0.0]])
@pytest.mark.parametrize("metric", ["search_execution_seconds", "llm_faithfulness_score"])
def test_quantile_from_buckets(spark, values, metric):
    bounds = list(metrics.METRICS[metric].bounds)
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    hist = metrics.histogram(df, ["k"], "v", bounds)
    got = metrics.histogram_quantiles(hist, ["k"], bounds, {"p10": 0.1, "p50": 0.5, "p95": 0.95}).first()
    for name, q in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95)):
        assert got[name] == pytest.approx(quantile(values, bounds, q))


def test_rate_ratio_and_gauge_series(spark):
    rows = [(5, "http_requests_total", {"status_code": "200"}, 1), (20, "http_requests_total", {"status_code": "503"}, 1)]
    rows += [(3, "hnsw_recall_rate", {"k": "5"}, 0.9), (9, "hnsw_recall_rate", {"k": "5"}, 0.8)]
    s = [
        Series("rate", "rate", "http_requests_total", interval=15, lookback=30),
        Series("bad", "ratio", "http_requests_total", where={"status_code": "5.."}, interval=15, lookback=30),
        Series("recall", "gauge", "hnsw_recall_rate", ("k",), interval=60),
    ]
    got = {(r.series, seconds(r.tick)): r.value for r in evaluate(observed(spark, rows), s).collect()}
    assert got == {
        ("rate", 15): 1 / 30, ("rate", 30): 2 / 30, ("rate", 45): 1 / 30,
        ("bad", 15): 0.0, ("bad", 30): 0.5, ("bad", 45): 1.0, ("recall", 60): 0.8,
    }


def fired(spark, rows, names):
    rules = [r for r in alerts.RULES if r.name in names]
    return {
        (r.rule, r.labels, seconds(r.started_at), seconds(r.fired_at), seconds(r.ended_at)): round(r.value, 6)
        for r in alerts.alerts_fired(observed(spark, rows), rules).collect()
    }


def test_hold_must_last(spark):
    slow = [(s, "search_execution_seconds", {"has_vector": "True"}, 4.0) for s in (0, 100, 200)]
    unrelated = [(50, "search_execution_seconds", {"has_vector": "False"}, 4.0)]
    got = fired(spark, slow + unrelated, ["SearchLatencyHighCritical"])
    # True from tick 30 to tick 480 (200 s is in the 210 s slot and stays 300 s).
    assert list(got) == [("SearchLatencyHighCritical", "", 30, 210, 480)]
    # A fast request in every lookback pulls the quantile below the limit, so nothing fires.
    fast = [(s, "search_execution_seconds", {"has_vector": "True"}, 0.2) for s in range(0, 300) for _ in range(2)]
    assert fired(spark, slow + fast, ["SearchLatencyHighCritical"]) == {}
    assert fired(spark, [slow[0]], ["SearchLatencyHighWarning"]) == {}


def test_gauge_holds_until_changed(spark):
    rows = [
        (10, "hnsw_recall_rate", {"k": "5"}, 0.8), (800, "hnsw_recall_rate", {"k": "5"}, 0.7),
        (1000, "hnsw_recall_rate", {"k": "5"}, 0.95), (5000, "http_requests_total", {}, 1),
        (1000, "hnsw_recall_rate", {"k": "10"}, 0.5),
    ]
    got = fired(spark, rows, ["HNSWRecallRateLow", "HNSWRecallRateCritical"])
    assert got == {
        ("HNSWRecallRateLow", "k=5", 60, 660, 960): 0.8,
        ("HNSWRecallRateLow", "k=10", 1020, 1620, 4980): 0.5,
        ("HNSWRecallRateCritical", "k=10", 1020, 1320, 4980): 0.5,
    }


def test_zero_hold_and_silence(spark):
    rows = [(1, "embedding_drift_score", {"category": "c"}, 0.15), (2, "http_requests_total", {}, 1)]
    rows += [(1200, "http_requests_total", {}, 1), (1500, "http_requests_total", {}, 1)]
    got = fired(spark, rows, ["EmbeddingDriftWarning", "EmbeddingDriftCritical", "APINoTraffic"])
    assert got[("EmbeddingDriftWarning", "category=c", 300, 300, 1500)] == 0.15
    assert got[("APINoTraffic", "", 315, 615, 1200)] == 0.0 and len(got) == 2


def test_silence_that_still_lasts(spark):
    rows = [(2, "http_requests_total", {}, 1), (3000, "embedding_drift_score", {"category": "c"}, 0.01)]
    got = fired(spark, rows, ["APINoTraffic"])
    assert set(got) == {("APINoTraffic", "", 315, 615, 3015)}


def test_routing(spark):
    rows = [(s, "llm_generation_seconds", {"model_name": "m"}, 50.0) for s in range(0, 900, 60)]
    row = alerts.alerts_fired(observed(spark, rows)).filter("rule = 'LLMGenerationLatencyHigh'").first()
    assert (row.severity, row.team, row.channel) == ("critical", "ml-engineering", "#alerts-llm")
    assert row.message.startswith("LLMGenerationLatencyHigh [model_name=m]: ") and row.message.endswith("> 30.0000")


def test_every_rule_and_panel_is_evaluated(spark):
    assert len(alerts.RULES) == 17 and len({r.name for r in alerts.RULES}) == 17
    assert len({s.name for s in dashboards.PANELS}) == len(dashboards.PANELS)
    with pytest.raises(ValueError):
        dashboards.panel_series(observed(spark, [(0, "http_requests_total", {}, 1)]), ["nope"])


def test_bands(spark):
    df = spark.createDataFrame([(None,), (0.05,), (0.1,), (0.5,)], "v double")
    assert [r[0] for r in df.select(dashboards.band(F.col("v"), "drift")).collect()] == [None, "green", "yellow", "red"]


def write_files(spark, parts, folder):
    """One file per part, read by the stream in this order."""
    for i, rows in enumerate(parts):
        observed(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return f"{folder}/*"


def run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    windows.run_available(stream, out, str(tmp_path / "offsets"))
    return spark.read.schema(stream.schema).parquet(out)


def test_late_rows_and_closed_windows(spark, tmp_path):
    one = [(s, "http_requests_total", {}, 1) for s in (10, 700, 100)]  # out of order, in time
    two = [(3000, "http_requests_total", {}, 1)]
    three = [(3050, "http_requests_total", {}, 1)]
    four = [(20, "http_requests_total", {}, 1), (3100, "http_requests_total", {}, 1)]  # 20 is too late
    source = write_files(spark, [one, two, three, four], tmp_path / "in")
    schema = observed(spark, one).schema
    stream = windows.rates(
        windows.read_stream(spark, source, schema, files_per_trigger=1), ["metric"], "5 minutes"
    )
    got = {seconds(r.window_start): r.events for r in run(spark, stream, tmp_path).collect()}
    # The open window that starts at 3000 is not emitted.
    assert got == {0: 2, 600: 1}


def test_streamed_alerts_equal_batch_alerts(spark, tmp_path):
    stream_alerts.use_rocksdb(spark)
    slow = [(s, "search_execution_seconds", {"has_vector": "True"}, 4.0) for s in range(0, 900, 50)]
    fine = [(s, "search_execution_seconds", {"has_vector": "True"}, 0.1) for s in range(1500, 1600)]
    more = [(s, "search_execution_seconds", {"has_vector": "True"}, 1.4) for s in range(2000, 3000, 40)]
    end = [(9000, "search_execution_seconds", {"has_vector": "True"}, 0.1)]
    parts = [slow[::2], slow[1::2] + fine, more, end]
    source = write_files(spark, parts, tmp_path / "in")
    everything = observed(spark, sum(parts, []))
    rules = [r for r in alerts.RULES if r.series.name == "search_p95"]
    stream = stream_alerts.alert_stream(
        windows.read_stream(spark, source, everything.schema, files_per_trigger=1), rules
    )
    got = {(r.rule, r.started, r.fired, round(r.value, 9)) for r in run(spark, stream, tmp_path).collect()}
    base = int(START.timestamp())
    want = {
        (r.rule, base + seconds(r.started_at), base + seconds(r.fired_at), round(r.value, 9))
        for r in alerts.alerts_fired(everything, rules).collect()
    }
    assert got == want and len(want) == 4


def test_streamed_silence_fires_by_timer(spark, tmp_path):
    stream_alerts.use_rocksdb(spark)
    rule = next(r for r in alerts.RULES if r.name == "APINoTraffic")
    parts = [
        [(2, "http_requests_total", {}, 1), (100, "http_requests_total", {}, 1)],
        [(1500, "http_requests_total", {}, 1)],
        [(1600, "http_requests_total", {}, 1), (9000, "http_requests_total", {}, 1)],
    ]
    source = write_files(spark, parts, tmp_path / "in")
    everything = observed(spark, sum(parts, []))
    stream = stream_alerts.silence_stream(
        windows.read_stream(spark, source, everything.schema, files_per_trigger=1), rule
    )
    base = int(START.timestamp())
    got = sorted((r.started - base, r.fired - base) for r in run(spark, stream, tmp_path).collect())
    batch = alerts.alerts_fired(everything, [rule]).collect()
    assert got == sorted((seconds(r.started_at), seconds(r.fired_at)) for r in batch) == [(405, 705), (1905, 2205)]


def test_silence_fires_although_the_input_simply_stops(spark, tmp_path):
    stream_alerts.use_rocksdb(spark)
    rule = next(r for r in alerts.RULES if r.name == "APINoTraffic")
    requests = [(s, "http_requests_total", {}, 1) for s in (2, 100)]
    source = write_files(spark, [requests], tmp_path / "in")
    clock = tmp_path / "clock"

    def beat(at):
        """The clock goes on; requests don't."""
        at = F.lit(START).cast("timestamp") + F.expr(f"INTERVAL {at} SECONDS")
        spark.range(1).select(at.alias("timestamp")).coalesce(1).write.mode("append").parquet(str(clock / "ticks"))

    beat(10)
    schema = observed(spark, requests).schema

    def fired_so_far():
        ticks = windows.read_stream(spark, f"{clock}/*", spark.read.parquet(str(clock / "ticks")).schema)
        stream = stream_alerts.silence_stream(
            windows.read_stream(spark, source, schema), rule, beats=stream_alerts.as_heartbeats(ticks)
        )
        base = int(START.timestamp())
        return [(r.started - base, r.fired - base) for r in run(spark, stream, tmp_path).collect()]

    assert fired_so_far() == []
    for at in (400, 900):  # within the lookback, the hold and the bound on lateness
        beat(at)
        assert fired_so_far() == []
    beat(2000)
    assert fired_so_far() == [(405, 705)]
    beat(9000)
    assert fired_so_far() == [(405, 705)]  # once


def test_gauges_stand_until_their_next_setting(spark):
    rows = [(3, "hnsw_recall_rate", {"k": "5"}, 0.9), (3600, "hnsw_recall_rate", {"k": "5"}, 0.8)]
    rows += [(70, "hnsw_recall_rate", {"k": "10"}, 0.5), (4000, "http_requests_total", {}, 1)]
    s = [Series("recall", "gauge", "hnsw_recall_rate", ("k",), interval=60)]
    got = {(r.labels, seconds(r.tick)): r.value for r in evaluate(observed(spark, rows), s).collect()}
    want = {("k=5", t): 0.9 for t in range(60, 3660, 60)} | {("k=5", t): 0.8 for t in range(3660, 4000, 60)}
    assert got == want | {("k=10", t): 0.5 for t in range(120, 4000, 60)}


def test_values_are_carried_over_the_borders_of_pieces(spark):
    points = [("a" if i % 3 else "b", 10 * i) for i in range(400)]
    table = spark.createDataFrame([("g", label, 10, t, float(t)) for label, t in points if t % 70 < 30], "series string, labels string, interval int, tick long, value double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.labels, r.tick): r.value for r in series.carried(table.repartition(3), F.lit(5004)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for label in "ab":
        known = {t: float(t) for x, t in points if x == label and t % 70 < 30}
        for t in range(min(known), 5001, 10):
            want[label, t] = known.get(t, want.get((label, t - 10)))
    assert got == want


def test_streamed_histogram(spark, tmp_path):
    rows = [(s, "http_request_duration_seconds", {}, s % 3 / 10) for s in range(0, 5000, 7)]
    source = write_files(spark, [rows[::2], rows[1::2]], tmp_path / "in")
    bounds = metrics.METRICS["http_request_duration_seconds"].bounds
    stream = windows.histograms(
        windows.read_stream(spark, source, observed(spark, rows).schema), ["metric"], "value", bounds, "10 minutes"
    )
    got = {seconds(r.window_start): (r.total, list(r.cumulative)) for r in run(spark, stream, tmp_path).collect()}
    for start in range(0, 4200, 600):
        inside = [r[3] for r in rows if start <= r[0] < start + 600]
        assert got[start] == (len(inside), [sum(v <= b for v in inside) for b in bounds])


MIXED = ["SearchLatencyHighWarning", "HNSWRecallRateLow", "HNSWRecallRateCritical", "LLMErrorRateHigh", "APINoTraffic",
         "LLMFaithfulnessLow", "EmbeddingDriftCritical", "PGBufferHitRatioLow"]


def mixed_traffic():
    """Files of one stream: slow searches, gauges that fall and recover, errors, and a silence."""
    search = [(s, "search_execution_seconds", {"has_vector": "True"}, 1.5 if s < 900 else 0.1) for s in range(0, 1500, 45)]
    recall = [(s, "hnsw_recall_rate", {"k": "5"}, v) for s, v in ((30, 0.8), (500, 0.7), (1400, 0.99), (3000, 0.5))]
    recall += [(31, "hnsw_recall_rate", {"k": "10"}, 0.9), (1000, "pg_buffer_hit_ratio", {}, 0.5)]
    errors = [(s, "llm_errors_total", {"model_name": "m", "error_type": "Timeout"}, 1) for s in range(200, 900, 100)]
    errors += [(s, "llm_generation_seconds", {"model_name": "m"}, 1) for s in range(0, 2000, 25)]
    scores = [(s, "llm_faithfulness_score", {"model_name": "m"}, 0.3) for s in range(0, 4000, 400)]
    drift = [(700, "embedding_drift_score", {"category": "a"}, 0.3), (2600, "embedding_drift_score", {"category": "a"}, 0.0)]
    http = [(s, "http_requests_total", {"status_code": "200"}, 1) for s in (2, 100, 1500, 1505, 2000)]
    return [search + recall[:2], recall[2:] + errors, scores[::2] + http[:2], drift + scores[1::2] + http[2:]]


def changes_of(batch, watermark):
    """Rows that a stream owes by its watermark, from the firings of the whole table."""
    step = {r.name: r.series.interval for r in alerts.RULES}
    for r in batch:
        started, fired_at, ended = (seconds(x) for x in (r.started_at, r.fired_at, r.ended_at))
        if fired_at <= watermark:
            yield r.rule, r.labels, "firing", started, fired_at, None, round(r.value, 9)
        if ended + step[r.rule] <= watermark:
            yield r.rule, r.labels, "resolved", started, fired_at, ended, round(r.value, 9)


def test_streamed_rules_of_all_kinds_fire_and_end_as_in_batch(spark, tmp_path):
    stream_alerts.use_rocksdb(spark)
    by_time = sorted(sum(mixed_traffic(), []), key=lambda row: row[0])
    late = [by_time[i::2] for i in range(2)]  # each half spans all times, within the bound on lateness
    parts = [late[0], late[1], [(9000, "http_requests_total", {"status_code": "200"}, 1)]]
    source = write_files(spark, parts, tmp_path / "in")
    everything = observed(spark, sum(parts, []))
    rules = [r for r in alerts.RULES if r.name in MIXED]
    stream = walk.alert_changes(
        windows.read_stream(spark, source, everything.schema, files_per_trigger=1), rules, lateness="2 hours"
    )
    got = [
        (r.rule, r.labels, r.status, seconds(r.started_at), seconds(r.fired_at), r.ended_at and seconds(r.ended_at), round(r.value, 9))
        for r in run(spark, stream, tmp_path).collect()
    ]
    want = list(changes_of(alerts.alerts_fired(everything, rules).collect(), 9000 - 7200))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[0] for r in want} > {"SearchLatencyHighWarning", "HNSWRecallRateCritical", "APINoTraffic"}
    assert {r[2] for r in want} == {"firing", "resolved"}


def test_streamed_rules_go_on_by_the_clock_and_over_restarts(spark, tmp_path):
    stream_alerts.use_rocksdb(spark)
    everything = sorted(sum(mixed_traffic(), []), key=lambda row: row[0])
    schema = observed(spark, everything).schema
    rules = [r for r in alerts.RULES if r.name in MIXED]
    source, clock = str(tmp_path / "in"), tmp_path / "clock"

    def upto(first, last):
        """Observations of a stretch of time arrive, the clock goes on, the stream is started again."""
        rows = [r for r in everything if first <= r[0] < last]
        observed(spark, rows).coalesce(1).write.mode("append").parquet(f"{source}/0")
        at = F.lit(START).cast("timestamp") + F.expr(f"INTERVAL {last} SECONDS")
        spark.range(1).select(at.alias("timestamp")).coalesce(1).write.mode("append").parquet(str(clock / "ticks"))
        beats = windows.read_stream(spark, f"{clock}/*", spark.read.parquet(str(clock / "ticks")).schema)
        stream = walk.alert_changes(
            windows.read_stream(spark, f"{source}/*", schema), rules, beats=stream_alerts.as_heartbeats(beats)
        )
        return run(spark, stream, tmp_path).collect()

    got = []
    for first, last in ((0, 400), (400, 2500), (2500, 9000)):
        got = upto(first, last)
    seen = [
        (r.rule, r.labels, r.status, seconds(r.started_at), seconds(r.fired_at), r.ended_at and seconds(r.ended_at), round(r.value, 9))
        for r in got
    ]
    # the clock as an observation that no rule reads, so silence and gauges last until then
    whole = observed(spark, [*everything, (9000, "heartbeat", {}, 1)])
    want = list(changes_of(alerts.alerts_fired(whole, rules).collect(), 9000 - 600))
    assert sorted(seen, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["gauge", "silence", "rate"])
@pytest.mark.parametrize("cuts", [[], [300], [60, 120, 180, 2400], list(range(60, 3600, 60))])
def test_a_walk_in_pieces_is_the_whole_walk(kind, cuts):
    rule = alerts.Rule("r", Series("s", kind, "http_requests_total", lookback=300, interval=60),
                       "==" if kind == "silence" else ">", 0.0, 120, "warning", "t", "c")
    points = {60: 1.0, 120: 2.0, 180: 0.0, 900: 3.0, 960: -1.0, 1020: 1.0, 2000 // 60 * 60: 0.5}
    slots = {p: (p, v, np.array([1.0, max(v, 0.0), 0.0])) for p, v in points.items()}

    def walked(stops):
        run, seen, out = None, None, []
        for stop in stops:
            here = {p: v for p, v in slots.items() if p <= stop}
            if seen is not None:
                left = walk.still_needed(rule.series, {p: v for p, v in slots.items() if p <= seen}, seen)
                here = {p: v for p, v in here.items() if p in left or p > seen}
            run, changes = walk.hold(rule, run, list(walk.stretches(rule.series, here, seen, stop)), stop)
            out, seen = out + changes, stop
        return out

    assert walked([*cuts, 3600]) == walked([3600])
    assert walked([3600])


class _State:
    """One value or list of a key, as a walk keeps it."""

    def __init__(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held

    def put(self, rows):
        self.held = list(rows)

    def update(self, row):
        self.held = row

    def clear(self):
        self.held = []


class _Key:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark
        self.getValueState = self.getListState = lambda *_: _State()
        self.listTimers, self.deleteTimer = list, None
        self.registerTimer = lambda at: None


@pytest.mark.parametrize("kind", ["rate", "gauge", "silence"])
def test_a_long_catch_up_holds_a_piece_of_its_slots_at_a_time(kind, monkeypatch):
    rule = alerts.Rule("r", Series("s", kind, "http_requests_total", lookback=300, interval=60),
                       "==" if kind == "silence" else ">", 0.0, 120, "warning", "t", "c")
    ends = [30 * i for i in range(1, 4000) if i % 90 < 60 and i % 7]  # two slots to an interval, with gaps
    rows = pd.DataFrame({"slot": ends, "at": ends, "setting": [float(e % 4200 < 2100) for e in ends],
                         "sums": [[1.0, float(e % 4200 < 2100), 0.0] for e in ends]}).sample(frac=1, random_state=1)
    most, plain = [], walk.stretches

    def watched(s, slots, *rest):
        most.append(len(slots))
        return plain(s, slots, *rest)

    def changes(size):
        monkeypatch.setattr(walk, "PIECE_SLOTS", size, raising=False)
        walker, made = walk.Walk([rule]), []
        walker.init(_Key(0))
        for watermark in (90_000_000, 130_000_000):
            part = rows[(rows.slot * 1000 <= watermark) & (rows.slot * 1000 > watermark - 90_000_000)] if not made else rows[rows.slot > 90_000]
            found = list(walker.handleInputRows(("s", "l"), iter([part[:500], part[500:]]), _Key(watermark)))
            made += [tuple(r) for f in found for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
        return sorted(made, key=repr)

    monkeypatch.setattr(walk, "stretches", watched)
    whole = changes(10**9)
    most.clear()
    assert changes(50) == whole and len(whole) > 10
    assert max(most) < 50 + 2 + 300 // 60 + 1


def test_sliding_windows_are_summed_from_tumbling_ones(spark, tmp_path):
    parts = [[(s, "m", {}, 1) for s in range(0, 2000, 7)], [(20000, "m", {}, 1)]]
    source = write_files(spark, parts, tmp_path / "in")
    everything = observed(spark, sum(parts, []))
    stream = windows.rates(
        windows.read_stream(spark, source, everything.schema, files_per_trigger=1), ["metric"], "5 minutes", "2 minutes"
    )
    got = {(seconds(r.window_start), r.events, r.per_second) for r in run(spark, stream, tmp_path).collect()}
    batch = metrics.windowed_rate(everything, ["metric"], "5 minutes", "2 minutes").collect()
    assert got == {(seconds(r.window_start), r.events, r.per_second) for r in batch if seconds(r.window_end) <= 19400}
    assert windows.common_width("5 minutes", "2 minutes") == "60000000 microseconds"
    with pytest.raises(ValueError):
        windows.microseconds_of("minutes")


def test_alert_rules_read_the_observations_twice_at_most(spark):
    rows = [(60.0 * i, "http_requests_total", {"method": "GET", "endpoint": "/a", "status_code": "500"}, 1.0) for i in range(40)]
    rows += [(60.0 * i, "pg_buffer_hit_ratio", {}, 0.5) for i in range(40)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    whole = observed(spark, rows)
    fired = alerts.alerts_fired(whole.mapInPandas(count, whole.schema)).collect()
    assert {r.rule for r in fired} >= {"APIHighErrorRate", "PGBufferHitRatioLow"}
    assert seen.value <= 2 * len(rows)
