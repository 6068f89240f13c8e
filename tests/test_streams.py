"""Streams whose rows come late, that start again from a checkpoint, and whose states end by time."""

import datetime as dt
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from tests.test_series import _streamed
from tidegauge.operators import contract, live, reports, signals, windows
from tidegauge.operators import swings as W
from tidegauge.plans.registry import bars as bars_of
from tidegauge.sources.tables import read_event_log, read_ticks, strategy_config
from tidegauge.streaming import ordered, streams

LATE = 2 * 86400
DELAY = "2 days 1 minute"


@pytest.fixture(scope="module")
def log(spark, sf):
    return read_event_log(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_late_log_rows_change_nothing(spark, log):
    got = {r["event_id"] for r in _streamed(spark, log, lambda s: streams.stream_log_on_change(s, DELAY), "late_changes", late=LATE).collect()}
    assert got == {r["event_id"] for r in reports.changes(log, ("label", "state_key"), ("ts", "event_id"), "message").collect()}
    got = {(r["event_id"], r["suppressed"]) for r in _streamed(spark, log, lambda s: streams.stream_log_throttle(s, 21600, DELAY), "late_throttle", late=LATE).collect()}
    assert got == {(r["event_id"], r["suppressed"]) for r in reports.log_throttle(log.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 21600).collect()}


def test_late_bars_change_nothing(spark, sf):
    b = windows.with_stochastic(bars_of(spark, sf, "15min")).withColumn("v", W.oscillator())
    last = b.groupBy("symbol").agg(F.max("bar_idx").alias("last"))
    b = b.join(last, "symbol").where("bar_idx < last").withColumn("sign", F.when(F.col("bar_idx") < 2, None).when(F.col("v") > 80, 1).when(F.col("v") < 20, -1))
    b = b.select("symbol", F.col("bar_ts").cast("timestamp").alias("bar_ts"), "bar_idx", "high", "low", "close", "sign")
    got = _streamed(spark, b, lambda s: streams.stream_swings(s, DELAY), "late_swings", time="bar_ts", late=LATE)
    want = W.swings(bars_of(spark, sf, "15min")).where("confirmed")
    columns = ("symbol", "extremum_idx", "confirm_idx", "price")
    assert {tuple(r) for r in got.select(*columns).collect()} == {tuple(r) for r in want.select(*columns).collect()}
    n = 5
    batch = windows.with_ma(windows.with_ma(windows.with_atr(bars_of(spark, sf, "15min"), n), "SMA", n, "sma"), "EMA", n, "ema")
    want = {(r["symbol"], r["bar_idx"]): (r["sma"], r["ema"], r["atr"]) for r in batch.collect()}
    rows = _streamed(spark, b, lambda s: streams.stream_indicators(s, n, DELAY), "late_indicators", time="bar_ts", late=LATE).collect()
    assert len(rows) == b.count()
    for r in rows:
        assert (r["sma"], r["ema"], r["atr"]) == pytest.approx(want[r["symbol"], r["bar_idx"]], abs=1e-6)


def test_rows_beyond_the_delay_are_counted(spark, sf):
    eq = read_ticks(spark, f"{sf}/events.parquet").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("price").alias("drawdown"))
    late = ordered.LateRows()
    spark.streams.addListener(late)
    try:
        got = _streamed(spark, eq, lambda s: streams.stream_drawdown_lock(s, 480.0, late="3 hours"), "too_late", late=8 * LATE)
        for _ in range(100):  # listeners are told a little later
            if late.dropped.get("too_late", 0) + got.count() >= eq.count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(late)
    assert 0 < late.dropped["too_late"] == eq.count() - got.count()
    # what was handed on came in order of time
    batches = got.groupBy("symbol").agg(F.collect_list("ts").alias("ts")).collect()
    assert all(x["ts"] == sorted(x["ts"]) for x in batches)


def test_a_lifecycle_of_late_ticks(spark):
    t = dt.datetime(2024, 1, 1)
    opening = {0: (7, "BULLISH", 10.0, 8.0, 12.0), 3: (8, "BEARISH", 11.0, 13.0, 9.0)}
    prices = (9.0, 9.5, 10.5, 11.5, 11.2, 10.9, 12.5, 12.0, 13.5, 7.0)
    rows = [("a", t + dt.timedelta(minutes=i), i, p, *opening.get(i, (None,) * 5)) for i, p in enumerate(prices)]
    e = spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, price double, signal_id long, direction string, trigger double, stop double, target double")
    got = [(r["signal_id"], r["event"], r["price"]) for r in _streamed(spark, e, lambda s: streams.stream_lifecycle(s, "10 minutes"), "late_cycle", late=300).orderBy("ts", "signal_id").collect()]
    assert got == [(7, "ENTRY", 10.5), (8, "ENTRY", 10.9), (7, "TP", 12.5), (8, "SL", 13.5)]


# -- states that end


def _parts(spark, frame, folder, first, second):
    """Two files, the second of which is put in place later."""
    for name, rows in (("a", first), ("b", second)):
        frame.where(rows).coalesce(1).write.parquet(f"{folder}/made-{name}")
        os.makedirs(f"{folder}/in", exist_ok=True)

    def put(name):
        (made,) = glob.glob(f"{folder}/made-{name}/*.parquet")
        os.rename(made, f"{folder}/in/{name}.parquet")

    return put


def _run(spark, frame, make, folder, mode="append"):
    source = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    out = make(source).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/{n}")).outputMode(mode).option("checkpointLocation", f"{folder}/check")
    out.trigger(availableNow=True).start().awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _written(spark, folder):
    return spark.read.parquet(*glob.glob(f"{folder}/out/*"))


@pytest.mark.parametrize("period", ["day", "week"])
def test_locks_end_by_timer_and_survive_a_restart(spark, sf, tmp_path, period):
    eq = read_ticks(spark, f"{sf}/events.parquet").withColumn("drawdown", F.col("price"))
    flow = eq.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "drawdown")
    flush = flow.limit(1).select(F.lit("~").alias("symbol"), F.lit("2034-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("drawdown"))
    whole = flow.unionByName(flush)
    put = _parts(spark, whole, str(tmp_path), "ts < '2024-01-12 13:00:00'", "ts >= '2024-01-12 13:00:00'")
    for name in ("a", "b"):
        put(name)
        _run(spark, whole, lambda s: streams.stream_drawdown_lock(s, 480.0, period, releases=True), str(tmp_path))
    rows = _written(spark, str(tmp_path)).collect()
    live = {r["event_id"]: r["locked"] for r in rows if r["event_id"] is not None}
    want = reports.drawdown_lock(eq, F.lit(480.0), period, order=("ts", "event_id"))
    assert live == {r["event_id"]: r["locked"] for r in want.collect()}
    released = {(r["symbol"], r["ts"]) for r in rows if r["event_id"] is None}
    length = dt.timedelta(days=7 if period == "week" else 1)
    locked = eq.where("drawdown >= 480").select("symbol", F.date_trunc(period, "ts").alias("start")).distinct().collect()
    assert released == {(r["symbol"], r["start"].replace(tzinfo=None) + length) for r in locked}
    left = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "own").load()
    assert left.count() == 0  # nothing is held of days that are over


@pytest.mark.parametrize("mode", ["SIGNALS", "LOSSES"])
def test_daily_limits_are_the_batch(spark, sf, mode):
    e = read_ticks(spark, f"{sf}/events.parquet").select(F.when(F.col("event_id") % 2 == 0, "BULLISH").otherwise("BEARISH").alias("direction"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("signal_id"), (F.col("price") - 200).alias("profit"))
    got = {r["signal_id"]: r["allowed"] for r in _streamed(spark, e, lambda s: streams.stream_daily_limit(s, mode, 3, late=DELAY), f"limit_{mode}", late=LATE).collect()}
    assert got == {r["signal_id"]: r["allowed"] for r in reports.daily_limit(e, mode, 3).collect()}
    assert len(set(got.values())) == 2


def test_daily_counts_are_the_batch(spark, sf):
    e = read_ticks(spark, f"{sf}/events.parquet").select(F.when(F.col("event_id") % 2 == 0, "BULLISH").otherwise("BEARISH").alias("direction"), F.col("ts").cast("timestamp").alias("ts"), (F.col("price") - 200).alias("profit"))
    got = {tuple(r) for r in _streamed(spark, e, lambda s: streams.stream_daily_counts(s, DELAY), "counts", late=LATE).select(F.col("day").cast("timestamp_ntz"), "direction", "signals", "losses").collect()}
    assert got == {tuple(r) for r in reports.daily_signal_counts(e).select("day", "direction", "signals", "losses").collect()}


def _sources(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", "k", "ATTEMPT", 0), ("a", "k", "TP", 60), ("a", "k", "ATTEMPT", 120), ("a", "m", "ATTEMPT", 30), ("b", "m", "SL", 0), ("b", "n", "TP", 50), ("a", "x", "ATTEMPT", 3000), ("a", "m", "ATTEMPT", 3001), ("b", "y", "ATTEMPT", 3060)]
    return spark.createDataFrame([(s, k, e, t + dt.timedelta(minutes=m)) for s, k, e, m in rows], "symbol string, source_key string, event string, ts timestamp"), t


def test_sources_expire_and_survive_a_restart(spark, tmp_path):
    e, t = _sources(spark)
    put = _parts(spark, e, str(tmp_path), "ts < '2024-01-01 01:00:00'", "ts >= '2024-01-01 01:00:00'")
    make = lambda s: streams.stream_source_state(s, 86400, "10 minutes")
    held = lambda: {(r["key"]["symbol"], r["user_map_key"]["source_key"]) for r in spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "sources").load().collect()}
    put("a")
    _run(spark, e, make, str(tmp_path), "update")
    assert held() == {("a", "k"), ("a", "m"), ("b", "m"), ("b", "n")}
    first = {(r["symbol"], r["source_key"]): (r["attempts"], r["consumed_ts"]) for r in _written(spark, str(tmp_path)).collect()}
    assert first == {("a", "k"): (1, None), ("a", "m"): (1, None), ("b", "m"): (0, None), ("b", "n"): (1, t + dt.timedelta(minutes=50))}
    put("b")
    _run(spark, e, make, str(tmp_path), "update")
    last = {}
    for r in _written(spark, str(tmp_path)).collect():
        last[r["symbol"], r["source_key"]] = max(last.get((r["symbol"], r["source_key"]), (0, None)), (r["attempts"], r["consumed_ts"]), key=lambda x: (x[0], x[1] is not None))
    # "k" goes on over the restart; "m" comes again while the watermark hasn't passed a day after its first event
    assert last["a", "k"] == (2, t + dt.timedelta(hours=1)) and last["a", "m"] == (2, None) and last["b", "y"] == (1, None)
    assert held() == {("a", "x"), ("a", "m"), ("b", "y")}  # those without an event within a day of the watermark are gone


def test_sources_are_the_batch_while_they_live(spark, sf, tmp_path):
    e = read_ticks(spark, f"{sf}/events.parquet").select("symbol", F.concat_ws("|", "symbol", F.col("event_id") % 40).alias("source_key"), F.when(F.col("price") > 470, "TP").otherwise("ATTEMPT").alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    rows = _streamed(spark, e, lambda s: streams.stream_source_state(s, 10**8, DELAY), "all_sources", "update", late=LATE).collect()
    got = {}
    for r in rows:
        if r["attempts"] >= got.get(r["source_key"], (-1,))[0]:
            got[r["source_key"]] = (r["attempts"], r["first_ts"], r["consumed_ts"])
    want = e.groupBy("source_key").agg(F.count_if(F.col("event") == "ATTEMPT").alias("n"), F.min(F.when(F.col("event") == "ATTEMPT", F.col("ts"))).alias("a"), F.min(F.when(F.col("event") == "TP", F.col("ts"))).alias("c")).collect()
    assert {k: v[0] for k, v in got.items()} == {r["source_key"]: r["n"] for r in want}
    latest = {r["source_key"]: (r["a"], r["c"]) for r in want}
    assert all(any((r["first_ts"], r["consumed_ts"]) == latest[k] for r in rows if r["source_key"] == k) for k in latest)


def test_sources_forgotten_by_the_clock(spark, tmp_path):
    e, _ = _sources(spark)
    put = _parts(spark, e, str(tmp_path), "symbol = 'a'", "symbol = 'b'")
    put("a")
    source = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    keep = lambda df, n: None if df.isEmpty() else df.write.parquet(f"{tmp_path}/out/{n}")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    made = streams.stream_source_state(source, 2, by_clock=True).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/check")
    q = made.trigger(processingTime="1 second").start()  # states that end by the clock need batches that go on
    try:
        for _ in range(200):
            if glob.glob(f"{tmp_path}/out/*/_SUCCESS"):
                break
            time.sleep(0.3)
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["source_key"]: r["attempts"] for r in _written(spark, str(tmp_path)).collect()} == {"k": 2, "m": 2, "x": 1}


# -- signals from ticks


def _events(df):
    return sorted((tuple(r) for r in df.select("symbol", *(name for name, _, _ in live.EVENTS)).collect()), key=str)


@pytest.mark.parametrize("gates", [live.Gates(), live.Gates("SIGNALS", 1, True, 100.0)])
def test_live_signals_from_late_ticks_are_the_batch(spark, sf, gates):
    ticks = read_ticks(spark, f"{sf}/events.parquet").select("symbol", "event_id", F.col("ts").cast("timestamp").alias("ts"), "price")
    rules = live.rules_of(strategy_config(spark), gates)
    got = _streamed(spark, ticks, lambda s: streams.stream_live_signals(s, rules, "1 hour", DELAY), f"live_{gates.single}", late=LATE, key="symbol")
    want = _events(live.signal_events(bars_of(spark, sf), rules))
    got = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "extremum_ts")})
    assert _events(got) == want and len(want) > 20


def test_live_signals_survive_a_restart(spark, sf, tmp_path):
    ticks = read_ticks(spark, f"{sf}/events.parquet").select("symbol", "event_id", F.col("ts").cast("timestamp").alias("ts"), "price")
    flush = spark.createDataFrame([("~", -1, dt.datetime(2034, 1, 1), 1.0)], ticks.schema)
    whole = ticks.unionByName(flush)
    rules = live.rules_of(strategy_config(spark))
    put = _parts(spark, whole, str(tmp_path), "ts < '2024-01-20 07:30:00'", "ts >= '2024-01-20 07:30:00'")
    for name in ("a", "b"):
        put(name)
        _run(spark, whole, lambda s: streams.stream_live_signals(s, rules), str(tmp_path))
    got = _written(spark, str(tmp_path)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "extremum_ts")})
    assert _events(got) == _events(live.signal_events(bars_of(spark, sf), rules))


@pytest.fixture(scope="module")
def some_bars(spark):
    return bars_of(spark, "/root/testdata/sf0.01").cache()


def test_ungated_events_are_the_candidates(spark, some_bars):
    columns = ("symbol", "strategy_id", "direction", "extremum_ts", "stop", "attempt", "bar_ts", "trigger", "entry_ts", "entry_close", "outcome", "exit_ts", "profit")
    got = live.attempts_of(live.signal_events(some_bars, live.rules_of(strategy_config(spark))))
    want = signals.label_outcomes(signals.detect_candidates(some_bars, strategy_config(spark)), some_bars)
    assert {tuple(r) for r in got.select(*columns).collect()} == {tuple(r) for r in want.select(*columns).collect()}


def test_each_gate_holds_and_bites(spark, some_bars):
    def run(*gates):
        rows = live.signal_events(some_bars, live.rules_of(strategy_config(spark), live.Gates(*gates))).orderBy("symbol", "bar_idx", "strategy_id").collect()
        return rows, sum(r["event"] == "SIGNAL" for r in rows)

    free = run()[1]
    rows, n = run("SIGNALS", 1)
    began = [(r["symbol"], r["direction"], r["ts"].date()) for r in rows if r["event"] == "SIGNAL"]
    assert n < free and len(set(began)) == len(began)
    rows, n = run("LOSSES", 1)
    lost = {}
    for r in rows:
        key = r["symbol"], r["direction"], r["ts"].date()
        if r["event"] == "SL":
            lost[key] = min(lost.get(key, r["bar_idx"]), r["bar_idx"])
    assert n < free and all(r["bar_idx"] <= lost.get((r["symbol"], r["direction"], r["ts"].date()), 10**9) for r in rows if r["event"] == "SIGNAL")
    rows, n = run("OFF", 0, True)
    open_ = {}
    for r in rows:
        key = r["symbol"], r["direction"]
        if r["event"] == "SIGNAL":
            assert not any(until is None or until > r["bar_idx"] for until in open_.get(key, {}).values())
            open_.setdefault(key, {})[r["strategy_id"], r["extremum_ts"], r["attempt"]] = None
        elif r["event"] != "ENTRY":
            open_[key][r["strategy_id"], r["extremum_ts"], r["attempt"]] = r["bar_idx"]
    assert n < free
    assert run("OFF", 0, False, 100.0)[1] < free


# -- indicators by one definition


@pytest.mark.parametrize("name,indicator", [("atr", contract.atr(5)), ("macd", contract.macd()), ("stochastic", contract.stochastic()), ("own", contract.changes_up(6))])
def test_an_indicator_is_one_thing_on_both(spark, sf, name, indicator):
    b = bars_of(spark, sf).cache()
    columns = indicator.names()

    def of(df):
        return {(r["symbol"], r["bar_idx"]): tuple(r[c] for c in columns) for r in df.select("symbol", "bar_idx", *columns).collect()}

    folded = of(contract.on_bars(indicator, b, windows_too=False, size=60))  # in spans, where it has a reach
    assert folded == of(contract._folded(indicator, b)) and len(folded) == b.count()
    by_windows = of(contract.on_bars(indicator, b))
    assert set(by_windows) == set(folded) and all(folded[k] == pytest.approx(v, abs=1e-9) for k, v in by_windows.items())
    flow = b.select("symbol", F.col("bar_ts").cast("timestamp").alias("bar_ts"), "bar_idx", *contract.INPUTS)
    live_rows = _streamed(spark, flow, lambda s: contract.on_stream(indicator, s, DELAY), f"one_{name}", time="bar_ts", late=LATE)
    assert of(live_rows) == folded
    if name == "own":
        windows.register_indicator("up_percent", lambda x, n: contract.on_bars(contract.changes_up(n), x))
        assert of(windows.indicator("up_percent", b, n=6)) == folded
