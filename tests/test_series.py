"""Values by hand, set-based operators against walks over the bars, and streams against batches."""

import datetime as dt
import glob
import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import fib, scalars
from tidegauge.operators import lifecycle, reports, signals, windows
from tidegauge.operators import swings as W
from tidegauge.plans.registry import bars as bars_of
from tidegauge.sources import sinks
from tidegauge.sources.tables import build_bars, read_deals, read_event_log, read_ticks, strategy_config
from tidegauge.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "x,up,steps,want",
    [(10.0, True, 1, 23.6), (61.8, True, 1, 78.6), (100.0, True, 1, 123.6), (-30.0, True, 1, -23.6), (-10.0, True, 1, 0.0), (0.0, False, 1, -23.6), (30.0, False, 1, 23.6), (100.0, False, 1, 78.6), (-100.0, False, 1, -123.6), (10.0, True, 3, 61.8)],
)
def test_cycled_levels(spark, x, up, steps, want):
    assert one(spark, fib.fib_next_cycled(F.lit(x), steps, up, (23.6, 38.2, 61.8, 78.6, 100.0))) == pytest.approx(want)


def test_cycled_levels_skip_zero(spark):
    assert one(spark, fib.fib_next_cycled(F.lit(-10.0), 1, True, (23.6, 61.8))) == pytest.approx(23.6)


def test_snap_and_gap(spark):
    s = one(spark, fib.snap_level(F.lit(61.70), fib.levels((0.0, 38.2, 61.8, 100.0))))
    assert (s["level"], s["next"]) == (38.2, 61.8)
    assert one(spark, scalars.points_between(F.lit(1.09159), F.lit(1.09159), F.lit(0.00001))) == 0


@pytest.mark.parametrize("text,want", [("08:00-12:30", (480, 750, False, False, True)), ("22:00-02:00", (1320, 120, True, False, True)), ("09:00-09:00", (540, 540, False, True, True)), ("9h-10", (0, 0, False, True, False)), ("", (0, 0, False, True, False)), ("25:00-26:00", (0, 0, False, True, False))])
def test_hhmm(spark, text, want):
    assert tuple(one(spark, scalars.parse_hhmm_range(F.lit(text)))) == want


def test_dst(spark):
    for day, want in (("2024-03-10", True), ("2024-03-09", False), ("2024-11-03", False), ("2024-11-02", True)):
        assert one(spark, scalars.dst_active(F.lit(day).cast("timestamp_ntz"))) is want


def test_ema_is_the_recursion(spark):
    rng = np.random.default_rng(1)
    prices = rng.normal(100, 10, 500).round(2).tolist()
    rows = [("a", "1h", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), p, i) for i, p in enumerate(prices)]
    b = spark.createDataFrame(rows, "symbol string, tf string, bar_ts timestamp_ntz, close double, bar_idx int")
    for n in (1, 2, 21, 200):
        y, k = prices[0], 2 / (n + 1)
        want = [y]
        for p in prices[1:]:
            y = k * p + (1 - k) * y
            want.append(y)
        got = [r["e"] for r in windows.with_ma(b, "EMA", n, "e").orderBy("bar_idx").collect()]
        assert np.allclose(got, want, rtol=1e-12)


def _walk(rows):
    """Swings of one symbol by walking its bars."""
    sign, idx, price, out = 0, -1, 0.0, []
    for r in rows[2:-1]:
        own = 1 if r["v"] > 80 else -1 if r["v"] < 20 else 0
        if sign:
            edge = r["high"] if sign > 0 else r["low"]
            if (edge > price) if sign > 0 else (edge < price):
                idx, price = r["bar_idx"], edge
        if own and own != sign and (sign or own > 0):
            if sign:
                out.append((sign > 0, idx, price, r["bar_idx"]))
            sign, idx, price = own, r["bar_idx"], r["high"] if own > 0 else r["low"]
    return out


def test_swings_are_the_walk(spark, sf):
    b = bars_of(spark, sf, "15min")
    got = {}
    for r in W.swings(b).where("confirmed").orderBy("symbol", "leg_id").collect():
        got.setdefault(r["symbol"], []).append((r["is_peak"], r["extremum_idx"], r["price"], r["confirm_idx"]))
    rows = {}
    for r in windows.with_stochastic(b).withColumn("v", W.oscillator()).orderBy("symbol", "bar_idx").collect():
        rows.setdefault(r["symbol"], []).append(r)
    assert got == {s: w for s, x in rows.items() if (w := _walk(x))}


def test_chunks_change_nothing(spark, sf):
    b = bars_of(spark, sf)
    whole = windows.with_stochastic(b).select("symbol", "bar_idx", "stoch_d")
    cut = windows.in_chunks(b, windows.with_stochastic, 8, 40).select("symbol", "bar_idx", "stoch_d")
    assert whole.exceptAll(cut).count() == cut.exceptAll(whole).count() == 0


def test_one_exchange_for_chained_windows(spark, sf):
    plan = windows.with_stochastic(bars_of(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 2  # the aggregation's and the windows'


def test_throttle_counts_what_it_drops(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 1, t + dt.timedelta(seconds=s), i, 0) for i, s in enumerate((0, 30, 59, 60, 61, 200))]
    e = spark.createDataFrame(rows, "label string, state_key long, ts timestamp_ntz, event_id long, message int")
    got = [(r["event_id"], r["suppressed"]) for r in reports.log_throttle(e, 60).orderBy("event_id").collect()]
    assert got == [(0, 0), (3, 2), (5, 1)]


def test_publish_once(spark, tmp_path):
    rows = [(1, 1, dt.datetime(2024, 1, 1), 1.5, 2), (1, 1, dt.datetime(2024, 1, 1), 1.5, 2), (1, 2, dt.datetime(2024, 1, 1), 0.5, 1)]
    r = spark.createDataFrame(rows, "account long, magic long, day timestamp_ntz, net_pnl double, deals long")
    path = str(tmp_path / "results")
    assert [sinks.publish_daily_results(spark, r, path) for _ in range(2)] == [2, 0]


def _results(spark, days):
    rows = [(a, 1, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 1.5 * a, d) for a in range(3) for d in days]
    return spark.createDataFrame(rows, "account long, magic long, day timestamp_ntz, net_pnl double, deals long")


def test_two_writers_publish_each_day_once(spark, tmp_path):
    path = str(tmp_path / "results")
    spans = [range(0, 8), range(4, 12), range(0, 12), range(8, 16)]
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda days: sinks.publish_daily_results(spark, _results(spark, days), path), spans))
    there = spark.read.parquet(path)
    assert there.count() == there.select("account", "magic", "day").distinct().count() == sum(counts) == 3 * 16


def test_a_killed_batch_is_published_once_when_it_runs_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    sinks.publish_daily_results(spark, _results(spark, range(2)), path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks, "_take", killed)
        with pytest.raises(KeyboardInterrupt):
            sinks.publish_daily_results(spark, _results(spark, range(5)), path)
    assert spark.read.parquet(path).count() == 6  # what was staged isn't seen
    assert [sinks.publish_daily_results(spark, _results(spark, range(5)), path) for _ in range(2)] == [9, 0]
    assert spark.read.parquet(path).count() == 15
    assert sinks.publish_daily_results(spark, _results(spark, []), path) == 0


def _streamed(spark, frame, make, sink, mode="append", time="ts", late=None, key=None):
    """What `make` gives of frame as a stream. A last row, of a key of its own, lets the watermark pass all others; with `late`
    the files come one by one, each with rows that are earlier than some before by up to that."""
    folder = tempfile.mkdtemp()
    key = key or frame.columns[0]
    text = dict(frame.dtypes)[key] == "string"
    flush = frame.orderBy(F.desc(time)).limit(1).withColumns({key: F.lit("~" if text else -99), time: (F.col(time) + F.expr("INTERVAL 3650 DAYS")).cast(dict(frame.dtypes)[time])})
    if late:
        rows = frame.withColumn("__at", F.unix_seconds(F.col(time).cast("timestamp")) + F.pmod(F.xxhash64(*frame.columns), F.lit(late)))
        parts = rows.repartitionByRange(3, "__at").withColumn("__part", F.spark_partition_id()).cache()
        files = [parts.where(F.col("__part") == k).drop("__at", "__part") for k in range(3)]
    else:
        files = [frame]
    for k, part in enumerate([*files, flush.select(*frame.columns)]):
        part.coalesce(1).write.parquet(f"{folder}/made{k}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        (made,) = glob.glob(f"{folder}/made{k}/*.parquet")
        os.rename(made, f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1 if late else 10).parquet(f"{folder}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # few rows: a state store for each partition costs more than they do
    q = make(source).writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(sink).where(F.col(key) != ("~" if text else -99))


def test_stream_bars_are_the_batch(spark, sf):
    t = read_ticks(spark, f"{sf}/events.parquet")
    got = {(r["symbol"], r["bar_ts"]): (r["open"], r["close"], r["tick_volume"]) for r in _streamed(spark, t, lambda s: streams.stream_bars(s), "live_bars", "update", key="symbol").collect()}
    want = {(r["symbol"], r["bar_ts"]): (r["open"], r["close"], r["tick_volume"]) for r in build_bars(t, "1h").collect()}
    assert got == want


def test_stream_logs_are_the_batch(spark, sf):
    e = read_event_log(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"] for r in _streamed(spark, e, streams.stream_log_on_change, "live_changes").collect()}
    assert got == {r["event_id"] for r in reports.changes(e, ("label", "state_key"), ("ts", "event_id"), "message").collect()}
    got = {(r["event_id"], r["suppressed"]) for r in _streamed(spark, e, lambda s: streams.stream_log_throttle(s, 21600), "live_throttle").collect()}
    assert got == {(r["event_id"], r["suppressed"]) for r in reports.log_throttle(e.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 21600).collect()}


def test_stream_swings_are_the_batch(spark, sf):
    b = windows.with_stochastic(bars_of(spark, sf, "15min")).withColumn("v", W.oscillator())
    last = b.groupBy("symbol").agg(F.max("bar_idx").alias("last"))
    b = b.join(last, "symbol").where("bar_idx < last").withColumn("sign", F.when(F.col("bar_idx") < 2, None).when(F.col("v") > 80, 1).when(F.col("v") < 20, -1))
    b = b.select("symbol", F.col("bar_ts").cast("timestamp").alias("bar_ts"), "bar_idx", "high", "low", "sign")
    got = {(r["symbol"], r["extremum_idx"], r["confirm_idx"], r["price"]) for r in _streamed(spark, b, streams.stream_swings, "live_swings", time="bar_ts").collect()}
    want = {(r["symbol"], r["extremum_idx"], r["confirm_idx"], r["price"]) for r in W.swings(bars_of(spark, sf, "15min")).where("confirmed").collect()}
    assert got == want


def test_stream_lifecycle(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=i), i, p, 7 if i == 0 else None, "BULLISH" if i == 0 else None, 10.0 if i == 0 else None, 8.0 if i == 0 else None, 12.0 if i == 0 else None) for i, p in enumerate((9.0, 9.5, 10.5, 11.0, 12.5, 7.0))]
    e = spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, price double, signal_id long, direction string, trigger double, stop double, target double")
    got = [(r["event"], r["price"]) for r in _streamed(spark, e, streams.stream_lifecycle, "live_cycle").orderBy("ts").collect()]
    assert got == [("ENTRY", 10.5), ("TP", 12.5)]


def test_snapshot_sees_all_of_a_long_leg(spark):
    """A peak leg of more than 512 bars: flat closes keep the stochastic high, and slot 0 is still the leg's highest high."""
    close = [round(float(100 + 10 * np.sin(i / 4)), 2) for i in range(384)] + [109.0] * 1200
    high, low = [c + 1 for c in close], [c - 1 for c in close]
    high[500] = 150.0
    rows = [("a", "1h", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, c, h, x, c) for i, (c, h, x) in enumerate(zip(close, high, low))]
    b = spark.createDataFrame(rows, "symbol string, tf string, bar_ts timestamp_ntz, bar_idx int, open double, high double, low double, close double")
    newest = {}
    for r in W.swings(b).where("confirmed").orderBy("leg_id").collect():
        newest[r["confirm_idx"]] = (r["is_peak"], r["extremum_idx"])
    stoch = {r["bar_idx"]: r["v"] for r in windows.with_stochastic(b).withColumn("v", W.oscillator()).collect()}
    got = {r["bar_idx"]: r["slots"] for r in W.structure_snapshot(b).collect()}
    longest = 0
    for i in range(len(rows)):
        seen = [c for c in newest if c <= i - 1]
        if not seen:
            assert got[i] is None
            continue
        peak, start = newest[max(seen)]
        longest = max(longest, i - start)
        at = range(start, i)
        best = max(at, key=lambda j: (-low[j] if peak else high[j], j))
        osc = (min if peak else max)(stoch[j] for j in at)
        assert tuple(got[i][0]) == (0, not peak, rows[best][2], best, low[best] if peak else high[best], osc)
    assert longest > 1000


# -- signals of sources


def _bar(i, close, high_1=10.0, low_1=9.0, eligible=False, base=True, macro=True, high=None, low=None):
    return (i, i, high_1, low_1, high if high is not None else close, low if low is not None else close, close, eligible, base, macro, 99)


def _life(bars, stop=8.0):
    s, out = lifecycle.Signal(), []
    for b in bars:
        if end := s.step(1, stop, b, 0.01, 5.0, 100.0):
            out.append((end[0], end[9], end[11]))
    if end := s.left(99):
        out.append((end[0], end[9], end[11]))
    return out


def test_a_source_is_tried_again_until_a_target():
    b = [_bar(0, 9.5, eligible=True), _bar(1, 10.5, eligible=True), _bar(2, 7.5, eligible=True), _bar(3, 9.0, eligible=True), _bar(4, 10.5), _bar(5, 13.5), _bar(6, 9.5, eligible=True)]
    # enters at 10.5 with the stop at 8 and so the target at 13; stopped, tried again by the next bar, entered, hit; then never again
    assert _life(b) == [(1, "SL", 2), (2, "TP", 5)]
    assert _life([_bar(0, 9.5, eligible=True), _bar(1, 10.5, base=False), _bar(2, 9.5, eligible=True), _bar(3, 10.5, macro=False), _bar(4, 9.0)]) == [(1, "BASE_EXPIRED", 1), (2, "MACRO_EXPIRED", 3)]
    assert _life([_bar(0, 9.5, eligible=True), _bar(1, 9.5)]) == [(1, "EXPIRED", None)]
    assert _life([_bar(98, 9.5, eligible=True), _bar(99, 9.5)]) == [(1, "PENDING", None)]
    assert _life([_bar(0, 9.5, eligible=True), *(_bar(i, 9.5) for i in range(1, 80)), _bar(80, 10.5), *(_bar(i, 11.0) for i in range(81, 98)), _bar(98, 13.5)]) == [(1, "TP", 98)]  # no limit of bars


def test_the_trigger_follows_closed_bars_towards_the_stop():
    # the edge comes down to 9.2, so that 9.5 enters; an edge below the stop, or nearer than five points, is no trigger
    assert _life([_bar(0, 9.5, eligible=True), _bar(1, 9.1, high_1=9.2), _bar(2, 9.5, high_1=9.3), _bar(3, 7.0)]) == [(1, "SL", 3)]
    s = lifecycle.Signal()
    for b in (_bar(0, 9.0, eligible=True), _bar(1, 7.9, high_1=7.5), _bar(2, 7.9, high_1=8.02)):
        s.step(1, 8.0, b, 0.01, 5.0, 100.0)
    assert s.anchor == 10.0 and s.status == lifecycle.PENDING


def test_first_bar_is_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 9000  # more than FAN * FAN * 2 bars
    close = np.cumsum(rng.normal(size=n)).round(2)
    high, low = close + 0.5, close - 0.5
    b = spark.createDataFrame(pd.DataFrame({"symbol": "a", "bar_idx": np.arange(n, dtype="int32"), "close": close, "high": high, "low": low}))
    asks = [(k, "a", int(i), float(close[i] + d)) for k, (i, d) in enumerate(zip(rng.integers(0, n, 300), rng.normal(size=300) * 40))]
    q = spark.createDataFrame(asks, "k int, symbol string, at int, goal double")
    got = {r["k"]: r["hit_idx"] for r in lifecycle.first_bar(q, ("k",), b, "at", lambda cl, ch, lo, hi: hi >= F.col("goal")).collect()}
    assert got == {k: int(i + 1 + np.argmax(high[i + 1 :] >= g)) for k, _, i, g in asks if (high[i + 1 :] >= g).any()}


def test_stream_signals_are_the_batch(spark, sf):
    b = bars_of(spark, sf, "15min")
    s = signals.setups(b, strategy_config(spark), macros=("3h", "4h", "8h"))
    want = signals.label_outcomes(signals.detect_candidates(b, strategy_config(spark)), b).where("outcome NOT IN ('OPEN', 'PENDING')")
    want = {(r["symbol"], r["strategy_id"], r["extremum_ts"], r["attempt"]): (r["outcome"], r["exit_idx"] if r["outcome"] in ("TP", "SL") else None) for r in want.collect()}
    flow = s.select(*lifecycle.SOURCE, *lifecycle.BAR).withColumns({c: F.col(c).cast("timestamp") for c in ("bar_ts", "extremum_ts")})
    rows = _streamed(spark, flow, streams.stream_signals, "live_signals", time="bar_ts").collect()
    got = {(r["symbol"], r["strategy_id"], r["extremum_ts"], r["attempt"]): (r["outcome"], r["exit_idx"] if r["outcome"] in ("TP", "SL") else None) for r in rows}
    assert len(got) == len(rows) and got == want and len(want) > 20


def test_stream_indicators_are_the_batch(spark, sf):
    b = bars_of(spark, sf)
    b = windows.with_ma(windows.with_ma(windows.with_atr(b, 5), "SMA", 5, "sma"), "EMA", 5, "ema")
    flow = b.select("symbol", F.col("bar_ts").cast("timestamp").alias("bar_ts"), "bar_idx", "high", "low", "close")
    got = {(r["symbol"], r["bar_idx"]): (r["sma"], r["ema"], r["atr"]) for r in _streamed(spark, flow, lambda x: streams.stream_indicators(x, 5), "live_indicators", time="bar_ts").collect()}
    for r in b.collect():
        assert got.pop((r["symbol"], r["bar_idx"])) == pytest.approx((r["sma"], r["ema"], r["atr"]), abs=1e-6)
    assert not got


def test_stream_new_bars_come_once(spark, sf):
    t = read_ticks(spark, f"{sf}/events.parquet")
    rows = _streamed(spark, t, lambda s: streams.stream_new_bars(s, 3600, "40 days"), "live_new", key="symbol").collect()
    assert {(r["symbol"], r["bar_ts"]) for r in rows} == {(r["symbol"], r["bar_ts"]) for r in build_bars(t, "1h").collect()} and len(rows) == len({(r["symbol"], r["bar_ts"]) for r in rows})


def test_stream_locks_and_closes(spark, sf):
    t = dt.datetime(2024, 1, 1)
    eq = read_ticks(spark, f"{sf}/events.parquet").withColumn("drawdown", F.col("price"))
    for period in ("day", "week"):
        flow = eq.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "drawdown")
        live = {r["event_id"]: r["locked"] for r in _streamed(spark, flow, lambda s: streams.stream_drawdown_lock(s, 480.0, period), f"live_lock_{period}").collect()}
        assert live == {r["event_id"]: r["locked"] for r in reports.drawdown_lock(eq, F.lit(480.0), period, order=("ts", "event_id")).collect()}
    rows = [("a", t + dt.timedelta(seconds=i), i, reason, ok) for i, (reason, ok) in enumerate([("x", False), ("x", False), ("y", False), (None, True), (None, True), ("x", True)])]
    r = spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, reason string, allowed boolean")
    assert [x["reason"] for x in _streamed(spark, r, streams.stream_force_close, "live_closes").orderBy("ts", "reason").collect()] == ["x", "y", "x"]


def test_stream_publishes_once(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), 1.5, 2), (1, 2, dt.datetime(2024, 1, 2), 0.5, 1)], "account long, magic long, day timestamp_ntz, net_pnl double, deals long")
    r.write.parquet(str(tmp_path / "in"))
    for turn in range(2):
        flow = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
        streams.publish_stream(flow, str(tmp_path / "out"), str(tmp_path / f"check{turn}")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_event_log_is_written_by_day(spark, sf, tmp_path):
    e = read_event_log(spark, f"{sf}/events.parquet")
    sinks.write_event_log(e, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == e.count()
    assert {r["day"] for r in spark.read.text(str(tmp_path / "log")).select("day").distinct().collect()} == {int(r["d"]) for r in e.select(F.date_format("ts", "yyyyMMdd").alias("d")).distinct().collect()}


def test_deals_since_and_until_reach_the_scan(spark, sf):
    whole = read_deals(spark, f"{sf}/lineitem.parquet")
    cut = read_deals(spark, f"{sf}/lineitem.parquet", "1995-01-01", "1996-01-01", 3600)
    a, b = dt.datetime(1995, 1, 1, 1), dt.datetime(1996, 1, 1, 1)
    assert cut.count() == whole.where((F.col("deal_time") >= F.lit(a)) & (F.col("deal_time") < F.lit(b))).count() > 0
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual" in cut._jdf.queryExecution().executedPlan().toString()


def test_indicators_by_name(spark, sf):
    b = bars_of(spark, sf)
    windows.register_indicator("double", lambda x, by=2: x.withColumn("d", F.col("close") * by))
    assert windows.indicator("double", b, by=3).where("d <> close * 3").count() == 0
    assert "atr" in windows.indicator("atr", b, n=5).columns


@pytest.mark.parametrize("n", [1, 2, 3, 90, 2000])
def test_exponential_means_of_long_histories(spark, n):
    rng = np.random.default_rng(n)
    close = 100 + np.cumsum(rng.normal(size=5000))
    b = spark.createDataFrame(pd.DataFrame({"symbol": "a", "tf": "1h", "bar_ts": pd.date_range("2024-01-01", periods=5000, freq="h"), "bar_idx": np.arange(5000, dtype="int32"), "close": close}))
    for method, k in (("EMA", 2 / (n + 1)), ("SMMA", 1 / n)):
        want = [close[0]]
        for x in close[1:]:
            want.append(k * x + (1 - k) * want[-1])
        got = [r["y"] for r in windows.with_ma(b, method, n, "y").orderBy("bar_idx").collect()]
        assert np.allclose(got, want, rtol=1e-11, atol=0)
