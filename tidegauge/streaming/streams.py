"""The ordered-series operators on streams: bars, new-bar events, swings, lifecycles, logs and daily results.

Sources are streaming ticks (event_id, ts, symbol, price). Bars need no code of their own: a windowed aggregation with a
watermark. Operators whose next decision depends on earlier ones keep a small state for each key and get its rows in order of
time, as ordered.py says: a row may be late by `late`, and what is decided on it comes out when the watermark has passed it.
"""

from __future__ import annotations

import json
from dataclasses import astuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import live
from tidegauge.operators.lifecycle import ACTIVE, ATTEMPT, BAR, SOURCE, Signal
from tidegauge.sources.sinks import publish_daily_results
from tidegauge.streaming.ordered import DAY_US, Machine, SourceState, event_time, keyed, ordered


def stream_bars(ticks: DataFrame, tf: str = "1 hour", late: str = "10 minutes", closed: bool = False) -> DataFrame:
    """Bars of each symbol: symbol, bar_ts, open, high, low, close, tick_volume. In append mode a bar comes once, when the
    watermark passes its end; in update mode the forming bar comes with every change. With `closed` also the last moment of
    the bar, which carries the watermark on to a further operator."""
    at = F.struct("ts", "event_id")
    bars = event_time(ticks, "ts", late).groupBy("symbol", F.window("ts", tf).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("tick_volume")
    )
    end = [F.window_time("w").alias("closed")] if closed else []
    return bars.select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "tick_volume", *end)


def stream_new_bars(ticks: DataFrame, tf_seconds: int, late: str = "10 minutes") -> DataFrame:
    """The first tick seen of each symbol's bar, once."""
    t = event_time(ticks, "ts", late).withColumn("bar_ts", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / tf_seconds) * tf_seconds))
    return t.dropDuplicatesWithinWatermark(["symbol", "bar_ts"])


def stream_swings(bars: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Confirmed swings of streaming bars with a sign (symbol, bar_ts, bar_idx, high, low, sign: 1, -1 or null): symbol,
    is_peak, extremum_idx, price, confirm_idx. Holds a sign and the leg's extremum for each symbol."""

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        sign, idx, price = state
        own, out = r.sign or 0, []
        if sign:  # the leg goes on, and has the bar that turns it
            edge = r.high if sign > 0 else r.low
            if (edge > price) if sign > 0 else (edge < price):
                idx, price = r.bar_idx, edge
        if own and own != sign and (sign or own > 0):
            if sign:
                out.append((sign > 0, idx, price, r.bar_idx))
            sign, idx, price = own, r.bar_idx, r.high if own > 0 else r.low
        return (sign, idx, price), out

    machine = Machine("sign int, idx long, price double", (0, -1, 0.0), "is_peak boolean, extremum_idx long, price double, confirm_idx long", step)
    return ordered(bars, ("symbol",), "bar_ts", ("bar_idx",), ("high", "low", "sign"), machine, late)


def stream_indicators(bars: DataFrame, n: int = 14, late: str = "0 seconds") -> DataFrame:
    """Mean, exponential mean and mean true range of each streaming bar (symbol, bar_ts, bar_idx, high, low, close): symbol, bar_ts,
    bar_idx, sma, ema, atr, as the batch functions give them. Holds n closes and n true ranges of a symbol, whatever its
    history."""

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        closes, ranges, ema, seen = state
        ranges = [*ranges, max(r.high, closes[-1]) - min(r.low, closes[-1]) if closes else 0.0][-n:]
        closes = [*closes, r.close][-n:]
        ema = r.close if not seen else 2 / (n + 1) * r.close + (1 - 2 / (n + 1)) * ema
        seen += 1
        return (closes, ranges, ema, seen), [(r.us, r.bar_idx, sum(closes) / n if seen >= n else None, ema, sum(ranges) / n if seen > n else None)]

    machine = Machine("closes array<double>, ranges array<double>, ema double, seen long", ([], [], 0.0, 0), "bar_ts long, bar_idx int, sma double, ema double, atr double", step)
    return ordered(bars, ("symbol",), "bar_ts", ("bar_idx",), ("high", "low", "close"), machine, late, ("bar_ts",))


_SIGNAL = "attempt int, status int, signal_us long, signal_idx int, trigger double, anchor double, target double, entry_us long, entry_idx int, entry_close double, seen_idx int"
#: Of SOURCE, what a symbol and strategy don't have in common. Times are microseconds.
_OF = "direction string, slot int, is_peak boolean, extremum_us long, price double"


def stream_signals(setups: DataFrame, point: float = 0.01, least_points: float = 5.0, percent: float = 100.0, late: str = "0 seconds") -> DataFrame:
    """Signals of streaming setups (lifecycle.SOURCE and BAR, one row for each bar and strategy) as they end: lifecycle.SOURCE and
    the columns of lifecycle.ATTEMPT.

    A signal waits, runs and ends as in the batch; what runs when its source changes goes on until it meets its stop or target.
    State of a symbol and strategy: the newest source and its signal, and those that still run.
    """

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        source, held, running = state
        source, signal, out = source and tuple(source), Signal(*held), []
        own = (r.direction, r.slot, r.is_peak, r.extremum_us, r.price)
        bar = (r.us, r.bar_idx, r.high_1, r.low_1, r.high, r.low, r.close, r.eligible, r.base_ok, r.macro_ok, None)
        if own != source:
            if source is not None and signal.status == ACTIVE:
                running = [*running, (*source, *astuple(signal))]
            elif source is not None and (end := signal.left(-1)):
                out.append((*source, *end))
            source, signal = own, Signal()
        left = []
        for x in running:
            of, live = tuple(x[:5]), Signal(*x[5:])
            end = live.exit(1 if of[0] == "BULLISH" else -1, of[4], bar)
            if end:
                out.append((*of, *end))
            else:
                left.append((*of, *astuple(live)))
        if end := signal.step(1 if own[0] == "BULLISH" else -1, own[4], bar, point, least_points, percent):
            out.append((*own, *end))
        return (source, astuple(signal), left), out

    state = f"source struct<{_as_struct(_OF)}>, signal struct<{_as_struct(_SIGNAL)}>, running array<struct<{_as_struct(_OF)}, {_as_struct(_SIGNAL)}>>"
    machine = Machine(state, (None, astuple(Signal()), []), _OF.replace("extremum_us", "extremum_ts") + ", " + ATTEMPT.replace("timestamp_ntz", "long"), step)
    rows = setups.select(*SOURCE, *BAR).withColumn("extremum_us", F.unix_micros(F.col("extremum_ts").cast("timestamp"))).withColumn("slot", F.col("slot").cast("int"))
    columns = ("bar_idx", "direction", "slot", "is_peak", "extremum_us", "price", "high_1", "low_1", "high", "low", "close", "eligible", "base_ok", "macro_ok")
    out = ordered(rows, ("symbol", "strategy_id"), "bar_ts", ("bar_idx",), columns, machine, late, ("extremum_ts", "bar_ts", "entry_ts", "exit_ts"))
    return out.select(*SOURCE, *(x.split(" ")[0] for x in ATTEMPT.split(", ")))


def stream_live_signals(ticks: DataFrame, rules: live.Rules, tf: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Ticks in, signals out, in one query: symbol and live.EVENTS, as live.signal_events has them of the batch's bars.

    Ticks become bars by a windowed aggregation; a symbol's closed bars then go through its structure (swings, means, macro
    bars joined as of each bar) and its signals with their gates. A bar's events come when the watermark has passed its end.
    State of a symbol: some dozens of numbers and the signals that wait or run, as two JSON texts of named fields.
    """
    bars = stream_bars(ticks, tf, late, closed=True)

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        structure, turns = (live.Structure(rules, json.loads(state[0])), live.Turns(rules, json.loads(state[1]))) if state[0] else (live.Structure(rules), live.Turns(rules))
        at = structure.s["bars"]
        events = list(turns.bar(r.bar_us, at, r.high, r.low, r.close, structure.setups(r.bar_us, r.high, r.low, r.close)))
        return (json.dumps(structure.s), json.dumps(turns.s)), events

    machine = Machine("structure string, turns string", ("", ""), ", ".join(f"{name} {ddl}" for name, _, ddl in live.EVENTS), step)
    bars = bars.withColumn("bar_us", F.unix_micros("bar_ts"))
    return ordered(bars, ("symbol",), "closed", (), ("bar_us", "high", "low", "close"), machine, None, ("ts", "extremum_ts"))


def _as_struct(ddl: str) -> str:
    return ", ".join(x.replace(" ", ": ", 1) for x in ddl.split(", "))


def stream_lifecycle(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Decisions on signals that come mixed with the ticks of their symbol: symbol, signal_id, event, ts, price.

    Rows: symbol, ts, event_id, price, and for a row that opens a signal also signal_id, direction, trigger, stop, target.
    A signal waits for the trigger, is then ACTIVE until the stop or the target is met (the stop counts first), and
    goes. State: the signals of a symbol that are still open.
    """

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        left, out = [], []
        for sid, sign, trigger, stop, target, active in state[0]:
            event = None
            if not active and (r.price - trigger) * sign > 0:
                event, active = "ENTRY", True
            elif active and (r.price - stop) * sign < 0:
                event = "SL"
            elif active and (r.price - target) * sign >= 0:
                event = "TP"
            if event:
                out.append((sid, event, r.us, r.price))
            if event not in ("SL", "TP"):
                left.append((sid, sign, trigger, stop, target, active))
        if r.signal_id is not None:
            left.append((r.signal_id, 1 if r.direction == "BULLISH" else -1, r.trigger, r.stop, r.target, False))
        return (left,), out

    state = "open array<struct<id: long, sign: int, trigger: double, stop: double, target: double, active: boolean>>"
    machine = Machine(state, ([],), "signal_id long, event string, ts long, price double", step)
    return ordered(ticks, ("symbol",), "ts", ("event_id",), ("price", "signal_id", "direction", "trigger", "stop", "target"), machine, late, ("ts",))


def stream_source_state(events: DataFrame, ttl_seconds: int = 30 * 86400, late: str = "10 minutes", key: str = "symbol", by_clock: bool = False) -> DataFrame:
    """Attempts and consumption of each source, in update mode: key, source_key, attempts, first_ts, consumed, consumed_ts, as
    reports.source_attempts has them; the last row of a source counts.

    Events: key, source_key, event (ATTEMPT, TP or another), ts. Sources of a key are a map in its state. A source is forgotten
    ttl_seconds after its last event, once the watermark has passed that (to the minute), so that a replay forgets the same
    ones; by_clock: as much later by the clock, in a query that goes on (one that takes what is there and ends doesn't end). One that comes again then begins anew. Rows without a time or source are left out.
    """
    e = event_time(events.where("ts IS NOT NULL AND source_key IS NOT NULL"), "ts", late).withColumn("us", F.unix_micros("ts")).select(key, "ts", "us", "source_key", "event")
    schema = f"{key} {dict(e.dtypes)[key]}, {SourceState.OUT}"
    out = keyed(e).groupBy(key).transformWithState(SourceState(key, ttl_seconds * 1000, by_clock), schema, "update", "processingTime" if by_clock else "eventTime")
    return out.select(key, "source_key", "attempts", F.timestamp_micros("first_us").alias("first_ts"), "consumed", F.timestamp_micros("consumed_us").alias("consumed_ts"))


def stream_daily_counts(outcomes: DataFrame, late: str = "1 day") -> DataFrame:
    """Signals and losses by day and direction, as reports.daily_signal_counts: each day once, when the watermark passes its end."""
    o = event_time(outcomes, "ts", late)
    return o.groupBy(F.window("ts", "1 day").alias("w"), "direction").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("profit") <= -0.01).alias("losses")).select(F.col("w.start").alias("day"), "direction", "signals", "losses")


def _period_us(period: str):
    """Where a time's day or week (from Monday on) begins, and how long it is."""
    if period == "week":
        return lambda us: (us + 3 * DAY_US) // (7 * DAY_US) * 7 * DAY_US - 3 * DAY_US, 7 * DAY_US
    return lambda us: us // DAY_US * DAY_US, DAY_US


def stream_daily_limit(signals: DataFrame, mode: str, limit: int, keys: tuple[str, ...] = ("direction",), late: str = "1 hour") -> DataFrame:
    """keys, ts, signal_id and `allowed` of signals (keys, ts, signal_id, profit), as reports.daily_limit: SIGNALS lets the first
    `limit` of a day through, LOSSES all until that many have lost. A day's count goes when the watermark passes its end."""
    begin, length = _period_us("day")

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        n = state[1]
        counts = mode == "SIGNALS" or r.profit is not None and r.profit <= -0.01
        return (begin(r.us), n + counts), [(r.us, r.signal_id, n < limit)]

    machine = Machine("day long, n long", (0, 0), "ts long, signal_id long, allowed boolean", step, lambda state: state[0] + length)
    return ordered(signals, keys, "ts", ("signal_id",), ("profit",), machine, late, ("ts",))


_LOG = ("label", "state_key", "ts", "event_id", "message")


def stream_log_on_change(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events (label, state_key, ts, event_id, message) whose message differs from their key's last one."""

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        return (True, r.message), [] if tuple(state) == (True, r.message) else [(r.us, r.event_id, r.message)]

    machine = Machine("seen boolean, last int", (False, None), "ts long, event_id long, message int", step)
    return ordered(events, ("label", "state_key"), "ts", ("event_id",), ("message",), machine, late, ("ts",)).select(*_LOG)


def stream_log_throttle(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Events at least `seconds` after their key's last kept one, with the number dropped between."""

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        last, dropped = state
        if last is None or r.us - last >= seconds * 1_000_000:
            return (r.us, 0), [(r.us, r.event_id, r.message, dropped)]
        return (last, dropped + 1), []

    machine = Machine("last long, dropped long", (None, 0), "ts long, event_id long, message int, suppressed long", step)
    return ordered(events, ("label", "state_key"), "ts", ("event_id",), ("message",), machine, late, ("ts",)).select(*_LOG, "suppressed")


def stream_drawdown_lock(equity: DataFrame, threshold: float, period: str = "day", late: str = "10 minutes", releases: bool = False) -> DataFrame:
    """Rows (symbol, ts, event_id, drawdown) with `locked`: an earlier row of the same day or week had a drawdown of at least the
    threshold. The lock goes when the watermark passes the day's or week's end; with `releases` that is a row too, without an
    event_id."""
    begin, length = _period_us(period)

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        return (begin(r.us), state[1] or r.drawdown is not None and r.drawdown >= threshold), [(r.us, r.event_id, state[1])]

    def end(key: tuple, state: tuple) -> tuple[None, list[tuple]]:
        return None, [(state[0] + length, None, False)] if releases and state[1] else []

    machine = Machine("start long, locked boolean", (0, False), "ts long, event_id long, locked boolean", step, lambda state: state[0] + length, end)
    return ordered(equity, ("symbol",), "ts", ("event_id",), ("drawdown",), machine, late, ("ts",))


def stream_force_close(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests (symbol, ts, event_id, reason or null, allowed) as they are carried out: symbol, ts, reason. A reason waits until
    a row of its symbol says that closing is allowed, and isn't queued again while it waits."""

    def step(key: tuple, state: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        waiting = list(state[0])
        if r.reason and r.reason not in waiting:
            waiting.append(r.reason)
        return (([],), [(r.us, reason) for reason in waiting]) if r.allowed else ((waiting,), [])

    machine = Machine("waiting array<string>", ([],), "ts long, reason string", step)
    return ordered(requests, ("symbol",), "ts", ("event_id",), ("reason", "allowed"), machine, late, ("ts",))


def publish_stream(results: DataFrame, path: str, checkpoint: str):
    """Publish each batch of daily results once: a batch that runs again finds its rows already there."""
    return results.writeStream.foreachBatch(lambda batch, _: publish_daily_results(batch.sparkSession, batch, path) and None).option("checkpointLocation", checkpoint)
