"""Trade candidates, gates and outcomes on bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators.joins import asof_closed_bars, cross_strategies, dimension
from tidegauge.operators.lifecycle import first_bar, source_signals
from tidegauge.operators.swings import current_extremum, structure_snapshot
from tidegauge.operators.windows import KEYS, lag, with_ma
from tidegauge.sources.stored import stored
from tidegauge.sources.tables import resample_bars


def is_bull() -> Column:
    return F.col("direction") == S.BULLISH


def directional_slope(direction: Column | str, now: Column, before: Column, strict: bool = False) -> Column:
    """Whether a value didn't fall (for bulls) or rise (for bears); with `strict`, whether it moved their way."""
    d = F.col(direction) if isinstance(direction, str) else direction
    way = (now - before) * S.direction_multiplier(d)
    return way > 0 if strict else way >= 0


def first_reason(**blocked: Column) -> Column:
    """The name of the first condition that holds, null if none does."""
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in blocked.items()))


def attempt_gate(rows: DataFrame, mode: str = "BOTH") -> DataFrame:
    """Add blocked_by: manual, algo, protection, equity, session, daily_limit, direction or concurrency, whichever comes
    first, from the boolean columns *_ok; null when all let the attempt through. A missing answer blocks."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    direction = F.lit(mode != "BOTH") & (F.col("direction") != mode)
    return rows.withColumn("blocked_by", first_reason(manual=no("manual_ok"), algo=no("algo_ok"), protection=no("protection_ok"), equity=no("equity_ok"), session=no("session_ok"), daily_limit=no("daily_ok"), direction=direction, concurrency=no("single_ok")))


def with_next_price(rows: DataFrame, anchor: Column, level_points: Column, protective_points: Column, broker_points: Column, ask: Column, bid: Column, previous: Column, tick: float) -> DataFrame:
    """Add next_price, source and reasons: where the next order of a row's direction goes, from its level in points beyond the anchor.

    It must be beyond the own side's price (ask for bulls, bid for bears; the other where that is missing) by the protective and
    the broker's points; without any price yet it falls back to one tick beyond the side's. Then it goes to a tick away from
    the side, and never further than the order before it. Prices and points of 0 or less are missing. Each step is a column
    that the next ones read, as one expression would repeat them many times over.
    """
    c, sign, bull = F.col, F.col("__sign"), is_bull()
    own, other = F.when(bull, ask).otherwise(bid), F.when(bull, bid).otherwise(ask)
    r = rows.withColumns({"__sign": S.direction_multiplier("direction"), "__side": F.when(own > 0, own).otherwise(other)})
    r = r.withColumn("__level", F.when((anchor > 0) & (level_points > 0), anchor + sign * level_points * tick).otherwise(0.0))
    for before, after, points in (("__level", "__safe", protective_points), ("__safe", "__far", broker_points)):
        r = r.withColumn(f"{after}_least", c("__side") + sign * points * tick)
        r = r.withColumn(f"{after}_hit", (c("__side") > 0) & (points > 0) & ((c(before) <= 0) | ((c(f"{after}_least") - c(before)) * sign > 0)))
        r = r.withColumn(after, F.when(c(f"{after}_hit"), c(f"{after}_least")).otherwise(c(before)))
    r = r.withColumn("__fallback", (c("__far") <= 0) & (c("__side") > 0))
    r = r.withColumn("__found", F.when(c("__fallback"), c("__side") + sign * tick).otherwise(F.when(c("__far") <= 0, c("__level")).otherwise(c("__far"))))
    r = r.withColumn("__whole", F.when(bull, F.ceil(c("__found") / tick - 1e-9)).otherwise(F.floor(c("__found") / tick + 1e-9)) * tick)
    r = r.withColumn("__rounded", (c("__found") > 0) & (F.abs(c("__whole") - c("__found")) > 1e-9)).withColumn("__placed", F.when(c("__rounded"), c("__whole")).otherwise(c("__found")))
    r = r.withColumn("__beyond", (c("__placed") - previous) * sign).withColumn("__held", (previous > 0) & (c("__placed") > 0) & (c("__beyond") > 0))
    r = r.withColumn("next_price", F.when(c("__held"), previous).otherwise(c("__placed")))
    clamped = c("__safe_hit") | c("__far_hit")
    source = F.when(c("next_price") <= 0, "-").when(c("__held"), "monotonic").when(c("__rounded"), "clamped").when(c("__fallback"), "side_fallback").when(clamped, "clamped").otherwise("baseline")
    said = S.join_reasons(F.when(c("__safe_hit"), "protective"), F.when(c("__far_hit"), "broker_stops"), F.when(c("__fallback"), "fallback_side"), F.when(c("__rounded"), "tick_round"), F.when(c("__held") & (c("__beyond") > tick + 1e-9), "monotonic"))
    r = r.withColumns({"source": source, "reasons": said})
    return r.drop(*(x for x in r.columns if x.startswith("__")))


def spread_guard(ticks: DataFrame, most_points: float, digits: int = 2) -> DataFrame:
    """Ticks whose spread is no more than so many points; a millionth of a point is forgiven. Ticks without both prices go."""
    return ticks.where(S.spread_points(digits) <= most_points + 1e-6)


def direction_rejects(rows: DataFrame, context: str = "BASE", trigger: str = "LIMIT") -> DataFrame:
    """Rows (id, direction, is_bottom, peak, bottom, price, ts) whose structure's orientation doesn't fit their direction, as the
    event log tells of them: id, ts, label, state_key (what changed-only logs compare by) and message."""
    from tidegauge.functions.levels import orientation_matches

    orientation = F.when(F.col("is_bottom"), "BOTTOM").otherwise("PEAK")
    at = F.date_format("ts", "yyyy.MM.dd HH:mm:ss")
    number = lambda c: F.format_string("%.5f", S.round_digits(c, 5))
    text = S.kv_message(reason=F.lit("STRUCTURE_DIRECTION_MISMATCH"), context=F.lit(context), trigger=F.lit(trigger), dir=F.col("direction"), orientation=orientation, current_is_bottom=F.col("is_bottom"), peak=number("peak"), bottom=number("bottom"), close=number("price"), structure_ts=at)
    key = F.concat_ws("|", F.lit(context), "direction", orientation, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    out = rows.where(~orientation_matches("direction", "is_bottom"))
    return out.select("id", "ts", F.lit("SIGNAL_REJECT").alias("label"), key.alias("state_key"), text.alias("message"))


def execution_eligibility(rows: DataFrame, max_spread_points: float, least_points: Column) -> DataFrame:
    """Add refused_by, the first failing check of an order, and allowed.

    Needs direction, market_status, locked, session_ok, spread_points, price, entry_price, tp_points, next_points, volume,
    min_volume, margin, free_margin.
    """
    bad = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    reason = first_reason(
        snapshot=F.col("price").isNull(), direction=~F.col("direction").isin(S.BULLISH, S.BEARISH), market=~F.col("market_status").isin("ACTIVE"), protection=F.col("locked"), session=~F.col("session_ok"),
        spread=F.col("spread_points") > max_spread_points, price=bad("price"), entry=bad("entry_price"), tp_distance=F.col("tp_points") < least_points, next_distance=F.col("next_points") < least_points,
        volume=F.col("volume") < F.col("min_volume"), margin=F.col("margin") > F.col("free_margin"),
    )
    return rows.withColumn("refused_by", reason).withColumn("allowed", F.col("refused_by").isNull())


def market_status(mode: Column, guarded: Column) -> Column:
    return F.when(mode == "CLOSEONLY", "BROKER_CLOSEONLY").when(mode == "DISABLED", "BROKER_DISABLED").when(guarded, "CLOSE_GUARD").otherwise("ACTIVE")


def entry_geometry_valid(trigger: Column, stop: Column) -> Column:
    return (trigger > 0) & (stop > 0) & F.when(is_bull(), trigger > stop).otherwise(trigger < stop)


def _base_means(bars: DataFrame, delays: tuple[int, ...], n: int) -> DataFrame:
    """Of each bar: the mean of n closes some bars ago and one before that, for every delay."""
    b = with_ma(bars, "SMA", n, "ma")
    return b.withColumns({f"ma_{d}": lag("ma", d) for d in delays} | {f"was_{d}": lag("ma", d + 1) for d in delays}).select("symbol", "bar_ts", "low", "high", *(f"{k}_{d}" for k in ("ma", "was") for d in delays))


def _picked(by: str, kind: str, of: tuple) -> Column:
    return F.coalesce(*(F.when(F.col(by) == x, F.col(f"__{kind}_{x}")) for x in of))


def with_base_setup(rows: DataFrame, bars: DataFrame, delays: tuple[int, ...], n: int = 21) -> DataFrame:
    """Add base_ma and base_ma_before, the mean of base_delay bars before the extremum and one before; base_setup, whether
    the extremum lies beyond that mean while it moved their way (a bottom below a rising mean for bulls, a peak above a
    falling one for bears); and base_ok, whether the mean of base_delay bars before the row's own bar moved their way."""
    means = _base_means(bars, delays, n)
    names = [c for c in means.columns if c not in ("symbol", "bar_ts")]
    for time, prefix in (("extremum_ts", "__"), ("bar_ts", "__now_")):
        own = means.select(F.col("symbol").alias("__symbol"), F.col("bar_ts").alias("__ts"), *(F.col(c).alias(f"{prefix}{c}") for c in names))
        rows = rows.join(own, (F.col("symbol") == F.col("__symbol")) & (F.col(time) == F.col("__ts")), "left").drop("__symbol", "__ts")
    rows = rows.withColumns({"base_ma": _picked("base_delay", "ma", delays), "base_ma_before": _picked("base_delay", "was", delays)})
    up = ~F.col("is_peak") & (F.col("__low") < F.col("base_ma")) & (F.col("base_ma") > F.col("base_ma_before"))
    down = F.col("is_peak") & (F.col("__high") > F.col("base_ma")) & (F.col("base_ma") < F.col("base_ma_before"))
    now = directional_slope("direction", _picked("base_delay", "now_ma", delays), _picked("base_delay", "now_was", delays), strict=True)
    setup = F.when(is_bull(), up).otherwise(down)
    return rows.withColumns({"base_setup": F.coalesce(setup, F.lit(False)), "base_ok": F.coalesce(now, F.lit(False))}).drop(*(f"{p}{c}" for p in ("__", "__now_") for c in names))


def base_setup(rows: DataFrame, bars: DataFrame, delays: tuple[int, ...], n: int = 21) -> DataFrame:
    return with_base_setup(rows, bars, delays, n).where("base_setup").drop("base_setup", "base_ok")


def with_macro(rows: DataFrame, bars: DataFrame, tfs: tuple[str, ...], n: int = 21) -> DataFrame:
    """Add macro_ma and macro_ma_before, the mean of the last closed bar of the row's macro timeframe and of the one before,
    and macro_ok, whether it moved their way. All timeframes take one pass over the bars and one window."""
    macro = with_ma(resample_bars(bars, *tfs), "SMA", n, "ma").withColumn("ma_before", lag("ma"))
    out = asof_closed_bars(rows, macro, {"ma": F.col("ma"), "was": F.col("ma_before")}, tfs)
    out = out.withColumns({"macro_ma": _picked("macro", "ma", tfs), "macro_ma_before": _picked("macro", "was", tfs)})
    ok = F.when(is_bull(), F.col("macro_ma") > F.col("macro_ma_before")).otherwise(F.col("macro_ma") < F.col("macro_ma_before"))
    return out.withColumn("macro_ok", F.coalesce(ok, F.lit(False))).drop(*(f"__{k}_{tf}" for k in ("ma", "was") for tf in tfs))


def macro_confirm(rows: DataFrame, bars: DataFrame, tfs: tuple[str, ...], n: int = 21) -> DataFrame:
    return with_macro(rows, bars, tfs, n).where("macro_ok").drop("macro_ok")


def fresh_structure(rows: DataFrame) -> DataFrame:
    """Rows whose extremum is newer than all used before by the symbol, strategy and direction."""
    w = Window.partitionBy("symbol", "strategy_id", "direction").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__used", F.max("extremum_ts").over(w)).where(F.col("__used").isNull() | (F.col("extremum_ts") > F.col("__used"))).drop("__used")


def with_attempt_index(rows: DataFrame) -> DataFrame:
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy("source_key").orderBy("bar_ts")))


def setups(bars: DataFrame, strategies: DataFrame, delays: tuple[int, ...] = (3, 5, 10), macros: tuple[str, ...] = ("3h", "4h", "8h"), allowed: Column | None = None) -> DataFrame:
    """Each bar with its current extremum, for every strategy, in the direction that the extremum speaks for: what
    source_signals reads of it. A bar is eligible when base setup, macro mean and entry geometry hold, and `allowed` (a
    Column over bars, such as the outcome of gates)."""
    x = stored(current_extremum(structure_snapshot(bars)), "extrema")
    own = bars.withColumn("allowed", F.lit(True) if allowed is None else allowed).select("symbol", "bar_ts", lag("high").alias("high_1"), lag("low").alias("low_1"), "high", "low", "close", "allowed", F.max("bar_idx").over(Window.partitionBy(*KEYS)).alias("last_idx"))
    c = cross_strategies(x.join(own, ["symbol", "bar_ts"]), strategies).where(F.when(is_bull(), ~F.col("is_peak")).otherwise(F.col("is_peak")))
    c = with_macro(with_base_setup(c, bars, delays), bars, macros)
    edge = F.when(is_bull(), F.col("high_1")).otherwise(F.col("low_1"))
    valid = F.coalesce(entry_geometry_valid(edge, F.col("price")), F.lit(False))
    return c.withColumn("eligible", F.col("base_setup") & F.col("macro_ok") & valid & F.col("allowed"))


def detect_candidates(bars: DataFrame, strategies: DataFrame, delays: tuple[int, ...] = (3, 5, 10), macros: tuple[str, ...] = ("3h", "4h", "8h"), allowed: Column | None = None) -> DataFrame:
    """The signals of each source, with trigger (the last closed bar's high or low), stop (the extremum), target, key and
    number, and what became of them: see source_signals. A source is tried again after a stop or a failed confirmation, not
    while a signal of it waits or runs, and not after a target.

    The bars are read several times: pass a stored table. The result is one (a row for each signal)."""
    c = setups(bars, strategies, delays, macros, allowed)
    c = source_signals(c).join(dimension(strategies.select("strategy_id", "label")), "strategy_id")
    key = S.source_key(F.col("label"), F.col("direction"), F.col("slot"), F.col("is_peak"), F.unix_seconds(F.col("extremum_ts").cast("timestamp")), F.col("price"))
    target = S.tp_price("direction", "trigger", "price", 100.0)
    c = c.withColumnsRenamed({"target": "running_target"}).withColumns({"stop": F.col("price"), "target": target, "source_key": F.concat_ws("|", "symbol", key)})
    return stored(c, "candidates")


def label_outcomes(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcomes of detected candidates: entry_ts, entry_close, exit_ts, exit_close, outcome (TP, SL, OPEN, and as in
    source_signals for those without an entry) and profit.

    A signal that runs when its source is over ends at the first later bar that closes beyond the stop or reaches the
    target, however late; the stop counts first on one bar.
    """
    keys = ("symbol", "strategy_id", "source_key", "attempt")
    live = candidates.where("outcome IS NULL")

    def ends(close_low: Column, close_high: Column, low: Column, high: Column) -> Column:
        return F.when(is_bull(), (close_low < F.col("stop")) | (high >= F.col("running_target"))).otherwise((close_high > F.col("stop")) | (low <= F.col("running_target")))

    found = first_bar(live, keys, bars, "seen_idx", ends)
    at = bars.select(F.col("symbol").alias("__s"), F.col("bar_idx").alias("__i"), F.struct("bar_ts", "close").alias("__bar"))
    found = found.join(at, (F.col("symbol") == F.col("__s")) & (F.col("hit_idx") == F.col("__i"))).select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("hit_idx"), "__bar")
    c = candidates.join(found, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left")
    stopped = F.when(is_bull(), F.col("__bar.close") < F.col("stop")).otherwise(F.col("__bar.close") > F.col("stop"))
    late = F.when(F.col("__bar").isNull(), "OPEN").when(stopped, "SL").otherwise("TP")
    ended = F.col("outcome").isin("TP", "SL")  # an end without an entry is no exit
    c = c.withColumns({
        "exit_ts": F.coalesce(F.when(ended, F.col("exit_ts")), F.col("__bar.bar_ts")), "exit_close": F.coalesce(F.when(ended, F.col("exit_close")), F.col("__bar.close")), "exit_idx": F.coalesce(F.when(ended, F.col("exit_idx")), F.col("hit_idx")),
        "outcome": F.coalesce("outcome", late),
    })
    price = F.when(F.col("outcome") == "SL", F.col("exit_close")).when(F.col("outcome") == "TP", F.col("running_target"))
    return c.withColumn("profit", (price - F.col("entry_close")) * S.direction_multiplier("direction")).drop("__bar", "hit_idx", *(f"__k_{k}" for k in keys))


def outcome_report(outcomes: DataFrame, *keys: str) -> DataFrame:
    """By keys: candidates, entered, targets, stops, wins and profit (2 decimals); only ends count as wins and profit."""
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.count("entry_ts").alias("entered"), F.count_if(F.col("outcome") == "TP").alias("targets"), F.count_if(F.col("outcome") == "SL").alias("stops"),
        F.count_if(S.outcome_class("profit") == "WIN").alias("wins"), S.round_digits(F.coalesce(F.sum("profit"), F.lit(0.0)), 2).alias("profit"),
    )


def execution_plan(candidates: DataFrame, spec: DataFrame, levels: int = 3, multiplier: float = 1.5, risk_amount: float = 100.0, tp_percent: float = 100.0) -> DataFrame:
    """Leg table of candidates: entry, distance, price, target and lot of each level."""
    from tidegauge.operators.joins import enrich_symbol

    c = enrich_symbol(candidates, spec).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    base = F.abs(F.col("trigger") - F.col("stop")) / F.col("point_size")
    distance = S.level_distance(base, multiplier, F.col("level"), F.col("min_stop_distance"))
    value = S.point_value("tick_value", "point_size", "tick_size")
    c = c.withColumns({"distance_points": distance, "point_value": value})
    sign = S.direction_multiplier("direction")
    price = F.when(F.col("level") == 0, F.col("trigger")).otherwise(F.col("trigger") - sign * F.col("distance_points") * F.col("point_size"))
    lot = S.normalize_volume(F.try_divide(F.lit(risk_amount), F.col("distance_points") * F.col("point_value")) * F.pow(F.lit(multiplier), F.col("level")), "min_volume", "max_volume", "volume_step")
    c = c.withColumns({"leg_price": price, "lot": lot, "tp": S.tp_price("direction", "trigger", "stop", tp_percent)})
    comment = S.leg_comment(F.col("label"), F.col("direction"), F.unix_seconds(F.col("bar_ts").cast("timestamp")), F.col("level"))
    return c.select("symbol", "bar_ts", "strategy_id", "direction", "level", "distance_points", "leg_price", "tp", "lot", comment.alias("comment"))


def range_distance(mode: str, points: float, least: Column, tick: float, point: float, atr: Column | None = None, structure: Column | None = None) -> Column:
    """Distance in points of a signal's range, at least the broker's: ATR of the last closed bar, fixed POINTS, or the
    STRUCTURE's base distance. Null where there is none."""
    if mode == "STRUCTURE":
        return structure
    own = F.when(atr > 0, atr / point) if mode == "ATR" else F.lit(float(points))
    return F.when(own.isNotNull(), S.enforce_distance(own, least, F.lit(tick), F.lit(point)))


def expire_on_new_source(pending: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Add valid_until, the first bar at which the symbol's current extremum (of current_extremum) isn't any more the one that
    each pending signal (symbol, bar_ts, extremum_ts, is_peak, price) came from; null while it is. Signals with an open or
    active leg (exposed) don't expire. A source is one run of bars: the next run's start is its end."""
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    x = snapshot.select("symbol", "bar_ts", "extremum_ts", "is_peak", "price")
    same = F.lit(True)
    for c in ("extremum_ts", "is_peak", "price"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    starts = x.withColumn("__same", same).where(~F.col("__same")).withColumn("__until", F.lead("bar_ts").over(w))
    runs = starts.select(F.col("symbol").alias("__s"), F.col("bar_ts").alias("__from"), "__until", F.col("extremum_ts").alias("__x"), F.col("is_peak").alias("__p"), F.col("price").alias("__v"))
    on = (F.col("symbol") == F.col("__s")) & (F.col("extremum_ts") == F.col("__x")) & (F.col("is_peak") == F.col("__p")) & (F.col("price") == F.col("__v"))
    on = on & (F.col("bar_ts") >= F.col("__from")) & (F.col("__until").isNull() | (F.col("bar_ts") < F.col("__until")))
    out = pending.join(runs, on, "left").withColumn("valid_until", F.when(~F.col("exposed"), F.col("__until")))
    return out.drop("__s", "__from", "__until", "__x", "__p", "__v")


def close_guard(ts: Column, session_end: Column, seconds: int) -> Column:
    """Whether a time is in the last span of so many seconds that ends with the session, spans counted from midnight."""
    second = F.col(ts) if isinstance(ts, str) else ts
    return (second >= F.floor((session_end - 1) / seconds) * seconds) & (second < session_end)


def session_exit_edges(rows: DataFrame) -> DataFrame:
    """Rows (symbol, slot, ts, active) at which a slot that was active on the row before of that day is not any more."""
    w = Window.partitionBy("symbol", "slot", F.date_trunc("day", "ts")).orderBy("ts")
    return rows.withColumn("__was", F.lag("active").over(w)).where(F.col("__was") & ~F.col("active")).drop("__was")
