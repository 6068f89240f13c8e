"""Column functions on prices, times, volumes and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLISH, BEARISH = "BULLISH", "BEARISH"


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def round_digits(x: Column | str, digits: int) -> Column:
    """To so many decimals, halves up, on the binary double."""
    scale = float(10**digits)
    return F.floor(_c(x) * scale + 0.5) / scale


def round6(x: Column | str) -> Column:
    return round_digits(x, 6)


# -- bars


def applied_price(kind: str, weighted: str = "hlcc4") -> Column:
    """CLOSE, OPEN, HIGH, LOW, MEDIAN, TYPICAL or WEIGHTED; weighted says of what the last is the mean: hlcc4 or ohlc4."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    last = (o + h + low + c) / 4 if weighted == "ohlc4" else (h + low + 2 * c) / 4
    return {"CLOSE": c, "OPEN": o, "HIGH": h, "LOW": low, "MEDIAN": (h + low) / 2, "TYPICAL": (h + low + c) / 3, "WEIGHTED": last}[kind]


def candle_anatomy(point: float) -> dict[str, Column]:
    """Body, wicks, and the wicks' weights in the candle."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    body, upper, lower = top - bottom, F.col("high") - top, bottom - F.col("low")
    weigh = lambda wick: wick / F.greatest(body + wick, F.lit(point))
    return {
        "body_high": top, "body_low": bottom, "body_range": body, "upper_wick": upper, "lower_wick": lower, "upper_weight": weigh(upper), "lower_weight": weigh(lower),
        "long_anchor": bottom - lower * weigh(lower), "short_anchor": top + upper * weigh(upper),
    }


def body_size() -> Column:
    return F.abs(F.col("open") - F.col("close"))


def percent_in_channel(x: Column | str, lower: Column | str, upper: Column | str, point: float | None = None) -> Column:
    """Where x is between lower (0) and upper (100), 2 decimals. A flat channel is `point` wide; null without a point."""
    width = _c(upper) - _c(lower)
    if point is not None:
        width = F.when(width == 0, F.lit(point)).otherwise(width)
    return round_digits(F.try_divide(_c(x) - _c(lower), width) * 100, 2)


def spread_points(digits: int = 2) -> Column:
    return F.abs(F.col("ask") - F.col("bid")) * float(10**digits)


def round2_no_negzero(x: Column | str) -> Column:
    return F.when(F.abs(_c(x)) < 0.005, F.lit(0.0)).otherwise(round_digits(x, 2))


def format2(x: Column | str) -> Column:
    return F.format_string("%.2f", round2_no_negzero(x))


def direction_multiplier(direction: Column | str) -> Column:
    return F.when(_c(direction) == BULLISH, 1).when(_c(direction) == BEARISH, -1).otherwise(0)


def is_direction(direction: Column | str) -> Column:
    return _c(direction).isin(BULLISH, BEARISH)


def side_price(direction: Column | str, entry_side: bool) -> Column:
    """Bulls enter at the ask and leave at the bid, bears the other way."""
    a, b = ("ask", "bid") if entry_side else ("bid", "ask")
    return F.when(_c(direction) == BULLISH, F.col(a)).otherwise(F.col(b))


def step_direction(direction: Column | str, is_bottom: Column | str) -> Column:
    return direction_multiplier(direction) * F.when(_c(is_bottom), 1).otherwise(-1)


def points_between(a: Column | str, b: Column | str, point: Column | str | float) -> Column:
    return F.try_divide(_c(b) - _c(a), _c(point))


def profit_sign_class(x: Column | str) -> Column:
    return F.when(_c(x) > 0, "POSITIVE").when(_c(x) < 0, "NEGATIVE").otherwise("NEUTRAL")


def point_or_default(x: Column | str, default: float = 0.0001) -> Column:
    return F.when(_c(x) > 0, _c(x)).otherwise(F.lit(default))


def reference_price(*prices: Column | str) -> Column:
    """The first price above 0."""
    return F.coalesce(*(F.when(_c(p) > 0, _c(p)) for p in prices))


def structure_time(second: Column | str, first: Column | str) -> Column:
    return F.coalesce(_c(second), _c(first))


# -- times


def parse_hhmm_range(text: Column | str) -> Column:
    """HH:MM-HH:MM as struct(start, end, wraps, full_day, valid): minutes of the day; invalid texts are the full day."""
    parts = F.split(_c(text), "[:-]")
    at = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("int")
    h1, m1, h2, m2 = (at(i) for i in range(4))
    shape = _c(text).rlike(r"^\s*\d{1,2}:\d{1,2}\s*-\s*\d{1,2}:\d{1,2}\s*$")
    ok = F.coalesce(shape & h1.between(0, 23) & h2.between(0, 23) & m1.between(0, 59) & m2.between(0, 59), F.lit(False))
    start, end = F.when(ok, h1 * 60 + m1).otherwise(0), F.when(ok, h2 * 60 + m2).otherwise(0)
    return F.struct(start.alias("start"), end.alias("end"), (start > end).alias("wraps"), (start == end).alias("full_day"), ok.alias("valid"))


def minute_of_day(ts: Column | str, offset_minutes: Column | int = 0) -> Column:
    """Minutes since midnight after moving the time back by the offset."""
    return F.pmod(F.hour(_c(ts)) * 60 + F.minute(_c(ts)) - (F.lit(offset_minutes) if isinstance(offset_minutes, int) else offset_minutes), F.lit(1440)).cast("int")


def minute_in_range(minute: Column | str, slot: Column) -> Column:
    """In [start, end), past midnight if the range wraps; always in a full day."""
    m, a, b = _c(minute), slot["start"], slot["end"]
    return F.when(slot["full_day"], True).when(slot["wraps"], (m >= a) | (m < b)).otherwise((m >= a) & (m < b))


def nth_weekday_of_month(year: Column, month: int, weekday: int, n: int) -> Column:
    """Day of the month of the n-th weekday (0 is Sunday), -1 if the month has none."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    day = 1 + F.pmod(F.lit(weekday + 1) - F.dayofweek(first), F.lit(7)) + 7 * (n - 1)
    return F.when(day <= F.dayofmonth(F.last_day(first)), day).otherwise(-1)


def dst_active(ts: Column | str) -> Column:
    """From midnight of March's second Sunday to midnight of November's first."""
    year = F.year(_c(ts))
    start = F.make_date(year, F.lit(3), nth_weekday_of_month(year, 3, 0, 2))
    end = F.make_date(year, F.lit(11), nth_weekday_of_month(year, 11, 0, 1))
    return (F.to_date(_c(ts)) >= start) & (F.to_date(_c(ts)) < end)


def trading_offset_minutes(mode: str, ts: Column | str, manual: int = 0) -> Column:
    if mode == "AUTO":
        return F.when(dst_active(ts), 0).otherwise(60)
    return F.lit(manual if mode == "MANUAL" else 0)


def utc_day(server_ts: Column | str, offset_seconds: int = 0) -> Column:
    return F.date_trunc("day", _c(server_ts) - F.make_dt_interval(secs=F.lit(offset_seconds))).cast("timestamp_ntz")


# -- texts


TF_LABELS = {"1min": "M1", "3min": "M3", "5min": "M5", "15min": "M15", "30min": "M30", "1h": "H1", "3h": "H3", "4h": "H4", "8h": "H8", "1d": "D1"}


def tf_label(tf: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TF_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, _c(tf)), F.lit("UNKNOWN"))


#: The names of enumerated kinds by their numbers, and what stands around a number that has none.
ENUM_LABELS = {
    "swing": (("EQ", "HH", "HL", "LH", "LL"), "T(%d)"), "signal": (("NO_SIGNAL", "BULLISH", "BEARISH"), "SIG(%d)"), "body_trend": (("BODY_UNDEFINED", "STRONG_BODY_TREND", "WEAK_BODY_TREND"), "BODY_TREND(%d)"),
    "body_ma": (("BODY_UNDEFINED_MA", "BODY_BULLISH_MA", "BODY_BEARISH_MA"), "BODY_MA(%d)"),
}


def enum_label(kind: str, number: Column | str) -> Column:
    names, unknown = ENUM_LABELS[kind]
    named = F.try_element_at(F.array(*(F.lit(n) for n in names)), F.when(_c(number) >= 0, _c(number) + 1).cast("int"))
    return F.coalesce(named, F.format_string(unknown, _c(number)))


def sanitize_token(x: Column | str) -> Column:
    clean = F.regexp_replace(_c(x), "[^0-9A-Za-z_-]", "_")
    return F.when(clean == "", "_").otherwise(clean)


def source_key(label: Column, direction: Column, slot: Column, is_peak: Column, seconds: Column, price: Column, digits: int = 2) -> Column:
    """S1|BULLISH|slot=0|BOTTOM|time=...|price=...; empty when a part is missing or invalid."""
    kind = F.when(is_peak, "PEAK").otherwise("BOTTOM")
    text = F.concat_ws("|", label, direction, F.concat(F.lit("slot="), slot), kind, F.concat(F.lit("time="), seconds), F.concat(F.lit("price="), F.format_string(f"%.{digits}f", price)))
    return F.when((label != "") & direction.isin(BULLISH, BEARISH) & (slot >= 0) & (seconds > 0) & (price > 0), text).otherwise("")


def sequence_id(label: Column, direction: Column, entry: Column, structure: Column) -> Column:
    """S1_B_<entry seconds>_<structure seconds>."""
    return F.concat_ws("_", label, F.when(direction == BULLISH, "B").otherwise("S"), entry, structure)


def leg_comment(label: Column, direction: Column, seconds: Column, level: Column) -> Column:
    return F.concat(F.lit("EX_"), label, F.when(direction == BULLISH, "_B_").otherwise("_S_"), seconds % 1000000, F.lit("_L"), level)


def compact_time(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd_HHmmss")


def signal_identifier(sequence: Column | str, entry_ts: Column | str, price: Column | str, direction: Column | str, digits: int = 2, zero: bool = False) -> Column:
    """The first there is: the sequence id, the compact time, the price's digits, EXEC_ and the direction's number. A price of 0 is
    none, unless `zero` says that it is a price like others."""
    number = F.when(_c(direction) == BULLISH, 1).when(_c(direction) == BEARISH, 2).otherwise(0)
    figures = F.replace(F.format_string(f"%.{digits}f", _c(price)), F.lit("."), F.lit(""))
    return F.coalesce(F.when(_c(sequence) != "", _c(sequence)), compact_time(entry_ts), F.when(_c(price) >= 0 if zero else _c(price) > 0, figures), F.format_string("EXEC_%d", number))


def signal_label(direction: Column | str, suffix: str = "") -> Column:
    side = F.when(_c(direction) == BULLISH, BULLISH).otherwise(BEARISH)
    return F.concat_ws(" ", side, F.lit(suffix)) if suffix else side


def fib_entry_label(base: Column, level: Column, actual: Column | None = None) -> Column:
    return F.format_string("%s %.1f%%", base, level) if actual is None else F.format_string("%s %.1f%% (%.2f%%)", base, level, actual)


def fib_next_label(base: Column, level: Column, level_index: Column, lot: Column) -> Column:
    return F.format_string("%s %.1f%% L%d lot=%.2f", base, level, F.greatest(level_index, F.lit(0)) + 1, lot)


def kv_message(**parts: Column) -> Column:
    """k=v|k=v; missing values are n/a."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("n/a"))) for k, v in parts.items()))


def join_reasons(*reasons: Column) -> Column:
    return F.concat_ws(";", *reasons)


def safe_number(x: Column | str, low: float, high: float, default: float = 0.0) -> Column:
    return F.when(F.isnan(_c(x)) | _c(x).isNull() | (_c(x) < low) | (_c(x) > high), F.lit(default)).otherwise(_c(x))


def safe_price(x: Column | str) -> Column:
    return F.when(_c(x) <= 0, F.lit(0.0)).otherwise(safe_number(x, 0.0, 1e7))


def safe_fibo(x: Column | str) -> Column:
    return safe_number(x, 0.0, 5000.0)


def safe_percentile(x: Column | str) -> Column:
    return safe_number(x, -100.0, 200.0)


def safe_epoch(x: Column | str) -> Column:
    return F.when(_c(x) >= 0, _c(x)).otherwise(F.lit(0))


def safe_enum(x: Column | str, low: int, high: int, default: int) -> Column:
    return F.when(_c(x).between(low, high), _c(x)).otherwise(F.lit(default))


def offset_text(minutes: Column | str) -> Column:
    """+60m, 0m, -30m."""
    return F.when(_c(minutes) > 0, F.format_string("+%dm", _c(minutes))).otherwise(F.format_string("%dm", _c(minutes)))


def session_label(**slots: Column) -> Column:
    """The name of the first slot that is open, OUTSIDE if none is, ALL HOURS without slots."""
    if not slots:
        return F.lit("ALL HOURS")
    return F.coalesce(*(F.when(is_open, F.lit(name)) for name, is_open in slots.items()), F.lit("OUTSIDE"))


def dst_summary(mode: str, ts: Column | str, manual: int = 0) -> Column:
    """MANUAL (60m) and the like."""
    return F.concat(F.lit(f"{mode} ("), offset_text(trading_offset_minutes(mode, ts, manual)), F.lit(")"))


# -- distances, volumes, profits


def min_broker_distance(freeze: Column | str, stops: Column | str) -> Column:
    return F.greatest(_c(freeze), _c(stops), F.lit(0.0))


def enforce_distance(points: Column | str, least: Column | str, tick: Column | str, point: Column | str) -> Column:
    """At least the broker's distance; where it gives none, 10 points or a tick's points."""
    fallback = F.greatest(F.lit(10.0), F.coalesce(F.try_divide(_c(tick), _c(point)), F.lit(0.0)))
    return F.greatest(_c(points), F.when(_c(least) > 0, _c(least)).otherwise(fallback))


def normalize_volume(volume: Column | str, low: Column | str, high: Column | str, step: Column | str, up: bool = False, digits: int = 2) -> Column:
    """Within [low, high], down (or up) to a whole number of steps."""
    inside = F.least(F.greatest(_c(volume), _c(low)), _c(high))
    steps = F.ceil(inside / _c(step) - 1e-12) if up else F.floor(inside / _c(step) + 1e-12)
    return F.least(F.greatest(round_digits(steps * _c(step), digits), _c(low)), _c(high))


def point_value(tick_value: Column | str, point: Column | str, tick: Column | str) -> Column:
    """Money that one point is worth for one lot."""
    return F.try_divide(_c(tick_value) * _c(point), _c(tick))


def amount_to_lots(amount: Column | str, points: Column | str, value: Column, low: Column | str, high: Column | str, step: Column | str) -> Column:
    """Lots whose move by so many points is worth the amount; 0 where one of them isn't above 0."""
    ok = (_c(amount) > 0) & (_c(points) > 0) & (value > 0)
    return F.when(ok, normalize_volume(_c(amount) / (value * _c(points)), low, high, step)).otherwise(0.0)


def lots_to_amount(lots: Column | str, points: Column | str, value: Column) -> Column:
    return F.when((_c(lots) > 0) & (_c(points) > 0) & (value > 0), _c(lots) * value * _c(points)).otherwise(0.0)


def raw_profit(direction: Column | str, entry: Column | str, price: Column | str, value: Column, point: Column | str) -> Column:
    """Of one lot."""
    return projected_profit(direction, F.lit(1.0), entry, price, value, point)


def projected_profit(direction: Column | str, lots: Column | str, entry: Column | str, price: Column | str, value: Column, point: Column | str) -> Column:
    return _c(lots) * value * F.try_divide((_c(price) - _c(entry)) * direction_multiplier(direction), _c(point))


def target_profit(mode: str, amount: float, balance: Column, account_size: Column, tp_percent: float = 100.0) -> Column:
    """FIXED money, or a PERCENT of the balance (of the account size where there is none), times the take-profit's share."""
    base = F.lit(amount) if mode == "FIXED" else F.coalesce(F.when(balance > 0, balance), account_size) * amount / 100
    return base * tp_percent / 100


def base_lot(kind: str, size: float, points: Column | str, target: Column, value: Column, low: Column, high: Column, step: Column, tp_percent: float = 100.0) -> Column:
    """FIXED: the size in whole steps. Else (a share of the account or a sum of money) lots whose move over the points, times
    the take-profit's share, is worth the target, up to whole steps; the size where target or points aren't above 0."""
    fixed = normalize_volume(F.lit(abs(size)), low, high, step)
    if kind == "FIXED":
        return fixed
    reach = _c(points) * (tp_percent / 100 if tp_percent > 0 else 1.0)
    lots = amount_to_lots(target, reach, value, low, high, step)
    own = F.when(lots > 0, lots).otherwise(F.lit(abs(size)) if size else low)
    return F.when((target > 0) & (reach > 0), normalize_volume(own, low, high, step, up=True)).otherwise(fixed)


def scaled_lot(lot: Column | str, multiplier: float, step_index: Column | str, low: Column, high: Column, step: Column) -> Column:
    """The lot times the multiplier for each step; as it is for step 0."""
    grown = normalize_volume(_c(lot) * F.pow(F.lit(abs(multiplier) or 1.0), _c(step_index)), low, high, step)
    return F.when(_c(step_index) > 0, grown).otherwise(_c(lot))


# -- order triggers


def limit_reached(direction: Column | str, price: Column | str, trigger: Column | str) -> Column:
    """A bull's price has come down to the trigger, a bear's up to it."""
    way = (_c(trigger) - _c(price)) * direction_multiplier(direction)
    return (_c(trigger) > 0) & is_direction(direction) & (way >= 0)


def limit_opposite(direction: Column | str, price: Column | str, trigger: Column | str) -> Column:
    """The price is still on the other side of the trigger."""
    return (_c(trigger) > 0) & is_direction(direction) & ~limit_reached(direction, price, trigger)


def breakout_entry(direction: Column | str, price: Column | str, trigger: Column | str) -> Column:
    way = (_c(price) - _c(trigger)) * direction_multiplier(direction)
    return (_c(trigger) > 0) & is_direction(direction) & (way >= 0)


def meaningful_gap(a: Column | str, b: Column | str, point: float, least_points: Column) -> Column:
    """Two prices above 0 that are at least so many points apart."""
    return (_c(a) > 0) & (_c(b) > 0) & (F.abs(_c(a) - _c(b)) / point + 1e-9 >= least_points)


def level_cap(level_index: Column | str, limit: int) -> Column:
    """Whether the level, counted from 1, has reached a limit above 0."""
    return F.lit(limit > 0) & (_c(level_index) >= 0) & (_c(level_index) + 1 >= limit)


def market_status_allows(status: Column | str, action: str = "SIGNAL") -> Column:
    """Signals only where the market is ACTIVE, broker actions unless the broker has disabled trade."""
    return _c(status) == "ACTIVE" if action == "SIGNAL" else _c(status) != "BROKER_DISABLED"


def required_lot(target: Column, existing: Column, per_lot: Column, low: Column, high: Column, step: Column) -> Column:
    """struct(lot, feasible): lots that reach the target, up to whole steps; infeasible beyond the largest volume."""
    raw = F.try_divide(target - existing, F.when(per_lot > 0, per_lot))
    ok = F.coalesce((raw <= high) & (raw > 0), F.lit(False))
    return F.struct(F.when(ok, normalize_volume(raw, low, high, step, up=True)).alias("lot"), ok.alias("feasible"))


def level_distance(base: Column | str, multiplier: float, level: Column | str, least: Column | str) -> Column:
    return F.greatest(_c(base) * F.pow(F.lit(multiplier), _c(level)), _c(least))


def tp_price(direction: Column | str, entry: Column | str, stop: Column | str, percent: float) -> Column:
    return _c(entry) + direction_multiplier(direction) * F.abs(_c(entry) - _c(stop)) * percent / 100


def margin_required(initial: Column, contract: Column, price: Column, leverage: Column, volume: Column) -> Column:
    per_lot = F.coalesce(F.when(initial > 0, initial), F.try_divide(contract * price, F.when(leverage > 0, leverage)))
    return per_lot * volume


def outcome_class(profit: Column | str) -> Column:
    return F.when(F.abs(_c(profit)) < 0.01, "NEUTRAL").when(_c(profit) > 0, "WIN").otherwise("LOSS")


def drawdown_threshold(mode: str, amount: float, account_size: Column, balance: Column) -> Column:
    """OFF 0, FIXED money, or a percent of ACCOUNT or BALANCE; each falls back to the other."""
    if mode in ("OFF", "FIXED"):
        return F.lit(amount if mode == "FIXED" else 0.0)
    a, b = (account_size, balance) if mode == "ACCOUNT" else (balance, account_size)
    return F.coalesce(F.when(a > 0, a), F.when(b > 0, b), F.lit(0.0)) * amount / 100


def next_price(direction: Column, anchor: Column, distance: Column, protective: Column, broker: Column, side: Column, previous: Column, tick: Column) -> Column:
    """struct(price, reasons): the next level's price after the clamps, and which of them moved it.

    The level lies `distance` against the direction from the anchor; then it must not pass the protective price, must keep
    the broker's distance from the side price, lies on a tick (up for bulls, down for bears), and is monotonic against the
    previous level.
    """
    bull, sign = direction == BULLISH, direction_multiplier(direction)
    raw = anchor - sign * distance
    p1 = F.when(protective > 0, F.when(bull, F.greatest(raw, protective)).otherwise(F.least(raw, protective))).otherwise(raw)
    edge = side - sign * broker
    p2 = F.when(bull, F.least(p1, edge)).otherwise(F.greatest(p1, edge))
    p3 = F.when(bull, F.ceil(p2 / tick - 1e-9)).otherwise(F.floor(p2 / tick + 1e-9)) * tick
    p4 = F.when(previous > 0, F.when(bull, F.least(p3, previous)).otherwise(F.greatest(p3, previous))).otherwise(p3)
    said = join_reasons(F.when(p1 != raw, "protective"), F.when(p2 != p1, "broker"), F.when(F.abs(p3 - p2) > 1e-9, "tick"), F.when(p4 != p3, "monotonic"))
    return F.struct(p4.alias("price"), said.alias("reasons"))
