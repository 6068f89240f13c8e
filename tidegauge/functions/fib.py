"""Fibonacci levels of price ranges, as Column expressions over literal level arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.scalars import _c, round_digits

#: The levels that percents are snapped to, the five of a cycle repeated up to 2000 or the nine usual ones.
CYCLE = (0.0, 23.6, 38.2, 61.8, 78.6)
ALL_LEVELS = tuple(round(100 * k + v, 1) for k in range(20) for v in CYCLE) + (2000.0,)
DEFAULT_LEVELS = (0.0, 23.6, 38.2, 61.8, 78.6, 100.0, 161.8, 261.8, 423.6)
FALLBACK_CSV = "23.6,38.2,50.0,61.8,78.6,100.0"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def levels(values: tuple[float, ...]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def trend_price(kind: str, percent: Column | str, peak: Column | str, bottom: Column | str) -> Column:
    """bottom: from the peak down; peak: from the bottom up."""
    reach = _c(percent) / 100 * (_c(peak) - _c(bottom))
    return _c(peak) - reach if kind == "bottom" else _c(bottom) + reach


def trend_percent(kind: str, price: Column | str, peak: Column | str, bottom: Column | str) -> Column:
    """The inverse, to 1 decimal; null for an empty range."""
    way = _c(peak) - _c(price) if kind == "bottom" else _c(price) - _c(bottom)
    return round_digits(F.try_divide(way, _c(peak) - _c(bottom)) * 100, 1)


def expansion_price(kind: str, percent: Column | str, a: Column | str, b: Column | str, c: Column | str) -> Column:
    reach = _c(percent) / 100 * F.abs(_c(a) - _c(b))
    return _c(c) - reach if kind == "bottom" else _c(c) + reach


def expansion_percent(kind: str, price: Column | str, a: Column | str, b: Column | str, c: Column | str) -> Column:
    way = _c(c) - _c(price) if kind == "bottom" else _c(price) - _c(c)
    return round_digits(F.try_divide(way, F.abs(_c(a) - _c(b))) * 100, 1)


def snap_level(x: Column | str, at: Column) -> Column:
    """struct(level, next): the largest level at or below x (to 2 decimals) and the one above, clamped to both ends."""
    v = round_digits(x, 2)
    low = F.array_max(F.filter(at, lambda e: e <= v))
    high = F.array_min(F.filter(at, lambda e: e > v))
    return F.struct(F.coalesce(low, F.array_min(at)).alias("level"), F.coalesce(high, F.array_max(at)).alias("next"))


def parse_levels(csv: Column | str, fallback: str = FALLBACK_CSV) -> Column:
    """Numbers of a comma-separated text, sorted and distinct; the fallback's where there are fewer than two."""
    read = lambda text: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda e: F.trim(e).try_cast("double")), lambda e: e.isNotNull())))
    own = read(_c(csv))
    return F.when(F.size(own) >= 2, own).otherwise(read(F.lit(fallback)))


def cycle_levels(at: Column) -> Column:
    """Levels with both 0 and 100 where either is there."""
    either = F.exists(at, lambda e: (F.abs(e) < 1e-4) | (F.abs(e - 100) < 1e-4))
    return F.when(either, F.array_sort(F.array_union(at, levels((0.0, 100.0))))).otherwise(at)


def fib_band(x: Column | str, at: Column) -> Column:
    """struct(low, high): the half-open band that x is in; above the top, bands of the last step's width go on."""
    v = _c(x)
    last, before = F.element_at(at, -1), F.element_at(at, -2)
    step = last - before
    n = F.floor((v - last) / step)
    low = F.array_max(F.filter(at, lambda e: e <= v))
    high = F.array_min(F.filter(at, lambda e: e > v))
    return F.struct(F.when(v >= last, last + n * step).otherwise(low).alias("low"), F.when(v >= last, last + (n + 1) * step).otherwise(high).alias("high"))


def fib_band_strict(x: Column | str, at: Column) -> Column:
    """struct(low, high) of the first closed band that has x; null outside all bands."""
    v = _c(x)
    high = F.array_min(F.filter(at, lambda e: (e >= v) & (e > F.array_min(at))))
    low = F.array_max(F.filter(at, lambda e: e < high))
    return F.when((v >= F.array_min(at)) & (v <= F.array_max(at)), F.struct(low.alias("low"), high.alias("high")))


def fib_next(x: Column | str, steps: int, at: Column) -> Column:
    """The upper end of x's band, `steps` times over."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), _c(x).cast("double"), lambda v, _: fib_band(v, at)["high"])


_EPS = 1e-4


def _beyond(at: Column, cursor: Column) -> Column:
    return F.array_min(F.filter(at, lambda e: e - cursor > _EPS))


def _short_of(at: Column, cursor: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(at, lambda e: e + _EPS < cursor)), F.array_min(at))


def _cycled_up(v: Column, at: Column, first: float, top: float) -> Column:
    base = F.floor(v / top) * top
    below_zero = F.when(-v <= first + _EPS, F.lit(0.0)).otherwise(-_short_of(at, -v))
    return F.when(v < 0, below_zero).otherwise(base + F.coalesce(_beyond(at, v - base), F.lit(top + first)))


def _cycled_down(v: Column, at: Column, first: float, top: float) -> Column:
    a = F.abs(v)
    base = F.floor(a / top) * top
    deeper = -(base + F.coalesce(_beyond(at, F.when(a - base < _EPS, F.lit(0.0)).otherwise(a - base)), F.lit(top + first)))
    start = F.when(v - base < _EPS, base - top).otherwise(base)
    cursor = v - start
    shallower = F.when(cursor <= first + _EPS, start).otherwise(start + _short_of(at, cursor))
    return F.when(v <= 0, deeper).otherwise(shallower)


def fib_next_cycled(x: Column | str, steps: Column | int, up: bool, at: tuple[float, ...]) -> Column:
    """`steps` levels up or down from x, along levels of at least 0 that repeat every largest level and are mirrored below
    0; 0 is skipped where the levels have neither 0 nor 100. Null where there are fewer than two levels or none above 0."""
    allow_zero = any(abs(e) < _EPS or abs(e - 100) < _EPS for e in at)
    own = sorted({float(e) for e in at} | ({0.0, 100.0} if allow_zero else set()))
    if len(own) < 2 or own[-1] <= 0:
        return F.lit(None).cast("double")
    all_, move = levels(tuple(own)), _cycled_up if up else _cycled_down

    def one(v: Column, _: Column) -> Column:
        to = move(v, all_, own[0], own[-1])
        return to if allow_zero else bound(to, lambda t: F.when(F.abs(t) >= _EPS, t).otherwise(move(t, all_, own[0], own[-1])))

    if isinstance(steps, int) and steps == 1:
        return bound(_c(x).cast("double"), lambda v: one(v, v))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps) if isinstance(steps, int) else steps), _c(x).cast("double"), one)


def structure_percent(price: Column | str, is_bottom: Column | str, peak: Column | str, bottom: Column | str) -> Column:
    """Percent of a price in the structure's range, by its current extremum; null when below 0."""
    p = F.when(_c(is_bottom), trend_percent("bottom", price, peak, bottom)).otherwise(trend_percent("peak", price, peak, bottom))
    return bound(p, lambda v: F.when(v >= 0, v))


def structure_price(percent: Column | str, is_bottom: Column | str, peak: Column | str, bottom: Column | str) -> Column:
    p = F.when(_c(is_bottom), trend_price("bottom", percent, peak, bottom)).otherwise(trend_price("peak", percent, peak, bottom))
    return bound(p, lambda v: F.when(v > 0, v))


def breakout_target(direction: Column | str, a: Column | str, b: Column | str) -> Column:
    """Of two band prices, the higher one for bulls and the lower one for bears."""
    return F.when(_c(direction) == "BULLISH", F.greatest(_c(a), _c(b))).otherwise(F.least(_c(a), _c(b)))


def opposite_endpoint(x: Column | str, low: Column | str, high: Column | str) -> Column:
    """The band's end that is further from x; the upper one of equals."""
    return F.when(F.abs(_c(high) - _c(x)) >= F.abs(_c(x) - _c(low)), _c(high)).otherwise(_c(low))
