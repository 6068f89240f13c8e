"""Rolling indicators of bars: every function takes bars (symbol, tf, bar_ts, open, high, low, close, bar_idx) and adds columns.

Windows are always partitioned by symbol and timeframe and ordered by time, so that a chain of indicators takes one
exchange and one sort. For symbols with very long histories see in_chunks().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import applied_price, body_size, candle_anatomy, percent_in_channel, round_digits

KEYS = ("symbol", "tf")


def by_time():
    return Window.partitionBy(*KEYS).orderBy("bar_ts")


def rows(n: int):
    """The last n bars."""
    return by_time().rowsBetween(-(n - 1), 0)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def true_range() -> Column:
    """High and low with the previous close; 0 for the first bar."""
    before = lag("close")
    return F.coalesce(F.greatest("high", before) - F.least("low", before), F.lit(0.0)) * (F.col("bar_idx") > 0).cast("int")


def sma(x: Column, n: int) -> Column:
    return F.when(F.col("bar_idx") >= n - 1, F.avg(x).over(rows(n)))


def lwma(x: Column, n: int) -> Column:
    total = None
    for i in range(n):
        part = lag(x, i) * (n - i) if i else x * n
        total = part if total is None else total + part
    return F.when(F.col("bar_idx") >= n - 1, total / (n * (n + 1) / 2))


def rolling_range(x: Column, n: int) -> tuple[Column, Column]:
    """Rolling maximum and minimum, 2 decimals."""
    return round_digits(F.max(x).over(rows(n)), 2), round_digits(F.min(x).over(rows(n)), 2)


def atr(n: int) -> Column:
    """Mean true range of the last n bars; null for the first n bars."""
    return F.when(F.col("bar_idx") >= n, F.avg("true_range").over(rows(n)))


def std_around(x: Column, mean: Column, n: int) -> Column:
    """Root mean square distance of the last n values from the current mean; 0 for the first n bars."""
    spread = F.aggregate(F.collect_list(x).over(rows(n)), F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.when(F.col("bar_idx") >= n, F.sqrt(spread / n)).otherwise(0.0)


#: Rows of a chunk of the affine scan, and the weight below which what is further back doesn't change a double.
SCAN, EPSILON = 64, 1e-18


def affine_scan(bars: DataFrame, x: Column, k: float, out: str, first: Column | None = None, start: int = 0) -> DataFrame:
    """Add out: y[start] = first, then y = k * x + (1 - k) * y[previous]; null before start.

    Chunks of SCAN rows are summed up by windows. What a chunk passes on is a mean over the ends of the chunks before it, of
    which the weights fall below EPSILON after some: only those are looked at, so that no history is held or walked whole.
    """
    r = 1.0 - k
    first = x if first is None else first
    if r == 0.0:
        return bars.withColumn(out, F.when(F.col("bar_idx") == start, first).when(F.col("bar_idx") > start, x))
    at = F.col("bar_idx") - start
    chunk, place = F.floor(at / SCAN), F.pmod(at, F.lit(SCAN))
    term = F.when(at == 0, first).when(at > 0, k * x).otherwise(0.0)
    # within a chunk: the sum of r ** (m - j) * term[j], as r ** m times a running sum of r ** -j * term[j]
    keyed = bars.withColumns({"__chunk": chunk, "__place": place}).withColumn("__term", term * F.pow(F.lit(r), -F.col("__place")))
    running = F.sum("__term").over(Window.partitionBy(*KEYS, "__chunk").orderBy("bar_ts"))
    local = keyed.withColumn("__local", F.pow(F.lit(r), F.col("__place")) * running)
    step = r**SCAN
    reach = math.ceil(math.log(EPSILON) / math.log(step)) if step > EPSILON else 0
    over = Window.partitionBy(*KEYS).orderBy("__chunk").rowsBetween(-reach, 0)
    carried = F.aggregate(F.collect_list("__local").over(over), F.lit(0.0), lambda done, e: e + step * done)
    ends = local.where((F.col("__place") == SCAN - 1) & (F.col("__chunk") >= 0)).withColumn("__carry", carried)
    carries = ends.select(*(F.col(c).alias(f"__{c}") for c in KEYS), (F.col("__chunk") + 1).alias("__next"), "__carry")
    joined = local.join(carries, (F.col("symbol") == F.col("__symbol")) & (F.col("tf") == F.col("__tf")) & (F.col("__chunk") == F.col("__next")), "left")
    carry = F.coalesce("__carry", F.lit(0.0))
    y = F.when(at >= 0, F.col("__local") + F.pow(F.lit(r), F.col("__place") + 1) * carry)
    return joined.withColumn(out, y).drop("__chunk", "__place", "__term", "__local", "__symbol", "__tf", "__next", "__carry")


def with_ma(bars: DataFrame, method: str, n: int, out: str, x: Column | None = None, seed: str = "first_price") -> DataFrame:
    """Add a moving average: SMA, EMA, SMMA or LWMA. EMA's seed is the first price, or sma_then_ema: the mean of the first n
    prices, to which that bar's price is applied at once."""
    x = F.col("close") if x is None else x
    if method == "SMA":
        return bars.withColumn(out, sma(x, n))
    if method == "LWMA":
        return bars.withColumn(out, lwma(x, n))
    k = {"EMA": 2 / (n + 1), "SMMA": 1 / n}[method]
    if seed == "sma_then_ema":
        return affine_scan(bars.withColumn("__seed", sma(x, n)), x, k, out, k * x + (1 - k) * F.col("__seed"), n - 1).drop("__seed")
    return affine_scan(bars, x, k, out)


def with_true_range(bars: DataFrame) -> DataFrame:
    return bars.withColumn("true_range", true_range())


def with_atr(bars: DataFrame, n: int = 14, m: int = 14) -> DataFrame:
    """atr, and its mean over m bars (with zeros before it starts; null up to bar n)."""
    b = with_true_range(bars).withColumn("atr", atr(n))
    return b.withColumn("atr_sma", F.when(F.col("bar_idx") > n, F.avg(F.coalesce("atr", F.lit(0.0))).over(rows(m))))


def with_body_ma(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("body", body_size()).withColumn("body_ma", sma(F.col("body"), n))


def with_bollinger(bars: DataFrame, n: int = 20, deviations: float = 2.0, method: str = "SMA", x: Column | None = None) -> DataFrame:
    x = F.col("close") if x is None else x
    b = with_ma(bars, method, n, "bb_mid", x).withColumn("bb_std", std_around(x, F.col("bb_mid"), n))
    return b.withColumns({"bb_upper": F.col("bb_mid") + deviations * F.col("bb_std"), "bb_lower": F.col("bb_mid") - deviations * F.col("bb_std")})


def _percents(b: DataFrame, lower: str, upper: str, prefix: str, n: int, point: float | None) -> DataFrame:
    b = b.withColumns({f"{prefix}_{c}": percent_in_channel(c, lower, upper, point) for c in ("open", "high", "low", "close")})
    high, low = rolling_range(F.col(f"{prefix}_high"), n)[0], rolling_range(F.col(f"{prefix}_low"), n)[1]
    mean = F.when(F.col("bar_idx") >= n - 1, F.avg(f"{prefix}_close").over(rows(n)))
    return b.withColumns({f"{prefix}_mean": mean, f"{prefix}_max": high, f"{prefix}_min": low})


def with_bollinger_percent(bars: DataFrame, n: int = 20, deviations: float = 2.0, method: str = "SMA", m: int = 10) -> DataFrame:
    return _percents(with_bollinger(bars, n, deviations, method), "bb_lower", "bb_upper", "bbp", m, None)


def with_keltner(bars: DataFrame, ma: int = 20, n: int = 10, factor: float = 2.0, method: str = "EMA") -> DataFrame:
    b = with_ma(with_true_range(bars).withColumn("atr", atr(n)), method, ma, "__mid", applied_price("TYPICAL"), "sma_then_ema")
    ready = F.col("bar_idx") >= max(ma - 1, n)
    mid = F.when(ready, F.col("__mid"))
    return b.withColumns({"kc_mid": mid, "kc_upper": mid + factor * F.col("atr"), "kc_lower": mid - factor * F.col("atr")}).drop("__mid")


def with_keltner_percent(bars: DataFrame, ma: int = 20, n: int = 10, factor: float = 2.0, method: str = "EMA", m: int = 10, point: float = 0.01) -> DataFrame:
    return _percents(with_keltner(bars, ma, n, factor, method), "kc_lower", "kc_upper", "kcp", m, point)


def with_atr_stop_bands(bars: DataFrame, n: int = 14, factor: float = 1.5, point: float = 0.01) -> DataFrame:
    """Bands at the candles' anchors, their means and the middle; null before bar 2n."""
    parts = candle_anatomy(point)
    b = with_true_range(bars).withColumn("atr", atr(n)).withColumns({"long_anchor": parts["long_anchor"], "short_anchor": parts["short_anchor"]})
    raw = F.col("bar_idx") > n
    b = b.withColumns({"__up": F.when(raw, F.col("short_anchor") + factor * F.col("atr")), "__down": F.when(raw, F.col("long_anchor") - factor * F.col("atr"))})
    ready = F.col("bar_idx") >= 2 * n
    b = b.withColumns({"stop_upper": F.when(ready, F.avg("__up").over(rows(n))), "stop_lower": F.when(ready, F.avg("__down").over(rows(n)))})
    return b.withColumn("stop_mid", (F.col("stop_upper") + F.col("stop_lower")) / 2).drop("__up", "__down")


def with_atr_stop_percent(bars: DataFrame, n: int = 14, factor: float = 1.5, m: int = 10, point: float = 0.01) -> DataFrame:
    return _percents(with_atr_stop_bands(bars, n, factor, point), "stop_lower", "stop_upper", "asp", m, point)


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, method: str = "EMA", x: Column | None = None) -> DataFrame:
    """macd is 0 before bar `slow`, and its signal is a mean over those zeros too."""
    b = with_ma(with_ma(bars, method, fast, "__fast", x), method, slow, "__slow", x)
    b = b.withColumn("macd", F.when(F.col("bar_idx") >= slow, F.col("__fast") - F.col("__slow")).otherwise(0.0)).drop("__fast", "__slow")
    return b.withColumn("macd_signal", sma(F.col("macd"), signal))


def with_macd_normalized(bars: DataFrame, n: int = 89, **macd) -> DataFrame:
    """Where macd is in its last n values, 0 to 100; 50 when they are equal."""
    b = with_macd(bars, **macd)
    low, high = F.min("macd").over(rows(n)), F.max("macd").over(rows(n))
    return b.withColumn("macd_norm", F.when(high == low, 50.0).otherwise(F.greatest(F.lit(0.0), (F.col("macd") - low) / (high - low) * 100)))


def with_stochastic(bars: DataFrame, k: int = 5, d: int = 3, slow: int = 3, mode: str = "CLOSE", point: float = 0.01) -> DataFrame:
    """stoch_k and its mean stoch_d; null for the first k + slow - 2 bars (and d - 1 more for stoch_d).

    Prices are counted in whole points, so that sums over frames are exact.
    """
    ticks = lambda c: F.floor(F.col(c) / point + 0.5)
    low, high = ("close", "close") if mode == "CLOSE" else ("low", "high")
    b = bars.withColumns({"__lo": F.min(ticks(low)).over(rows(k)), "__hi": F.max(ticks(high)).over(rows(k)), "__c": ticks("close")})
    above, width = F.sum(F.when(F.col("bar_idx") >= k - 1, F.col("__c") - F.col("__lo"))).over(rows(slow)), F.sum(F.when(F.col("bar_idx") >= k - 1, F.col("__hi") - F.col("__lo"))).over(rows(slow))
    b = b.withColumns({"__a": above, "__w": width})
    value = F.when(F.col("__w") == 0, 100.0).otherwise(F.col("__a") * 100.0 / F.col("__w"))
    b = b.withColumn("stoch_k", F.when(F.col("bar_idx") >= k + slow - 2, value)).drop("__lo", "__hi", "__c", "__a", "__w")
    return b.withColumn("stoch_d", F.when(F.col("bar_idx") >= k + slow + d - 3, F.avg("stoch_k").over(rows(d))))


def with_ma_slope(bars: DataFrame, n: int = 21, shift: int = 0) -> DataFrame:
    """A mean, its value `shift` bars ago and one before that, and the trend: 1 rising, 2 falling, 0 flat."""
    b = bars.withColumn("ma", sma(F.col("close"), n))
    now, before = lag("ma", shift) if shift else F.col("ma"), lag("ma", shift + 1)
    return b.withColumns({"ma_now": now, "ma_before": before}).withColumn("trend", F.when(F.col("ma_now") > F.col("ma_before"), 1).when(F.col("ma_now") < F.col("ma_before"), 2).otherwise(0))


def bounded_history(bars: DataFrame, depth: int = 13, period: int = 5) -> DataFrame:
    """The last bars of each symbol that a structure of this depth needs: depth * period * 24, from 512 to 2048."""
    n = min(max(depth * period * 24, 512), 2048)
    last = F.max("bar_idx").over(Window.partitionBy(*KEYS))
    return bars.withColumn("__last", last).where(F.col("bar_idx") > F.col("__last") - n).drop("__last")


def in_chunks(bars: DataFrame, indicator: Callable[[DataFrame], DataFrame], halo: int, size: int = 100_000) -> DataFrame:
    """An indicator of bounded frames on chunks of `size` bars, so that a symbol's long history spreads over tasks.

    Each chunk also gets the `halo` bars before it, which the indicator reads and which are dropped again. The indicator must
    depend on no more bars than that; chunk and halo keep the bars' own numbers.
    """
    own = F.floor(F.col("bar_idx") / size).cast("long")
    ahead = (F.pmod("bar_idx", F.lit(size)) >= size - halo)
    copies = F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = bars.withColumn("__chunk", F.explode(copies)).withColumnsRenamed({"tf": "__tf"}).withColumn("tf", F.concat_ws("#", "__tf", "__chunk"))
    out = indicator(dealt).where(F.floor(F.col("bar_idx") / size) == F.col("__chunk"))
    return out.drop("tf", "__chunk").withColumnRenamed("__tf", "tf")


#: Indicators by name: functions of (bars, **parameters) that return bars with more columns.
INDICATORS: dict[str, Callable[..., DataFrame]] = {}


def register_indicator(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add an indicator of one's own; it may be made of Columns, or of applyInPandas on (symbol, tf)."""
    INDICATORS[name] = fn


def indicator(name: str, bars: DataFrame, **parameters) -> DataFrame:
    return INDICATORS[name](bars, **parameters)


for _name, _fn in list(globals().items()):
    if _name.startswith("with_"):
        register_indicator(_name.removeprefix("with_"), _fn)
