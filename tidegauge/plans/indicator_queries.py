"""Queries of bars and rolling indicators over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import windows as W
from tidegauge.plans.registry import BEFORE, bars, bars_sql, over, query, r6, shown, ticks
from tidegauge.sources.tables import build_bars, resample_bars

_OHLC = ("open", "high", "low", "close")
_BAR = ("tf", *_OHLC, "tick_volume", "bar_idx")
_PLAIN = "SELECT symbol, bar_ts, tf, open, high, low, close, tick_volume, CAST(bar_idx AS INTEGER) AS bar_idx FROM bars"
_TR = f"tr AS (SELECT *, CASE WHEN bar_idx = 0 THEN 0.0 ELSE greatest(high, lag(close) {BEFORE}) - least(low, lag(close) {BEFORE}) END AS true_range FROM bars)"


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join((bars_sql(), *ctes)) + " "


@query(f"WITH {bars_sql()} {_PLAIN}")
def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars(spark, sf_dir), *_BAR)


@query(f"WITH {bars_sql('15min')} {_PLAIN}")
def bars_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars(spark, sf_dir, "15min"), *_BAR)


@query(f"WITH {bars_sql('4h')} {_PLAIN}")
def resample_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resample_bars(bars(spark, sf_dir), "4h"), *_BAR)


@query(" UNION ALL ".join(f"(WITH {bars_sql(tf)} {_PLAIN})" for tf in ("15min", "1h", "4h")))
def bars_multi_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(build_bars(ticks(spark, sf_dir), "15min", "1h", "4h"), *_BAR)


@query(
    _with() + "SELECT symbol, bar_ts, close AS p_close, open AS p_open, high AS p_high, low AS p_low, "
    + ", ".join(f"{r6(e)} AS {n}" for n, e in (("p_median", "(high + low) / 2"), ("p_typical", "(high + low + close) / 3"), ("p_weighted", "(high + low + 2 * close) / 4"), ("p_ohlc4", "(open + high + low + close) / 4"))) + " FROM bars"
)
def applied_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {f"p_{k.lower()}": S.applied_price(k) for k in ("CLOSE", "OPEN", "HIGH", "LOW", "MEDIAN", "TYPICAL", "WEIGHTED")} | {"p_ohlc4": S.applied_price("WEIGHTED", "ohlc4")}
    return shown(bars(spark, sf_dir).withColumns(kinds), *kinds)


@query(_with(_TR) + f"SELECT symbol, bar_ts, {r6('true_range')} AS true_range FROM tr")
def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_true_range(bars(spark, sf_dir)), "true_range")


_WICK = """c AS (SELECT *, greatest(open, close) AS body_high, least(open, close) AS body_low FROM bars),
    d AS (SELECT *, body_high - body_low AS body_range, high - body_high AS upper_wick, body_low - low AS lower_wick FROM c),
    e AS (SELECT *, upper_wick / greatest(body_range + upper_wick, 0.01) AS upper_weight, lower_wick / greatest(body_range + lower_wick, 0.01) AS lower_weight FROM d),
    anatomy AS (SELECT *, body_low - lower_wick * lower_weight AS long_anchor, body_high + upper_wick * upper_weight AS short_anchor FROM e)"""
_ANATOMY = ("body_high", "body_low", "body_range", "upper_wick", "lower_wick", "upper_weight", "lower_weight", "long_anchor", "short_anchor")


@query(_with(_WICK) + "SELECT symbol, bar_ts, " + ", ".join(f"{r6(c)} AS {c}" for c in _ANATOMY) + " FROM anatomy")
def candle_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars(spark, sf_dir).withColumns(S.candle_anatomy(0.01)), *_ANATOMY)


def _sma(x: str, n: int) -> str:
    return f"CASE WHEN bar_idx >= {n - 1} THEN avg({x}) {over(n)} END"


def _lwma(x: str, n: int) -> str:
    return f"CASE WHEN bar_idx >= {n - 1} THEN (" + " + ".join(f"lag({x}, {i}) {BEFORE} * {n - i}" if i else f"{x} * {n}" for i in range(n)) + f") / {n * (n + 1) / 2} END"


def _ema(name: str, k: float, x: str = "close", start: int = 0, first: str | None = None, source: str = "bars") -> str:
    return f"""{name} AS (SELECT symbol, bar_idx, CAST({first or x} AS DOUBLE) AS y FROM {source} WHERE bar_idx = {start}
        UNION ALL SELECT b.symbol, b.bar_idx, {k!r} * ({x}) + {1 - k!r} * e.y FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1)"""


@query(_with() + f"SELECT symbol, bar_ts, {r6(_sma('close', 21))} AS sma FROM bars")
def sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_ma(bars(spark, sf_dir), "SMA", 21, "sma"), "sma")


@query(_with() + f"SELECT symbol, bar_ts, {r6(_lwma('close', 10))} AS lwma FROM bars")
def lwma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_ma(bars(spark, sf_dir), "LWMA", 10, "lwma"), "lwma")


@query(_with(_ema("ema", 2 / 22), recursive=True) + f"SELECT symbol, bar_ts, {r6('y')} AS ema FROM bars JOIN ema USING (symbol, bar_idx)")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_ma(bars(spark, sf_dir), "EMA", 21, "ema"), "ema")


@query(_with(_ema("smma", 1 / 21), recursive=True) + f"SELECT symbol, bar_ts, {r6('y')} AS smma FROM bars JOIN smma USING (symbol, bar_idx)")
def smma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_ma(bars(spark, sf_dir), "SMMA", 21, "smma"), "smma")


_ATR = _TR + f", a AS (SELECT *, CASE WHEN bar_idx >= 14 THEN avg(true_range) {over(14)} END AS atr FROM tr)"


@query(_with(_ATR) + f"SELECT symbol, bar_ts, {r6('atr')} AS atr FROM a")
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_atr(bars(spark, sf_dir)), "atr")


@query(_with(_ATR) + f"SELECT symbol, bar_ts, {r6(f'CASE WHEN bar_idx > 14 THEN avg(coalesce(atr, 0.0)) {over(14)} END')} AS atr_sma FROM a")
def atr_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_atr(bars(spark, sf_dir)), "atr_sma")


@query(_with("b AS (SELECT *, abs(open - close) AS body FROM bars)") + f"SELECT symbol, bar_ts, {r6('body')} AS body, {r6(_sma('body', 20))} AS body_ma FROM b")
def body_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_body_ma(bars(spark, sf_dir)), "body", "body_ma")


_STD = f"""m AS (SELECT *, {_sma('close', 20)} AS bb_mid, list(close) {over(20)} AS last FROM bars),
    s AS (SELECT *, CASE WHEN bar_idx >= 20 THEN sqrt(list_sum(list_transform(last, lambda v: (v - bb_mid) * (v - bb_mid))) / 20) ELSE 0.0 END AS bb_std FROM m),
    bb AS (SELECT *, bb_mid + 2 * bb_std AS bb_upper, bb_mid - 2 * bb_std AS bb_lower FROM s)"""


@query(_with(_STD) + f"SELECT symbol, bar_ts, {r6('bb_std')} AS bb_std FROM bb")
def std_around_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_bollinger(bars(spark, sf_dir)), "bb_std")


@query(_with(_STD) + "SELECT symbol, bar_ts, " + ", ".join(f"{r6(c)} AS {c}" for c in ("bb_mid", "bb_upper", "bb_lower")) + " FROM bb")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_bollinger(bars(spark, sf_dir)), "bb_mid", "bb_upper", "bb_lower")


def _percent_sql(source: str, lower: str, upper: str, p: str, flat: str) -> str:
    width = f"CASE WHEN {upper} - {lower} = 0 THEN {flat} ELSE {upper} - {lower} END"
    parts = ", ".join(f"floor(({c} - {lower}) / ({width}) * 100 * 100 + 0.5) / 100 AS {p}_{c}" for c in _OHLC)
    return f"pc AS (SELECT *, {parts} FROM {source}), ch AS (SELECT *, CASE WHEN bar_idx >= 9 THEN avg({p}_close) {over(10)} END AS {p}_mean, max({p}_high) {over(10)} AS {p}_max, min({p}_low) {over(10)} AS {p}_min FROM pc)"


def _channel(p: str) -> tuple[str, ...]:
    return tuple(f"{p}_{c}" for c in (*_OHLC, "mean", "max", "min"))


def _channel_sql(p: str) -> str:
    return "SELECT symbol, bar_ts, " + ", ".join(f"{r6(c)} AS {c}" for c in _channel(p)) + " FROM ch"


@query(_with(_STD, _percent_sql("bb", "bb_lower", "bb_upper", "bbp", "NULL")) + _channel_sql("bbp"))
def bollinger_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_bollinger_percent(bars(spark, sf_dir)), *_channel("bbp"))


_K = 2 / 21
_TYP = "(b.high + b.low + b.close) / 3"
_KELTNER = (
    f"t AS MATERIALIZED (SELECT *, {_sma('(high + low + close) / 3', 20)} AS seed FROM bars)",
    _ema("km", _K, _TYP, 19, f"{_K!r} * ((high + low + close) / 3) + {1 - _K!r} * seed", "t"),
    _TR,
    f"a AS (SELECT *, CASE WHEN bar_idx >= 10 THEN avg(true_range) {over(10)} END AS atr FROM tr)",
    "kc AS (SELECT a.*, km.y AS kc_mid, km.y + 2 * atr AS kc_upper, km.y - 2 * atr AS kc_lower FROM a LEFT JOIN km ON km.symbol = a.symbol AND km.bar_idx = a.bar_idx)",
)


@query(_with(*_KELTNER, recursive=True) + "SELECT symbol, bar_ts, " + ", ".join(f"{r6(c)} AS {c}" for c in ("kc_mid", "kc_upper", "kc_lower")) + " FROM kc")
def keltner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_keltner(bars(spark, sf_dir)), "kc_mid", "kc_upper", "kc_lower")


@query(_with(*_KELTNER, _percent_sql("kc", "kc_lower", "kc_upper", "kcp", "0.01"), recursive=True) + _channel_sql("kcp"))
def keltner_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_keltner_percent(bars(spark, sf_dir)), *_channel("kcp"))


_BANDS = (
    _WICK,
    f"tr2 AS (SELECT *, CASE WHEN bar_idx = 0 THEN 0.0 ELSE greatest(high, lag(close) {BEFORE}) - least(low, lag(close) {BEFORE}) END AS true_range FROM anatomy)",
    f"a2 AS (SELECT *, CASE WHEN bar_idx >= 14 THEN avg(true_range) {over(14)} END AS atr FROM tr2)",
    "raw AS (SELECT *, CASE WHEN bar_idx > 14 THEN short_anchor + 1.5 * atr END AS up, CASE WHEN bar_idx > 14 THEN long_anchor - 1.5 * atr END AS down FROM a2)",
    f"sb0 AS (SELECT *, CASE WHEN bar_idx >= 28 THEN avg(up) {over(14)} END AS stop_upper, CASE WHEN bar_idx >= 28 THEN avg(down) {over(14)} END AS stop_lower FROM raw)",
    "sb AS (SELECT *, (stop_upper + stop_lower) / 2 AS stop_mid FROM sb0)",
)


@query(_with(*_BANDS) + "SELECT symbol, bar_ts, " + ", ".join(f"{r6(c)} AS {c}" for c in ("stop_upper", "stop_lower", "stop_mid")) + " FROM sb")
def atr_stop_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_atr_stop_bands(bars(spark, sf_dir)), "stop_upper", "stop_lower", "stop_mid")


@query(_with(*_BANDS, _percent_sql("sb", "stop_lower", "stop_upper", "asp", "0.01")) + _channel_sql("asp"))
def atr_stop_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_atr_stop_percent(bars(spark, sf_dir)), *_channel("asp"))


def _macd(x: str = "close") -> tuple[str, ...]:
    return (
        _ema("fast", 2 / 13, x if x == "close" else f"b.{x}", first=x, source="px"), _ema("slow", 2 / 27, x if x == "close" else f"b.{x}", first=x, source="px"),
        "mc AS (SELECT px.*, CASE WHEN px.bar_idx >= 26 THEN fast.y - slow.y ELSE 0.0 END AS macd FROM px JOIN fast USING (symbol, bar_idx) JOIN slow USING (symbol, bar_idx))",
        f"md AS (SELECT *, {_sma('macd', 9)} AS macd_signal FROM mc)",
    )


_PX = "px AS MATERIALIZED (SELECT *, (high + low + 2 * close) / 4 AS weighted FROM bars)"
MACD_SQL = (_PX, *_macd())


@query(_with(*MACD_SQL, recursive=True) + f"SELECT symbol, bar_ts, {r6('macd')} AS macd, {r6('macd_signal')} AS macd_signal FROM md")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_macd(bars(spark, sf_dir)), "macd", "macd_signal")


@query(_with(_PX, *_macd("weighted"), recursive=True) + f"SELECT symbol, bar_ts, {r6('macd')} AS macd, {r6('macd_signal')} AS macd_signal FROM md")
def macd_on_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_macd(bars(spark, sf_dir), x=S.applied_price("WEIGHTED")), "macd", "macd_signal")


_NORM = f"mn AS (SELECT *, CASE WHEN max(macd) {over(89)} = min(macd) {over(89)} THEN 50.0 ELSE greatest(0.0, (macd - min(macd) {over(89)}) / (max(macd) {over(89)} - min(macd) {over(89)}) * 100) END AS macd_norm FROM md)"


@query(_with(*MACD_SQL, _NORM, recursive=True) + f"SELECT symbol, bar_ts, {r6('macd_norm')} AS macd_norm FROM mn")
def macd_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_macd_normalized(bars(spark, sf_dir)), "macd_norm")


def stochastic_sql(source: str = "bars") -> str:
    """Expressions `stoch` (stoch_k, stoch_d) over bars."""
    t = "CAST(floor({} / 0.01 + 0.5) AS BIGINT)"
    c = t.format("close")
    return f"""st0 AS (SELECT *, min({c}) {over(5)} AS lo, max({c}) {over(5)} AS hi, {c} AS ct FROM {source}),
        st1 AS (SELECT *, sum(CASE WHEN bar_idx >= 4 THEN ct - lo END) {over(3)} AS above, sum(CASE WHEN bar_idx >= 4 THEN hi - lo END) {over(3)} AS width FROM st0),
        st2 AS (SELECT *, CASE WHEN bar_idx >= 6 THEN CASE WHEN width = 0 THEN 100.0 ELSE above * 100.0::DOUBLE / width END END AS stoch_k FROM st1),
        stoch AS (SELECT *, CASE WHEN bar_idx >= 8 THEN avg(stoch_k) {over(3)} END AS stoch_d FROM st2)"""


@query(_with(stochastic_sql()) + f"SELECT symbol, bar_ts, {r6('stoch_k')} AS stoch_k, {r6('stoch_d')} AS stoch_d FROM stoch")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_stochastic(bars(spark, sf_dir)), "stoch_k", "stoch_d")


@query(_with() + f"SELECT symbol, bar_ts, floor(max(high) {over(20)} * 100 + 0.5) / 100 AS top, floor(min(low) {over(20)} * 100 + 0.5) / 100 AS bottom FROM bars")
def rolling_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return shown(b.withColumns({"top": W.rolling_range(F.col("high"), 20)[0], "bottom": W.rolling_range(F.col("low"), 20)[1]}), "top", "bottom")


_SLOPE = f"""m AS (SELECT *, {_sma('close', 21)} AS ma FROM bars), sl AS (SELECT *, lag(ma, 1) {BEFORE} AS ma_now, lag(ma, 2) {BEFORE} AS ma_before FROM m)"""


@query(_with(_SLOPE) + f"SELECT symbol, bar_ts, {r6('ma_now')} AS ma_now, {r6('ma_before')} AS ma_before, CASE WHEN ma_now > ma_before THEN 1 WHEN ma_now < ma_before THEN 2 ELSE 0 END AS trend FROM sl")
def ma_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.with_ma_slope(bars(spark, sf_dir), 21, 1), "ma_now", "ma_before", "trend")


@query(_with() + "SELECT symbol, bar_ts, close FROM (SELECT *, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM bars) WHERE bar_idx > last - 512")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.bounded_history(bars(spark, sf_dir), 4, 5), "close")


@query(_with() + f"SELECT symbol, bar_ts, {r6(_sma('close', 21))} AS sma FROM bars")
def sma_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.in_chunks(bars(spark, sf_dir), lambda b: W.with_ma(b, "SMA", 21, "sma"), 20, 100), "sma")


@query("SELECT symbol, ts, event_id, floor(abs(ask - bid) * 100 * 1e6 + 0.5) / 1e6 AS spread_points FROM (SELECT event_id, ts, event_type AS symbol, value AS bid, value + 0.02 AS ask FROM events)")
def spread_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ticks(spark, sf_dir).withColumn("spread_points", S.spread_points(2)), "spread_points", keys=("symbol", "ts", "event_id"))
