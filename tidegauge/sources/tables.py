"""Sources: ticks, bars, deals, positions and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of the supported timeframes (fixed values); each divides a day.
TIMEFRAMES = {f"{n}{u}": n * s for u, s, ns in (("min", 60, (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30)), ("h", 3600, (1, 2, 3, 4, 6, 8, 12))) for n in ns}

STRATEGIES = "strategy_id int, label string, base_delay int, macro string, macro_delay int, enabled boolean"


def _tf_seconds(tf: str) -> int:
    if tf not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {tf}; known: {', '.join(TIMEFRAMES)}")
    return TIMEFRAMES[tf]


def read_ticks(spark: SparkSession, path: str, spread: float = 0.02) -> DataFrame:
    """An events table as ticks: event_id, ts, symbol, price, bid, ask. Only four of its columns are read."""
    e = spark.read.parquet(path)
    return e.select("event_id", "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.col("value").alias("bid"), (F.col("value") + spread).alias("ask"))


def floor_ts(ts: Column, seconds: int) -> Column:
    """The start of the span of so many seconds since midnight that a time without zone is in; spans divide a day."""
    day = F.date_trunc("day", ts)
    inside = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return (day + F.make_dt_interval(secs=F.floor(inside / seconds) * seconds)).cast("timestamp_ntz")


def build_bars(ticks: DataFrame, *tfs: str, span_days: int | None = None) -> DataFrame:
    """OHLC bars of every symbol and timeframe: symbol, tf, bar_ts, open, high, low, close, tick_volume, bar_idx.

    Ticks go by (ts, event_id). Spans without ticks give no bar. Several timeframes take one pass and one shuffle; each
    task sums up its own ticks before that. span_days: see with_bar_idx.
    """
    spans = F.array(*(F.struct(F.lit(tf).alias("tf"), floor_ts(F.col("ts"), _tf_seconds(tf)).alias("bar_ts")) for tf in tfs))
    at = F.struct("ts", "event_id")
    rows = ticks.select("symbol", "price", "ts", "event_id", F.explode(spans).alias("span"))
    bars = rows.groupBy("symbol", F.col("span.tf").alias("tf"), F.col("span.bar_ts").alias("bar_ts")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("tick_volume")
    )
    return with_bar_idx(bars, span_days)


def with_bar_idx(bars: DataFrame, span_days: int | None = None) -> DataFrame:
    """Bars numbered from 0 within symbol and timeframe. With span_days a symbol's spans of so many days are numbered in tasks of
    their own, each from the number of bars in the spans before it: for long histories, of which it reads the times twice."""
    from pyspark.sql import Window

    if span_days is None:
        return bars.withColumn("bar_idx", F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("bar_ts")) - 1)
    b = bars.withColumn("__span", F.floor(F.unix_seconds(F.col("bar_ts").cast("timestamp")) / (span_days * 86400)))
    counts = b.groupBy("symbol", "tf", "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("symbol", "tf").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("symbol", "tf", "__span").orderBy("bar_ts"))
    return b.join(starts, ["symbol", "tf", "__span"]).withColumn("bar_idx", (F.col("__before") + own - 1).cast("int")).select(*bars.columns, "bar_idx")


def resample_bars(bars: DataFrame, *tfs: str, span_days: int | None = None) -> DataFrame:
    """Bars of larger timeframes from bars of one smaller timeframe."""
    spans = F.array(*(F.struct(F.lit(tf).alias("tf"), floor_ts(F.col("bar_ts"), _tf_seconds(tf)).alias("bar_ts")) for tf in tfs))
    rows = bars.select("symbol", "open", "high", "low", "close", "tick_volume", F.col("bar_ts").alias("at"), F.explode(spans).alias("span"))
    out = rows.groupBy("symbol", F.col("span.tf").alias("tf"), F.col("span.bar_ts").alias("bar_ts")).agg(
        F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.sum("tick_volume").alias("tick_volume")
    )
    return with_bar_idx(out, span_days)


def symbol_spec(symbols: DataFrame, point: float = 0.01) -> DataFrame:
    """Specifications of the distinct symbols, with their least stop distance and whether they are usable."""
    spec = symbols.select("symbol").distinct().withColumns({
        "point_size": F.lit(point), "tick_size": F.lit(point), "tick_value": F.lit(1.0), "contract_size": F.lit(100.0), "min_volume": F.lit(0.01), "max_volume": F.lit(100.0),
        "volume_step": F.lit(0.01), "freeze_level_points": F.lit(0.0), "stops_level_points": F.lit(5.0), "digits": F.lit(2),
    })
    return spec.withColumns({"min_stop_distance": F.greatest("freeze_level_points", "stops_level_points"), "valid": (F.col("point_size") > 0) & (F.col("tick_size") > 0) & (F.col("tick_value") > 0)})


def strategy_config(spark: SparkSession, enabled: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The three strategies: delay of the base confirmation, macro timeframe and its delay (fixed values)."""
    rows = [(1, "S1", 3, "3h", 1), (2, "S2", 5, "4h", 1), (3, "S3", 10, "8h", 1)]
    return spark.createDataFrame([(*r, r[0] in enabled) for r in rows], STRATEGIES)


def trade_sessions(symbols: DataFrame) -> DataFrame:
    """Sessions of each weekday (0 is Sunday): symbol, dow, session, from_sec, to_sec; to_sec beyond a day ends on the next.

    Weekdays trade 00:05-12:00 and 13:00-23:55, Sundays 22:00-01:00.
    """
    week = [(d, s, a, b) for d in range(1, 6) for s, a, b in ((0, 300, 43200), (1, 46800, 86100))] + [(0, 0, 79200, 90000)]
    plan = F.array(*(F.struct(F.lit(d).alias("dow"), F.lit(s).alias("session"), F.lit(a).alias("from_sec"), F.lit(b).alias("to_sec")) for d, s, a, b in week))
    return symbols.select("symbol").distinct().select("symbol", F.inline(plan))


def read_deals(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, server_offset_seconds: int = 0) -> DataFrame:
    """Closed deals of a lineitem table. since and until are UTC times that reach the scan as server times."""
    li = spark.read.parquet(path)
    shift = F.make_dt_interval(secs=F.lit(server_offset_seconds))
    if since is not None:
        li = li.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz") + shift)
    if until is not None:
        li = li.where(F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz") + shift)
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("deal_id"), (F.col("l_suppkey") % 10).alias("account"), (F.col("l_suppkey") % 4).alias("magic"), F.col("l_shipdate").alias("deal_time"),
        F.when(F.col("l_returnflag") == "A", "IN").when(F.col("l_returnflag") == "R", "OUT").otherwise("INOUT").alias("entry"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("deal_type"),
        (F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("profit"), (-0.01 * F.col("l_quantity")).alias("swap"),
        (-0.01 * F.col("l_extendedprice") * F.col("l_tax")).alias("commission"), F.lit(0.0).alias("fee"),
    )


def read_legs(spark: SparkSession, path: str) -> DataFrame:
    """Execution legs of an orders table: one signal per customer, one leg per order."""
    from pyspark.sql import Window

    o = spark.read.parquet(path)
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(
        F.col("o_custkey").alias("signal_id"), nth.alias("level_index"),
        F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("COMPLETED").alias("status"),
        F.when(F.col("o_custkey") % 2 == 0, "BULLISH").otherwise("BEARISH").alias("direction"),
        (F.col("o_totalprice") / 1000).alias("entry_price"), (0.01 * (1 + F.col("o_custkey") % 50)).alias("lot_size"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 != 0), F.col("o_orderkey")).alias("ticket"),
        F.concat(F.lit("EX_S1_"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey")).alias("comment"),
    )


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Open positions of an orders table; the filter on the status reaches the scan."""
    o = spark.read.parquet(path).where((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 7 != 0))
    return o.select(
        F.col("o_orderkey").alias("ticket"), (F.col("o_custkey") % 4).alias("magic"), F.when(F.col("o_custkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (0.01 * (1 + F.col("o_custkey") % 50)).alias("volume"), (F.col("o_totalprice") / 1000).alias("entry_price"), (F.col("o_totalprice") / 1000 - 250).alias("profit"),
        F.concat(F.lit("EX_S1_"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey")).alias("comment"),
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of an events table: event_id, ts, label, state_key, message."""
    e = spark.read.parquet(path)
    return e.select("event_id", "ts", F.col("event_type").alias("label"), (F.col("user_id") % 10).alias("state_key"), F.floor(F.col("value") / 50).cast("int").alias("message"))
