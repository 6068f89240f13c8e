"""Joins of bars, ticks, sessions, candidates, legs and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.windows import lag
from tidegauge.sources.tables import TIMEFRAMES

#: Days of a span of an as-of join; a symbol's spans are tasks of their own.
SPAN_DAYS = 256
#: Dimension tables are broadcast up to this many rows; larger ones are joined as Spark sees fit.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame) -> DataFrame:
    """A broadcast hint, if the table is as small as a dimension should be."""
    return F.broadcast(df) if df.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else df


def lookup_bars_back(at: DataFrame, bars: DataFrame, value: str, n: int, time_col: str, out: str) -> DataFrame:
    """Add the value n bars before the bar at time_col (null where there is none)."""
    back = bars.withColumn(out, lag(value, n)).select("symbol", "tf", F.col("bar_ts").alias(time_col), out)
    return at.join(back, ["symbol", "tf", time_col], "left")


def asof_closed_bars(base: DataFrame, macro: DataFrame, values: dict[str, Column], tfs: tuple[str, ...]) -> DataFrame:
    """Add to each row of base (symbol, bar_ts) values of the last macro bar of each timeframe that closed at or before its
    start, as __name_tf.

    Both sides are put in one order by the time from which they count, and the last macro row of each timeframe is carried
    on: one shuffle for all, whatever gaps there are. Time is cut into spans of SPAN_DAYS that are tasks of their own; the
    last rows before a span come from a small table of the spans' ends.
    """
    closes = F.col("bar_ts") + F.make_dt_interval(secs=F.coalesce(*(F.when(F.col("tf") == tf, F.lit(TIMEFRAMES[tf])) for tf in tfs)))
    m = macro.where(F.col("tf").isin(*tfs)).select("symbol", closes.alias("__at"), F.col("tf").alias("__tf"), F.struct(*(v.alias(k) for k, v in values.items())).alias("__macro"))
    span = F.floor(F.unix_seconds(F.col("__at").cast("timestamp")) / (SPAN_DAYS * 86400))
    m = m.withColumn("__span", span)
    kind = m.schema["__macro"].dataType
    # the last row of each span and timeframe, carried over the spans after it that have none
    ends = m.groupBy("symbol", "__span").agg(*(F.max_by(F.when(F.col("__tf") == tf, F.col("__macro")), F.when(F.col("__tf") == tf, F.col("__at"))).alias(f"__end_{tf}") for tf in tfs))
    b = base.select("symbol", F.col("bar_ts").alias("__at"), F.struct(*base.columns).alias("__base")).withColumn("__span", span)
    spans = b.select("symbol", "__span").distinct().withColumns({f"__end_{tf}": F.lit(None).cast(kind) for tf in tfs} | {"__own": F.lit(True)}).unionByName(ends.withColumn("__own", F.lit(False)))
    before = Window.partitionBy("symbol").orderBy("__span").rangeBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumns({f"__start_{tf}": F.last(f"__end_{tf}", True).over(before) for tf in tfs}).where("__own").select("symbol", "__span", *(f"__start_{tf}" for tf in tfs))
    w = Window.partitionBy("symbol", "__span").orderBy("__at", F.col("__base").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = b.withColumns({"__macro": F.lit(None).cast(kind), "__tf": F.lit(None).cast("string")}).unionByName(m.withColumn("__base", F.lit(None).cast(b.schema["__base"].dataType)))
    both = both.withColumns({f"__last_{tf}": F.last(F.when(F.col("__tf") == tf, F.col("__macro")), True).over(w) for tf in tfs}).where("__base IS NOT NULL")
    both = both.join(starts, ["symbol", "__span"], "left")
    return both.select("__base.*", *(F.coalesce(F.col(f"__last_{tf}"), F.col(f"__start_{tf}"))[k].alias(f"__{k}_{tf}") for tf in tfs for k in values))


def asof_closed_bar(base: DataFrame, macro: DataFrame, values: dict[str, Column], macro_tf: str) -> DataFrame:
    """Add to each row of base (symbol, bar_ts) values of the last macro bar that closed at or before its start."""
    out = asof_closed_bars(base, macro, values, (macro_tf,))
    return out.withColumnsRenamed({f"__{k}_{macro_tf}": k for k in values})


def cross_strategies(rows: DataFrame, strategies: DataFrame) -> DataFrame:
    """Each row for every enabled strategy and both directions."""
    s = dimension(strategies.where("enabled").select("strategy_id", "label", "base_delay", "macro", "macro_delay"))
    return rows.join(s).withColumn("direction", F.explode(F.array(F.lit("BULLISH"), F.lit("BEARISH"))))


def session_join(rows: DataFrame, sessions: DataFrame, ts: str = "ts", guard_seconds: int = 60) -> DataFrame:
    """Rows inside a session of their weekday (sessions may end after midnight), without its first and last guard seconds.
    A session of the day before isn't looked at."""
    day = F.dayofweek(ts) - 1
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    s = dimension(sessions.select(F.col("symbol").alias("__s"), "dow", "session", "from_sec", "to_sec"))
    hit = (F.col("symbol") == F.col("__s")) & (day == F.col("dow")) & (second > F.col("from_sec") + guard_seconds) & (second < F.col("to_sec") - guard_seconds)
    return rows.join(s, hit).drop("__s", "dow")


def enrich_symbol(rows: DataFrame, spec: DataFrame) -> DataFrame:
    return rows.join(dimension(spec), "symbol")


def reconcile_positions(legs: DataFrame, positions: DataFrame) -> DataFrame:
    """Legs with the position they belong to: by ticket, else by comment and side; and what becomes of them.

    A leg whose ticket has vanished is COMPLETED with no volume. match is ticket, comment, vanished or none.
    """
    p = positions.select(F.col("ticket").alias("p_ticket"), F.col("side").alias("p_side"), F.col("volume").alias("p_volume"), F.col("profit").alias("p_profit"), F.col("comment").alias("p_comment"))
    by_ticket = p.select(*(F.col(c).alias(f"t_{c}") for c in ("p_ticket", "p_volume", "p_profit")))
    # of positions with one comment and side the smallest ticket counts
    by_comment = p.groupBy(F.col("p_comment").alias("c_comment"), F.col("p_side").alias("c_side")).agg(F.min(F.struct("p_ticket", "p_volume", "p_profit")).alias("c"))
    side = F.when(F.col("direction") == "BULLISH", "BUY").otherwise("SELL")
    # legs without a ticket match none; a key of their own spreads them over tasks, where null would put them all in one
    spread = F.coalesce(F.col("ticket"), F.xxhash64("signal_id", "level_index").cast(legs.schema["ticket"].dataType))
    j = legs.join(by_ticket, (spread == F.col("t_p_ticket")) & (F.col("ticket") == F.col("t_p_ticket")), "left")
    j = j.join(by_comment, (F.col("comment") == F.col("c_comment")) & (side == F.col("c_side")), "left")
    use_comment = F.col("ticket").isNull() & F.col("c").isNotNull() & (F.col("status") != "COMPLETED")
    match = F.when(F.col("t_p_ticket").isNotNull(), "ticket").when(F.col("ticket").isNotNull(), "vanished").when(use_comment, "comment").otherwise("none")
    j = j.withColumn("match", match)
    found = F.col("match").isin("ticket", "comment")
    return j.select(
        "signal_id", "level_index", "direction", "comment", "match",
        F.when(F.col("match") == "ticket", F.col("t_p_ticket")).when(F.col("match") == "comment", F.col("c.p_ticket")).otherwise(F.col("ticket")).alias("ticket"),
        F.when(found, "ACTIVE").when(F.col("match") == "vanished", "COMPLETED").otherwise(F.col("status")).alias("status"),
        F.when(F.col("match") == "ticket", F.col("t_p_volume")).when(F.col("match") == "comment", F.col("c.p_volume")).when(F.col("match") == "vanished", 0.0).otherwise(F.col("lot_size")).alias("volume"),
        F.when(F.col("match") == "ticket", F.col("t_p_profit")).when(F.col("match") == "comment", F.col("c.p_profit")).alias("profit"),
    )


def exclude_consumed(candidates: DataFrame, consumed: DataFrame, time_col: str = "signal_ts") -> DataFrame:
    """Candidates whose source hasn't been consumed (source_key, consumed_ts) before their time."""
    first = consumed.groupBy(F.col("source_key").alias("__k")).agg(F.min("consumed_ts").alias("__t"))
    return candidates.join(first, (F.col("source_key") == F.col("__k")) & (F.col("__t") < F.col(time_col)), "left_anti")


def same_identity(candidates: DataFrame, running: DataFrame, point: float, how: str = "left_semi") -> DataFrame:
    """Candidates that have (left_semi) or lack (left_anti) a running signal of the same strategy, direction, source slot,
    time and kind whose source price differs by a point at most."""
    keys = ("symbol", "strategy_id", "direction", "slot", "extremum_ts", "is_peak")
    r = running.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("price").alias("__price"))
    on = F.abs(F.col("price") - F.col("__price")) <= point + 1e-9
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return candidates.join(r, on, how)


def first_touch(starts: DataFrame, path: DataFrame, hit: Column, horizon_seconds: int, bucket_seconds: int, key: str, time: str = "bar_ts") -> DataFrame:
    """The first row of path (symbol, time, ...; a row for each symbol and time) after each start (key, symbol, start_ts, ...)
    within the horizon for which `hit` holds: key, hit_ts, hit_row (all columns of path). Starts without one are left out.

    Time is cut into buckets; each start goes to the buckets that its horizon reaches, and meets path rows by symbol and
    bucket. Buckets spread a symbol over tasks, and a start that has its first touch is one row however long it waits. Pairs that
    meet are reduced to their first time, a hash aggregation that never sorts them; only then that time's row is looked up.
    """
    reach = -(-horizon_seconds // bucket_seconds)
    bucket = lambda ts: F.floor(F.unix_timestamp(ts.cast("timestamp")) / bucket_seconds)
    s = starts.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("start_ts")), bucket(F.col("start_ts")) + reach)))
    p = path.select(F.col("symbol").alias("__symbol"), F.col(time).alias("__time"), F.struct(*path.columns).alias("row"))
    within = (F.col("__time") > F.col("start_ts")) & (F.col("__time") <= F.col("start_ts") + F.make_dt_interval(secs=F.lit(horizon_seconds)))
    j = s.join(p.withColumn("__pb", bucket(F.col("__time"))), (F.col("symbol") == F.col("__symbol")) & (F.col("__bucket") == F.col("__pb")) & within & hit)
    first = j.groupBy(key, "symbol").agg(F.min("__time").alias("hit_ts"))
    return first.join(p, (F.col("symbol") == F.col("__symbol")) & (F.col("hit_ts") == F.col("__time"))).select(key, F.col("row").alias("hit_row"), "hit_ts")


def deal_to_position(deals: DataFrame, positions: DataFrame, hours: int = 24) -> DataFrame:
    """Deals with the positions of their magic opened up to `hours` before.

    Both meet by magic and time span; a position is in the span it opened in and the next one, so that a magic with very
    many deals spreads over its spans.
    """
    span = lambda ts: F.floor(F.unix_seconds(ts.cast("timestamp")) / (hours * 3600))
    own = span(F.col("opened_ts"))
    p = positions.select(F.col("magic").alias("__m"), F.col("ticket").alias("position_id"), "opened_ts", F.explode(F.array(own, own + 1)).alias("__span"))
    near = (F.col("magic") == F.col("__m")) & (span(F.col("deal_time")) == F.col("__span")) & (F.col("opened_ts") <= F.col("deal_time")) & (F.col("opened_ts") > F.col("deal_time") - F.make_dt_interval(hours=F.lit(hours)))
    return deals.join(p, near).drop("__m", "__span")
