"""Queries of times, sessions, volumes, joins, reports, logs and trade candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import joins as J
from tidegauge.operators import live
from tidegauge.operators import reports as R
from tidegauge.operators import signals as G
from tidegauge.operators import windows as W
from tidegauge.plans.registry import bars, bars_sql, query, r6, shown, stored_bars, table, ticks
from tidegauge.plans.structure_queries import SNAPSHOT_SQL
from tidegauge.sources import sinks as K
from tidegauge.sources import tables as T


def _p(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


# -- times

_SLOTS = (("Asia", "00:00-08:00"), ("London", "07:00-12:00"), ("NewYork", "12:00-20:00"), ("Night", "22:00-02:00"), ("Full", "09:00-09:00"), ("Bad", "9h-10"))


@query(
    """WITH t AS (SELECT event_id, ts, (hour(ts) * 60 + minute(ts) - 60 + 1440) % 1440 AS m FROM events),
    f AS (SELECT *, m < 480 AS asia, m >= 420 AND m < 720 AS london, m >= 720 AND m < 1200 AS newyork, m >= 1320 OR m < 120 AS night, true AS always, true AS bad FROM t)
    SELECT event_id, CAST(m AS INTEGER) AS minute, asia, london, newyork, night, always, bad, CASE WHEN asia THEN 'Asia' WHEN london THEN 'London' WHEN newyork THEN 'NewYork' WHEN night THEN 'Night' ELSE 'OUTSIDE' END AS label FROM f"""
)
def session_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("minute", S.minute_of_day("ts", 60))
    names = ("asia", "london", "newyork", "night", "always", "bad")
    t = t.withColumns({n: S.minute_in_range("minute", S.parse_hhmm_range(F.lit(r))) for n, (_, r) in zip(names, _SLOTS)})
    label = F.coalesce(*(F.when(F.col(n), label) for n, (label, _) in zip(names[:4], _SLOTS)), F.lit("OUTSIDE"))
    return t.select("event_id", "minute", *names, label.alias("label"))


@query(
    """WITH d AS (SELECT o_orderkey AS id, o_orderdate AS ts, year(o_orderdate) AS y FROM orders),
    e AS (SELECT *, make_date(y, 3, 1) AS m, make_date(y, 11, 1) AS n FROM d),
    f AS (SELECT *, m + CAST((7 - dayofweek(m)) % 7 + 7 AS INTEGER) AS starts, n + CAST((7 - dayofweek(n)) % 7 AS INTEGER) AS ends FROM e)
    SELECT id, ts >= starts AND ts < ends AS dst, CAST(CASE WHEN ts >= starts AND ts < ends THEN 0 ELSE 60 END AS INTEGER) AS offset_minutes, CAST(day(starts) AS INTEGER) AS second_sunday FROM f"""
)
def dst_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    return o.select("id", S.dst_active("ts").alias("dst"), S.trading_offset_minutes("AUTO", "ts").alias("offset_minutes"), S.nth_weekday_of_month(F.year("ts"), 3, 0, 2).cast("int").alias("second_sunday"))


_SESSIONS = "s AS (SELECT * FROM (SELECT d AS dow, 0 AS session, 300 AS a, 43200 AS b FROM range(1, 6) r(d) UNION ALL SELECT d, 1, 46800, 86100 FROM range(1, 6) r(d) UNION ALL SELECT 0, 0, 79200, 90000))"


@query(
    f"""WITH {_SESSIONS}, t AS (SELECT event_id, event_type AS symbol, dayofweek(ts) AS dow, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS sec FROM events)
    SELECT event_id, symbol, CAST(session AS INTEGER) AS session FROM t JOIN s USING (dow) WHERE sec > a + 60 AND sec < b - 60"""
)
def market_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return J.session_join(t, T.trade_sessions(t)).select("event_id", "symbol", "session")


@query(
    """WITH t AS (SELECT event_id, date_trunc('day', ts) AS day, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS sec FROM events)
    SELECT event_id, CAST(day + to_seconds(sec - sec % 14400) AS TIMESTAMP) AS start_4h, CAST(day + to_seconds(sec - sec % 14400 + 14400) AS TIMESTAMP) AS next_4h, sec >= 86099 - 86099 % 900 AND sec < 86100 AS guarded FROM t"""
)
def aligned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans' starts, the next starts, and whether a time is in the last quarter of an hour before 23:55."""
    start = T.floor_ts(F.col("ts"), 14400)
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    end = 86100
    return ticks(spark, sf_dir).select("event_id", start.alias("start_4h"), (start + F.make_dt_interval(hours=F.lit(4))).cast("timestamp_ntz").alias("next_4h"), ((second >= (end - 1) // 900 * 900) & (second < end)).alias("guarded"))


@query(
    """WITH t AS (SELECT event_type AS symbol, ts, event_id, (hour(ts) * 60 + minute(ts)) BETWEEN 420 AND 719 AS active FROM events),
    l AS (SELECT *, lag(active) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts) AS was FROM t) SELECT symbol, 'London' AS slot, ts, active FROM l WHERE was AND NOT active"""
)
def session_exit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    active = S.minute_in_range(S.minute_of_day("ts"), S.parse_hhmm_range(F.lit("07:00-12:00")))
    return G.session_exit_edges(t.select("symbol", F.lit("London").alias("slot"), "ts", active.alias("active")))


_STATUS = "CASE user_id % 7 WHEN 0 THEN 'CLOSEONLY' WHEN 1 THEN 'DISABLED' ELSE 'FULL' END"


@query(f"SELECT event_id, CASE {_STATUS} WHEN 'CLOSEONLY' THEN 'BROKER_CLOSEONLY' WHEN 'DISABLED' THEN 'BROKER_DISABLED' ELSE CASE WHEN hour(ts) = 23 THEN 'CLOSE_GUARD' ELSE 'ACTIVE' END END AS status FROM events")
def market_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("user_id") % 7 == 0, "CLOSEONLY").when(F.col("user_id") % 7 == 1, "DISABLED").otherwise("FULL")
    return e.select("event_id", G.market_status(mode, F.hour("ts") == 23).alias("status"))


@query(
    f"""WITH m AS (SELECT event_type AS symbol, ts, event_id, CASE {_STATUS} WHEN 'CLOSEONLY' THEN 'BROKER_CLOSEONLY' WHEN 'DISABLED' THEN 'BROKER_DISABLED' ELSE CASE WHEN hour(ts) = 23 THEN 'CLOSE_GUARD' ELSE 'ACTIVE' END END AS status FROM events),
    l AS (SELECT *, lag(status) OVER w AS was, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)) SELECT symbol, event_id, status FROM l WHERE n = 1 OR was IS DISTINCT FROM status"""
)
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("user_id") % 7 == 0, "CLOSEONLY").when(F.col("user_id") % 7 == 1, "DISABLED").otherwise("FULL")
    m = e.select(F.col("event_type").alias("symbol"), "ts", "event_id", G.market_status(mode, F.hour("ts") == 23).alias("status"))
    return R.changes(m, ("symbol",), ("ts", "event_id"), "status", span=F.to_date("ts")).select("symbol", "event_id", "status")


# -- volumes and prices


@query(
    f"""WITH o AS (SELECT o_orderkey AS id, o_totalprice / 100000 AS v FROM orders), c AS (SELECT id, least(greatest(v, 0.01::DOUBLE), 100.0::DOUBLE) AS v FROM o)
    SELECT id, {r6('least(greatest(floor(floor(v / 0.01::DOUBLE + 1e-12) * 0.01::DOUBLE * 100 + 0.5) / 100, 0.01::DOUBLE), 100.0::DOUBLE)')} AS lot_down,
    {r6('least(greatest(floor(ceil(v / 0.01::DOUBLE - 1e-12) * 0.01::DOUBLE * 100 + 0.5) / 100, 0.01::DOUBLE), 100.0::DOUBLE)')} AS lot_up FROM c"""
)
def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("v"))
    low, high, step = F.lit(0.01), F.lit(100.0), F.lit(0.01)
    return shown(o.withColumns({"lot_down": S.normalize_volume("v", low, high, step), "lot_up": S.normalize_volume("v", low, high, step, up=True)}), "lot_down", "lot_up", keys=("id",))


_LEGS = """legs AS (SELECT o_custkey AS signal_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS level_index, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'ACTIVE' ELSE 'COMPLETED' END AS status,
    CASE WHEN o_custkey % 2 = 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, o_totalprice / 1000 AS entry_price, 0.01::DOUBLE * (1 + o_custkey % 50) AS lot_size, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 THEN o_orderkey END AS ticket,
    'EX_S1_' || o_custkey || '_' || o_orderkey AS comment FROM orders)"""
_POSITIONS = """positions AS (SELECT o_orderkey AS ticket, o_custkey % 4 AS magic, CASE WHEN o_custkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 0.01::DOUBLE * (1 + o_custkey % 50) AS volume, o_totalprice / 1000 AS entry_price,
    o_totalprice / 1000 - 250 AS profit, 'EX_S1_' || o_custkey || '_' || o_orderkey AS comment FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 7 <> 0)"""


@query(
    f"""WITH {_LEGS} SELECT signal_id, CAST(level_index AS INTEGER) AS level_index, {r6("lot_size * (250 - entry_price) * CASE direction WHEN 'BULLISH' THEN 1 ELSE -1 END / 0.01::DOUBLE")} AS projected,
    CASE WHEN abs(entry_price - 250) < 0.01 THEN 'NEUTRAL' WHEN entry_price - 250 > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome,
    {r6("entry_price + CASE direction WHEN 'BULLISH' THEN 1 ELSE -1 END * abs(entry_price - 240) * 150 / 100")} AS tp, {r6('greatest(10 * pow(1.5::DOUBLE, level_index), 12)')} AS distance FROM legs"""
)
def profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_legs(spark, _p(sf_dir, "orders"))
    more = {
        "projected": S.projected_profit("direction", "lot_size", "entry_price", F.lit(250.0), F.lit(1.0), F.lit(0.01)), "outcome": S.outcome_class(F.col("entry_price") - 250),
        "tp": S.tp_price("direction", "entry_price", F.lit(240.0), 150.0), "distance": S.level_distance(F.lit(10.0), 1.5, "level_index", F.lit(12.0)),
    }
    return shown(g.withColumns(more), *more, keys=("signal_id", "level_index"))


@query(
    f"""WITH o AS (SELECT o_orderkey AS id, o_totalprice / 1000 - 150 AS target, (o_custkey % 60)::DOUBLE AS existing, (o_custkey % 17)::DOUBLE * 10 AS per FROM orders),
    r AS (SELECT *, (target - existing) / nullif(CASE WHEN per > 0 THEN per END, 0) AS raw FROM o), f AS (SELECT *, coalesce(raw <= 100 AND raw > 0, false) AS feasible FROM r)
    SELECT id, feasible, CASE WHEN feasible THEN {r6('least(greatest(floor(ceil(least(greatest(raw, 0.01::DOUBLE), 100.0::DOUBLE) / 0.01::DOUBLE - 1e-12) * 0.01::DOUBLE * 100 + 0.5) / 100, 0.01::DOUBLE), 100.0::DOUBLE)')} END AS lot FROM f"""
)
def required_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    r = S.required_lot(F.col("o_totalprice") / 1000 - 150, (F.col("o_custkey") % 60).cast("double"), (F.col("o_custkey") % 17).cast("double") * 10, F.lit(0.01), F.lit(100.0), F.lit(0.01))
    return shown(o.select(F.col("o_orderkey").alias("id"), r.alias("r")).select("id", "r.*"), "feasible", "lot", keys=("id",))


@query(
    f"""WITH {_LEGS}, a AS (SELECT *, CASE direction WHEN 'BULLISH' THEN 1 ELSE -1 END AS sg FROM legs), b AS (SELECT *, entry_price - sg * 10 AS raw FROM a),
    c AS (SELECT *, CASE WHEN direction = 'BULLISH' THEN greatest(raw, 200) ELSE least(raw, 200) END AS p1 FROM b), d AS (SELECT *, CASE WHEN direction = 'BULLISH' THEN least(p1, 260 - sg * 5) ELSE greatest(p1, 260 - sg * 5) END AS p2 FROM c),
    e AS (SELECT *, CASE WHEN direction = 'BULLISH' THEN ceil(p2 / 0.05::DOUBLE - 1e-9) ELSE floor(p2 / 0.05::DOUBLE + 1e-9) END * 0.05::DOUBLE AS p3 FROM d), f AS (SELECT *, CASE WHEN direction = 'BULLISH' THEN least(p3, 240) ELSE greatest(p3, 240) END AS p4 FROM e)
    SELECT signal_id, CAST(level_index AS INTEGER) AS level_index, {r6('p4')} AS price, concat_ws(';', CASE WHEN p1 <> raw THEN 'protective' END, CASE WHEN p2 <> p1 THEN 'broker' END, CASE WHEN abs(p3 - p2) > 1e-9 THEN 'tick' END, CASE WHEN p4 <> p3 THEN 'monotonic' END) AS reasons FROM f"""
)
def next_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_legs(spark, _p(sf_dir, "orders"))
    n = S.next_price(F.col("direction"), F.col("entry_price"), F.lit(10.0), F.lit(200.0), F.lit(5.0), F.lit(260.0), F.lit(240.0), F.lit(0.05))
    return shown(g.withColumn("n", n).select("signal_id", "level_index", "n.*"), "price", "reasons", keys=("signal_id", "level_index"))


@query(
    f"""SELECT o_orderkey AS id, {r6('coalesce(CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 5)::DOUBLE END, 100 * (o_totalprice / 1000) / 30) * 2')} AS margin,
    {r6('greatest((o_custkey % 40)::DOUBLE, CASE WHEN o_custkey % 9 > 0 THEN (o_custkey % 9)::DOUBLE ELSE 10.0::DOUBLE END)')} AS distance FROM orders"""
)
def margin_and_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    m = S.margin_required((c % 5).cast("double"), F.lit(100.0), F.col("o_totalprice") / 1000, F.lit(30.0), F.lit(2.0))
    e = S.enforce_distance((c % 40).cast("double"), S.min_broker_distance(F.lit(0.0), (c % 9).cast("double")), F.lit(0.01), F.lit(0.01))
    return shown(o.select(F.col("o_orderkey").alias("id"), m.alias("margin"), e.alias("distance")), "margin", "distance", keys=("id",))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_name AS n, p_retailprice AS r FROM part) SELECT id, CASE WHEN regexp_replace(n, '[^0-9A-Za-z_-]', '_', 'g') = '' THEN '_' ELSE regexp_replace(n, '[^0-9A-Za-z_-]', '_', 'g') END AS token,
    CASE WHEN r - 1000 <= 0 THEN 0.0 WHEN r - 1000 > 1e7 THEN 0.0 ELSE floor((r - 1000) * 1e6 + 0.5) / 1e6 END AS price, CASE WHEN r - 1000 < -100 OR r - 1000 > 200 THEN 0.0 ELSE floor((r - 1000) * 1e6 + 0.5) / 1e6 END AS percentile FROM p"""
)
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("x", F.col("p_retailprice") - 1000)
    return shown(p.select(F.col("p_partkey").alias("id"), S.sanitize_token("p_name").alias("token"), S.safe_price("x").alias("price"), S.safe_percentile("x").alias("percentile")), "token", "price", "percentile", keys=("id",))


# -- joins


def _macro_sql() -> str:
    return f"""{bars_sql()}, m0 AS (SELECT symbol, CAST(date_trunc('day', bar_ts) + to_hours(CAST(floor(hour(bar_ts) / 4) * 4 AS BIGINT)) AS TIMESTAMP) AS mts, arg_max(close, bar_ts) AS close FROM bars GROUP BY 1, 2),
        m1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mts) - 1 AS i, avg(close) OVER (PARTITION BY symbol ORDER BY mts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS a FROM m0),
        m2 AS (SELECT symbol, mts + INTERVAL 4 HOUR AS at, CASE WHEN i >= 20 THEN a END AS macro_ma FROM m1)"""


@query(f"WITH {_macro_sql()} SELECT b.symbol, b.bar_ts, {r6('macro_ma')} AS macro_ma FROM bars b ASOF LEFT JOIN m2 ON b.symbol = m2.symbol AND b.bar_ts >= m2.at")
def asof_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    macro = W.with_ma(T.resample_bars(b, "4h"), "SMA", 21, "ma")
    return shown(J.asof_closed_bar(b, macro, {"macro_ma": F.col("ma")}, "4h"), "macro_ma")


@query(f"WITH {bars_sql()} SELECT symbol, bar_ts, lag(close, 3) OVER (PARTITION BY symbol ORDER BY bar_ts) AS close_3 FROM bars")
def lookup_bars_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return J.lookup_bars_back(b.select("symbol", "tf", "bar_ts"), b, "close", 3, "bar_ts", "close_3").select("symbol", "bar_ts", "close_3")


@query(f"WITH {bars_sql()} SELECT symbol, bar_ts, CAST(s AS INTEGER) AS strategy_id, d AS direction FROM bars, (VALUES (1), (2), (3)) v(s), (VALUES ('BULLISH'), ('BEARISH')) w(d)")
def cross_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cross_strategies(bars(spark, sf_dir), T.strategy_config(spark)).select("symbol", "bar_ts", "strategy_id", "direction")


@query(
    f"""WITH {_LEGS}, {_POSITIONS}, pc AS (SELECT comment, side, min(ticket) AS ticket FROM positions GROUP BY 1, 2),
    j AS (SELECT l.*, t.ticket AS tt, t.volume AS tv, t.profit AS tp, c.ticket AS ct, c.volume AS cv, c.profit AS cp FROM legs l LEFT JOIN positions t ON t.ticket = l.ticket
        LEFT JOIN pc ON pc.comment = l.comment AND pc.side = CASE WHEN l.direction = 'BULLISH' THEN 'BUY' ELSE 'SELL' END LEFT JOIN positions c ON c.ticket = pc.ticket),
    m AS (SELECT *, CASE WHEN tt IS NOT NULL THEN 'ticket' WHEN ticket IS NOT NULL THEN 'vanished' WHEN ct IS NOT NULL AND status <> 'COMPLETED' THEN 'comment' ELSE 'none' END AS match FROM j)
    SELECT signal_id, CAST(level_index AS INTEGER) AS level_index, direction, comment, match, CASE match WHEN 'ticket' THEN tt WHEN 'comment' THEN ct ELSE ticket END AS ticket, CASE WHEN match IN ('ticket', 'comment') THEN 'ACTIVE' WHEN match = 'vanished' THEN 'COMPLETED' ELSE status END AS status,
    {r6("CASE match WHEN 'ticket' THEN tv WHEN 'comment' THEN cv WHEN 'vanished' THEN 0.0 ELSE lot_size END")} AS volume, {r6("CASE match WHEN 'ticket' THEN tp WHEN 'comment' THEN cp END")} AS profit FROM m"""
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = J.reconcile_positions(T.read_legs(spark, _p(sf_dir, "orders")), T.read_positions(spark, _p(sf_dir, "orders")))
    return shown(r, "direction", "comment", "match", "ticket", "status", "volume", "profit", keys=("signal_id", "level_index"))


@query(
    f"""WITH {bars_sql()}, s AS (SELECT event_id, event_type AS symbol, ts AS start_ts, value + 20 AS target FROM events)
    SELECT s.event_id, min(b.bar_ts) AS hit_ts, arg_min(b.close, b.bar_ts) AS hit_close FROM s JOIN bars b ON b.symbol = s.symbol AND b.bar_ts > s.start_ts AND b.bar_ts <= s.start_ts + INTERVAL 12 HOUR AND b.high >= s.target GROUP BY 1"""
)
def first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks and the first bar within 12 hours that is 20 above them."""
    s = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("start_ts"), (F.col("value") + 20).alias("target"))
    hit = J.first_touch(s, bars(spark, sf_dir), F.col("row.high") >= F.col("target"), 43200, 21600, "event_id")
    return hit.select("event_id", "hit_ts", F.col("hit_row.close").alias("hit_close"))


# -- reports


_DEALS = """deals AS (SELECT l_suppkey % 10 AS account, l_suppkey % 4 AS magic, l_shipdate AS deal_time, CASE l_returnflag WHEN 'A' THEN 'IN' WHEN 'R' THEN 'OUT' ELSE 'INOUT' END AS entry,
    l_extendedprice * (0.05::DOUBLE - l_discount) + -0.01::DOUBLE * l_quantity + -0.01::DOUBLE * l_extendedprice * l_tax + 0.0 AS net FROM lineitem)"""


@query(
    f"""WITH {_DEALS}, d AS (SELECT account, magic, date_trunc('day', deal_time)::TIMESTAMP AS day, sum(net) AS s, count(*) AS deals FROM deals WHERE entry IN ('OUT', 'INOUT') GROUP BY 1, 2, 3)
    SELECT account, magic, day, CASE WHEN abs(s) < 0.005 THEN 0.0 ELSE floor(s * 100 + 0.5) / 100 END AS net_pnl, deals FROM d"""
)
def daily_net_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_net_pnl(T.read_deals(spark, _p(sf_dir, "lineitem")))


@query(f"WITH {_POSITIONS} SELECT magic, {r6('greatest(0.0, -sum(profit))')} AS drawdown, count(*) AS positions, count(*) FILTER (WHERE side = 'BUY') AS bullish, count(*) FILTER (WHERE side = 'SELL') AS bearish FROM positions GROUP BY 1")
def open_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read_positions(spark, _p(sf_dir, "orders"))
    return shown(R.open_drawdown(p).join(R.open_position_counts(p), "magic"), "drawdown", "positions", "bullish", "bearish", keys=("magic",))


@query(
    """SELECT event_type AS symbol, event_id, coalesce(max(CASE WHEN value >= 480 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, date_trunc('week', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS locked FROM events"""
)
def drawdown_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("drawdown", F.col("price"))
    return R.drawdown_lock(t, F.lit(480.0), "week", order=("ts", "event_id")).select("symbol", "event_id", "locked")


@query(
    f"""WITH {_LEGS}, g AS (SELECT signal_id, count(*) FILTER (WHERE status = 'ACTIVE') AS active, count(*) FILTER (WHERE status IN ('PENDING', 'WAITING')) AS pending, count(*) AS total, bool_or(status NOT IN ('WAITING', 'PENDING', 'INACTIVE')) AS has_executed_leg,
    bool_or(ticket IS NOT NULL OR status = 'ACTIVE') AS has_exposure, NOT bool_or(status IN ('WAITING', 'PENDING', 'ACTIVE') OR ticket IS NOT NULL) AS complete FROM legs GROUP BY 1) SELECT *, active || ' active, ' || pending || ' pending of ' || total AS summary FROM g"""
)
def leg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_legs(spark, _p(sf_dir, "orders"))
    return R.leg_status_summary(g).join(R.leg_flags(g), "signal_id")


@query(
    f"""WITH {_LEGS}, {_POSITIONS}, b AS (SELECT signal_id, sum(lot_size * 1.0 * (260 - entry_price) * CASE direction WHEN 'BULLISH' THEN 1 ELSE -1 END / 0.01::DOUBLE) AS p FROM legs WHERE status = 'ACTIVE' GROUP BY 1),
    v AS (SELECT signal_id, sum(coalesce(p.volume, lot_size)) AS v FROM legs l LEFT JOIN positions p ON p.ticket = l.ticket WHERE status = 'ACTIVE' GROUP BY 1)
    SELECT signal_id, floor(p * 100 + 0.5) / 100 AS basket_profit, floor(v * 100 + 0.5) / 100 AS volume FROM b JOIN v USING (signal_id)"""
)
def basket_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_legs(spark, _p(sf_dir, "orders"))
    b = R.basket_profit_at(g, F.lit(260), 1.0, 0.01).select("signal_id", S.round_digits("basket_profit", 2).alias("basket_profit"))
    return b.join(R.remaining_volume(g, T.read_positions(spark, _p(sf_dir, "orders"))), "signal_id")


_SIGNALS = "sg AS (SELECT o_orderkey AS signal_id, o_custkey % 10 AS grp, o_orderdate AS ts, CASE WHEN o_custkey % 2 = 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice / 1000 - 250 END AS profit FROM orders), sl AS (SELECT *, abs(profit) >= 0.01 AND profit < 0 AS lost, abs(profit) >= 0.01 AND profit > 0 AS won FROM sg)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("signal_id"), (F.col("o_custkey") % 10).alias("grp"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_custkey") % 2 == 0, "BULLISH").otherwise("BEARISH").alias("direction"),
        F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice") / 1000 - 250).alias("profit"),
    )


@query(f"WITH {_SIGNALS} SELECT date_trunc('day', ts)::TIMESTAMP AS day, direction, count(*) AS signals, count(*) FILTER (WHERE lost) AS losses FROM sl GROUP BY 1, 2")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_signal_counts(_signals(spark, sf_dir))


@query(
    f"""WITH {_SIGNALS} SELECT signal_id, row_number() OVER w <= 3 AS first_three, coalesce(sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2 AS until_two_losses
    FROM sl WINDOW w AS (PARTITION BY date_trunc('day', ts), direction ORDER BY ts, signal_id)"""
)
def daily_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.daily_limit(_signals(spark, sf_dir), "SIGNALS", 3).withColumnRenamed("allowed", "first_three")
    return R.daily_limit(s, "LOSSES", 2).select("signal_id", "first_three", F.col("allowed").alias("until_two_losses"))


@query(
    f"""WITH {_SIGNALS}, n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, signal_id) AS i FROM sl), x AS (SELECT a.signal_id, a.grp, a.i, (SELECT max(i) FROM n b WHERE b.grp = a.grp AND b.i < a.i AND b.won) AS reset FROM n a)
    SELECT x.signal_id, CAST(least((SELECT count(*) FROM n c WHERE c.grp = x.grp AND c.i < x.i AND c.i > coalesce(x.reset, 0) AND c.lost), 50) AS INTEGER) AS lot_step FROM x"""
)
def lot_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lot_sequence(_signals(spark, sf_dir), ("grp",), ("ts", "signal_id")).select("signal_id", "lot_step")


@query(
    f"""WITH {_LEGS}, a AS (SELECT *, entry_price - 250 AS profit FROM legs WHERE status = 'ACTIVE'), b AS (SELECT *, coalesce(sum(lot_size) OVER (PARTITION BY signal_id ORDER BY profit DESC, level_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM a)
    SELECT signal_id, CAST(level_index AS INTEGER) AS level_index, floor(greatest(0.0, least(lot_size, 0.5 - used)) * 100 + 0.5) / 100 AS close_volume FROM b"""
)
def close_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_legs(spark, _p(sf_dir, "orders")).withColumn("profit", F.col("entry_price") - 250)
    return R.close_by_priority(g, F.lit(0.5)).select("signal_id", "level_index", "close_volume")


@query(
    f"""WITH {_LEGS}, f AS (SELECT signal_id, max(level_index) AS level_index FROM legs WHERE entry_price > 0 AND status NOT IN ('INACTIVE', 'WAITING', 'PENDING') GROUP BY 1),
    e AS (SELECT *, coalesce(sum(CASE WHEN status NOT IN ('COMPLETED', 'INACTIVE') THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY level_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM legs)
    SELECT signal_id, CAST(level_index AS INTEGER) AS level_index, status, {r6('entry_price')} AS entry_price, CAST(n AS BIGINT) AS executed_index FROM f JOIN e USING (signal_id, level_index)"""
)
def latest_filled_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_legs(spark, _p(sf_dir, "orders"))
    n = R.executed_index(g).select("signal_id", "level_index", "executed_index")
    return shown(R.latest_filled_leg(g).join(n, ["signal_id", "level_index"]), "status", "entry_price", "executed_index", keys=("signal_id", "level_index"))


@query(
    f"""WITH {_SIGNALS}, a AS (SELECT grp, sum(profit) AS p, count(*) AS trades, avg(profit) / nullif(stddev_samp(profit), 0) AS sharpe FROM sg GROUP BY 1)
    SELECT grp, trades, floor(greatest(p / 10000, 0.0) * ln(1 + trades) * greatest(coalesce(sharpe, 0.0), 0.0) * 1e4 + 0.5) / 1e4 AS score FROM a"""
)
def run_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_score(_signals(spark, sf_dir), ("grp",), 10000.0).select("grp", "trades", S.round_digits("score", 4).alias("score"))


@query(
    """WITH RECURSIVE i AS (SELECT event_id AS signal_id, event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, ts AS start_ts, ts + to_minutes(CAST(user_id % 90 AS BIGINT)) AS end_ts FROM events),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY start_ts, signal_id) AS k FROM i),
    nx AS MATERIALIZED (SELECT a.symbol, a.direction, a.k, (SELECT min(b.k) FROM n b WHERE b.symbol = a.symbol AND b.direction = a.direction AND b.k > a.k AND b.start_ts >= a.end_ts) AS j FROM n a),
    c AS (SELECT symbol, direction, k FROM n WHERE k = 1 UNION ALL SELECT c.symbol, c.direction, nx.j FROM c JOIN nx ON nx.symbol = c.symbol AND nx.direction = c.direction AND nx.k = c.k WHERE nx.j IS NOT NULL)
    SELECT signal_id, symbol, direction, start_ts FROM c JOIN n USING (symbol, direction, k)"""
)
def single_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = e.select(F.col("event_id").alias("signal_id"), F.col("event_type").alias("symbol"), F.when(F.col("user_id") % 2 == 0, "BULLISH").otherwise("BEARISH").alias("direction"), F.col("ts").alias("start_ts"), (F.col("ts") + F.make_dt_interval(mins=F.col("user_id") % 90)).alias("end_ts"))
    return R.single_running(i).select("signal_id", "symbol", "direction", "start_ts")


# -- gates


@query(
    """SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'manual' WHEN value > 450 THEN 'protection' WHEN hour(ts) < 6 THEN 'session' WHEN user_id % 5 = 0 THEN 'daily_limit' WHEN user_id % 2 = 1 THEN 'direction' WHEN user_id % 3 = 0 THEN 'concurrency' END AS blocked_by FROM events"""
)
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    ok = {"manual_ok": u % 13 != 0, "algo_ok": F.lit(True), "protection_ok": F.col("value") <= 450, "equity_ok": F.lit(True), "session_ok": F.hour("ts") >= 6, "daily_ok": u % 5 != 0, "single_ok": u % 3 != 0, "direction": F.when(u % 2 == 0, "BULLISH").otherwise("BEARISH")}
    return G.attempt_gate(e.withColumns(ok), "BULLISH").select("event_id", "blocked_by")


@query(
    """WITH e AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CASE WHEN user_id % 17 = 0 THEN 'CLOSE_GUARD' ELSE 'ACTIVE' END AS st, user_id % 19 = 0 AS locked, hour(ts) >= 1 AS s_ok, (user_id % 6)::DOUBLE AS spread, value AS price, (user_id % 23)::DOUBLE AS tp, (user_id % 29)::DOUBLE AS nx, (user_id % 50)::DOUBLE / 100 AS vol, value * 3 AS margin FROM events)
    SELECT event_id, CASE WHEN st <> 'ACTIVE' THEN 'market' WHEN locked THEN 'protection' WHEN NOT s_ok THEN 'session' WHEN spread > 4 THEN 'spread' WHEN price <= 0 THEN 'price' WHEN tp < 3 THEN 'tp_distance' WHEN nx < 3 THEN 'next_distance' WHEN vol < 0.02 THEN 'volume' WHEN margin > 1200 THEN 'margin' END AS refused_by FROM e"""
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    rows = e.withColumns({
        "direction": F.when(u % 2 == 0, "BULLISH").otherwise("BEARISH"), "market_status": F.when(u % 17 == 0, "CLOSE_GUARD").otherwise("ACTIVE"), "locked": u % 19 == 0, "session_ok": F.hour("ts") >= 1, "spread_points": (u % 6).cast("double"),
        "price": F.col("value"), "entry_price": F.col("value"), "tp_points": (u % 23).cast("double"), "next_points": (u % 29).cast("double"), "volume": (u % 50) / 100, "min_volume": F.lit(0.02), "margin": F.col("value") * 3, "free_margin": F.lit(1200.0),
    })
    return G.execution_eligibility(rows, 4.0, F.lit(3.0)).select("event_id", "refused_by")


# -- candidates


_SOURCE = "symbol, strategy_id, extremum_ts, is_peak, price"


def _setups_sql() -> str:
    """Up to the table r of each bar's setups, a row for each strategy."""
    macros = {"3h": 3, "4h": 4, "8h": 8}
    ctes = []
    for tf, h in macros.items():
        ctes.append(
            f"""q{h}a AS (SELECT symbol, CAST(date_trunc('day', bar_ts) + to_hours(CAST(floor(hour(bar_ts) / {h}) * {h} AS BIGINT)) AS TIMESTAMP) AS mts, arg_max(close, bar_ts) AS close FROM bars GROUP BY 1, 2),
            q{h}b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mts) - 1 AS i, avg(close) OVER (PARTITION BY symbol ORDER BY mts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS a FROM q{h}a),
            q{h}c AS (SELECT *, CASE WHEN i >= 20 THEN a END AS ma FROM q{h}b),
            q{h} AS (SELECT symbol, mts + to_hours({h}) AS at, ma, lag(ma) OVER (PARTITION BY symbol ORDER BY mts) AS was FROM q{h}c)"""
        )
    pick = lambda c: "CASE strategy_id WHEN 1 THEN q3.{0} WHEN 2 THEN q4.{0} ELSE q8.{0} END".format(c)
    return f"""{SNAPSHOT_SQL}, {', '.join(ctes)},
        x AS (SELECT symbol, bar_ts, bar_idx, is_peak, extremum_ts, extremum_idx, price FROM sized WHERE valid AND slot = 0 AND price > 0),
        bb AS (SELECT *, CASE WHEN bar_idx >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END AS ma, lag(high) OVER (PARTITION BY symbol ORDER BY bar_ts) AS high_1, lag(low) OVER (PARTITION BY symbol ORDER BY bar_ts) AS low_1, max(bar_idx) OVER (PARTITION BY symbol) AS last_idx FROM bars),
        s AS (SELECT x.*, b.high_1, b.low_1, b.high, b.low, b.close, b.last_idx, v.strategy_id, v.label, v.delay, CASE WHEN x.is_peak THEN 'BEARISH' ELSE 'BULLISH' END AS direction, CASE WHEN x.is_peak THEN -1 ELSE 1 END AS sg FROM x JOIN bb b USING (symbol, bar_ts), (VALUES (1, 'S1', 3), (2, 'S2', 5), (3, 'S3', 10)) v(strategy_id, label, delay)),
        e AS (SELECT s.*, c.ma AS bma, d.ma AS bwas, o.low AS elow, o.high AS ehigh, f.ma AS nma, g.ma AS nwas FROM s JOIN bb o ON o.symbol = s.symbol AND o.bar_ts = s.extremum_ts LEFT JOIN bb c ON c.symbol = s.symbol AND c.bar_idx = s.extremum_idx - delay LEFT JOIN bb d ON d.symbol = s.symbol AND d.bar_idx = s.extremum_idx - delay - 1
            LEFT JOIN bb f ON f.symbol = s.symbol AND f.bar_idx = s.bar_idx - delay LEFT JOIN bb g ON g.symbol = s.symbol AND g.bar_idx = s.bar_idx - delay - 1),
        g AS (SELECT e.*, {pick('ma')} AS macro_ma, {pick('was')} AS macro_ma_before FROM e ASOF LEFT JOIN q3 ON e.symbol = q3.symbol AND e.bar_ts >= q3.at ASOF LEFT JOIN q4 ON e.symbol = q4.symbol AND e.bar_ts >= q4.at ASOF LEFT JOIN q8 ON e.symbol = q8.symbol AND e.bar_ts >= q8.at),
        h AS (SELECT *, coalesce((bma - bwas) * sg > 0 AND CASE WHEN is_peak THEN ehigh > bma ELSE elow < bma END, false) AS setup, coalesce((nma - nwas) * sg > 0, false) AS base_ok, coalesce((macro_ma - macro_ma_before) * sg > 0, false) AS macro_ok, CASE WHEN is_peak THEN low_1 ELSE high_1 END AS edge, CASE WHEN is_peak THEN low ELSE high END AS reach FROM g),
        r AS MATERIALIZED (SELECT *, setup AND macro_ok AND coalesce(edge > 0 AND price > 0 AND (edge - price) * sg > 0, false) AS eligible, row_number() OVER (PARTITION BY {_SOURCE} ORDER BY bar_idx) AS n FROM h)"""


def _candidates_sql() -> str:
    key = _SOURCE
    return f"""{_setups_sql()},
        life AS (SELECT {key}, sg, last_idx, n, bar_idx, bar_idx AS seen, CASE WHEN eligible THEN 1 ELSE 0 END AS att, CASE WHEN eligible THEN 'P' ELSE 'I' END AS st, bar_ts AS sig_ts, bar_idx AS sig_idx, edge AS trigger, edge AS anchor, CAST(NULL AS TIMESTAMP) AS entry_ts, CAST(NULL AS BIGINT) AS entry_idx, CAST(NULL AS DOUBLE) AS entry_close,
                CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS TIMESTAMP) AS exit_ts, CAST(NULL AS DOUBLE) AS exit_close FROM r WHERE n = 1
            UNION ALL
            SELECT {key}, sg, last_idx, n, bar_idx, CASE WHEN st IN ('P', 'A') AND gap THEN seen ELSE bar_idx END, att + (st = 'I' AND eligible)::INT,
                CASE st WHEN 'P' THEN CASE WHEN gap OR passed AND NOT (base_ok AND macro_ok) THEN 'I' WHEN passed THEN 'A' ELSE 'P' END WHEN 'A' THEN CASE WHEN gap OR stopped THEN 'I' WHEN reached THEN 'C' ELSE 'A' END WHEN 'I' THEN CASE WHEN eligible THEN 'P' ELSE 'I' END ELSE 'C' END,
                CASE WHEN st = 'I' AND eligible THEN bar_ts ELSE sig_ts END, CASE WHEN st = 'I' AND eligible THEN bar_idx ELSE sig_idx END, CASE WHEN st = 'I' AND eligible THEN edge ELSE trigger END, CASE WHEN st = 'I' AND eligible THEN edge ELSE nearer END,
                CASE WHEN st = 'P' AND passed AND base_ok AND macro_ok AND NOT gap THEN bar_ts WHEN st = 'I' AND eligible THEN NULL ELSE entry_ts END, CASE WHEN st = 'P' AND passed AND base_ok AND macro_ok AND NOT gap THEN bar_idx WHEN st = 'I' AND eligible THEN NULL ELSE entry_idx END, CASE WHEN st = 'P' AND passed AND base_ok AND macro_ok AND NOT gap THEN close WHEN st = 'I' AND eligible THEN NULL ELSE entry_close END,
                CASE WHEN st = 'P' THEN CASE WHEN gap THEN 'EXPIRED' WHEN passed AND NOT base_ok THEN 'BASE_EXPIRED' WHEN passed AND NOT macro_ok THEN 'MACRO_EXPIRED' END WHEN st = 'A' AND NOT gap THEN CASE WHEN stopped THEN 'SL' WHEN reached THEN 'TP' END WHEN st = 'I' AND eligible THEN NULL ELSE outcome END,
                CASE WHEN st = 'A' AND NOT gap AND (stopped OR reached) THEN bar_ts WHEN st = 'I' AND eligible THEN NULL ELSE exit_ts END, CASE WHEN st = 'A' AND NOT gap AND (stopped OR reached) THEN close WHEN st = 'I' AND eligible THEN NULL ELSE exit_close END
            FROM (SELECT *, (close - nearer) * sg > 0 AND (close - edge) * sg > 0 AS passed, (close - price) * sg < 0 AS stopped, (reach - (entry_close + sg * abs(entry_close - price))) * sg >= 0 AS reached
                FROM (SELECT l.symbol, l.strategy_id, l.extremum_ts, l.is_peak, l.price, l.sg, l.last_idx, l.seen, l.att, l.st, l.sig_ts, l.sig_idx, l.trigger, l.entry_ts, l.entry_idx, l.entry_close, l.outcome, l.exit_ts, l.exit_close, r.n, r.bar_idx, r.bar_ts, r.edge, r.close, r.reach, r.eligible, r.base_ok, r.macro_ok, r.bar_idx <> l.bar_idx + 1 AS gap,
                    CASE WHEN l.st = 'P' AND r.bar_idx = l.bar_idx + 1 AND (l.anchor - r.edge) * r.sg > 0.01::DOUBLE AND (r.edge - r.price) * r.sg > 0.01::DOUBLE AND abs(r.edge - r.price) / 0.01::DOUBLE >= 5 - 1e-7 THEN r.edge ELSE l.anchor END AS nearer
                    FROM life l JOIN r ON r.symbol = l.symbol AND r.strategy_id = l.strategy_id AND r.extremum_ts = l.extremum_ts AND r.is_peak = l.is_peak AND r.price = l.price AND r.n = l.n + 1))),
        ended AS (SELECT {key}, sg, last_idx, att, arg_max(struct_pack(seen := seen, st := st, sig_ts := sig_ts, sig_idx := sig_idx, trigger := trigger, anchor := anchor, entry_ts := entry_ts, entry_close := entry_close, outcome := outcome, exit_ts := exit_ts, exit_close := exit_close), n) AS z FROM life WHERE att > 0 GROUP BY ALL),
        candidates AS (SELECT symbol, z.sig_ts AS bar_ts, z.sig_idx AS bar_idx, strategy_id, 'S' || strategy_id AS label, CASE sg WHEN 1 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, sg, is_peak, extremum_ts, price AS stop, att AS attempt, z.trigger AS trigger, z.anchor AS anchor, z.trigger + sg * abs(z.trigger - price) AS target, z.entry_ts AS entry_ts, z.entry_close AS entry_close,
            z.entry_close + sg * abs(z.entry_close - price) AS running_target, z.seen AS seen, CASE WHEN z.st = 'P' THEN CASE WHEN z.seen = last_idx THEN 'PENDING' ELSE 'EXPIRED' END ELSE z.outcome END AS outcome, z.exit_ts AS exit_ts, z.exit_close AS exit_close,
            symbol || '|S' || strategy_id || '|' || CASE sg WHEN 1 THEN 'BULLISH' ELSE 'BEARISH' END || '|slot=0|' || CASE WHEN is_peak THEN 'PEAK' ELSE 'BOTTOM' END || '|time=' || CAST(epoch(extremum_ts) AS BIGINT) || '|price=' || printf('%.2f', price) AS source_key FROM ended)"""


_CANDIDATES = _candidates_sql()


@query(
    f"""WITH RECURSIVE {_CANDIDATES} SELECT symbol, bar_ts, CAST(strategy_id AS INTEGER) AS strategy_id, direction, extremum_ts, {r6('trigger')} AS trigger, {r6('stop')} AS stop, {r6('target')} AS target, source_key, CAST(attempt AS INTEGER) AS attempt FROM candidates"""
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.detect_candidates(stored_bars(spark, sf_dir), T.strategy_config(spark))
    return shown(c, "strategy_id", "direction", "extremum_ts", "trigger", "stop", "target", "source_key", "attempt")


_OUTCOMES = f"""{_CANDIDATES},
    ex AS (SELECT c.source_key, c.attempt, min(b.bar_idx) AS xi FROM candidates c JOIN bars b ON b.symbol = c.symbol AND b.bar_idx > c.seen AND ((b.close - c.stop) * sg < 0 OR (CASE WHEN is_peak THEN b.low ELSE b.high END - running_target) * sg >= 0) WHERE outcome IS NULL GROUP BY 1, 2),
    lab AS (SELECT c.* REPLACE (coalesce(c.exit_ts, b.bar_ts) AS exit_ts, coalesce(c.exit_close, b.close) AS exit_close, coalesce(c.outcome, CASE WHEN b.bar_ts IS NULL THEN 'OPEN' WHEN (b.close - c.stop) * sg < 0 THEN 'SL' ELSE 'TP' END) AS outcome) FROM candidates c LEFT JOIN ex USING (source_key, attempt) LEFT JOIN bars b ON b.symbol = c.symbol AND b.bar_idx = ex.xi),
    outcomes AS (SELECT *, CASE outcome WHEN 'SL' THEN (exit_close - entry_close) * sg WHEN 'TP' THEN (running_target - entry_close) * sg END AS profit FROM lab)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stored_bars(spark, sf_dir)
    return G.label_outcomes(G.detect_candidates(b, T.strategy_config(spark)), b)


@query(f"WITH RECURSIVE {_OUTCOMES} SELECT symbol, bar_ts, CAST(strategy_id AS INTEGER) AS strategy_id, direction, CAST(attempt AS INTEGER) AS attempt, entry_ts, {r6('entry_close')} AS entry_close, exit_ts, {r6('exit_close')} AS exit_close, outcome, {r6('profit')} AS profit FROM outcomes")
def outcomes_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_outcomes(spark, sf_dir), "strategy_id", "direction", "attempt", "entry_ts", "entry_close", "exit_ts", "exit_close", "outcome", "profit")


@query(
    f"""WITH RECURSIVE {_OUTCOMES} SELECT CAST(strategy_id AS INTEGER) AS strategy_id, direction, count(*) AS candidates, count(entry_ts) AS entered, count(*) FILTER (WHERE outcome = 'TP') AS targets, count(*) FILTER (WHERE outcome = 'SL') AS stops,
    count(*) FILTER (WHERE profit >= 0.01) AS wins, floor(coalesce(sum(profit), 0) * 100 + 0.5) / 100 AS profit FROM outcomes GROUP BY 1, 2"""
)
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.outcome_report(_outcomes(spark, sf_dir), "strategy_id", "direction")


@query(
    f"""WITH RECURSIVE {_CANDIDATES}, l AS (SELECT c.*, v.level, greatest(abs(trigger - stop) / 0.01::DOUBLE * pow(1.5::DOUBLE, v.level), 5.0) AS d FROM candidates c, (VALUES (0), (1), (2)) v(level)),
    m AS (SELECT *, least(greatest(100 / d * pow(1.5::DOUBLE, level), 0.01::DOUBLE), 100.0::DOUBLE) AS v FROM l)
    SELECT symbol, bar_ts, CAST(strategy_id AS INTEGER) AS strategy_id, direction, CAST(level AS INTEGER) AS level, {r6('d')} AS distance_points, {r6("CASE WHEN level = 0 THEN trigger ELSE trigger - sg * d * 0.01::DOUBLE END")} AS leg_price, {r6('target')} AS tp,
    {r6('least(greatest(floor(floor(v / 0.01::DOUBLE + 1e-12) * 0.01::DOUBLE * 100 + 0.5) / 100, 0.01::DOUBLE), 100.0::DOUBLE)')} AS lot, 'EX_' || label || CASE sg WHEN 1 THEN '_B_' ELSE '_S_' END || (CAST(epoch(bar_ts) AS BIGINT) % 1000000) || '_L' || level AS comment FROM m"""
)
def execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stored_bars(spark, sf_dir)
    p = G.execution_plan(G.detect_candidates(b, T.strategy_config(spark)), T.symbol_spec(b))
    return shown(p, "strategy_id", "direction", "level", "distance_points", "leg_price", "tp", "lot", "comment")


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT symbol, bar_ts, CAST(strategy_id AS INTEGER) AS strategy_id, direction, {r6('trigger')} AS trigger, {r6('anchor')} AS anchor FROM candidates")
def pending_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each signal's trigger had come to when it entered or ended."""
    return shown(G.detect_candidates(stored_bars(spark, sf_dir), T.strategy_config(spark)), "strategy_id", "direction", "trigger", "anchor")


def _gated_sql(mode: str, limit: int, single: bool, drawdown: float) -> str:
    """The turns of strategies as a recursion over (bar, strategy). A signal's end depends on the bars after its entry alone, so
    that it is looked up for every bar before; the recursion decides what begins and enters."""
    counted = "CASE WHEN sg = 1 THEN nb ELSE ns END" if mode == "SIGNALS" else "len(list_filter(live, lambda e: e.loss AND e.xday = today AND e.sg = sg AND (e.x < i OR e.x = i AND e.s <= sid)))"
    alone = "len(list_filter(cur, lambda e: e.s <> sid AND e.st = 'P' AND e.sg = sg)) = 0 AND len(list_filter(live, lambda e: e.sg = sg AND (e.x > i OR e.x = i AND e.s > sid))) = 0" if single else "true"
    never = 1 << 40
    turn = "struct_pack(s := {0}::BIGINT, k := CAST(NULL AS VARCHAR), sg := 0::BIGINT, st := 'I', att := 0::BIGINT, anchor := 0::DOUBLE, x := 0::BIGINT, loss := false)"
    held = "struct_pack(s := 0::BIGINT, sg := 0::BIGINT, ec := 0::DOUBLE, x := 0::BIGINT, loss := false, xday := DATE '1970-01-01')"
    return f"""WITH RECURSIVE {_setups_sql()},
        ends AS (SELECT r.symbol, r.strategy_id, r.bar_idx, min(b.bar_idx) AS x FROM r JOIN bars b ON b.symbol = r.symbol AND b.bar_idx > r.bar_idx AND ((b.close - r.price) * r.sg < 0 OR (CASE WHEN r.is_peak THEN b.low ELSE b.high END - (r.close + r.sg * abs(r.close - r.price))) * r.sg >= 0) GROUP BY ALL),
        turn AS MATERIALIZED (SELECT r.symbol, r.strategy_id AS sid, r.bar_idx AS i, r.bar_ts, CAST(r.bar_ts AS DATE) AS today, r.sg::BIGINT AS sg, r.direction, r.extremum_ts, r.price, r.edge, r.close, r.eligible, r.base_ok, r.macro_ok, coalesce(ends.x, {never}) AS nx, coalesce((b.close - r.price) * r.sg < 0, false) AS nloss, CAST(b.bar_ts AS DATE) AS nxday, b.bar_ts AS xts,
              CAST(r.extremum_ts AS VARCHAR) || '|' || r.is_peak || '|' || r.price AS k, row_number() OVER (PARTITION BY r.symbol ORDER BY r.bar_idx, r.strategy_id) AS n
              FROM r LEFT JOIN ends USING (symbol, strategy_id, bar_idx) LEFT JOIN bars b ON b.symbol = r.symbol AND b.bar_idx = ends.x),
        turns AS (SELECT DISTINCT symbol, 0::BIGINT AS n, CAST(NULL AS DATE) AS today, 0::BIGINT AS nb, 0::BIGINT AS ns, CAST(NULL AS DATE) AS lock, [{turn.format(1)}, {turn.format(2)}, {turn.format(3)}] AS cur, list_filter([{held}], lambda e: e.s > 0) AS live,
                 CAST(NULL AS VARCHAR) AS gone, 0::BIGINT AS gone_att, CAST(NULL AS VARCHAR) AS event, 0::BIGINT AS att FROM turn
            UNION ALL
            SELECT symbol, n, today, nb + (opens AND sg = 1)::INT, ns + (opens AND sg = -1)::INT,
                CASE WHEN sid = 3 AND coalesce(list_sum(list_transform(list_filter(alive, lambda e: e.x > i), lambda e: (e.ec - close) * e.sg)), 0) >= {drawdown} AND len(list_filter(alive, lambda e: e.x > i)) > 0 THEN today ELSE lock END,
                list_transform(cur, lambda e: CASE WHEN e.s = sid THEN struct_pack(s := e.s, k := k, sg := sg, st := CASE st WHEN 'P' THEN CASE WHEN enters THEN 'A' WHEN passed THEN 'I' ELSE 'P' END WHEN 'A' THEN CASE WHEN i >= c.x THEN CASE WHEN c.loss THEN 'I' ELSE 'C' END ELSE 'A' END WHEN 'I' THEN CASE WHEN opens THEN 'P' ELSE 'I' END ELSE 'C' END,
                    att := att + opens::INT, anchor := CASE WHEN opens THEN edge ELSE nearer END, x := CASE WHEN enters THEN nx ELSE c.x END, loss := CASE WHEN enters THEN nloss ELSE c.loss END) ELSE e END),
                alive, gone, gone_att, CASE WHEN opens THEN 'SIGNAL' WHEN enters THEN 'ENTRY' WHEN passed AND NOT base_ok THEN 'BASE_EXPIRED' WHEN passed THEN 'MACRO_EXPIRED' END, att + opens::INT
            FROM (SELECT *, list_concat(list_filter(live, lambda e: e.x >= i OR e.xday = today), CASE WHEN enters THEN [struct_pack(s := sid, sg := sg, ec := close, x := nx, loss := nloss, xday := nxday)] ELSE [] END) AS alive
                FROM (SELECT *, passed AND base_ok AND macro_ok AS enters, st = 'I' AND eligible AND {counted} < {limit} AND {alone} AND lock IS DISTINCT FROM today AS opens
                    FROM (SELECT *, st = 'P' AND (close - nearer) * sg > 0 AND (close - edge) * sg > 0 AS passed
                        FROM (SELECT *, CASE WHEN st = 'P' AND (c.anchor - edge) * sg > 0.01::DOUBLE AND (edge - price) * sg > 0.01::DOUBLE AND abs(edge - price) / 0.01::DOUBLE >= 5 - 1e-7 THEN edge ELSE c.anchor END AS nearer
                            FROM (SELECT *, CASE WHEN same THEN c.st ELSE 'I' END AS st, CASE WHEN same THEN c.att ELSE 0 END AS att, CASE WHEN NOT same AND c.st = 'P' THEN c.k END AS gone, c.att AS gone_att
                                FROM (SELECT *, coalesce(c.k = k, false) AS same
                                    FROM (SELECT q.*, l.cur, l.live, l.lock, CASE WHEN l.today = q.today THEN l.nb ELSE 0 END AS nb, CASE WHEN l.today = q.today THEN l.ns ELSE 0 END AS ns, l.cur[q.sid] AS c FROM turns l JOIN turn q ON q.symbol = l.symbol AND q.n = l.n + 1)))))))),
        told AS (SELECT symbol, n, event, att, gone, gone_att FROM turns),
        began AS MATERIALIZED (SELECT q.*, f.event, f.att AS attempt FROM told f JOIN turn q USING (symbol, n) WHERE f.event IS NOT NULL),
        left_ AS (SELECT q.symbol, q.sid, f.gone AS k, f.gone_att AS attempt FROM told f JOIN turn q USING (symbol, n) WHERE f.gone IS NOT NULL)
        SELECT a.symbol, a.bar_ts, CAST(a.sid AS INTEGER) AS strategy_id, a.direction, a.extremum_ts, CAST(a.attempt AS INTEGER) AS attempt, {r6('a.edge')} AS trigger, e.bar_ts AS entry_ts,
               coalesce(z.event, CASE WHEN o.k IS NOT NULL THEN 'EXPIRED' WHEN e.symbol IS NULL THEN 'PENDING' WHEN e.nx = {never} THEN 'OPEN' WHEN e.nloss THEN 'SL' ELSE 'TP' END) AS outcome, e.xts AS exit_ts
        FROM began a LEFT JOIN began e ON e.symbol = a.symbol AND e.sid = a.sid AND e.k = a.k AND e.attempt = a.attempt AND e.event = 'ENTRY' LEFT JOIN began z ON z.symbol = a.symbol AND z.sid = a.sid AND z.k = a.k AND z.attempt = a.attempt AND z.event IN ('BASE_EXPIRED', 'MACRO_EXPIRED')
        LEFT JOIN left_ o ON o.symbol = a.symbol AND o.sid = a.sid AND o.k = a.k AND o.attempt = a.attempt WHERE a.event = 'SIGNAL'"""


def _gated(spark: SparkSession, sf_dir: str, gates: live.Gates) -> DataFrame:
    a = live.attempts_of(live.signal_events(bars(spark, sf_dir), live.rules_of(T.strategy_config(spark), gates)))
    return shown(a, "strategy_id", "direction", "extremum_ts", "attempt", "trigger", "entry_ts", "outcome", "exit_ts")


@query(_gated_sql("SIGNALS", 2, True, 150.0))
def candidates_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals a day and direction, one at a time, none on a day after a drawdown of 150."""
    return _gated(spark, sf_dir, live.Gates("SIGNALS", 2, True, 150.0))


@query(_gated_sql("LOSSES", 1, False, 300.0))
def candidates_gated_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None after a stop of the day in its direction, none on a day after a drawdown of 300; any number at a time."""
    return _gated(spark, sf_dir, live.Gates("LOSSES", 1, False, 300.0))


# -- logs

_LOG = "lg AS (SELECT event_id, ts, event_type AS label, user_id % 10 AS state_key, CAST(floor(value / 50) AS INTEGER) AS message FROM events)"


@query(
    f"WITH {_LOG}, l AS (SELECT *, lag(message) OVER w AS was, row_number() OVER w AS n FROM lg WINDOW w AS (PARTITION BY label, state_key ORDER BY ts, event_id)) SELECT event_id, label, state_key, message FROM l WHERE n = 1 OR was IS DISTINCT FROM message"
)
def log_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.changes(T.read_event_log(spark, _p(sf_dir, "events")), ("label", "state_key"), ("ts", "event_id"), "message").select("event_id", "label", "state_key", "message")


@query(
    f"""WITH RECURSIVE {_LOG}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label, state_key ORDER BY ts, event_id) AS i FROM lg),
    nx AS MATERIALIZED (SELECT a.label, a.state_key, a.i, (SELECT min(b.i) FROM n b WHERE b.label = a.label AND b.state_key = a.state_key AND b.ts >= a.ts + INTERVAL 6 HOUR) AS j FROM n a),
    k AS (SELECT label, state_key, 1::BIGINT AS i, 0::BIGINT AS suppressed FROM n WHERE i = 1 UNION ALL SELECT k.label, k.state_key, nx.j, nx.j - k.i - 1 FROM k JOIN nx ON nx.label = k.label AND nx.state_key = k.state_key AND nx.i = k.i WHERE nx.j IS NOT NULL)
    SELECT event_id, label, state_key, message, suppressed FROM k JOIN n USING (label, state_key, i)"""
)
def log_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.log_throttle(T.read_event_log(spark, _p(sf_dir, "events")), 21600).select("event_id", "label", "state_key", "message", "suppressed")


@query(
    f"""WITH {_LOG} SELECT event_id, strftime(ts, '%Y.%m.%d %H:%M:%S') || ' | ' || upper(label) || ' | state=' || state_key || '|level=' || message || '|note=n/a' AS line, strftime(ts, '%Y%m%d') AS day FROM lg"""
)
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_event_log(spark, _p(sf_dir, "events"))
    return K.log_lines(R.event_log(g, state=F.col("state_key"), level=F.col("message"), note=F.lit(None)), "event_id").select("event_id", F.col("value").alias("line"), "day")


@query(
    f"""WITH {_LEGS}, m AS (SELECT *, floor(entry_price * 100 + 0.5) / 100 AS e FROM legs) SELECT signal_id, CAST(level_index AS INTEGER) AS level_index, 'level=' || (level_index + 1) || '|status=' || status || '|entry=' || printf('%.2f', e) || '|lot=' || printf('%.2f', floor(lot_size * 100 + 0.5) / 100) || '|ticket=' || coalesce(CAST(ticket AS VARCHAR), 'n/a') AS resolution FROM m"""
)
def leg_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_legs(spark, _p(sf_dir, "orders"))
    return g.select("signal_id", "level_index", R.leg_resolution(g).alias("resolution"))


@query(
    """WITH h AS (SELECT event_type, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
    SELECT 'symbol' AS section, event_type AS name, 'ticks=' || n || '|first=' || strftime(a, '%Y.%m.%d %H:%M:%S') || '|last=' || strftime(b, '%Y.%m.%d %H:%M:%S') AS value FROM h
    UNION ALL SELECT CASE WHEN id <> 2 THEN 'active strategy' ELSE 'inactive strategy' END, 'S' || id, 'base_delay=' || d || '|macro=' || m || '|macro_delay=1' FROM (VALUES (1, 3, 'H3'), (2, 5, 'H4'), (3, 10, 'H8')) v(id, d, m)
    UNION ALL SELECT 'input', n, x FROM (VALUES ('levels', '3'), ('risk', '100.0')) w(n, x)"""
)
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over the ticks with two of the strategies covers."""
    return R.run_manifest(ticks(spark, sf_dir), T.strategy_config(spark, (1, 3)), levels="3", risk="100.0")


@query(
    """WITH o AS (SELECT event_id, event_type AS symbol, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id, floor(min(value - 5) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 1e6 + 0.5) / 1e6 AS bull_reference, floor(max(value + 5) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 1e6 + 0.5) / 1e6 AS bear_reference FROM o"""
)
def trailing_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adverse-only references of a signal that each symbol and day opens."""
    t = R.trailing_reference(ticks(spark, sf_dir), ("symbol", F.date_trunc("day", "ts")), ("ts", "event_id"), 5)
    return shown(t, "bull_reference", "bear_reference", keys=("event_id",))
