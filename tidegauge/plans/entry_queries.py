"""Queries of entries on structures, execution levels, order triggers, lots, labels, and of what becomes of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import fib as X
from tidegauge.functions import levels as L
from tidegauge.functions import scalars as S
from tidegauge.operators import joins as J
from tidegauge.operators import reports as R
from tidegauge.operators import signals as G
from tidegauge.operators import swings as W
from tidegauge.operators import windows as I
from tidegauge.plans.market_queries import _DEALS, _LEGS, _OUTCOMES, _SESSIONS, _candidates_sql, _outcomes, _p
from tidegauge.plans.registry import bars, bars_sql, query, r6, shown, stored_bars, table, ticks
from tidegauge.plans.structure_queries import SNAPSHOT_SQL
from tidegauge.sources import tables as T
from tidegauge.sources.stored import stored

_AT = (0.0, 23.6, 38.2, 61.8, 78.6, 100.0)
_AT_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _AT) + "]"
# the levels repeat every largest one, and are mirrored below 0
_LADDER_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in sorted({s * (100 * k + x) for k in range(9) for x in _AT for s in (1, -1)})) + "]"


def _up(x: str, n: int) -> str:
    """So many levels up; from below minus the largest level, that one comes first."""
    own = f"list_filter({_LADDER_SQL}, lambda e: e > {x} + 1e-4)[{n}]"
    low = "-100.0::DOUBLE" if n == 1 else f"list_filter({_LADDER_SQL}, lambda e: e > -100 + 1e-4)[{n - 1}]"
    return f"CASE WHEN {x} < -100.0001 THEN {low} ELSE {own} END"


def _down(x: str, n: int) -> str:
    return f"list_reverse(list_filter({_LADDER_SQL}, lambda e: e < {x} - 1e-4))[{n}]"


def _percent(price: str) -> str:
    p = f"CASE WHEN is_bottom THEN floor((peak - {price}) / nullif(peak - bottom, 0) * 100 * 10 + 0.5) / 10 ELSE floor(({price} - bottom) / nullif(peak - bottom, 0) * 100 * 10 + 0.5) / 10 END"
    return f"CASE WHEN ({p}) >= 0 THEN {p} END"


def _price(percent: str) -> str:
    p = f"CASE WHEN is_bottom THEN peak - {percent} / 100 * (peak - bottom) ELSE bottom + {percent} / 100 * (peak - bottom) END"
    return f"CASE WHEN ({p}) > 0 THEN {p} END"


def _strict(v: str, end: str) -> str:
    high = f"list_min(list_filter({_AT_SQL}, lambda f: f >= {v} AND f > 0))"
    inner = high if end == "high" else f"list_max(list_filter({_AT_SQL}, lambda e: e < {high}))"
    return f"CASE WHEN {v} BETWEEN 0 AND 100 THEN {inner} END"


def _plain(v: str, end: str) -> str:
    n, f = ("+ 1", "list_min(list_filter({}, lambda e: e > {}))") if end == "high" else ("+ 0", "list_max(list_filter({}, lambda e: e <= {}))")
    return f"CASE WHEN {v} >= 100 THEN 100 + (floor(({v} - 100) / (100 - 78.6::DOUBLE)) {n}) * (100 - 78.6::DOUBLE) WHEN {v} IS NOT NULL THEN {f.format(_AT_SQL, v)} END"


_ENTRIES = """t AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS peak, o_totalprice / 1250 AS bottom, o_totalprice / 1000 * (0.7::DOUBLE + 0.001::DOUBLE * (o_custkey % 700)) AS price, o_custkey % 2 = 0 AS is_bottom,
    CASE WHEN o_orderkey % 2 = 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CASE WHEN (o_orderkey % 2 = 0) = (o_custkey % 2 = 0) THEN 1 ELSE -1 END AS step FROM orders)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures of orders with an entry price and a direction, which matches the orientation for some of them."""
    p, c = F.col("o_totalprice"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (p / 1000).alias("peak"), (p / 1250).alias("bottom"), (p / 1000 * (0.7 + 0.001 * (c % 700))).alias("price"), (c % 2 == 0).alias("is_bottom"),
        F.when(F.col("o_orderkey") % 2 == 0, "BULLISH").otherwise("BEARISH").alias("direction"),
    )


_S = ("is_bottom", "peak", "bottom")
_CANONICAL = f"""{_ENTRIES}, u AS (SELECT *, {_percent('price')} AS p FROM t), v AS (SELECT *, coalesce({_strict('p', 'low')}, {_plain('p', 'low')}) AS bl, coalesce({_strict('p', 'high')}, {_plain('p', 'high')}) AS bh FROM u),
    c AS (SELECT *, CASE WHEN ({_price('bl')}) IS NOT NULL AND ({_price('bh')}) IS NOT NULL THEN CASE step WHEN 1 THEN bh ELSE bl END ELSE p END AS canonical FROM v)"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).withColumn("canonical", L.canonical_percent("price", "direction", *_S, X.levels(_AT)))


@query(
    f"""WITH {_ENTRIES}, q AS (SELECT *, floor((peak - price) / (peak - bottom) * 100 * 10 + 0.5) / 10 AS bull, floor((price - bottom) / (peak - bottom) * 100 * 10 + 0.5) / 10 AS bear FROM t)
    SELECT id, bull AS bullish, bear AS bearish, coalesce(list_max(list_filter({_AT_SQL}, lambda e: e <= floor(bull * 100 + 0.5) / 100)), 0.0::DOUBLE) AS bullish_level, coalesce(list_max(list_filter({_AT_SQL}, lambda e: e <= floor(bear * 100 + 0.5) / 100)), 0.0::DOUBLE) AS bearish_level FROM q"""
)
def fib_direction_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    out = {f"{d.lower()}{'_level' if at is not None else ''}": L.direction_percent(d, "price", "peak", "bottom", at) for d in ("BULLISH", "BEARISH") for at in (None, X.levels(_AT))}
    return shown(e.withColumns(out), *out, keys=("id",))


@query(f"WITH {_ENTRIES} SELECT id, CAST(step AS INTEGER) AS step, CASE step WHEN 1 THEN 61.8::DOUBLE ELSE 38.2::DOUBLE END AS target, is_bottom = (direction = 'BULLISH') AS matches FROM t")
def directional_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return e.select("id", S.step_direction("direction", "is_bottom").alias("step"), L.directional_target("direction", "is_bottom", F.lit(38.2), F.lit(61.8)).alias("target"), L.orientation_matches("direction", "is_bottom").alias("matches"))


@query(f"WITH {_ENTRIES}, u AS (SELECT *, {_percent('price')} AS p FROM t) SELECT id, p AS percent, {r6(_plain('p', 'low'))} AS low, {r6(_plain('p', 'high'))} AS high FROM u")
def entry_percent_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).withColumn("b", L.entry_band("price", *_S, X.levels(_AT)))
    return shown(e.select("id", "b.*"), "percent", "low", "high", keys=("id",))


@query(
    f"""WITH {_CANONICAL}, g AS (SELECT *, k AS level, CASE step WHEN 1 THEN CASE k WHEN 2 THEN {_up('canonical', 3)} WHEN 1 THEN {_up('canonical', 2)} ELSE {_up('canonical', 1)} END ELSE CASE k WHEN 2 THEN {_down('canonical', 3)} WHEN 1 THEN {_down('canonical', 2)} ELSE {_down('canonical', 1)} END END AS lp FROM c, range(3) r(k))
    SELECT id, CAST(level AS INTEGER) AS level, {r6('canonical')} AS canonical, {r6('lp')} AS percent, {r6(_price('lp'))} AS price FROM g"""
)
def level_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _canonical(spark, sf_dir)
    grid = L.level_grid("canonical", "direction", *_S, _AT, 3)
    return shown(c.select("id", "canonical", F.inline(grid)), "level", "canonical", "percent", "price", keys=("id",))


def _steps_sql(points: float) -> str:
    """The first of 16 steps that is far enough."""
    at = lambda k: f"CASE step WHEN 1 THEN {_up('canonical', k)} ELSE {_down('canonical', k)} END"
    union = " UNION ALL ".join(f"SELECT id, {k} AS steps, abs(price - ({_price(f'({at(k)})')})) / 0.01::DOUBLE AS d FROM c" for k in range(1, 17))
    return f"(SELECT id, min(steps) AS steps, arg_min(d, steps) AS d FROM ({union}) WHERE d >= {points} GROUP BY id)"


@query(
    f"""WITH {_CANONICAL}, n AS (SELECT id, price, canonical, abs(price - ({_price(f"(CASE step WHEN 1 THEN {_up('canonical', 1)} ELSE {_down('canonical', 1)} END)")})) / 0.01::DOUBLE AS d FROM c), z AS {_steps_sql(900.0)}
    SELECT c.id, {r6('CASE WHEN n.d IS NOT NULL THEN greatest(n.d, 5.0) END')} AS first_points, CAST(z.steps AS INTEGER) AS zone_steps, {r6('CASE WHEN z.d IS NOT NULL THEN greatest(z.d, 5.0) END')} AS zone_points, 40.0::DOUBLE AS fixed_points FROM c JOIN n USING (id) LEFT JOIN z USING (id)"""
)
def base_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of the first level, of the first one that is 900 points away, and a fixed range."""
    c = _canonical(spark, sf_dir)
    least = F.lit(5.0)
    own = lambda points: L.base_distance("price", "canonical", "direction", *_S, _AT, 0.01, least, 0.01, points)
    c = c.withColumns({"n": own(0.0), "z": own(900.0)})
    out = {"first_points": G.range_distance("STRUCTURE", 0, least, 0.01, 0.01, structure=F.col("n.points")), "zone_steps": F.col("z.steps"), "zone_points": F.col("z.points"), "fixed_points": G.range_distance("POINTS", 40, least, 0.01, 0.01)}
    return shown(c.withColumns(out), *out, keys=("id",))


@query(
    f"""WITH {bars_sql()}, tr AS (SELECT *, CASE WHEN bar_idx > 0 THEN greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) ELSE 0.0 END AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
    a AS (SELECT *, CASE WHEN bar_idx >= 5 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS atr FROM tr), l AS (SELECT symbol, bar_ts, lag(atr) OVER (PARTITION BY symbol ORDER BY bar_ts) AS was FROM a)
    SELECT symbol, bar_ts, {r6('CASE WHEN was > 0 THEN greatest(was / 0.01::DOUBLE, 5.0) END')} AS points FROM l"""
)
def range_distance_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.with_true_range(bars(spark, sf_dir)).withColumn("atr", I.atr(5)).withColumn("was", I.lag("atr"))
    return shown(b.withColumn("points", G.range_distance("ATR", 0, F.lit(5.0), 0.01, 0.01, F.col("was"))), "points")


@query(
    f"""WITH {SNAPSHOT_SQL}, z AS (SELECT a.symbol, a.bar_ts, a.bar_idx, NOT b.is_peak AS is_bottom, CASE WHEN b.is_peak THEN b.price ELSE a.price END AS peak, CASE WHEN b.is_peak THEN a.price ELSE b.price END AS bottom FROM sized a JOIN sized b ON b.symbol = a.symbol AND b.bar_idx = a.bar_idx
        WHERE a.valid AND a.slot = 1 AND b.slot = 2 AND a.is_peak <> b.is_peak AND a.price > 0 AND b.price > 0 AND a.price <> b.price),
    d AS (SELECT z.*, s.close, s.low AS lo, s.high AS hi, w.d AS direction FROM z JOIN stoch s ON s.symbol = z.symbol AND s.bar_idx = z.bar_idx, (VALUES ('BULLISH'), ('BEARISH')) w(d)),
    p AS (SELECT *, {_percent('close')} AS cp, {_percent("CASE direction WHEN 'BULLISH' THEN lo ELSE hi END")} AS xp FROM d), q AS (SELECT *, coalesce(xp, cp) AS ep FROM p),
    b AS (SELECT *, CASE WHEN cp BETWEEN 0 AND 100 THEN {_strict('cp', 'low')} ELSE {_strict('ep', 'low')} END AS bl, CASE WHEN cp BETWEEN 0 AND 100 THEN {_strict('cp', 'high')} ELSE {_strict('ep', 'high')} END AS bh FROM q),
    e AS (SELECT *, ({_price('bl')}) AS pl, ({_price('bh')}) AS ph FROM b),
    f AS (SELECT *, is_bottom = (direction = 'BULLISH') AND cp IS NOT NULL AND bl IS NOT NULL AND coalesce(abs(pl - ph) / 0.01::DOUBLE >= 20, true) AS base, bh > 100 - 1e-4 AS terminal, CASE WHEN pl IS NOT NULL AND ph IS NOT NULL THEN ph END AS target FROM e),
    g AS (SELECT *, coalesce(base AND CASE direction WHEN 'BULLISH' THEN target <= close ELSE target >= close END, false) AS in_zone, coalesce(base AND NOT terminal AND CASE direction WHEN 'BULLISH' THEN target <= close ELSE target >= close END, false) AS guarded, coalesce(base, false) AS market FROM f)
    SELECT symbol, bar_ts, direction, in_zone, CASE WHEN in_zone THEN bh END AS percent, {r6('CASE WHEN in_zone THEN target END')} AS price, guarded, market FROM g"""
)
def structure_zone_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each bar enters its structure's zone, with a limit, with the guard of the last band too, and at the market."""
    b = stored_bars(spark, sf_dir)
    s = W.structure_snapshot(b).where("valid").withColumn("r", L.structure_range("slots")).where("r IS NOT NULL").select("symbol", "tf", "bar_idx", "r.*")
    rows = s.join(b.select("symbol", "tf", "bar_idx", "bar_ts", "close", "low", "high"), ["symbol", "tf", "bar_idx"]).withColumn("direction", F.explode(F.array(F.lit("BULLISH"), F.lit("BEARISH"))))
    own = lambda df, out, **how: L.with_zone_entry(df, out, _AT, F.lit(20.0), 0.01, **how)
    rows = own(own(own(rows, "z"), "g", guard=True), "m", limit=False)
    return shown(rows.select("symbol", "bar_ts", "direction", "z.*", F.col("g.in_zone").alias("guarded"), F.col("m.in_zone").alias("market")), "direction", "in_zone", "percent", "price", "guarded", "market")


# -- triggers, lots, labels

_ORDERS = """o AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'NONE' END AS direction, o_totalprice / 1000 AS price, (o_custkey % 400)::DOUBLE AS trigger, o_custkey % 9 - 1 AS k FROM orders)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("id"), F.when(c % 3 == 0, "BULLISH").when(c % 3 == 1, "BEARISH").otherwise("NONE").alias("direction"), (F.col("o_totalprice") / 1000).alias("price"), (c % 400).cast("double").alias("trigger"), (c % 9 - 1).alias("k"))


@query(
    f"""WITH {_ORDERS}, s AS (SELECT *, CASE direction WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END AS sg FROM o)
    SELECT id, trigger > 0 AND sg <> 0 AND (trigger - price) * sg >= 0 AS reached, trigger > 0 AND sg <> 0 AND (trigger - price) * sg < 0 AS opposite, trigger > 0 AND sg <> 0 AND (price - trigger) * sg >= 0 AS breakout,
    trigger > 0 AND price > 0 AND abs(price - trigger) / 0.01::DOUBLE + 1e-9 >= 2500 AS gap, k >= 0 AND k + 1 >= 4 AS capped, (price - trigger) * sg >= 0 AS slope, k = 2 AS signals, k <> 3 AS actions FROM s"""
)
def order_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    status = F.when(F.col("k") == 2, "ACTIVE").when(F.col("k") == 3, "BROKER_DISABLED").otherwise("CLOSE_GUARD")
    args = ("direction", "price", "trigger")
    return o.select(
        "id", S.limit_reached(*args).alias("reached"), S.limit_opposite(*args).alias("opposite"), S.breakout_entry(*args).alias("breakout"), S.meaningful_gap("price", "trigger", 0.01, F.lit(2500.0)).alias("gap"), S.level_cap("k", 4).alias("capped"),
        G.directional_slope("direction", F.col("price"), F.col("trigger")).alias("slope"), S.market_status_allows(status).alias("signals"), S.market_status_allows(status, "BROKER").alias("actions"),
    )


def _whole(v: str, up: bool = False) -> str:
    """Lots in whole steps."""
    inside = f"least(greatest({v}, 0.01::DOUBLE), 100.0::DOUBLE)"
    steps = f"ceil({inside} / 0.01::DOUBLE - 1e-12)" if up else f"floor({inside} / 0.01::DOUBLE + 1e-12)"
    return f"least(greatest(floor({steps} * 0.01::DOUBLE * 100 + 0.5) / 100, 0.01::DOUBLE), 100.0::DOUBLE)"


@query(
    f"""WITH {_ORDERS}, a AS (SELECT *, 2.0::DOUBLE AS pv, 5000 * (k::DOUBLE) / 100 * 80 / 100 AS target FROM o), b AS (SELECT *, CASE WHEN target > 0 AND trigger > 0 THEN {_whole('target / (pv * trigger)')} ELSE 0.0 END AS lots FROM a),
    c AS (SELECT *, CASE WHEN target > 0 AND trigger * 0.8::DOUBLE > 0 THEN {_whole(f"CASE WHEN {_whole('target / (pv * (trigger * 0.8::DOUBLE))')} > 0 THEN {_whole('target / (pv * (trigger * 0.8::DOUBLE))')} ELSE 0.3::DOUBLE END", True)} ELSE {_whole('0.3::DOUBLE')} END AS base FROM b)
    SELECT id, {r6('target')} AS target, {r6('lots')} AS lots, {r6('CASE WHEN lots > 0 AND trigger > 0 THEN lots * pv * trigger ELSE 0.0 END')} AS amount, {r6('base')} AS base, {r6(f"CASE WHEN k > 0 THEN {_whole('base * pow(1.5::DOUBLE, k)')} ELSE base END")} AS scaled,
    {r6("pv * (price - trigger) * CASE direction WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END / 0.01::DOUBLE")} AS raw, {r6("coalesce(CASE WHEN k > 0 THEN k::DOUBLE END, CASE WHEN price > 0 THEN price END, 0.0) * 5 / 100")} AS threshold FROM c"""
)
def lot_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high, step = F.lit(0.01), F.lit(100.0), F.lit(0.01)
    value = S.point_value(F.lit(2.0), F.lit(0.01), F.lit(0.01))
    o = _orders(spark, sf_dir).withColumn("target", S.target_profit("PERCENT", 1.0, F.lit(0.0), 5000 * F.col("k").cast("double"), 80.0))
    o = o.withColumn("lots", S.amount_to_lots("target", "trigger", value, low, high, step)).withColumn("base", S.base_lot("ACCOUNT", 0.3, "trigger", F.col("target"), value, low, high, step, 80.0))
    o = o.withColumns({"amount": S.lots_to_amount("lots", "trigger", value), "scaled": S.scaled_lot("base", 1.5, "k", low, high, step), "raw": S.raw_profit("direction", "trigger", "price", value, F.lit(0.01)), "threshold": S.drawdown_threshold("ACCOUNT", 5.0, F.col("k").cast("double"), F.col("price"))})
    return shown(o, "target", "lots", "amount", "base", "scaled", "raw", "threshold", keys=("id",))


@query(
    f"""SELECT event_id, {r6("CASE WHEN user_id % 2 = 0 THEN value + 0.02::DOUBLE ELSE value END")} AS entry_side, {r6("CASE WHEN user_id % 2 = 0 THEN value ELSE value + 0.02::DOUBLE END")} AS exit_side, {r6('(250 - value) / 0.01::DOUBLE')} AS points,
    CASE WHEN value > 250 THEN 'POSITIVE' WHEN value < 250 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sign, CASE WHEN user_id % 3 - 1 > 0 THEN (user_id % 3 - 1)::DOUBLE ELSE 0.0001::DOUBLE END AS point, {r6('CASE WHEN (user_id % 2) * value > 0 THEN (user_id % 2) * value ELSE 7.0 END')} AS reference,
    CASE WHEN user_id % 4 = 0 THEN ts ELSE date_trunc('day', ts) END AS structure, printf('%.2f', CASE WHEN abs(value - 250) < 0.005 THEN 0.0 ELSE floor((value - 250) * 100 + 0.5) / 100 END) AS text FROM events"""
)
def tick_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    t = ticks(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), "user_id"), F.col("event_id") == F.col("e")).withColumn("direction", F.when(u % 2 == 0, "BULLISH").otherwise("BEARISH"))
    out = {
        "entry_side": S.side_price("direction", True), "exit_side": S.side_price("direction", False), "points": S.points_between("price", F.lit(250.0), F.lit(0.01)), "sign": S.profit_sign_class(F.col("price") - 250),
        "point": S.point_or_default((u % 3 - 1).cast("double")), "reference": S.reference_price(u % 2 * F.col("price"), F.lit(7.0)), "structure": S.structure_time(F.when(u % 4 == 0, F.col("ts")), F.date_trunc("day", "ts").cast("timestamp_ntz")),
        "text": S.format2(F.col("price") - 250),
    }
    return shown(t.withColumns(out), *out, keys=("event_id",))


@query(
    """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CASE WHEN user_id % 2 = 0 THEN 'BULLISH' ELSE 'BEARISH' END AS d, user_id % 5 AS k FROM events)
    SELECT event_id, 'S1_' || CASE d WHEN 'BULLISH' THEN 'B' ELSE 'S' END || '_' || sec || '_' || (sec - 60) AS sequence, CASE k WHEN 0 THEN 'seq' WHEN 1 THEN strftime(ts, '%Y%m%d_%H%M%S') WHEN 2 THEN replace(printf('%.2f', value), '.', '') ELSE 'EXEC_' || CASE d WHEN 'BULLISH' THEN 1 ELSE 2 END END AS identifier,
    d || ' TP' AS label, printf('Entry %.1f%%', 61.8::DOUBLE) AS entry_label, printf('Next %.1f%% L%d lot=%.2f', 78.6::DOUBLE, CAST(greatest(k - 1, 0) + 1 AS INTEGER), 0.25::DOUBLE) AS next_label, CASE WHEN k - 2 >= 0 THEN k - 2 ELSE 0 END AS epoch, CASE WHEN k BETWEEN 1 AND 3 THEN k ELSE 2 END AS enum,
    CASE k WHEN 0 THEN 'EQ' WHEN 1 THEN 'HH' WHEN 2 THEN 'HL' WHEN 3 THEN 'LH' ELSE 'LL' END AS swing, CASE WHEN k <= 2 THEN ['NO_SIGNAL', 'BULLISH', 'BEARISH'][CAST(k AS INTEGER) + 1] ELSE 'SIG(' || k || ')' END AS signal,
    CASE WHEN k * 30 - 60 > 0 THEN '+' || (k * 30 - 60) || 'm' ELSE (k * 30 - 60) || 'm' END AS shift, CASE WHEN hour(ts) < 8 THEN 'Asia' WHEN hour(ts) < 12 THEN 'London' ELSE 'OUTSIDE' END AS session, 'MANUAL (+60m)' AS dst, CASE k WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS fibo FROM e"""
)
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("user_id") % 5
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = e.withColumn("direction", F.when(F.col("user_id") % 2 == 0, "BULLISH").otherwise("BEARISH"))
    return e.select(
        "event_id", S.sequence_id(F.lit("S1"), F.col("direction"), sec, sec - 60).alias("sequence"),
        S.signal_identifier(F.when(k == 0, "seq").otherwise(""), F.when(k == 1, F.col("ts")), F.when(k == 2, F.col("value")), "direction", zero=True).alias("identifier"),
        S.signal_label("direction", "TP").alias("label"), S.fib_entry_label(F.lit("Entry"), F.lit(61.8)).alias("entry_label"), S.fib_next_label(F.lit("Next"), F.lit(78.6), (k - 1).cast("int"), F.lit(0.25)).alias("next_label"),
        S.safe_epoch(k - 2).alias("epoch"), S.safe_enum(k, 1, 3, 2).alias("enum"), S.enum_label("swing", k).alias("swing"), S.enum_label("signal", k).alias("signal"), S.offset_text(k * 30 - 60).alias("shift"),
        S.session_label(Asia=F.hour("ts") < 8, London=F.hour("ts") < 12).alias("session"), S.dst_summary("MANUAL", "ts", 60).alias("dst"), S.safe_fibo(F.when(k == 0, -1.0).when(k == 1, 100.0).otherwise(6000.0)).alias("fibo"),
    )


# -- what becomes of signals

_ALL_OUTCOMES = f"WITH RECURSIVE {_OUTCOMES}"


@query(f"{_ALL_OUTCOMES} SELECT source_key, count(*) AS attempts, min(bar_ts) AS first_ts, count(*) FILTER (WHERE outcome = 'TP') > 0 AS consumed, min(CASE WHEN outcome = 'TP' THEN exit_ts END) AS consumed_ts FROM outcomes GROUP BY 1")
def source_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_attempts(_outcomes(spark, sf_dir).withColumnsRenamed({"bar_ts": "signal_ts", "exit_ts": "close_ts"}))


_ELIGIBLE = f"WITH RECURSIVE {_candidates_sql()}, w AS (SELECT *, symbol || '|S' || strategy_id || '|' || direction || '|slot=0|' || CASE WHEN is_peak THEN 'PEAK' ELSE 'BOTTOM' END || '|time=' || CAST(epoch(extremum_ts) AS BIGINT) || '|price=' || printf('%.2f', price) AS key FROM r WHERE eligible)"


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars at which a signal could start."""
    c = G.setups(stored_bars(spark, sf_dir), T.strategy_config(spark)).where("eligible")
    key = S.source_key(F.col("label"), F.col("direction"), F.col("slot"), F.col("is_peak"), F.unix_seconds(F.col("extremum_ts").cast("timestamp")), F.col("price"))
    return stored(c.withColumn("source_key", F.concat_ws("|", "symbol", key)), "eligible")


@query(f"{_ELIGIBLE}, u AS (SELECT *, max(extremum_ts) OVER (PARTITION BY symbol, strategy_id, direction ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM w) SELECT symbol, bar_ts, CAST(strategy_id AS INTEGER) AS strategy_id, direction, extremum_ts FROM u WHERE used IS NULL OR extremum_ts > used")
def fresh_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fresh_structure(_eligible(spark, sf_dir)).select("symbol", "bar_ts", "strategy_id", "direction", "extremum_ts")


@query(
    f"{_ELIGIBLE}, gone AS (SELECT key, min(bar_ts) + INTERVAL 3 HOUR AS consumed_ts FROM w WHERE strategy_id <> 2 GROUP BY 1) SELECT symbol, bar_ts, CAST(strategy_id AS INTEGER) AS strategy_id, key AS source_key FROM w WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.key = w.key AND gone.consumed_ts < w.bar_ts)"
)
def exclude_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars at which a signal could start, were the sources of two strategies consumed three hours after their first one."""
    c = _eligible(spark, sf_dir)
    gone = c.where("strategy_id <> 2").groupBy("source_key").agg((F.min("bar_ts") + F.make_dt_interval(hours=F.lit(3))).alias("consumed_ts"))
    return J.exclude_consumed(c, gone, "bar_ts").select("symbol", "bar_ts", "strategy_id", "source_key")


_IDENTITY = "symbol, strategy_id, direction, extremum_ts, is_peak"


@query(
    f"{_ELIGIBLE}, n AS (SELECT DISTINCT {_IDENTITY}, price + CASE WHEN strategy_id = 1 THEN 0.01::DOUBLE ELSE 0.05::DOUBLE END AS price FROM w WHERE hour(extremum_ts) % 2 = 0) SELECT symbol, bar_ts, CAST(strategy_id AS INTEGER) AS strategy_id, direction FROM w WHERE EXISTS (SELECT 1 FROM n WHERE n.symbol = w.symbol AND n.strategy_id = w.strategy_id AND n.direction = w.direction AND n.extremum_ts = w.extremum_ts AND n.is_peak = w.is_peak AND abs(n.price - w.price) <= 0.01 + 1e-9)"
)
def same_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose source has a running signal within a point of its price."""
    c = _eligible(spark, sf_dir)
    live = c.where(F.hour("extremum_ts") % 2 == 0).withColumn("price", F.col("price") + F.when(F.col("strategy_id") == 1, 0.01).otherwise(0.05)).select("symbol", "strategy_id", "direction", "slot", "extremum_ts", "is_peak", "price").distinct()
    return J.same_identity(c, live, 0.01).select("symbol", "bar_ts", "strategy_id", "direction")


@query(
    f"{_ELIGIBLE}, f AS (SELECT DISTINCT symbol, bar_ts, bar_idx, extremum_ts, is_peak, price FROM h), p AS (SELECT *, lag(extremum_ts) OVER o IS NOT DISTINCT FROM extremum_ts AND lag(is_peak) OVER o IS NOT DISTINCT FROM is_peak AND lag(price) OVER o IS NOT DISTINCT FROM price AS same FROM f WINDOW o AS (PARTITION BY symbol ORDER BY bar_ts)), "
    "c AS (SELECT symbol, bar_ts FROM p WHERE NOT same) SELECT w.symbol, w.bar_ts, CAST(w.strategy_id AS INTEGER) AS strategy_id, CASE WHEN w.strategy_id <> 3 THEN (SELECT min(c.bar_ts) FROM c WHERE c.symbol = w.symbol AND c.bar_ts > w.bar_ts) END AS valid_until FROM w"
)
def expire_on_new_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each bar's signal could wait, were those of one strategy exposed."""
    c = _eligible(spark, sf_dir).withColumn("exposed", F.col("strategy_id") == 3)
    return G.expire_on_new_source(c, W.current_extremum(W.structure_snapshot(bars(spark, sf_dir)))).select("symbol", "bar_ts", "strategy_id", "valid_until")


@query(
    f"""WITH {_DEALS.replace('AS account', 'AS account, l_orderkey * 100 + l_linenumber AS deal_id')}, p AS (SELECT o_orderkey AS ticket, o_custkey % 4 AS magic, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS opened_ts FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 97 = 0)
    SELECT deal_id, p.ticket AS position_id, opened_ts FROM deals d JOIN p ON p.magic = d.magic AND opened_ts <= deal_time AND opened_ts > deal_time - INTERVAL 24 HOUR"""
)
def deal_to_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 97 == 0))
    p = o.select(F.col("o_orderkey").alias("ticket"), (F.col("o_custkey") % 4).alias("magic"), (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey") % 24)).alias("opened_ts"))
    return J.deal_to_position(T.read_deals(spark, _p(sf_dir, "lineitem")), p).select("deal_id", "position_id", "opened_ts")


_CLOSES = "closes AS (SELECT signal_id, level_index, lot_size / (1 + level_index % 2) AS volume, CASE WHEN signal_id % 6 = 0 THEN 0 ELSE 255 END::DOUBLE AS close_price FROM legs WHERE status = 'COMPLETED')"


@query(
    f"""WITH {_LEGS}, {_CLOSES}, r AS (SELECT signal_id, sum(volume * 2.0::DOUBLE * ((close_price - entry_price) * CASE direction WHEN 'BULLISH' THEN 1 ELSE -1 END / 0.01::DOUBLE)) AS p, sum(volume) AS v FROM closes JOIN legs USING (signal_id, level_index) WHERE volume > 0 AND close_price > 0 AND entry_price > 0 GROUP BY 1)
    SELECT l.signal_id, floor(any_value(r.p) * 1e6 + 0.5) / 1e6 AS realized_profit, floor(any_value(r.v) * 1e4 + 0.5) / 1e4 AS closed_volume, bool_or(ticket IS NOT NULL OR status = 'ACTIVE' OR entry_price > 0) OR coalesce(any_value(r.v) > 0, false) AS has_confirmed_outcome, bool_or(status = 'ACTIVE') AS any_active FROM legs l LEFT JOIN r USING (signal_id) GROUP BY 1"""
)
def realized_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.read_legs(spark, _p(sf_dir, "orders"))
    closes = g.where("status = 'COMPLETED'").select("signal_id", "level_index", (F.col("lot_size") / (1 + F.col("level_index") % 2)).alias("volume"), F.when(F.col("signal_id") % 6 == 0, 0.0).otherwise(255.0).alias("close_price"))
    r = R.realized_profit(closes, g, 2.0, 0.01)
    flags = R.outcome_flags(g, r)
    return flags.join(r, "signal_id", "left").select("signal_id", S.round6("realized_profit").alias("realized_profit"), S.round_digits("closed_volume", 4).alias("closed_volume"), "has_confirmed_outcome", "any_active")


@query(
    f"""WITH {_SESSIONS}, t AS (SELECT event_id, dayofweek(ts) AS dow, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS sec FROM events)
    SELECT event_id, CAST(session AS INTEGER) AS session, sec >= (b - 1) // 900 * 900 AND sec < b AS guarded FROM t JOIN s USING (dow) WHERE sec > a AND sec < b"""
)
def close_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks inside a session, and whether they are in its last quarter of an hour."""
    t = ticks(spark, sf_dir)
    inside = J.session_join(t, T.trade_sessions(t), guard_seconds=0)
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return inside.select("event_id", "session", G.close_guard(second, F.col("to_sec"), 900).alias("guarded"))


_RESULTS = "(SELECT o_custkey AS id, count(*) % 7 AS finish_level, sum(o_totalprice) AS expectations, min(o_orderdate) AS entry_time FROM orders GROUP BY 1)"


@query(f"SELECT id, row_number() OVER (ORDER BY finish_level, id) AS by_level, row_number() OVER (ORDER BY expectations DESC, id) AS by_expectations FROM {_RESULTS}")
def sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' places in two orders of their results: sorted by ranges over all tasks, and numbered by the tasks' counts.

    A customer's prices add up in the order of their keys, row by row, so that equal customers have equal sums to the last digit
    however the rows lie in files and tasks."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum("o_totalprice").over(w).alias("total"))
    o = o.groupBy(F.col("o_custkey").alias("id")).agg((F.count(F.lit(1)) % 7).alias("finish_level"), F.max_by("total", "o_orderkey").alias("expectations"))
    o = stored(o, "results")
    a, b = (R.numbered(R.sort_by(o, field, None, "id"), name).select("id", name) for field, name in (("finish_level", "by_level"), ("expectations", "by_expectations")))
    return a.join(b, "id")


_SPREAD = "SELECT event_id, ts, event_type AS symbol, value AS bid, value + (event_id % 6) / 100::DOUBLE AS ask FROM events"


@query(f"SELECT event_id, symbol, {r6('abs(ask - bid) * 100')} AS points FROM ({_SPREAD}) WHERE abs(ask - bid) * 100 <= 3 + 1e-6")
def spread_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("ask", F.col("bid") + (F.col("event_id") % 6) / F.lit(100.0))
    return shown(G.spread_guard(t, 3.0).withColumn("points", S.spread_points(2)), "points", keys=("event_id", "symbol"))


@query(
    f"""WITH {_ENTRIES}, o AS (SELECT t.*, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN is_bottom THEN 'BOTTOM' ELSE 'PEAK' END AS orientation FROM t JOIN orders ON o_orderkey = id WHERE is_bottom <> (direction = 'BULLISH'))
    SELECT id, 'BASE|' || direction || '|' || orientation || '|' || CAST(epoch(ts) AS BIGINT) AS state_key, 'reason=STRUCTURE_DIRECTION_MISMATCH|context=BASE|trigger=LIMIT|dir=' || direction || '|orientation=' || orientation || '|current_is_bottom=' || is_bottom
        || '|peak=' || printf('%.5f', floor(peak * 1e5 + 0.5) / 1e5) || '|bottom=' || printf('%.5f', floor(bottom * 1e5 + 0.5) / 1e5) || '|close=' || printf('%.5f', floor(price * 1e5 + 0.5) / 1e5) || '|structure_ts=' || strftime(ts, '%Y.%m.%d %H:%M:%S') AS message FROM o"""
)
def direction_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("__id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    e = _entries(spark, sf_dir)
    return G.direction_rejects(e.join(at, F.col("id") == F.col("__id"))).select("id", "state_key", "message")


_NEXT = """n0 AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS p, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS sg, CASE WHEN o_custkey % 7 = 0 THEN 0::DOUBLE ELSE o_totalprice / 1000 END AS anchor, (o_custkey % 40)::DOUBLE AS level, (o_orderkey % 3 * 4)::DOUBLE AS protective, (o_orderkey % 5 * 3)::DOUBLE AS broker,
        CASE WHEN o_custkey % 11 = 0 THEN 0::DOUBLE ELSE o_totalprice / 1000 + 0.3::DOUBLE END AS ask, CASE WHEN o_custkey % 13 = 0 THEN 0::DOUBLE ELSE o_totalprice / 1000 - 0.3::DOUBLE END AS bid, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 1000 ELSE 0::DOUBLE END AS prev FROM orders),
    n1 AS (SELECT *, CASE WHEN CASE sg WHEN 1 THEN ask ELSE bid END > 0 THEN CASE sg WHEN 1 THEN ask ELSE bid END ELSE CASE sg WHEN 1 THEN bid ELSE ask END END AS side, CASE WHEN anchor > 0 AND level > 0 THEN anchor + sg * level * 0.05::DOUBLE ELSE 0 END AS a FROM n0),
    n2 AS (SELECT *, side > 0 AND protective > 0 AND (a <= 0 OR (side + sg * protective * 0.05::DOUBLE - a) * sg > 0) AS h1 FROM n1), n3 AS (SELECT *, CASE WHEN h1 THEN side + sg * protective * 0.05::DOUBLE ELSE a END AS b FROM n2),
    n4 AS (SELECT *, side > 0 AND broker > 0 AND (b <= 0 OR (side + sg * broker * 0.05::DOUBLE - b) * sg > 0) AS h2 FROM n3), n5 AS (SELECT *, CASE WHEN h2 THEN side + sg * broker * 0.05::DOUBLE ELSE b END AS c FROM n4),
    n6 AS (SELECT *, c <= 0 AND side > 0 AS h3, CASE WHEN c <= 0 AND side > 0 THEN side + sg * 0.05::DOUBLE WHEN c <= 0 THEN a ELSE c END AS d FROM n5), n7 AS (SELECT *, CASE sg WHEN 1 THEN ceil(d / 0.05::DOUBLE - 1e-9) ELSE floor(d / 0.05::DOUBLE + 1e-9) END * 0.05::DOUBLE AS w FROM n6),
    n8 AS (SELECT *, d > 0 AND abs(w - d) > 1e-9 AS h4, CASE WHEN d > 0 AND abs(w - d) > 1e-9 THEN w ELSE d END AS e FROM n7), n9 AS (SELECT *, prev > 0 AND e > 0 AND (e - prev) * sg > 0 AS h5 FROM n8), n AS (SELECT *, CASE WHEN h5 THEN prev ELSE e END AS f FROM n9)"""


@query(
    f"""WITH {_NEXT} SELECT id, {r6('f')} AS price, CASE WHEN f <= 0 THEN '-' WHEN h5 THEN 'monotonic' WHEN h4 THEN 'clamped' WHEN h3 THEN 'side_fallback' WHEN h1 OR h2 THEN 'clamped' ELSE 'baseline' END AS source,
    concat_ws(';', CASE WHEN h1 THEN 'protective' END, CASE WHEN h2 THEN 'broker_stops' END, CASE WHEN h3 THEN 'fallback_side' END, CASE WHEN h4 THEN 'tick_round' END, CASE WHEN h5 AND (e - prev) * sg > 0.05::DOUBLE + 1e-9 THEN 'monotonic' END) AS reasons FROM n"""
)
def resolve_next_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders some of which lack an anchor, a side's price, or both, so that every source of a price occurs."""
    c, p = F.col("o_custkey"), F.col("o_totalprice") / 1000
    unless = lambda n, x: F.when(c % n == 0, 0.0).otherwise(x)
    double = lambda x: x.cast("double")
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id").withColumn("direction", F.when(c % 2 == 0, "BULLISH").otherwise("BEARISH"))
    o = F.col("id")
    n = G.with_next_price(rows, unless(7, p), double(c % 40), double(o % 3 * 4), double(o % 5 * 3), unless(11, p + 0.3), unless(13, p - 0.3), F.when(o % 4 == 0, p).otherwise(0.0), 0.05)
    return shown(n.withColumnRenamed("next_price", "price"), "price", "source", "reasons", keys=("id",))
