"""Queries of swings, structures and Fibonacci levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import fib as X
from tidegauge.operators import swings as W
from tidegauge.plans.indicator_queries import MACD_SQL, stochastic_sql
from tidegauge.plans.registry import bars, bars_sql, query, r6, shown, table, ticks
from tidegauge.sources.stored import stored
from tidegauge.sources.tables import build_bars

_SWING = ("leg_id", "is_peak", "extremum_ts", "extremum_idx", "price", "osc", "confirm_ts", "confirm_idx", "confirmed")


def swings_sql(sign: str, osc: str, source: str) -> str:
    """Expressions up to `swings` over bars in `source`."""
    part = "OVER (PARTITION BY symbol ORDER BY bar_idx)"
    return f"""w0 AS (SELECT *, {osc} AS o, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM {source}),
        w1 AS (SELECT *, CASE WHEN bar_idx >= 2 THEN {sign} END AS sg FROM w0 WHERE bar_idx < last),
        w2 AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS s, max(CASE WHEN sg = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS started FROM w1),
        w3 AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) {part} THEN 1 ELSE 0 END AS flip FROM w2 WHERE started = 1),
        w4 AS (SELECT *, sum(flip) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS leg FROM w3),
        w5 AS (SELECT *, leg AS leg_id FROM w4 UNION ALL SELECT *, leg - 1 AS leg_id FROM w4 WHERE flip = 1 AND leg > 1),
        w6 AS (SELECT *, leg_id % 2 = 1 AS is_peak, CASE WHEN leg_id % 2 = 1 THEN high ELSE -low END AS v FROM w5),
        swings AS (SELECT symbol, leg_id, is_peak, arg_max(bar_ts, (v, -bar_idx)) AS extremum_ts, arg_max(bar_idx, (v, -bar_idx)) AS extremum_idx, arg_max(CASE WHEN is_peak THEN high ELSE low END, (v, -bar_idx)) AS price,
            CASE WHEN is_peak THEN max(o) ELSE min(o) END AS osc, max(CASE WHEN flip = 1 AND leg > leg_id THEN bar_ts END) AS confirm_ts, max(CASE WHEN flip = 1 AND leg > leg_id THEN bar_idx END) AS confirm_idx FROM w6 GROUP BY symbol, leg_id, is_peak)"""


def _stoch_swings(tf: str) -> str:
    return f"{bars_sql(tf)}, {stochastic_sql()}, {swings_sql('CASE WHEN o > 80 THEN 1 WHEN o < 20 THEN -1 END', 'coalesce(floor(stoch_k * 100 + 0.5) / 100, 0.0)', 'stoch')}"


SWINGS_SQL = _stoch_swings("1h")
_SHOW = "symbol, CAST(leg_id AS BIGINT) AS leg_id, is_peak, extremum_ts, CAST(extremum_idx AS INTEGER) AS extremum_idx, price, osc, confirm_ts, CAST(confirm_idx AS INTEGER) AS confirm_idx, confirm_idx IS NOT NULL AS confirmed"


def _show(df: DataFrame, *more: str) -> DataFrame:
    return shown(df, *_SWING, *more, keys=("symbol",))


@query(f"WITH {SWINGS_SQL} SELECT {_SHOW} FROM swings")
def swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(W.swings(bars(spark, sf_dir)))


@query(f"WITH {_stoch_swings('15min')} SELECT {_SHOW} FROM swings")
def swings_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(W.swings(bars(spark, sf_dir, "15min")))


@query(f"WITH {_stoch_swings('15min')} SELECT {_SHOW} FROM swings")
def swings_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long histories: bars numbered and swings found in spans, here short ones."""
    return _show(W.swings_in_spans(stored(build_bars(ticks(spark, sf_dir), "15min", span_days=2), "bars"), size=250))


_GAP = "floor((macd - macd_signal) * 1e9 + 0.5) / 1e9"


@query(f"WITH RECURSIVE {bars_sql()}, {', '.join(MACD_SQL)}, {swings_sql(f'CASE WHEN {_GAP} > 0 THEN 1 WHEN {_GAP} < 0 THEN -1 END', r6('macd'), 'md')} SELECT {_SHOW} FROM swings")
def macd_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(W.macd_swings(bars(spark, sf_dir)))


_TYPES = """typed AS (SELECT *, lag(price, 2) OVER (PARTITION BY symbol ORDER BY leg_id) AS old FROM swings),
    kinds AS (SELECT *, CASE WHEN old IS NULL OR price = old THEN 'EQ' WHEN is_peak THEN CASE WHEN price > old THEN 'HH' ELSE 'LH' END ELSE CASE WHEN price > old THEN 'HL' ELSE 'LL' END END AS swing_type FROM typed)"""


@query(f"WITH {SWINGS_SQL}, {_TYPES} SELECT {_SHOW}, swing_type FROM kinds")
def swing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(W.with_swing_types(W.swings(bars(spark, sf_dir))), "swing_type")


_NINE = "[" + ", ".join(f"{x}::DOUBLE" for x in X.DEFAULT_LEVELS) + "]"


def _snapped(x: str) -> str:
    return f"coalesce(list_max(list_filter({_NINE}, lambda e: e <= floor({x} * 100 + 0.5) / 100)), {min(X.DEFAULT_LEVELS)}::DOUBLE)"


@query(
    f"""WITH {SWINGS_SQL}, i AS (SELECT *, lag(price, 1) OVER o AS p1, lag(price, 2) OVER o AS p2 FROM swings WINDOW o AS (PARTITION BY symbol ORDER BY leg_id)),
    j AS (SELECT *, CASE WHEN p2 IS NOT NULL THEN floor(greatest(0.0, coalesce(abs(price - p1) / nullif(abs(p1 - p2), 0) * 100, 0.0)) * 100 + 0.5) / 100 END AS intern_percent FROM i)
    SELECT {_SHOW}, intern_percent, CASE WHEN intern_percent IS NOT NULL THEN {_snapped('intern_percent')} END AS intern_level, intern_percent > 100 AS intern_extended FROM j"""
)
def swing_intern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(W.with_swing_intern(W.swings(bars(spark, sf_dir))), "intern_percent", "intern_level", "intern_extended")


@query(
    f"""WITH {SWINGS_SQL}, s AS (SELECT *, CASE WHEN is_peak THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM swings),
    p AS (SELECT a.symbol, a.leg_id, max(b.leg_id) FILTER (WHERE b.price * a.sign >= a.price * a.sign) AS holds, min(b.leg_id) AS oldest FROM s a JOIN s b ON a.symbol = b.symbol AND b.leg_id BETWEEN a.leg_id - 12 AND a.leg_id - 1 AND (a.leg_id - b.leg_id) % 2 = 0 GROUP BY ALL),
    r AS (SELECT s.*, p.holds IS NOT NULL AS extern_active, coalesce(p.holds, p.oldest) AS extern_reference FROM s LEFT JOIN p USING (symbol, leg_id)),
    q AS (SELECT a.symbol, a.leg_id, count(*) FILTER (WHERE (a.leg_id - b.leg_id) % 2 = 0 AND b.price * a.sign < a.price * a.sign) AS broken, min(b.price * a.sign) FILTER (WHERE (a.leg_id - b.leg_id) % 2 = 1) * a.sign AS partner
        FROM r a JOIN s b ON a.symbol = b.symbol AND b.leg_id > a.extern_reference AND b.leg_id < a.leg_id GROUP BY a.symbol, a.leg_id, a.sign),
    e AS (SELECT r.*, CASE WHEN extern_reference IS NOT NULL THEN coalesce(q.broken, 0) END AS extern_broken, floor(abs(r.price - q.partner) / nullif(abs(f.price - q.partner), 0) * 100 * 100 + 0.5) / 100 AS extern_percent
        FROM r LEFT JOIN q USING (symbol, leg_id) LEFT JOIN s f ON f.symbol = r.symbol AND f.leg_id = r.extern_reference)
    SELECT {_SHOW}, CAST(extern_reference AS BIGINT) AS extern_reference, extern_active, CAST(extern_broken AS INTEGER) AS extern_broken, extern_percent, CASE WHEN extern_percent IS NOT NULL THEN {_snapped('extern_percent')} END AS extern_level FROM e"""
)
def swing_extern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(W.with_swing_extern(W.swings(bars(spark, sf_dir))), "extern_reference", "extern_active", "extern_broken", "extern_percent", "extern_level")


@query(f"WITH {SWINGS_SQL} SELECT * FROM (SELECT {_SHOW}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY leg_id DESC) - 1 AS INTEGER) AS slot FROM swings) WHERE slot < 13")
def top_k_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(W.latest_k_swings(W.swings(bars(spark, sf_dir))), "slot")


# A bar sees the legs confirmed before the bar itself; of two on one bar, the later one counts.
SNAPSHOT_SQL = f"""{SWINGS_SQL},
    seen AS (SELECT b.symbol, b.bar_ts, b.bar_idx, s.leg_id, s.is_peak, s.extremum_idx, s.extremum_ts, s.price, s.osc FROM stoch b JOIN swings s ON s.symbol = b.symbol AND s.confirm_idx <= b.bar_idx - 1),
    recent AS (SELECT *, row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY leg_id DESC) AS age FROM seen),
    once AS (SELECT *, max(leg_id) OVER (PARTITION BY symbol, bar_idx, extremum_idx) AS latest FROM recent WHERE age <= 25),
    slots AS (SELECT *, row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY leg_id DESC) AS slot FROM once WHERE leg_id = latest),
    done AS (SELECT * FROM slots WHERE slot <= 12),
    newest AS (SELECT * FROM done WHERE slot = 1),
    zero AS (SELECT n.symbol, n.bar_ts, n.bar_idx, NOT n.is_peak AS is_peak, arg_max(b.bar_ts, (CASE WHEN n.is_peak THEN -b.low ELSE b.high END, b.bar_idx)) AS extremum_ts, arg_max(b.bar_idx, (CASE WHEN n.is_peak THEN -b.low ELSE b.high END, b.bar_idx)) AS extremum_idx,
        max(CASE WHEN n.is_peak THEN -b.low ELSE b.high END) * CASE WHEN n.is_peak THEN -1 ELSE 1 END AS price, CASE WHEN n.is_peak THEN min(coalesce(floor(b.stoch_k * 100 + 0.5) / 100, 0.0)) ELSE max(coalesce(floor(b.stoch_k * 100 + 0.5) / 100, 0.0)) END AS osc
        FROM newest n JOIN stoch b ON b.symbol = n.symbol AND b.bar_idx BETWEEN n.extremum_idx AND n.bar_idx - 1 GROUP BY n.symbol, n.bar_ts, n.bar_idx, n.is_peak),
    allslots AS (SELECT symbol, bar_ts, bar_idx, 0 AS slot, is_peak, extremum_ts, extremum_idx, price, osc FROM zero UNION ALL SELECT symbol, bar_ts, bar_idx, slot, is_peak, extremum_ts, extremum_idx, price, osc FROM done),
    sized AS (SELECT *, count(*) FILTER (WHERE slot > 0) OVER (PARTITION BY symbol, bar_idx) >= 12 AS valid FROM allslots)"""


@query(f"WITH {SNAPSHOT_SQL} SELECT symbol, bar_ts, CAST(bar_idx AS INTEGER) AS bar_idx, valid, CAST(slot AS INTEGER) AS slot, is_peak, extremum_ts, CAST(extremum_idx AS INTEGER) AS extremum_idx, price, osc FROM sized")
def structure_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.structure_snapshot(bars(spark, sf_dir))
    return s.select("symbol", "bar_ts", "bar_idx", "valid", F.inline("slots")).withColumnsRenamed({"ts": "extremum_ts", "idx": "extremum_idx"})


@query(f"WITH {SNAPSHOT_SQL} SELECT symbol, bar_ts, CAST(bar_idx AS INTEGER) AS bar_idx, CAST(slot AS INTEGER) AS slot, is_peak, extremum_ts, CAST(extremum_idx AS INTEGER) AS extremum_idx, price, osc FROM sized WHERE valid AND slot = 0 AND price > 0")
def current_extremum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.current_extremum(W.structure_snapshot(bars(spark, sf_dir))).drop("tf")


_ALL = "[" + ", ".join(f"{x}::DOUBLE" for x in X.ALL_LEVELS) + "]"


def _fib_sql(price: str, k: int) -> str:
    a, b, peak = f"p[{k + 2}]", f"p[{k + 3}]", f"k[{k + 2}]"
    return f"CASE WHEN {peak} THEN floor(({a} - {price}) / nullif({a} - {b}, 0) * 100 * 10 + 0.5) / 10 ELSE floor(({price} - {a}) / nullif({b} - {a}, 0) * 100 * 10 + 0.5) / 10 END"


@query(
    f"""WITH {SNAPSHOT_SQL}, l AS (SELECT z.symbol, z.bar_ts, z.bar_idx, list(z.price ORDER BY slot) AS p, list(z.is_peak ORDER BY slot) AS k, any_value(b.close) AS close FROM sized z JOIN stoch b ON b.symbol = z.symbol AND b.bar_idx = z.bar_idx WHERE valid GROUP BY ALL)
    SELECT symbol, bar_ts, CAST(bar_idx AS INTEGER) AS bar_idx, """
    + ", ".join(f"CASE WHEN ({_fib_sql(f'p[{k + 1}]', k)}) IS NOT NULL THEN coalesce(list_max(list_filter({_ALL}, lambda e: e <= floor(({_fib_sql(f'p[{k + 1}]', k)}) * 100 + 0.5) / 100)), 0.0::DOUBLE) END AS fib_{k + 1}" for k in range(4))
    + f", {_fib_sql('close', 0)} AS fib_live FROM l"
)
def fib_levels5(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return W.fib_levels5(W.structure_snapshot(b), b).drop("tf")


def _kind_sql(i: int) -> str:
    new, old, peak = f"p[{i + 1}]", f"p[{i + 3}]", f"k[{i + 1}]"
    return f"CASE WHEN {new} = {old} THEN 'EQ' WHEN {new} > {old} THEN CASE WHEN {peak} THEN 'HH' ELSE 'HL' END ELSE CASE WHEN {peak} THEN 'LH' ELSE 'LL' END END"


@query(
    f"""WITH {SNAPSHOT_SQL}, l AS (SELECT symbol, bar_ts, bar_idx, list(price ORDER BY slot) AS p, list(is_peak ORDER BY slot) AS k, list(extremum_ts ORDER BY slot) AS t FROM sized WHERE valid GROUP BY ALL), y AS (SELECT *, [{', '.join(_kind_sql(i) for i in range(6))}] AS types FROM l)
    SELECT symbol, bar_ts, CAST(bar_idx AS INTEGER) AS bar_idx, array_to_string(types, ',') AS types, array_to_string(types[1:4], ',') AS sequence, """
    + ", ".join(f"t[{i + 1}] AS ts_{i}, p[{i + 1}] AS price_{i}" for i in range(4))
    + " FROM y"
)
def structure6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.structure6(W.structure_snapshot(bars(spark, sf_dir))).drop("tf").withColumn("types", F.array_join("types", ","))


# -- scalars over price triples

_TRIPLES = "t AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS peak, o_totalprice / 1250 AS bottom, o_totalprice / 1000 * (0.7::DOUBLE + 0.001::DOUBLE * (o_custkey % 700)) AS price, o_custkey % 500 - 150 AS x, o_custkey % 2 = 0 AS is_bottom FROM orders)"


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("id"), (p / 1000).alias("peak"), (p / 1250).alias("bottom"), (p / 1000 * (0.7 + 0.001 * (F.col("o_custkey") % 700))).alias("price"), (F.col("o_custkey") % 500 - 150).alias("x"), (F.col("o_custkey") % 2 == 0).alias("is_bottom"))


def _out(df: DataFrame, **columns) -> DataFrame:
    df = df.withColumns(columns)
    return shown(df, *columns, keys=("id",))


@query(
    f"WITH {_TRIPLES} SELECT id, {r6('peak - 61.8::DOUBLE / 100 * (peak - bottom)')} AS retrace_bottom, {r6('bottom + 61.8::DOUBLE / 100 * (peak - bottom)')} AS retrace_peak, "
    f"{r6('price - 161.8::DOUBLE / 100 * abs(peak - bottom)')} AS expand_bottom, {r6('price + 161.8::DOUBLE / 100 * abs(peak - bottom)')} AS expand_peak FROM t"
)
def fib_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir)
    p = F.lit(61.8)
    return _out(
        t, retrace_bottom=X.trend_price("bottom", p, "peak", "bottom"), retrace_peak=X.trend_price("peak", p, "peak", "bottom"),
        expand_bottom=X.expansion_price("bottom", F.lit(161.8), "peak", "bottom", "price"), expand_peak=X.expansion_price("peak", F.lit(161.8), "peak", "bottom", "price"),
    )


@query(
    f"WITH {_TRIPLES} SELECT id, floor((peak - price) / (peak - bottom) * 100 * 10 + 0.5) / 10 AS to_bottom, floor((price - bottom) / (peak - bottom) * 100 * 10 + 0.5) / 10 AS to_peak, "
    "floor((bottom - price) / abs(peak - bottom) * 100 * 10 + 0.5) / 10 AS expanded, "
    "CASE WHEN (CASE WHEN is_bottom THEN floor((peak - price) / (peak - bottom) * 1000 + 0.5) / 10 ELSE floor((price - bottom) / (peak - bottom) * 1000 + 0.5) / 10 END) >= 0 THEN (CASE WHEN is_bottom THEN floor((peak - price) / (peak - bottom) * 100 * 10 + 0.5) / 10 ELSE floor((price - bottom) / (peak - bottom) * 100 * 10 + 0.5) / 10 END) END AS in_structure FROM t"
)
def fib_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir)
    return _out(
        t, to_bottom=X.trend_percent("bottom", "price", "peak", "bottom"), to_peak=X.trend_percent("peak", "price", "peak", "bottom"),
        expanded=X.expansion_percent("bottom", "price", "peak", "bottom", "bottom"), in_structure=X.structure_percent("price", "is_bottom", "peak", "bottom"),
    )


@query(
    f"WITH {_TRIPLES}, v AS (SELECT id, floor((price - bottom) / (peak - bottom) * 100 * 100 + 0.5) / 100 AS v FROM t) SELECT id, coalesce(list_max(list_filter({_NINE}, lambda e: e <= v)), 0.0::DOUBLE) AS level, coalesce(list_min(list_filter({_NINE}, lambda e: e > v)), 423.6::DOUBLE) AS next_level FROM v"
)
def snap_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir)
    s = X.snap_level((F.col("price") - F.col("bottom")) / (F.col("peak") - F.col("bottom")) * 100, X.levels(X.DEFAULT_LEVELS))
    return _out(t, level=s["level"], next_level=s["next"])


_SIX = (0.0, 23.6, 38.2, 61.8, 78.6, 100.0)
_SIX_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _SIX) + "]"


@query(
    f"""WITH {_TRIPLES} SELECT id,
        {r6(f'CASE WHEN x >= 100 THEN 100 + floor((x - 100) / (100 - 78.6::DOUBLE)) * (100 - 78.6::DOUBLE) ELSE list_max(list_filter({_SIX_SQL}, lambda e: e <= x)) END')} AS low,
        {r6(f'CASE WHEN x >= 100 THEN 100 + (floor((x - 100) / (100 - 78.6::DOUBLE)) + 1) * (100 - 78.6::DOUBLE) ELSE list_min(list_filter({_SIX_SQL}, lambda e: e > x)) END')} AS high,
        CASE WHEN x BETWEEN 0 AND 100 THEN list_max(list_filter({_SIX_SQL}, lambda e: e < list_min(list_filter({_SIX_SQL}, lambda f: f >= x AND f > 0)))) END AS strict_low,
        CASE WHEN x BETWEEN 0 AND 100 THEN list_min(list_filter({_SIX_SQL}, lambda f: f >= x AND f > 0)) END AS strict_high FROM t"""
)
def fib_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, at = _triples(spark, sf_dir), X.levels(_SIX)
    band, strict = X.fib_band("x", at), X.fib_band_strict("x", at)
    return _out(t, low=band["low"], high=band["high"], strict_low=strict["low"], strict_high=strict["high"])


# the levels repeat every largest one, and are mirrored below 0; from below minus the largest one, that comes first
_LADDER = "[" + ", ".join(f"{x}::DOUBLE" for x in sorted({s * (100 * k + x) for k in range(9) for x in _SIX for s in (1, -1)})) + "]"
_UP, _DOWN = f"list_filter({_LADDER}, lambda e: e > x + 1e-4)", f"list_reverse(list_filter({_LADDER}, lambda e: e < x - 1e-4))"


@query(
    f"WITH {_TRIPLES} SELECT id, x, CASE WHEN x < -100 THEN -100.0::DOUBLE ELSE {_UP}[1] END AS up_1, CASE WHEN x < -100 THEN list_filter({_LADDER}, lambda e: e > -100 + 1e-4)[2] ELSE {_UP}[3] END AS up_3, {_DOWN}[1] AS down_1, {_DOWN}[3] AS down_3 FROM t"
)
def fib_next_cycled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, at = _triples(spark, sf_dir), _SIX
    return _out(t, x=F.col("x"), up_1=X.fib_next_cycled("x", 1, True, at), up_3=X.fib_next_cycled("x", 3, True, at), down_1=X.fib_next_cycled("x", 1, False, at), down_3=X.fib_next_cycled("x", 3, False, at))


@query(
    """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '0.0, 61.8,100.0' WHEN 1 THEN '38.2,x,,' WHEN 2 THEN concat('50,', CAST(o_custkey % 90 AS VARCHAR), ' , 50') ELSE '' END AS csv FROM orders),
    p AS (SELECT id, list_sort(list_distinct(list_filter(list_transform(string_split(csv, ','), lambda e: try_cast(trim(e) AS DOUBLE)), lambda e: e IS NOT NULL))) AS own FROM t)
    SELECT id, array_to_string(list_transform(CASE WHEN len(own) >= 2 THEN own ELSE [23.6, 38.2, 50.0, 61.8, 78.6, 100.0]::DOUBLE[] END, lambda e: CAST(floor(e * 10 + 0.5) AS BIGINT)), '|') AS levels FROM p"""
)
def parse_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    csv = F.when(k == 0, "0.0, 61.8,100.0").when(k == 1, "38.2,x,,").when(k == 2, F.concat(F.lit("50,"), F.col("o_custkey") % 90, F.lit(" , 50"))).otherwise("")
    t = o.select(F.col("o_orderkey").alias("id"), csv.alias("csv"))
    text = F.array_join(F.transform(X.parse_levels("csv"), lambda e: F.floor(e * 10 + 0.5).cast("string")), "|")
    return t.select("id", text.alias("levels"))


@query(
    f"WITH {_TRIPLES}, b AS (SELECT *, 38.2::DOUBLE AS low, 61.8::DOUBLE AS high FROM t) SELECT id, {r6('CASE WHEN is_bottom THEN greatest(peak, bottom) ELSE least(peak, bottom) END')} AS breakout, CASE WHEN abs(high - x) >= abs(x - low) THEN high ELSE low END AS opposite FROM b"
)
def band_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir).withColumn("direction", F.when(F.col("is_bottom"), "BULLISH").otherwise("BEARISH"))
    return _out(t, breakout=X.breakout_target("direction", "peak", "bottom"), opposite=X.opposite_endpoint("x", F.lit(38.2), F.lit(61.8)))


def _next_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 100 THEN 100 + (floor(({x} - 100) / (100 - 78.6::DOUBLE)) + 1) * (100 - 78.6::DOUBLE) ELSE list_min(list_filter({_SIX_SQL}, lambda e: e > {x})) END"


@query(
    f"""WITH {_TRIPLES}, n AS (SELECT *, {_next_sql('x')} AS n1 FROM t), q AS (SELECT *, CASE WHEN is_bottom THEN peak - x::DOUBLE / 100 * (peak - bottom) ELSE bottom + x::DOUBLE / 100 * (peak - bottom) END AS p FROM n)
    SELECT id, {r6('n1')} AS next_1, {r6(_next_sql('n1'))} AS next_2, {r6('CASE WHEN p > 0 THEN p END')} AS price, CASE WHEN id % 2 = 0 THEN '0|236|1000' ELSE '236|618' END AS cycle FROM q"""
)
def fib_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper ends of the bands above a percent, its price, and levels with both ends of a cycle where one is there."""
    t, at = _triples(spark, sf_dir), X.levels(_SIX)
    own = F.when(F.col("id") % 2 == 0, X.levels((23.6, 100.0))).otherwise(X.levels((23.6, 61.8)))
    t = t.withColumn("cycle", F.array_join(F.transform(X.cycle_levels(own), lambda e: F.floor(e * 10 + 0.5).cast("string")), "|"))
    out = {"next_1": X.fib_next("x", 1, at), "next_2": X.fib_next("x", 2, at), "price": X.structure_price(F.col("x").cast("double"), "is_bottom", "peak", "bottom")}
    return shown(t.withColumns(out), *out, "cycle", keys=("id",))
