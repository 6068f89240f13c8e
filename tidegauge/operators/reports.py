"""Aggregations and ordered reports: profits, drawdowns, counts, limits, allocations and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import direction_multiplier, kv_message, outcome_class, projected_profit, round2_no_negzero, round_digits, tf_label, utc_day
from tidegauge.sources.stored import stored


def daily_net_pnl(deals: DataFrame, server_offset_seconds: int = 0) -> DataFrame:
    """Net profit and number of closing deals by account, magic and UTC day: account, magic, day, net_pnl, deals."""
    net = F.col("profit") + F.col("swap") + F.col("commission") + F.col("fee")
    closing = deals.where(F.col("entry").isin("OUT", "INOUT") & F.col("deal_type").isin("BUY", "SELL")).withColumn("net", net).where(~F.isnan("net") & (F.abs("net") != float("inf")))
    return closing.groupBy("account", "magic", utc_day("deal_time", server_offset_seconds).alias("day")).agg(round2_no_negzero(F.sum("net")).alias("net_pnl"), F.count(F.lit(1)).alias("deals"))


def open_drawdown(positions: DataFrame) -> DataFrame:
    """By magic: magic, drawdown (the loss of the open positions together, 0 in profit), positions."""
    return positions.groupBy("magic").agg(F.greatest(F.lit(0.0), -F.sum("profit")).alias("drawdown"), F.count(F.lit(1)).alias("positions"))


def drawdown_lock(equity: DataFrame, threshold: Column, period: str = "day", keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Add `locked`: an earlier row of the same day or week had a drawdown of at least the threshold."""
    w = Window.partitionBy(*keys, F.date_trunc(period, "ts")).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return equity.withColumn("locked", F.coalesce(F.max((F.col("drawdown") >= threshold).cast("int")).over(w), F.lit(0)) == 1)


def leg_status_summary(legs: DataFrame) -> DataFrame:
    out = legs.groupBy("signal_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(F.col("status").isin("PENDING", "WAITING")).alias("pending"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("summary", F.format_string("%d active, %d pending of %d", "active", "pending", "total"))


def leg_flags(legs: DataFrame) -> DataFrame:
    """By signal: has_executed_leg, has_exposure, complete (nothing waiting, pending, active or with a ticket)."""
    live = F.col("status").isin("WAITING", "PENDING", "ACTIVE")
    return legs.groupBy("signal_id").agg(
        F.bool_or(~F.col("status").isin("WAITING", "PENDING", "INACTIVE")).alias("has_executed_leg"), F.bool_or(F.col("ticket").isNotNull() | (F.col("status") == "ACTIVE")).alias("has_exposure"),
        (~F.bool_or(live | F.col("ticket").isNotNull())).alias("complete"),
    )


def open_position_counts(positions: DataFrame) -> DataFrame:
    return positions.groupBy("magic").agg(F.count_if(F.col("side") == "BUY").alias("bullish"), F.count_if(F.col("side") == "SELL").alias("bearish"))


def remaining_volume(legs: DataFrame, positions: DataFrame) -> DataFrame:
    """Volume of each signal's active legs: the position's where the ticket is found, else the leg's own."""
    p = positions.select(F.col("ticket").alias("__t"), F.col("volume").alias("__v"))
    j = legs.where(F.col("status") == "ACTIVE").join(p, F.col("ticket") == F.col("__t"), "left")
    return j.groupBy("signal_id").agg(round_digits(F.sum(F.coalesce("__v", "lot_size")), 2).alias("volume"))


def basket_profit_at(legs: DataFrame, price: Column, point_value: float, point: float, skip_level: int | None = None) -> DataFrame:
    """Profit of each signal's active legs, were they closed at the price."""
    own = legs.where(F.col("status") == "ACTIVE")
    if skip_level is not None:
        own = own.where(F.col("level_index") != skip_level)
    p = F.col("lot_size") * point_value * (price - F.col("entry_price")) * direction_multiplier("direction") / point
    return own.groupBy("signal_id").agg(F.sum(p).alias("basket_profit"))


def daily_signal_counts(outcomes: DataFrame) -> DataFrame:
    """By day and direction: signals and losing ones, of rows with ts, direction, profit."""
    return outcomes.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "direction").agg(F.count(F.lit(1)).alias("signals"), F.count_if(outcome_class("profit") == "LOSS").alias("losses"))


def source_attempts(candidates: DataFrame) -> DataFrame:
    """By source_key: attempts, first_ts, consumed (some attempt hit its target), consumed_ts."""
    hit = F.when(F.col("outcome") == "TP", F.col("close_ts"))
    return candidates.groupBy("source_key").agg(F.count(F.lit(1)).alias("attempts"), F.min("signal_ts").alias("first_ts"), F.min(hit).isNotNull().alias("consumed"), F.min(hit).alias("consumed_ts"))


def run_score(trades: DataFrame, keys: tuple[str, ...], deposit: float, growth: str = "profit/deposit") -> DataFrame:
    """Positive growth times ln(1 + trades) times the positive Sharpe ratio of the trades' profits; 0 without trades or
    deposit. growth "reference" takes the profit for the final balance: (profit - deposit) / deposit."""
    a = trades.groupBy(*keys).agg(F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("trades"), F.try_divide(F.avg("profit"), F.stddev_samp("profit")).alias("sharpe"))
    g = (F.col("profit") - deposit) / deposit if growth == "reference" else F.col("profit") / deposit
    score = F.greatest(g, F.lit(0.0)) * F.log1p("trades") * F.greatest(F.coalesce("sharpe", F.lit(0.0)), F.lit(0.0)) if deposit > 0 else F.lit(0.0)
    return a.withColumn("score", score)


def daily_limit(signals: DataFrame, mode: str, limit: int, order: tuple[str, ...] = ("ts", "signal_id")) -> DataFrame:
    """Add `allowed`: SIGNALS lets the first `limit` of a day and direction through, LOSSES all until that many have lost."""
    w = Window.partitionBy(F.date_trunc("day", "ts"), "direction").orderBy(*order)
    if mode == "SIGNALS":
        return signals.withColumn("allowed", F.row_number().over(w) <= limit)
    lost = F.sum((outcome_class("profit") == "LOSS").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return signals.withColumn("allowed", F.coalesce(lost, F.lit(0)) < limit)


def lot_sequence(outcomes: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], on: str = "LOSS", cap: int = 50) -> DataFrame:
    """Add lot_step: how many outcomes of the kind came in a row just before, at most `cap`. Neutral outcomes don't count
    and don't interrupt."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kind = outcome_class("profit")
    o = outcomes.withColumns({"__hit": (kind == on).cast("int"), "__reset": (~kind.isin(on, "NEUTRAL")).cast("int")})
    o = o.withColumn("__run", F.sum("__reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    o = o.withColumn("__before_run", F.coalesce(F.sum("__reset").over(before), F.lit(0)))
    # hits in the run that the previous row belongs to
    hits = F.coalesce(F.sum("__hit").over(before), F.lit(0))
    o = o.withColumn("__hits", hits)
    start = F.min("__hits").over(Window.partitionBy(*keys, "__before_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return o.withColumn("lot_step", F.least(F.col("__hits") - start, F.lit(cap)).cast("int")).drop("__hit", "__reset", "__run", "__before_run", "__hits")


def executed_index(legs: DataFrame) -> DataFrame:
    """Add how many of the signal's earlier legs are neither completed nor inactive."""
    w = Window.partitionBy("signal_id").orderBy("level_index").rowsBetween(Window.unboundedPreceding, -1)
    return legs.withColumn("executed_index", F.coalesce(F.sum((~F.col("status").isin("COMPLETED", "INACTIVE")).cast("int")).over(w), F.lit(0)))


def close_by_priority(legs: DataFrame, requested: Column) -> DataFrame:
    """Volume to close of each active leg: those of the best profit first, until the requested volume is used up."""
    active = legs.where(F.col("status") == "ACTIVE")
    w = Window.partitionBy("signal_id").orderBy(F.desc("profit"), "level_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("lot_size").over(w), F.lit(0.0))
    return active.withColumn("close_volume", round_digits(F.greatest(F.lit(0.0), F.least(F.col("lot_size"), requested - before)), 2))


def latest_filled_leg(legs: DataFrame) -> DataFrame:
    filled = legs.where((F.col("entry_price") > 0) & ~F.col("status").isin("INACTIVE", "WAITING", "PENDING"))
    return filled.groupBy("signal_id").agg(F.max_by(F.struct("level_index", "status", "entry_price"), "level_index").alias("leg")).select("signal_id", "leg.*")


def _in_order(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], first, step, added: str) -> DataFrame:
    """Rows that `step` keeps, which depends on what it kept before of the same keys: rows stream through in order, and only
    the state that step returns is held. step(state, row) gives the next state and the added column's value, or None to drop
    the row; `first` is the state of new keys."""
    import pyarrow as pa

    names, kind = rows.columns, added.split(" ")
    keyed = [names.index(k) for k in keys]

    def keep(batches):
        key, state = None, first
        for b in batches:
            out, columns = [], [b.column(c).cast(pa.int64()).to_pylist() if pa.types.is_timestamp(b.column(c).type) else b.column(c).to_pylist() for c in names]
            for k, row in enumerate(zip(*columns)):
                own = tuple(row[i] for i in keyed)
                if own != key:
                    key, state = own, first
                state, value = step(state, row)
                if value is not None:
                    out.append((k, value))
            took = b.take(pa.array([k for k, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array([d for _, d in out], pa.int64())], names=[*names, kind[0]])

    kinds = dict(rows.dtypes)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(keep, ", ".join(f"{n} {kinds[n]}" for n in names) + f", {added}")


def single_running(intervals: DataFrame, key: str = "signal_id") -> DataFrame:
    """Intervals (key, symbol, direction, start_ts, end_ts) that start while none that was let through of their symbol and
    direction runs. Ones that were refused don't run, and so refuse no other. A symbol's and direction's intervals meet in
    one task, as they depend on each other."""
    rows = intervals.select(key, "symbol", "direction", "start_ts", "end_ts")

    def step(running, row):
        _, _, _, start, end = row
        return (running, None) if running is not None and start < running else (end, 1)

    return _in_order(rows, ("symbol", "direction"), ("start_ts", key), None, step, "allowed long").drop("allowed")


def changes(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], *values: str, span: Column | None = None) -> DataFrame:
    """Rows whose values differ from the row before of the same keys; the first row always stays. With a span (one that grows
    with the order, such as the day) each span is a task of its own, and gets the values at the end of the one before."""
    if span is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        before, first = [F.lag(v).over(w) for v in values], F.row_number().over(w) == 1
    else:
        rows = rows.withColumn("__span", span)
        w = Window.partitionBy(*keys, "__span").orderBy(*order)
        ends = rows.groupBy(*keys, "__span").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__end"))
        over = Window.partitionBy(*keys).orderBy("__span")
        ends = ends.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__span").alias("__k_span"), F.lag("__end").over(over).alias("__before"), F.row_number().over(over).alias("__n_span"))
        on = F.col("__span") == F.col("__k_span")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        rows = rows.join(ends, on).withColumn("__n", F.row_number().over(w))
        before = [F.when(F.col("__n") == 1, F.col(f"__before.{v}")).otherwise(F.lag(v).over(w)) for v in values]
        first = (F.col("__n") == 1) & (F.col("__n_span") == 1)
    same = F.lit(True)
    for v, old in zip(values, before):
        same = same & F.col(v).eqNullSafe(old)
    names = [c for c in rows.columns if not c.startswith("__")]
    return rows.withColumns({"__first": first, "__same": same}).where(F.col("__first") | ~F.col("__same")).select(*names)


def log_throttle(events: DataFrame, seconds: int) -> DataFrame:
    """Of each (label, state_key), the first event and then the next one at least `seconds` after the last kept one, with the
    number of events dropped since: event_id, ts, label, state_key, message, suppressed.

    Events go by (ts, event_id); a key's events meet in one task, as they depend on each other.
    """
    rows = events.select("label", "state_key", "ts", "event_id", "message")

    def step(state, row):
        last, dropped = state
        if last is None or row[2] - last >= seconds * 1_000_000:
            return (row[2], 0), dropped
        return (last, dropped + 1), None

    return _in_order(rows, ("label", "state_key"), ("ts", "event_id"), (None, 0), step, "suppressed long")


def realized_profit(closes: DataFrame, legs: DataFrame, point_value: float, point: float) -> DataFrame:
    """By signal: realized_profit and closed_volume of closes (signal_id, level_index, volume, close_price) at their legs' entry
    prices. Closes without a volume, a price or an entry price above 0 don't count."""
    at = legs.select("signal_id", "level_index", "direction", "entry_price")
    own = closes.join(at, ["signal_id", "level_index"]).where((F.col("volume") > 0) & (F.col("close_price") > 0) & (F.col("entry_price") > 0))
    profit = projected_profit("direction", "volume", "entry_price", "close_price", F.lit(point_value), F.lit(point))
    return own.groupBy("signal_id").agg(F.sum(profit).alias("realized_profit"), F.sum("volume").alias("closed_volume"))


def outcome_flags(legs: DataFrame, realized: DataFrame) -> DataFrame:
    """By signal: has_confirmed_outcome (volume or profit was realized, or a leg has a ticket, an entry or is ACTIVE) and
    any_active."""
    held = legs.groupBy("signal_id").agg(F.bool_or(F.col("ticket").isNotNull() | (F.col("status") == "ACTIVE") | (F.col("entry_price") > 0)).alias("__held"), F.bool_or(F.col("status") == "ACTIVE").alias("any_active"))
    r = realized.select(F.col("signal_id").alias("__id"), ((F.col("closed_volume") > 0) | (F.abs("realized_profit") > 1e-7)).alias("__closed"))
    out = held.join(r, F.col("signal_id") == F.col("__id"), "left")
    return out.select("signal_id", (F.col("__held") | F.coalesce("__closed", F.lit(False))).alias("has_confirmed_outcome"), "any_active")


#: How results are ordered by each of their fields.
SORT_ORDERS = {"finish_level": "asc", "expectations": "desc", "z_score": "desc", "winrate": "desc", "variant_sharpe_ratio": "desc", "sharpe_ratio": "desc", "bayesian_sharpe_ratio": "desc", "entry_time": "asc"}


def sort_by(rows: DataFrame, field: str, order: str | None = None, *ties: str) -> DataFrame:
    """Rows by a field, in the order that results have by it unless another is given; equal ones by `ties`."""
    down = (order or SORT_ORDERS[field]) == "desc"
    return rows.orderBy(F.desc(field) if down else F.asc(field), *ties)


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Sorted rows with their places from 1: counts of the sorted tasks say where each one's rows begin. The rows are written with
    their tasks' numbers, so that a task that runs again changes none."""
    at = stored(rows.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "sorted")
    starts = at.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    starts = starts.withColumn("__before", F.coalesce(before, F.lit(0))).select(F.col("__task").alias("__t"), "__first", "__before")
    out_ = at.join(F.broadcast(starts), F.col("__task") == F.col("__t")).withColumn(out, F.col("__before") + F.col("__at") - F.col("__first") + 1)
    return out_.drop("__task", "__at", "__t", "__first", "__before")


def trailing_reference(ticks: DataFrame, keys: tuple[Column | str, ...], order: tuple[str, ...], offset: float, price: str = "price") -> DataFrame:
    """Add bull_reference and bear_reference, the adverse-only references of a signal that starts with each key: an offset below
    the price that only ever falls, and one above that only ever rises."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumns({"bull_reference": F.min(F.col(price) - offset).over(w), "bear_reference": F.max(F.col(price) + offset).over(w)})


def event_log(events: DataFrame, **parts: Column) -> DataFrame:
    """Rows of an event log (event_id, ts, label) with their message of labelled parts, as the log's sink writes them."""
    return events.withColumn("message", kv_message(**parts))


def leg_resolution(legs: DataFrame) -> Column:
    """What became of a leg: its number, status, entry and lot in one labelled text."""
    return kv_message(level=F.col("level_index") + 1, status=F.col("status"), entry=F.format_string("%.2f", round_digits("entry_price", 2)), lot=F.format_string("%.2f", round_digits("lot_size", 2)), ticket=F.col("ticket"))


def run_manifest(ticks: DataFrame, strategies: DataFrame, **inputs: str) -> DataFrame:
    """What a run over ticks covers, one labelled row for each input, strategy and symbol: section, name, value."""
    head = ticks.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    said = lambda c: F.date_format(c, "yyyy.MM.dd HH:mm:ss")
    symbols = head.select(F.lit("symbol").alias("section"), F.col("symbol").alias("name"), kv_message(ticks=F.col("n"), first=said("a"), last=said("b")).alias("value"))
    text = kv_message(base_delay=F.col("base_delay"), macro=tf_label("macro"), macro_delay=F.col("macro_delay"))
    own = strategies.select(F.when(F.col("enabled"), "active strategy").otherwise("inactive strategy").alias("section"), F.col("label").alias("name"), text.alias("value"))
    out = symbols.unionByName(own)
    if inputs:
        given = F.array(*(F.struct(F.lit("input").alias("section"), F.lit(k).alias("name"), F.lit(str(v)).alias("value")) for k, v in sorted(inputs.items())))
        out = out.unionByName(ticks.sparkSession.range(1).select(F.inline(given)))
    return out
