"""Swings of an oscillator and what is derived from them, without walking bars one by one.

A peak leg begins where the oscillator turns overbought, a bottom leg where it turns oversold, and they alternate. A leg
covers the bars up to and including the next leg's first; its extremum is its highest high or lowest low, the earliest of
equals, and is confirmed when the next leg begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.fib import ALL_LEVELS, DEFAULT_LEVELS, levels, snap_level, trend_percent
from tidegauge.functions.scalars import round_digits
from tidegauge.operators.windows import KEYS, in_chunks, with_macd, with_macd_normalized, with_stochastic


def _bars():
    return Window.partitionBy(*KEYS).orderBy("bar_idx")


def _legs():
    return Window.partitionBy(*KEYS).orderBy("leg_id")


def swings_of(bars: DataFrame, sign: Column, osc: Column) -> DataFrame:
    """Swings of bars by a sign (1, -1 or null): symbol, tf, leg_id, is_peak, extremum_ts, extremum_idx, price, osc,
    confirm_ts, confirm_idx, confirmed. The first two bars and the last one (still forming) have no sign."""
    last = F.max("bar_idx").over(Window.partitionBy(*KEYS))
    b = bars.withColumn("__last", last).where(F.col("bar_idx") < F.col("__last"))
    b = b.withColumns({"__sign": F.when(F.col("bar_idx") >= 2, sign), "__osc": osc})
    b = b.withColumn("__s", F.last("__sign", True).over(_bars().rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("__started", F.max((F.col("__sign") == 1).cast("int")).over(_bars().rowsBetween(Window.unboundedPreceding, 0)))
    b = b.where("__started = 1").withColumn("__flip", (~F.col("__s").eqNullSafe(F.lag("__s").over(_bars()))).cast("int"))
    b = b.withColumn("__leg", F.sum("__flip").over(_bars().rowsBetween(Window.unboundedPreceding, 0)))
    return _legs_of(b)


def _legs_of(b: DataFrame) -> DataFrame:
    """Swings of bars with their leg's number (__leg), whether they begin it (__flip), and the oscillator (__osc)."""
    # a leg's first bar is also the last bar of the leg before
    legs = F.when((F.col("__flip") == 1) & (F.col("__leg") > 1), F.array(F.col("__leg") - 1, F.col("__leg"))).otherwise(F.array("__leg"))
    rows = b.select(*KEYS, "bar_ts", "bar_idx", "high", "low", "__osc", "__flip", F.col("__leg").alias("__own"), F.explode(legs).alias("leg_id"))
    rows = rows.withColumn("is_peak", F.col("leg_id") % 2 == 1)
    bar = F.struct("bar_ts", "bar_idx", F.when(F.col("is_peak"), F.col("high")).otherwise(F.col("low")).alias("price"))
    best = F.struct(F.when(F.col("is_peak"), F.col("high")).otherwise(-F.col("low")), -F.col("bar_idx"))
    ending = (F.col("__flip") == 1) & (F.col("__own") > F.col("leg_id"))
    out = rows.groupBy(*KEYS, "leg_id", "is_peak").agg(
        F.max_by(bar, best).alias("bar"), F.max("__osc").alias("__top"), F.min("__osc").alias("__bottom"), F.max(F.when(ending, F.col("bar_ts"))).alias("confirm_ts"), F.max(F.when(ending, F.col("bar_idx"))).alias("confirm_idx")
    )
    return out.select(
        *KEYS, "leg_id", "is_peak", F.col("bar.bar_ts").alias("extremum_ts"), F.col("bar.bar_idx").alias("extremum_idx"), F.col("bar.price").alias("price"),
        F.when(F.col("is_peak"), F.col("__top")).otherwise(F.col("__bottom")).alias("osc"), "confirm_ts", "confirm_idx", F.col("confirm_idx").isNotNull().alias("confirmed"),
    )


def oscillator() -> Column:
    """The stochastic to 2 decimals; 0 before it starts."""
    return F.coalesce(round_digits("stoch_k", 2), F.lit(0.0))


def swings(bars: DataFrame, high: float = 80.0, low: float = 20.0, **stochastic) -> DataFrame:
    b = with_stochastic(bars, **stochastic).withColumn("__value", oscillator())
    v = F.col("__value")
    return swings_of(b, F.when(v > high, 1).when(v < low, -1), v)


def swings_in_spans(bars: DataFrame, high: float = 80.0, low: float = 20.0, size: int = 100_000, k: int = 5, slow: int = 3, **stochastic) -> DataFrame:
    """swings(), with a symbol's history in spans of `size` bars that are tasks of their own.

    What a span does to the legs depends on the sign that it comes in with, and on nothing else: it turns it into its own last
    sign, and begins as many legs as its signs change, one more if its first differs from the one that came in. So spans are
    summed up apart from each other, their sums are put one behind the other (a row for each span), and each span then
    numbers its own bars' legs from where those before it end. The oscillator reads a few bars across a span's start.
    """
    b = in_chunks(bars, lambda x: with_stochastic(x, k=k, slow=slow, **stochastic).withColumn("__osc", oscillator()), k + slow, size)
    v = F.col("__osc")
    ends = bars.groupBy(*KEYS).agg(F.max("bar_idx").alias("__last"))
    b = b.join(ends, list(KEYS)).where("bar_idx < __last").withColumn("__sign", F.when(F.col("bar_idx") >= 2, F.when(v > high, 1).when(v < low, -1))).drop("__last")
    b = b.join(b.where("__sign = 1").groupBy(*KEYS).agg(F.min("bar_idx").alias("__start")), list(KEYS)).where("bar_idx >= __start").withColumn("__span", F.floor(F.col("bar_idx") / size))
    own = Window.partitionBy(*KEYS, "__span").orderBy("bar_idx")
    b = b.withColumn("__was", F.last("__sign", True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    changed = F.col("__was").isNotNull() & (F.col("__sign") != F.col("__was"))
    sums = b.groupBy(*KEYS, "__span").agg(F.min_by("__sign", F.when(F.col("__sign").isNotNull(), F.col("bar_idx"))).alias("__first"), F.max_by("__sign", F.when(F.col("__sign").isNotNull(), F.col("bar_idx"))).alias("__final"), F.count_if(changed).alias("__changes"))
    spans = Window.partitionBy(*KEYS).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__in", F.last("__final", True).over(spans))
    begun = F.col("__changes") + (F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("__in"))).cast("int")
    sums = sums.withColumn("__begun", begun).withColumn("__legs", F.coalesce(F.sum("__begun").over(spans), F.lit(0))).select(*KEYS, "__span", "__in", "__legs")
    b = b.join(sums, [*KEYS, "__span"])
    b = b.withColumn("__flip", (F.col("__sign").isNotNull() & ~F.col("__sign").eqNullSafe(F.coalesce("__was", "__in"))).cast("int"))
    return _legs_of(b.withColumn("__leg", F.col("__legs") + F.sum("__flip").over(own.rowsBetween(Window.unboundedPreceding, 0))))


def macd_swings(bars: DataFrame, mode: str = "signal", **macd) -> DataFrame:
    """Swings of macd above or below its signal, or of its normalised value above 80 or below 20."""
    if mode == "signal":
        b = with_macd(bars, **macd)
        gap = round_digits(F.col("macd") - F.col("macd_signal"), 9)
        return swings_of(b, F.when(gap > 0, 1).when(gap < 0, -1), round_digits("macd", 6))
    b = with_macd_normalized(bars, **macd)
    v = round_digits("macd_norm", 6)
    return swings_of(b, F.when(v > 80, 1).when(v < 20, -1), v)


def with_swing_types(swings: DataFrame) -> DataFrame:
    """HH or LH for peaks, HL or LL for bottoms, against the swing of the same kind before; EQ for the first two."""
    old = F.lag("price", 2).over(_legs())
    kind = F.when(old.isNull(), "EQ").when(F.col("price") == old, "EQ").when(F.col("is_peak"), F.when(F.col("price") > old, "HH").otherwise("LH")).otherwise(F.when(F.col("price") > old, "HL").otherwise("LL"))
    return swings.withColumn("swing_type", kind)


def with_swing_intern(swings: DataFrame) -> DataFrame:
    """Move since the previous swing as a percent of the move before it, snapped to the nine levels, and whether it is more."""
    p1, p2 = F.lag("price", 1).over(_legs()), F.lag("price", 2).over(_legs())
    percent = round_digits(F.greatest(F.lit(0.0), F.try_divide(F.abs(F.col("price") - p1), F.abs(p1 - p2)) * 100), 2)
    s = swings.withColumn("intern_percent", F.when(p2.isNotNull(), percent))
    snapped = snap_level("intern_percent", levels(DEFAULT_LEVELS))
    return s.withColumns({"intern_level": F.when(F.col("intern_percent").isNotNull(), snapped["level"]), "intern_extended": F.col("intern_percent") > 100})


def with_swing_extern(swings: DataFrame, depth: int = 13) -> DataFrame:
    """Against the older swings within `depth`: the first of the same kind that the swing doesn't exceed (else the oldest
    one exceeded) is the reference; the partner is the furthest swing of the other kind between; the percent is the
    move from the partner against that range, with the number of structures broken on the way."""
    item = F.struct("leg_id", "price")
    w = _legs().rowsBetween(-(depth - 1), -1)
    s = swings.withColumn("__before", F.reverse(F.collect_list(item).over(w)))
    sign = F.when(F.col("is_peak"), 1.0).otherwise(-1.0)
    same = F.filter("__before", lambda e: F.pmod(F.col("leg_id") - e["leg_id"], F.lit(2)) == 0)
    s = s.withColumns({"__sign": sign, "__same": same})
    holds = F.filter("__same", lambda e: e["price"] * F.col("__sign") >= F.col("price") * F.col("__sign"))
    s = s.withColumn("__ref", F.coalesce(F.try_element_at(holds, F.lit(1)), F.try_element_at("__same", F.lit(-1))))
    s = s.withColumn("extern_active", F.size(holds) > 0)
    broken = F.size(F.filter("__same", lambda e: (e["leg_id"] > F.col("__ref.leg_id")) & (e["price"] * F.col("__sign") < F.col("price") * F.col("__sign"))))
    between = F.filter("__before", lambda e: (F.pmod(F.col("leg_id") - e["leg_id"], F.lit(2)) == 1) & (e["leg_id"] > F.col("__ref.leg_id")))
    partner = F.array_min(F.transform(between, lambda e: e["price"] * F.col("__sign"))) * F.col("__sign")
    s = s.withColumns({"extern_broken": F.when(F.col("__ref").isNotNull(), broken), "__partner": partner})
    percent = round_digits(F.try_divide(F.abs(F.col("price") - F.col("__partner")), F.abs(F.col("__ref.price") - F.col("__partner"))) * 100, 2)
    s = s.withColumns({"extern_reference": F.col("__ref.leg_id"), "extern_percent": percent})
    s = s.withColumn("extern_level", F.when(F.col("extern_percent").isNotNull(), snap_level("extern_percent", levels(DEFAULT_LEVELS))["level"]))
    return s.drop("__before", "__sign", "__same", "__ref", "__partner")


def latest_k_swings(swings: DataFrame, k: int = 13) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("leg_id")))
    return swings.withColumn("slot", n - 1).where(F.col("slot") < k)


def structure_snapshot(bars: DataFrame, depth: int = 13, **stochastic) -> DataFrame:
    """As of every bar: symbol, tf, bar_ts, bar_idx, valid, slots (slot, is_peak, ts, idx, price, osc).

    Slot 0 is provisional: the lowest low or highest high from the last confirmed extremum's bar up to the last closed
    bar, the newest of equals; the other slots are confirmed swings, newest first, of which two on one bar count as the
    later. With fewer than depth - 1 of them the snapshot isn't valid.
    """
    b = with_stochastic(bars, **stochastic).withColumn("__osc", oscillator())
    s = swings(bars, **stochastic).where("confirmed")
    keep = 2 * depth - 1  # two legs at most share a bar
    held = F.collect_list(F.struct("leg_id", F.col("extremum_idx").alias("idx"), F.col("extremum_ts").alias("ts"), "is_peak", "price", "osc")).over(_legs().rowsBetween(-(keep - 1), 0))
    # the provisional extremum starts from the bars of the leg itself, from its extremum to the bar that confirms it
    value = lambda peak: F.when(peak, -F.col("low")).otherwise(F.col("high"))
    own = s.select(*KEYS, "confirm_idx", "is_peak", F.explode(F.sequence("extremum_idx", "confirm_idx")).alias("bar_idx")).join(b.select(*KEYS, "bar_idx", "bar_ts", "high", "low", "__osc"), [*KEYS, "bar_idx"])
    start = own.groupBy(*KEYS, "confirm_idx").agg(F.max(F.struct(value(F.col("is_peak")).alias("v"), F.col("bar_idx").alias("idx"), F.col("bar_ts").alias("ts"))).alias("__start"), F.max(F.when(F.col("is_peak"), -F.col("__osc")).otherwise(F.col("__osc"))).alias("__start_osc"))
    s = s.withColumn("held", held).groupBy(*KEYS, "confirm_idx").agg(F.max_by("held", "leg_id").alias("held"), F.max("leg_id").alias("__leg")).join(start, [*KEYS, "confirm_idx"])
    # a leg confirmed at bar c is seen from bar c + 1 on
    seen = b.join(s.withColumnRenamed("confirm_idx", "__c").withColumnsRenamed({k: f"__{k}" for k in KEYS}), (F.col("symbol") == F.col("__symbol")) & (F.col("tf") == F.col("__tf")) & (F.col("bar_idx") - 1 == F.col("__c")), "left").drop("__c", *(f"__{k}" for k in KEYS))
    so_far = _bars().rowsBetween(Window.unboundedPreceding, 0)
    now = seen.withColumns({"held": F.last("held", True).over(so_far), "__leg": F.last("__leg", True).over(so_far)})
    once = F.filter("held", lambda x: ~F.exists("held", lambda y: (y["idx"] == x["idx"]) & (y["leg_id"] > x["leg_id"])))
    now = now.withColumn("__done", F.slice(F.reverse(once), 1, depth - 1))
    now = now.withColumn("__peak", F.try_element_at("__done", F.lit(1))["is_peak"])
    # each later bar adds the bar before it, as a running maximum over the bars that see the same leg as the newest
    before = now.withColumns({"__before": F.lag(F.struct("high", "low", F.col("bar_idx").alias("idx"), F.col("bar_ts").alias("ts"), F.col("__osc").alias("osc"))).over(_bars())})
    bar = F.struct(F.when(F.col("__peak"), -F.col("__before.low")).otherwise(F.col("__before.high")).alias("v"), F.col("__before.idx").alias("idx"), F.col("__before.ts").alias("ts"))
    since = Window.partitionBy(*KEYS, "__leg").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    now = before.withColumns({
        "__top": F.max(F.coalesce("__start", bar)).over(since),
        "__osc_top": F.max(F.coalesce("__start_osc", F.when(F.col("__peak"), -F.col("__before.osc")).otherwise(F.col("__before.osc")))).over(since),
    })
    top, signed = F.col("__top"), lambda x: F.when(F.col("__peak"), -x).otherwise(x)
    first = F.struct(F.lit(0).alias("slot"), (~F.col("__peak")).alias("is_peak"), top["ts"].alias("ts"), top["idx"].alias("idx"), signed(top["v"]).alias("price"), signed(F.col("__osc_top")).alias("osc"))
    rest = F.transform("__done", lambda x, i: F.struct((i + 1).alias("slot"), x["is_peak"].alias("is_peak"), x["ts"].alias("ts"), x["idx"].alias("idx"), x["price"].alias("price"), x["osc"].alias("osc")))
    slots = F.when(F.col("__peak").isNotNull(), F.concat(F.array(first), rest))
    return now.select(*KEYS, "bar_ts", "bar_idx", (F.coalesce(F.size("__done"), F.lit(0)) >= depth - 1).alias("valid"), slots.alias("slots"))


def current_extremum(snapshot: DataFrame, confirmed: bool = False) -> DataFrame:
    """Slot 0 (or 1) of valid snapshots: symbol, tf, bar_ts, bar_idx, slot, is_peak, extremum_ts, extremum_idx, price, osc."""
    x = F.try_element_at("slots", F.lit(2 if confirmed else 1))
    s = snapshot.where("valid").withColumn("__x", x).where("__x.price > 0")
    return s.select(*KEYS, "bar_ts", "bar_idx", F.col("__x.slot").alias("slot"), F.col("__x.is_peak").alias("is_peak"), F.col("__x.ts").alias("extremum_ts"), F.col("__x.idx").alias("extremum_idx"), F.col("__x.price").alias("price"), F.col("__x.osc").alias("osc"))


def _fib(price: Column, peak_first: Column, a: Column, b: Column) -> Column:
    """Percent of a price in the range of two swings, of which the newer one (a) is a peak or a bottom."""
    return F.when(peak_first, trend_percent("bottom", price, a, b)).otherwise(trend_percent("peak", price, b, a))


def fib_levels5(snapshot: DataFrame, bars: DataFrame) -> DataFrame:
    """Four successive percents of the newest swings, snapped to the large set, and the raw percent of the close."""
    at = lambda i: F.try_element_at("slots", F.lit(i + 1))
    s = snapshot.where("valid").join(bars.select(*KEYS, "bar_idx", F.col("close").alias("__close")), [*KEYS, "bar_idx"])
    out = {}
    for k in range(4):
        p = _fib(at(k)["price"], at(k + 1)["is_peak"], at(k + 1)["price"], at(k + 2)["price"])
        out[f"fib_{k + 1}"] = F.when(p.isNotNull(), snap_level(p, levels(ALL_LEVELS))["level"])
    out["fib_live"] = _fib(F.col("__close"), at(1)["is_peak"], at(1)["price"], at(2)["price"])
    return s.select(*KEYS, "bar_ts", "bar_idx", *(v.alias(k) for k, v in out.items()))


def structure6(snapshot: DataFrame) -> DataFrame:
    """Types of the six newest slots, and time and price of the four newest."""
    at = lambda i: F.try_element_at("slots", F.lit(i + 1))

    def kind(i: int) -> Column:
        new, old = at(i)["price"], at(i + 2)["price"]
        up = F.when(at(i)["is_peak"], "HH").otherwise("HL")
        return F.when(old.isNull() | (new == old), "EQ").when(new > old, up).otherwise(F.when(at(i)["is_peak"], "LH").otherwise("LL"))

    types = F.array(*(kind(i) for i in range(6)))
    return snapshot.where("valid").select(*KEYS, "bar_ts", "bar_idx", types.alias("types"), F.concat_ws(",", F.slice(types, 1, 4)).alias("sequence"), *(at(i)[f].alias(f"{f}_{i}") for i in range(4) for f in ("ts", "price")))
