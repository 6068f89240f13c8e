"""Entries and execution levels on the grid of a structure's Fibonacci levels, as Columns.

A structure is a peak and a bottom; is_bottom says that its current extremum is a bottom, so that percents count from the peak
down, and else from the bottom up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import fib
from tidegauge.functions.scalars import _c, enforce_distance, is_direction, step_direction

#: What levels may miss by rounding.
EPS = 1e-4


def direction_percent(direction: str, entry: Column | str, peak: Column | str, bottom: Column | str, at: Column | None = None) -> Column:
    """Percent of an entry between a peak and a bottom: BULLISH from the peak down, BEARISH from the bottom up; with levels,
    the level that it has reached."""
    p = fib.trend_percent("bottom" if direction == "BULLISH" else "peak", entry, peak, bottom)
    return p if at is None else F.when(p.isNotNull(), fib.snap_level(p, at)["level"])


def structure_range(slots: Column | str) -> Column:
    """struct(peak, bottom, is_bottom) of a snapshot's slots 1 and 2; null unless they are of two kinds, above 0 and apart."""
    one, two = F.try_element_at(_c(slots), F.lit(2)), F.try_element_at(_c(slots), F.lit(3))
    bottom = ~two["is_peak"]
    peak, low = F.when(bottom, one["price"]).otherwise(two["price"]), F.when(bottom, two["price"]).otherwise(one["price"])
    ok = (one["is_peak"] != two["is_peak"]) & (peak > 0) & (low > 0) & (peak != low)
    return F.when(ok, F.struct(peak.alias("peak"), low.alias("bottom"), bottom.alias("is_bottom")))


def orientation_matches(direction: Column | str, is_bottom: Column | str) -> Column:
    return F.when(_c(direction) == "BULLISH", _c(is_bottom)).when(_c(direction) == "BEARISH", ~_c(is_bottom)).otherwise(True)


def directional_target(direction: Column | str, is_bottom: Column | str, low: Column | str, high: Column | str) -> Column:
    """The end of a band towards which levels go: the upper one where they rise, the lower one where they fall."""
    step = step_direction(direction, is_bottom)
    return F.when(step > 0, _c(high)).when(step < 0, _c(low))


def entry_band(price: Column | str, is_bottom: Column | str, peak: Column | str, bottom: Column | str, at: Column) -> Column:
    """struct(percent, low, high): a price's percent of the structure and the half-open band around it; null below 0."""
    p = F.when(_c(price) > 0, fib.structure_percent(price, is_bottom, peak, bottom))
    band = fib.fib_band(p, at)
    return F.when(p.isNotNull(), F.struct(p.alias("percent"), band["low"].alias("low"), band["high"].alias("high")))


def canonical_percent(price: Column | str, direction: Column | str, is_bottom: Column | str, peak: Column | str, bottom: Column | str, at: Column, limit: bool = True) -> Column:
    """The percent from which levels are counted: of a limit entry the directional end of its band (the strict one, or the
    half-open one where there is none) where both ends have a price, else the entry's own."""
    own = F.when(_c(price) > 0, fib.structure_percent(price, is_bottom, peak, bottom))
    if not limit:
        return own

    def counted(own: Column, band: Column) -> Column:
        priced = fib.structure_price(band["low"], is_bottom, peak, bottom).isNotNull() & fib.structure_price(band["high"], is_bottom, peak, bottom).isNotNull()
        return F.coalesce(F.when(priced, directional_target(direction, is_bottom, band["low"], band["high"])), own)

    ends = lambda strict, plain: F.struct(F.coalesce(strict["low"], plain["low"]).alias("low"), F.coalesce(strict["high"], plain["high"]).alias("high"))
    band = lambda own: fib.bound(F.struct(fib.fib_band_strict(own, at).alias("s"), fib.fib_band(own, at).alias("p")), lambda b: ends(b["s"], b["p"]))
    return fib.bound(own, lambda v: fib.bound(band(v), lambda b: counted(v, b)))


def next_level(percent: Column | str, steps: Column | int, direction: Column | str, is_bottom: Column | str, at: tuple[float, ...]) -> Column:
    """The percent so many levels further on, up or down as direction and orientation say."""
    step = step_direction(direction, is_bottom)
    return F.when(step > 0, fib.fib_next_cycled(percent, steps, True, at)).when(step < 0, fib.fib_next_cycled(percent, steps, False, at))


def level_grid(canonical: Column | str, direction: Column | str, is_bottom: Column | str, peak: Column | str, bottom: Column | str, at: tuple[float, ...], n: int, offset: int = 1) -> Column:
    """array of struct(level, percent, price) of execution levels 0 to n - 1: offset + level steps from the entry's canonical
    percent, one at least. The price is null where it isn't above 0."""
    items = []
    for k in range(n):
        percent = next_level(canonical, max(offset + k, 1), direction, is_bottom, at)
        items.append(F.struct(F.lit(k).alias("level"), percent.alias("percent"), fib.structure_price(percent, is_bottom, peak, bottom).alias("price")))
    return F.array(*items)


def base_distance(
    entry: Column | str, canonical: Column | str, direction: Column | str, is_bottom: Column | str, peak: Column | str, bottom: Column | str, at: tuple[float, ...], point: float, least: Column, tick: float, range_points: float = 0.0
) -> Column:
    """struct(steps, points): the first step, of the number of levels and ten more, whose price is at least range_points away
    from the entry, and its distance, at least the broker's. With range_points 0 the first step counts, however near. Null
    where no step is far enough or it has no price."""
    e = _c(entry)

    def at_step(n: Column) -> Column:
        price = fib.structure_price(next_level(canonical, n, direction, is_bottom, at), is_bottom, peak, bottom)
        return F.struct(n.alias("steps"), (F.abs(e - price) / point).alias("points"))

    if range_points > 0:

        def onward(done: Column, n: Column) -> Column:
            def at_percent(percent: Column, points: Column) -> Column:
                far = points >= range_points
                return F.struct(percent.alias("percent"), F.when(far, n).alias("steps"), F.when(far, points).alias("points"))

            away = lambda percent: F.abs(e - fib.structure_price(percent, is_bottom, peak, bottom)) / point
            following = fib.bound(next_level(done["percent"], 1, direction, is_bottom, at), lambda v: fib.bound(away(v), lambda d: at_percent(v, d)))
            return F.when(done["steps"].isNotNull(), done).otherwise(following)  # what is found stays

        start = F.struct(_c(canonical).cast("double").alias("percent"), F.lit(None).cast("int").alias("steps"), F.lit(None).cast("double").alias("points"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(len(at) + 10)), start, onward)
    else:
        found = at_step(F.lit(1))
    points = lambda f: enforce_distance(f["points"], least, F.lit(tick), F.lit(point))
    return fib.bound(found, lambda f: F.when((e > 0) & f["points"].isNotNull(), F.struct(f["steps"].alias("steps"), points(f).alias("points"))))


def beyond_levels(percent: Column | str, direction: Column | str, is_bottom: Column | str, at: tuple[float, ...]) -> Column:
    """Whether the level after a percent leaves the levels' own range: such an entry would have no stop of its own."""
    following = next_level(percent, 1, direction, is_bottom, at)
    return F.coalesce((following < min(at) - EPS) | (following > max(at) + EPS), F.lit(False))


def with_zone_entry(rows: DataFrame, out: str, at: tuple[float, ...], required_points: Column, point: float, limit: bool = True, guard: bool = False) -> DataFrame:
    """Add struct(in_zone, percent, price): whether each bar (direction, close, low, high, is_bottom, peak, bottom) enters its
    structure's range, and where.

    The close's band counts, else that of the bar's low (of its high for bears). Directions against the orientation, a close
    below 0 percent, bands narrower than required_points and, with `guard`, entries whose next level is beyond all levels
    don't enter. A limit entry lies at the directional end of the band, on the close's near side; others at the close.
    Each step is a column of its own, so that it is computed once.
    """
    levels, own = fib.levels(at), ("is_bottom", "peak", "bottom")
    bull = F.col("direction") == "BULLISH"
    r = rows.withColumns({"__p": fib.structure_percent("close", *own), "__x": fib.structure_percent(F.when(bull, F.col("low")).otherwise(F.col("high")), *own)})
    r = r.withColumns({"__band": fib.fib_band_strict("__p", levels), "__beside": fib.fib_band_strict(F.coalesce("__x", "__p"), levels)})
    r = r.withColumn("__band", F.coalesce("__band", "__beside"))
    r = r.withColumns({"__low": fib.structure_price("__band.low", *own), "__high": fib.structure_price("__band.high", *own), "__target": directional_target("direction", "is_bottom", "__band.low", "__band.high")})
    wide = F.coalesce(F.abs(F.col("__low") - F.col("__high")) / point >= required_points, F.lit(True))
    ok = orientation_matches("direction", "is_bottom") & is_direction("direction") & F.col("__p").isNotNull() & F.col("__band").isNotNull() & wide
    price, percent = F.col("close"), F.col("__p")
    if limit:
        percent, price = F.col("__target"), F.when(F.col("__low").isNotNull() & F.col("__high").isNotNull(), fib.structure_price("__target", *own))
        if guard:
            r = r.withColumn("__beyond", beyond_levels("__target", "direction", "is_bottom", at))
            ok = ok & ~F.col("__beyond")
        ok = ok & F.when(bull, price <= F.col("close")).otherwise(price >= F.col("close"))
    r = r.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    entry = F.struct(F.col("__ok").alias("in_zone"), F.when(F.col("__ok"), percent).alias("percent"), F.when(F.col("__ok"), price).alias("price"))
    return r.withColumn(out, entry).drop("__p", "__x", "__band", "__beside", "__low", "__high", "__target", "__beyond", "__ok")
