"""The signals of each source, one at a time: waiting for their trigger, running, ended.

What a bar does to a signal depends on what earlier bars did to it and to the signals before it: a source is tried again
after a stop or a failed confirmation, never while a signal of it runs, and no more after a target. Bars stream by in order,
and one signal of one source is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What tells one source from another, beside the strategy and direction that look at it.
SOURCE = ("symbol", "strategy_id", "direction", "slot", "is_peak", "extremum_ts", "price")
#: What a signal's life reads of a bar.
BAR = ("bar_ts", "bar_idx", "high_1", "low_1", "high", "low", "close", "eligible", "base_ok", "macro_ok", "last_idx")

#: ENDED: idle, but its strategy hasn't had a turn since the stop.
IDLE, PENDING, ACTIVE, CONSUMED, ENDED = range(5)


@dataclass
class Signal:
    """The newest signal of a source. Times are as the rows have them; an index of -1 is none."""

    attempt: int = 0
    status: int = IDLE
    signal_ts: object = None
    signal_idx: int = -1
    trigger: float = 0.0
    anchor: float = 0.0
    target: float = 0.0
    entry_ts: object = None
    entry_idx: int = -1
    entry_close: float = 0.0
    seen_idx: int = -1

    def step(self, sign: int, stop: float, bar: tuple, point: float, least_points: float, percent: float) -> tuple | None:
        """One more bar; the signal's row, if the bar ends it. A running signal whose source was another one for a while is
        handed on as if its source were over."""
        ts, i, high_1, low_1, high, low, close, eligible, base_ok, macro_ok, _ = bar
        edge = high_1 if sign > 0 else low_1
        if self.status in (PENDING, ACTIVE) and i != self.seen_idx + 1:
            out, self.status, self.seen_idx = self.row("EXPIRED" if self.status == PENDING else None), IDLE, i
            return out
        self.seen_idx = i
        if self.status == PENDING:
            # the trigger follows the closed bar's edge towards the stop, by more than a point and not up to the stop
            if (self.anchor - edge) * sign > point and (edge - stop) * sign > point and abs(edge - stop) / point >= least_points - 1e-7:
                self.anchor, self.target = edge, edge + (edge - stop) * (percent / 100)
            if (close - self.anchor) * sign > 0 and (close - edge) * sign > 0:
                if not (base_ok and macro_ok):
                    self.status = IDLE
                    return self.row("MACRO_EXPIRED" if base_ok else "BASE_EXPIRED", ts, i, close)
                self.status, self.entry_ts, self.entry_idx, self.entry_close = ACTIVE, ts, i, close
                self.target = close + sign * abs(close - stop) * (percent / 100)
        elif self.status == ACTIVE:
            return self.exit(sign, stop, bar)
        elif self.status == IDLE and eligible:
            self.attempt, self.status, self.signal_ts, self.signal_idx = self.attempt + 1, PENDING, ts, i
            self.trigger = self.anchor = edge
            self.target = edge + (edge - stop) * (percent / 100)
            self.entry_ts, self.entry_idx, self.entry_close = None, -1, 0.0
        return None

    def exit(self, sign: int, stop: float, bar: tuple) -> tuple | None:
        """The row of a running signal, if the bar ends it; the stop counts first."""
        ts, i, _, _, high, low, close = bar[:7]
        if (close - stop) * sign < 0:
            self.status = IDLE
            return self.row("SL", ts, i, close)
        if ((high if sign > 0 else low) - self.target) * sign >= 0:
            self.status = CONSUMED
            return self.row("TP", ts, i, close)
        return None

    def left(self, last_idx: int) -> tuple | None:
        """The signal's row when its source's bars are over, if it hasn't ended. One that runs has no outcome yet."""
        if self.status == PENDING:
            return self.row("PENDING" if self.seen_idx == last_idx else "EXPIRED")
        return self.row(None) if self.status == ACTIVE else None

    def row(self, outcome: str | None, ts: object = None, idx: int | None = None, close: float | None = None) -> tuple:
        entry = (self.entry_ts, self.entry_idx, self.entry_close) if self.entry_idx >= 0 else (None, None, None)
        return self.attempt, self.signal_ts, self.signal_idx, self.trigger, self.anchor, self.target, *entry, outcome, ts, idx, close, self.seen_idx


ATTEMPT = (
    "attempt int, bar_ts timestamp_ntz, bar_idx int, trigger double, anchor double, target double, entry_ts timestamp_ntz, entry_idx int, entry_close double, outcome string, exit_ts timestamp_ntz, exit_idx int, "
    "exit_close double, seen_idx int"
)


def source_signals(setups: DataFrame, point: float = 0.01, least_points: float = 5.0, percent: float = 100.0) -> DataFrame:
    """Signals of setups (SOURCE and BAR): SOURCE, and the columns of ATTEMPT.

    A bar makes a waiting signal where none waits or runs and no target was hit before. outcome: TP, SL, BASE_EXPIRED or
    MACRO_EXPIRED (the trigger was passed without the confirmation), EXPIRED (the source changed first), PENDING (it waits
    at the last bar), and null for one that runs when its source is over: from bar seen_idx on nothing else decides it.
    """
    rows = setups.select(*SOURCE, *BAR).repartition(*SOURCE).sortWithinPartitions(*SOURCE, "bar_idx")
    key_schema = ", ".join(f"{c} {t}" for c, t in rows.select(*SOURCE).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        key, signal, last_idx = None, Signal(), -1
        for batch in batches:
            if schema is None:
                kinds = (pa.int32(), pa.timestamp("us"), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.timestamp("us"), pa.int32(), pa.float64(), pa.string(), pa.timestamp("us"), pa.int32(), pa.float64(), pa.int32())
                names = [x.split(" ")[0] for x in ATTEMPT.split(", ")]
                schema = pa.schema([*(batch.schema.field(c) for c in SOURCE), *(pa.field(n, k) for n, k in zip(names, kinds))])
            out = []
            columns = [batch.column(c).to_pylist() for c in (*SOURCE, *BAR)]
            for row in zip(*columns):
                own, bar = row[: len(SOURCE)], row[len(SOURCE) :]
                if own != key:
                    if key is not None and (end := signal.left(last_idx)):
                        out.append((*key, *end))
                    key, signal, last_idx = own, Signal(), bar[-1]
                if end := signal.step(1 if own[2] == "BULLISH" else -1, own[6], bar, point, least_points, percent):
                    out.append((*key, *end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if key is not None and (end := signal.left(last_idx)):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, *end), schema)], schema=schema)

    return rows.mapInArrow(run, f"{key_schema}, {ATTEMPT}")


#: Bars of a span, and spans of a larger one.
FAN = 64


def levels_of(bars: DataFrame) -> int:
    """How many levels of spans a history needs so that its largest spans are FAN at most: the logarithm of its bars."""
    last, levels = bars.agg(F.max("bar_idx")).first()[0] or 0, 1
    while FAN**levels <= last:
        levels += 1
    return levels


def bar_spans(bars: DataFrame, levels: int) -> DataFrame:
    """Bars (level 0), spans of FAN bars, spans of FAN spans and so on, with the range of their closes and prices: symbol, level,
    span, parent (-1 on the highest level), close_low, close_high, low, high. Each level is a FAN-th of the one below."""
    b = bars.select("symbol", F.lit(0).alias("level"), F.col("bar_idx").cast("long").alias("span"), F.col("close").alias("close_low"), F.col("close").alias("close_high"), "low", "high")
    out = b
    for k in range(1, levels):
        b = b.groupBy("symbol", F.floor(F.col("span") / FAN).alias("span")).agg(F.lit(k).alias("level"), F.min("close_low").alias("close_low"), F.max("close_high").alias("close_high"), F.min("low").alias("low"), F.max("high").alias("high"))
        out = out.unionByName(b)
    return out.withColumn("parent", F.when(F.col("level") < levels - 1, F.floor(F.col("span") / FAN)).otherwise(F.lit(-1)))


def first_bar(queries: DataFrame, keys: tuple[str, ...], bars: DataFrame, after: str, hit) -> DataFrame:
    """The number of the first bar of its symbol after bar `after` for which hit(close_low, close_high, low, high) holds:
    keys, hit_idx. Queries without one are left out.

    On each level the later spans under the own one's parent are looked at, and the first that has a hit is opened down to a
    bar: whatever the history and however far away the hit is, a query meets FAN rows a level, and levels grow with the
    logarithm of the history. hit must say of a span's range whether one of its bars hits.
    """
    levels = levels_of(bars)
    spans = bar_spans(bars, levels).select(F.col("symbol").alias("__s"), F.col("level").alias("__l"), F.col("span").alias("__span"), F.col("parent").alias("__parent"), *(F.col(c).alias(f"__{c}") for c in ("close_low", "close_high", "low", "high")))
    hits = hit(*(F.col(f"__{c}") for c in ("close_low", "close_high", "low", "high")))
    met = lambda q, level: q.join(spans, (F.col("symbol") == F.col("__s")) & (level == F.col("__l")) & (F.col("__look") == F.col("__parent")) & hits)
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col(after) / FAN**k).alias("own"), (F.floor(F.col(after) / FAN ** (k + 1)) if k < levels - 1 else F.lit(-1)).alias("look")) for k in range(levels))))
    q = queries.withColumn("__step", steps).withColumns({"__look": F.col("__step.look"), "__own": F.col("__step.own")})
    found = met(q, F.col("__step.level")).where("__span > __own").groupBy(*keys).agg(F.min(F.struct("__l", "__span")).alias("__at"))
    for k in range(levels - 1, 0, -1):
        named = queries.join(found.withColumnsRenamed({c: f"__k_{c}" for c in keys}), [F.col(c) == F.col(f"__k_{c}") for c in keys]).drop(*(f"__k_{c}" for c in keys))
        upper = met(named.where(F.col("__at.__l") == k).withColumn("__look", F.col("__at.__span")), F.lit(k - 1)).groupBy(*keys).agg(F.min(F.struct("__l", "__span")).alias("__at"))
        found = found.where(F.col("__at.__l") < k).unionByName(upper)
    return found.select(*keys, F.col("__at.__span").cast("int").alias("hit_idx"))
