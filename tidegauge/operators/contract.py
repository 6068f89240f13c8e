"""Indicators by one definition, for histories and for streams.

An Indicator says what it holds of the bars so far and what a bar adds to that. On streams a symbol's state goes from one
micro-batch to the next; in batch the same step folds the bars in order, or, where the indicator is one that windows can
say, its windows are used. A fold whose result depends on a bounded number of bars runs on spans of the history apart.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import windows
from tidegauge.streaming.ordered import Machine, ordered

INPUTS = ("open", "high", "low", "close")
_ARROW = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


@dataclass(frozen=True)
class Indicator:
    """state (DDL) and first, what a new symbol holds; step(state, bar) gives the next state and the values of `out` (DDL of plain
    types). bar has open, high, low, close and bar_idx. reach: after how many bars a bar changes nothing any more, or None if it
    always may. over: the same as windows over bars, if windows can say it."""

    out: str
    state: str
    first: tuple
    step: Callable[[tuple, tuple], tuple[tuple, tuple]]
    reach: int | None = None
    over: Callable[[DataFrame], DataFrame] | None = None

    def names(self) -> list[str]:
        return [x.strip().split(" ")[0] for x in self.out.split(",")]


def on_bars(indicator: Indicator, bars: DataFrame, windows_too: bool = True, size: int = 100_000) -> DataFrame:
    """Bars with the indicator's columns: by its windows, or by folding each symbol's bars in order. With a reach, spans of `size`
    bars are folded apart, each from `reach` bars before it on; without, a symbol's bars stream through one task."""
    if indicator.over and windows_too:
        return indicator.over(bars)
    if indicator.reach is not None:
        return windows.in_chunks(bars, lambda b: _folded(indicator, b), indicator.reach, size)
    return _folded(indicator, bars)


def _folded(indicator: Indicator, bars: DataFrame) -> DataFrame:
    rows = bars.repartition("symbol", "tf").sortWithinPartitions("symbol", "tf", "bar_idx")
    names, step, first = indicator.names(), indicator.step, indicator.first
    kinds = [_ARROW[x.strip().split(" ")[1]] for x in indicator.out.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, bar_of = None, first, namedtuple("Bar", (*INPUTS, "bar_idx"))
        for batch in batches:
            values = []
            for *own, a, b, c, d, i in zip(*(batch.column(x).to_pylist() for x in ("symbol", "tf", *INPUTS, "bar_idx"))):
                if own != key:
                    key, state = own, first
                state, found = step(state, bar_of(a, b, c, d, i))
                values.append(found)
            columns = [pa.array([v[k] for v in values], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    ddl = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return rows.mapInArrow(run, f"{ddl}, {indicator.out}")


def on_stream(indicator: Indicator, bars: DataFrame, late: str = "0 seconds") -> DataFrame:
    """symbol, bar_ts, bar_idx and the indicator's columns of streaming bars (symbol, bar_ts, bar_idx, open, high, low, close)."""
    step = lambda key, state, r: (lambda now, found: (now, [(r.us, r.bar_idx, *found)]))(*indicator.step(state, r))
    machine = Machine(indicator.state, indicator.first, f"bar_ts long, bar_idx int, {indicator.out}", step)
    return ordered(bars, ("symbol",), "bar_ts", ("bar_idx",), INPUTS, machine, late, ("bar_ts",))


def _mean(values: list[float]) -> float:
    """From the oldest on, as windows add up; sum() rounds otherwise."""
    total = 0.0
    for x in values:
        total += x
    return total / len(values)


def atr(n: int = 14) -> Indicator:
    """Mean true range of the last n bars; null for the first n."""

    def step(state: tuple, r: tuple) -> tuple[tuple, tuple]:
        before, ranges = state
        ranges = [*ranges, 0.0 if before is None else max(r.high, before) - min(r.low, before)][-n:]
        return (r.close, ranges), (_mean(ranges) if r.bar_idx >= n else None,)

    return Indicator("atr double", "close double, ranges array<double>", (None, []), step, n + 1, lambda b: windows.with_true_range(b).withColumn("atr", windows.atr(n)).drop("true_range"))


def stochastic(k: int = 5, d: int = 3, slow: int = 3, point: float = 0.01) -> Indicator:
    """stoch_k of closes and its mean stoch_d, see windows.with_stochastic."""

    def step(state: tuple, r: tuple) -> tuple[tuple, tuple]:
        ticks, above, width, values = state
        tick = int((r.close / point + 0.5) // 1)
        ticks = [*ticks, tick][-k:]
        if r.bar_idx >= k - 1:
            above, width = [*above, tick - min(ticks)][-slow:], [*width, max(ticks) - min(ticks)][-slow:]
        value = None
        if r.bar_idx >= k + slow - 2:
            value = sum(above) * 100.0 / sum(width) if sum(width) else 100.0
            values = [*values, value][-d:]
        return (ticks, above, width, values), (value, _mean(values) if r.bar_idx >= k + slow + d - 3 else None)

    return Indicator("stoch_k double, stoch_d double", "ticks array<long>, above array<long>, width array<long>, k array<double>", ([], [], [], []), step, k + slow + d, lambda b: windows.with_stochastic(b, k, d, slow, point=point))


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Indicator:
    """Difference of two exponential means of closes (0 before bar `slow`), and its mean over `signal` bars, see windows.with_macd."""

    def step(state: tuple, r: tuple) -> tuple[tuple, tuple]:
        means, held = state
        means = [r.close if not means else 2 / (n + 1) * r.close + (1 - 2 / (n + 1)) * means[i] for i, n in enumerate((fast, slow))]
        held = [*held, means[0] - means[1] if r.bar_idx >= slow else 0.0][-signal:]
        return (means, held), (held[-1], _mean(held) if r.bar_idx >= signal - 1 else None)

    return Indicator("macd double, macd_signal double", "means array<double>, held array<double>", ([], []), step, None, lambda b: windows.with_macd(b, fast, slow, signal))


def changes_up(n: int) -> Indicator:
    """Share of the last n closes above the one before them, in percent; null for the first n. No windows: an example of one's own."""

    def step(state: tuple, r: tuple) -> tuple[tuple, tuple]:
        closes = [*state[0], r.close][-(n + 1) :]
        return (closes,), (100.0 * sum(b > a for a, b in pairwise(closes)) / n if r.bar_idx >= n else None,)

    return Indicator("up_percent double", "closes array<double>", ([],), step, n + 1)
