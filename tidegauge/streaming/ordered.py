"""Rows of a key in the order of their time on a stream, and states that end by time.

Spark hands a stateful operator each micro-batch's rows in any order, and rows of a later one may be earlier. Ordered holds
them, as rows of their own in the state store, until the watermark passes them, and hands them on in order: rows that come
late by no more than the watermark's delay change no result. Later ones Spark leaves out, and LateRows counts. States have
fields, so that the state store can be read and they can be told apart in it. What ends at a time (a day's counts, a
week's lock) ends by a timer when the watermark passes, whether or not another row comes.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Where states with lists, maps and timers can be held.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Machine:
    """What a key does with its rows.

    state: the state's fields (DDL), first: a new key's. step(key, state, row) gives the next state and rows to hand on, each
    without the key, of the fields `out` (DDL; times are microseconds). row has the time as `us`, and the other columns by
    name. ends(state) is the time at which the state ends, or None; end(key, state) then gives the state after it (None:
    nothing is held) and rows to hand on.
    """

    state: str
    first: tuple
    out: str
    step: Callable[[tuple, tuple, tuple], tuple[tuple, list[tuple]]]
    ends: Callable[[tuple], int | None] = lambda state: None
    end: Callable[[tuple, tuple], tuple[tuple | None, list[tuple]]] = lambda key, state: (None, [])


class Ordered(StatefulProcessor):
    """A Machine's rows of a key, in order of time and then of the `ties`."""

    def __init__(self, machine: Machine, columns: list[str], kinds: str, ties: int, out: list[str]):
        self.machine, self.columns, self.kinds, self.ties, self.out = machine, columns, kinds, ties, out

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.kinds)
        self.own = handle.getValueState("own", self.machine.state)
        self.due = handle.getValueState("due", "at_ms long")
        self.row = namedtuple("Tick", self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if new:
            self.held.appendList(new)
            due = self.due.get()[0] if self.due.exists() else None
            self.due.update((self._wake(due, min(r[0] for r in new)),))
        return iter(())

    def _wake(self, due: int | None, us: int) -> int:
        """Be called once the watermark has passed a time, or an earlier one that was asked for before."""
        at = us // 1000 + 1
        if due is not None and due <= at:
            return due
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for r in self.held.get():
            (ready if r[0] <= passed else rest).append(r)
        if ready:
            self.held.put(rest) if rest else self.held.clear()
        ready.sort(key=lambda r: [(x is not None, x) for x in r[: 1 + self.ties]])
        state = tuple(self.own.get()) if self.own.exists() else None
        machine, out = self.machine, []

        def ended_by(us: int) -> None:
            nonlocal state
            while state is not None and (at := machine.ends(state)) is not None and at <= us:
                state, rows = machine.end(key, state)
                out.extend(rows)

        for r in ready:
            ended_by(r[0])
            state, rows = machine.step(key, machine.first if state is None else state, self.row(*r))
            out.extend(rows)
        ended_by(passed)
        if state is None:
            self.own.clear()
        else:
            self.own.update(state)
        later = [r[0] for r in rest]
        if state is not None and (at := machine.ends(state)) is not None:
            later.append(at)
        if later:
            self.due.update((self._wake(None, min(later)),))
        else:
            self.due.clear()
        for row in out:
            yield Row(**dict(zip(self.out, (*key, *row))))

    def close(self) -> None:
        pass


def event_time(rows: DataFrame, time: str, late: str | None) -> DataFrame:
    """Rows with a watermark; None leaves the one that they have."""
    if late is None:
        return rows
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def keyed(rows: DataFrame):
    """Groups for transformWithState, which needs a state store with lists, maps and timers. A query that runs on from a
    checkpoint keeps the store that it began with."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows


def ordered(rows: DataFrame, keys: tuple[str, ...], time: str, ties: tuple[str, ...], columns: tuple[str, ...], machine: Machine, late: str | None, times: tuple[str, ...] = ()) -> DataFrame:
    """Keys and machine.out of streaming rows, whose `time` may be late by `late`; rows without a time are left out. Of the result
    the columns in `times` are microseconds that become timestamps. A row comes out once the watermark has passed it."""
    w = event_time(rows.where(F.col(time).isNotNull()), time, late).withColumn("us", F.unix_micros(time))
    held = ["us", *ties, *(c for c in columns if c not in ties)]
    w = w.select(*keys, *([time] if time not in (*keys, *held) else []), *held)
    kinds = dict(w.dtypes)
    names = [*keys, *(x.strip().split(" ")[0] for x in _fields(machine.out))]
    processor = Ordered(machine, held, ", ".join(f"{c} {kinds[c]}" for c in held), len(ties), names)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), machine.out])
    out = keyed(w).groupBy(*keys).transformWithState(processor, schema, "append", "eventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in times})


def _fields(ddl: str) -> list[str]:
    """The fields of a DDL string of plain types."""
    return [x for x in ddl.split(",") if x.strip()]


class LateRows(StreamingQueryListener):
    """Counts the rows that came after the watermark had passed them, by the name of the query: spark.streams.addListener(...)."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class SourceState(StatefulProcessor):
    """Of each source of a key: attempts, first time, outcome that ended it and when. A source is forgotten `ttl_ms` after its last
    event: of event time by timers (to the minute), or of the clock by the state store itself."""

    OUT = "source_key string, attempts long, first_us long, consumed boolean, consumed_us long"
    MINUTE = 60_000

    def __init__(self, key: str, ttl_ms: int, by_clock: bool):
        self.key, self.ttl_ms, self.by_clock = key, ttl_ms, by_clock

    def init(self, handle) -> None:
        self.handle = handle
        ttl = self.ttl_ms if self.by_clock else None
        self.sources = handle.getMapState("sources", "source_key string", "attempts long, first_us long, consumed_us long, until_ms long", ttl)
        if not self.by_clock:
            self.leaving = handle.getMapState("leaving", "until_ms long", "source_keys array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changed: dict[str, list] = {}
        for r in rows:
            name, us = r["source_key"], r["us"]
            if name not in changed:
                known = self.sources.getValue((name,)) if self.sources.containsKey((name,)) else (0, None, None, 0)
                changed[name] = [*known, known[3]]
            now = changed[name]
            if r["event"] == "ATTEMPT":
                now[0] += 1
                now[1] = us if now[1] is None else min(now[1], us)
            elif r["event"] == "TP":
                now[2] = us if now[2] is None else min(now[2], us)
            now[3] = max(now[3], -(-(us // 1000 + self.ttl_ms) // self.MINUTE) * self.MINUTE)
        for name, (attempts, first, consumed, until, before) in changed.items():
            self.sources.updateValue((name,), (attempts, first, consumed, until))
            if not self.by_clock and until != before:
                others = self.leaving.getValue((until,))[0] if self.leaving.containsKey((until,)) else []
                self.leaving.updateValue((until,), ([*others, name],))
                self.handle.registerTimer(until)
            # a target ends a source even where its attempt was never seen
            yield Row(**{self.key: key[0], "source_key": name, "attempts": attempts if consumed is None else max(attempts, 1), "first_us": first, "consumed": consumed is not None, "consumed_us": consumed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        if self.leaving.containsKey((until,)):
            for name in self.leaving.getValue((until,))[0]:
                if self.sources.containsKey((name,)) and self.sources.getValue((name,))[3] == until:
                    self.sources.removeKey((name,))
            self.leaving.removeKey((until,))
        return iter(())

    def close(self) -> None:
        pass
