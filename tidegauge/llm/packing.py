"""Packing of documents into sequences by swap-based local search.

Every task tokenizes its documents and packs their pieces by best fit; then local search exchanges one piece for one, two
for one, or moves a piece between underfull sequences, as long as the sum of squared fills grows, until sequences empty.
Sequences that still have room give their pieces up to a second round over all tasks' left-overs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import text_tokens
from tidegauge.llm.common import batched, rows_of, saved

#: Pieces that one packing problem holds; bounds memory and time of a task.
GROUP = 8192
#: A sequence with more room than 1/SLACK of its size gives its pieces to the second round.
SLACK = 128

_PIECES = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())])
_PIECES_DDL = "id long, key long, piece int, start long, length long, ids_crc32 long, sequence long, offset long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all of them are full but the first, which may be shorter."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes into lengths: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by the room they have
    rooms: list[int] = []  # the rooms that some bin has, sorted
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, k = size, len(bins)
            bins.append([])
        bins[k].append(i)
        left = room - n
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(k)
    return bins


class LocalSearch:
    """Bins whose sum of squared fills grows with each exchange, until none is left that makes it grow; emptied bins go.

    A bin has few distinct lengths (44 at most of 1024 tokens), over which all searches run.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.held: list[dict[int, list[int]]] = []  # pieces of each bin by their length
        for b in bins:
            own: dict[int, list[int]] = {}
            for i in b:
                own.setdefault(lengths[i], []).append(i)
            self.held.append(own)
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.sorted = [sorted(own) for own in self.held]

    def _exchange(self, a: int, out: tuple[int, ...], b: int, into: tuple[int, ...]) -> None:
        """Pieces of the lengths `out` leave bin a for bin b, of the lengths `into` b for a."""
        moved = [(b, n, self.held[a][n].pop()) for n in out] + [(a, n, self.held[b][n].pop()) for n in into]
        for k, n, i in moved:
            self.held[k].setdefault(n, []).append(i)
            self.fill[k] += n
            self.fill[a + b - k] -= n
        for k in (a, b):
            self.held[k] = {n: own for n, own in self.held[k].items() if own}
            self.sorted[k] = sorted(self.held[k])

    def _best(self, a: int, b: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange that fills b most at a's cost: a move, one for one, two for one or one for two.

        b is at least as full as a, so that any gain g > 0 of b raises the sum of squares by 2 g (fill b - fill a + g).
        """
        room, mine, theirs = self.size - self.fill[b], self.sorted[a], self.sorted[b]
        best, found = 0, None
        at = bisect_right(mine, room)
        if at and mine[at - 1] > best:
            best, found = mine[at - 1], ((mine[at - 1],), ())
        several, more = [n for n in mine if len(self.held[a][n]) > 1], [n for n in theirs if len(self.held[b][n]) > 1]
        for n in theirs:
            if best == room:
                return best, *found
            at = bisect_right(mine, n + room)
            if at and mine[at - 1] - n > best:
                best, found = mine[at - 1] - n, ((mine[at - 1],), (n,))
            two = _two(mine, several, n + best + 1, n + room, True)
            if two:
                best, found = sum(two) - n, (two, (n,))
        for n in mine:
            if best == room:
                break
            two = _two(theirs, more, n - room, n - best - 1, False)
            if two:
                best, found = n - sum(two), ((n,), two)
        return (best, *found) if found else None

    def run(self) -> list[list[int]]:
        """Empty the emptiest bins one after the other into the fullest of the underfull ones, as far as exchanges go.

        A bin that found none is tried again with those that have changed since.
        """
        open_ = sorted((k for k in range(len(self.held)) if 0 < self.fill[k] < self.size), key=self.fill.__getitem__)
        changed, tried, clock = dict.fromkeys(open_, 1), dict.fromkeys(open_, 0), 1
        again = True
        while again:
            again = False
            for a in sorted(open_, key=self.fill.__getitem__):
                mine = changed[a] > tried[a]
                partners = sorted((b for b in open_ if b != a and (mine or changed[b] > tried[a])), key=lambda b: -self.fill[b])
                tried[a] = clock
                for b in partners:
                    if self.fill[b] < self.fill[a] or not 0 < self.fill[b] < self.size:
                        continue
                    if got := self._best(a, b):
                        self._exchange(a, got[1], b, got[2])
                        clock += 1
                        changed[a] = changed[b] = clock
                        again = True
                        if not self.fill[a]:
                            break
            open_ = [k for k in open_ if 0 < self.fill[k] < self.size]
        return [[i for own in b.values() for i in own] for b in self.held if b]


def _two(lengths: list[int], several: list[int], least: int, most: int, largest: bool) -> tuple[int, int] | None:
    """Two of the sorted distinct lengths (one of `several` may count twice) with the largest or smallest sum from least to most."""
    if most < least:
        return None
    best, found = (least - 1, None) if largest else (most + 1, None)
    lo, hi = 0, len(lengths) - 1
    while lo < hi:
        total = lengths[lo] + lengths[hi]
        if largest:
            if best < total <= most:
                best, found = total, (lengths[lo], lengths[hi])
        elif least <= total < best:
            best, found = total, (lengths[lo], lengths[hi])
        if total > most or (not largest and total > least):
            hi -= 1
        else:
            lo += 1
    for n in several:
        if best < 2 * n <= most if largest else least <= 2 * n < best:
            best, found = 2 * n, (n, n)
    return found


def pack(lengths: list[int], size: int) -> list[list[int]]:
    return LocalSearch(best_fit(lengths, size), lengths, size).run()


def _placed(group: list[tuple], size: int) -> Iterator[tuple]:
    """Pieces (id, key, piece, start, length, crc) with their sequence, which has the key of its first piece, and offset."""
    for members in pack([p[4] for p in group], size):
        first, at = group[members[0]][1], 0
        for i in members:
            yield (*group[i], first, at)
            at += group[i][4]


def _in_groups(pieces: Iterator[tuple], size: int) -> Iterator[tuple]:
    held: list[tuple] = []
    for p in pieces:
        if p[4] == size:
            yield (*p, p[1], 0)
            continue
        held.append(p)
        if len(held) >= GROUP:
            yield from _placed(held, size)
            held = []
    if held:
        yield from _placed(held, size)


def _first_round(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key = text_tokens(path), TaskContext.get().partitionId() << 33

        def pieces() -> Iterator[tuple]:
            nonlocal key
            for name, text in rows_of(batches, "id", "text"):
                ids = np.append(encoder.encode(text or ""), np.array([end_id], "<u4"))
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    yield name, key, k, start, n, zlib.crc32(ids[start : start + n])
                    key += 1

        yield from batched(_in_groups(pieces(), size), _PIECES)

    return run


def _second_round(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(_in_groups(rows_of(batches, "id", "key", "piece", "start", "length", "ids_crc32"), size), _PIECES)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document stands: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then end_id; null and empty texts are the end id alone. Documents longer than `size`
    are cut into pieces of `size` ids, the first of which may be shorter; others stay whole. Sequences hold at most `size`
    ids, gapless from offset 0. Those with more room than `size` / SLACK give their pieces to the second round; fuller ones stay as
    they are (a parameter of this module: 8 of 1024 tokens). They are numbered by the task and count of their first piece, so that no two share a number.
    Rows that repeat an id are documents of their own; null ids stay null. Other columns aren't read. An empty table gives
    an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = saved(source.mapInArrow(_first_round(tokenizer_path, end_id, size), _PIECES_DDL), "pieces")
    fills = first.groupBy("sequence").agg(F.sum("length").alias("fill")).where(F.col("fill") < size - size // SLACK).select(F.col("sequence").alias("open"))
    loose = saved(first.join(fills, F.col("sequence") == F.col("open"), "left_semi"), "loose")
    groups = max(1, -(-loose.count() // (4 * GROUP)))
    again = loose.repartition(groups, F.xxhash64("key")).mapInArrow(_second_round(size), _PIECES_DDL)
    placed = first.join(fills, F.col("sequence") == F.col("open"), "left_anti").unionByName(again)
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids and ids, in order of offset.

    Needs ids of docs to be distinct. Groups are of one sequence and so bounded by its size.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_tokens(tokenizer_path)
        schema = pa.schema([("sequence_id", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

        def rows() -> Iterator[tuple]:
            for key, text, own in rows_of(batches, "id", "text", "pieces"):
                ids = np.append(encoder.encode(text or ""), np.array([end_id], "<u4"))
                for p in own:
                    yield p["sequence_id"], key, p["offset"], ids[p["start"] : p["start"] + p["length"]].tobytes()

        yield from batched(rows(), schema, 512)

    own = placed.groupBy(F.col(id_col).alias("own")).agg(F.collect_list(F.struct("sequence_id", "start", "length", "offset")).alias("pieces"))
    cuts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(own, F.col("id") == F.col("own")).select("id", "text", "pieces")
    parts = cuts.mapInArrow(encode, "sequence_id long, doc_id long, offset long, ids binary")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return parts.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.aggregate("parts.ids", F.lit(b""), lambda done, x: F.concat(done, x)).alias("ids"))
