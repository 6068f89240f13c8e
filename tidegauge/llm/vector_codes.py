"""Vectors as short codes: each part of a vector by the number of the nearest entry of its part's codebook.

Codebooks are fitted on all vectors, in whole numbers, so that the result is the same however the rows are dealt to tasks. Few
parts change their entry from one round to the next: each part keeps its b closest entries in order, an upper bound of its
distance to the first, lower bounds to the others, and one outer bound below its distance to any entry that isn't listed. A
round moves the bounds by as much as the entries moved. Where the upper bound stays below the first lower bound, nothing is
computed; else only the entries whose bounds the upper one reaches are, and all of them beyond the outer bound. Bounds are
rounded away from each other, and what they leave open is decided by whole-number distances, ties by the lower number.

A round is one pass over the rows: it reads the vectors and bounds that the last round wrote to the shared folder and writes
them again; each task adds up its own entries' parts. b follows how deep the last round had to look.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import saved, shared_dir, small

#: Entries that a part keeps in the first round, and the fewest later.
FIRST_B, LEAST_B = 4, 2
#: b is as deep as all but one in so many parts had to look.
DEEPER = 32
#: Shares by which bounds are rounded, more than 32-bit numbers lose.
_UP, _DOWN = 1 + 1e-6, 1 - 1e-6


@dataclass(frozen=True)
class Shape:
    """Parts of a vector, numbers in a part, entries of a codebook, and what a number is multiplied by."""

    parts: int
    width: int
    entries: int
    scale: int

    @property
    def limit(self) -> int:
        """Whole components are held within this, so that a vector's error, times the entries, fits into 63 bits."""
        return math.isqrt((1 << 63) // self.entries // (self.parts * self.width)) // 2

    def whole(self, numbers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(numbers * float(self.scale)), -self.limit, self.limit).astype(np.int32).reshape(-1, self.parts, self.width)


@dataclass
class Bounds:
    """Of n parts at one position: near (n, b) entries, the first the nearest; far (n, b) an upper bound of the first's distance,
    then lower bounds of the others'; outer (n) a lower bound for all others. A place whose entry isn't known has the number
    `entries` and the outer bound."""

    near: np.ndarray
    far: np.ndarray
    outer: np.ndarray


def _exact(part: np.ndarray, book: np.ndarray) -> type:
    """float64 where it holds all whole numbers on the way, which is faster, else int64."""
    most = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    return np.float64 if 4 * part.shape[1] * most * most < 1 << 52 else np.int64


def distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all parts to all entries, as int64."""
    kind = _exact(part, book)
    p, c = part.astype(kind), book.astype(kind)
    if kind is np.float64:
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((p - e) ** 2).sum(1) for e in c], axis=1)


def _to(part: np.ndarray, book: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, width) to the entries that are named for each (n, m), as int64."""
    kind = _exact(part, book)
    apart = part.astype(kind)[:, None, :] - book.astype(kind)[named]
    return (apart * apart).sum(2).astype(np.int64)


def _put(bounds: Bounds, at: np.ndarray, named: np.ndarray, squares: np.ndarray, entries: int) -> np.ndarray:
    """Order the named entries of the parts `at` by distance, then number, as their first ones; returns the order's squares."""
    order = np.argsort(squares * entries + named, axis=1)
    named, squares = np.take_along_axis(named, order, 1), np.take_along_axis(squares, order, 1)
    m = min(named.shape[1], bounds.near.shape[1])
    bounds.near[at, :m] = named[:, :m]
    root = np.sqrt(squares.astype(np.float64))
    bounds.far[at, 0] = root[:, 0] * _UP
    bounds.far[at, 1:m] = root[:, 1:m] * _DOWN
    return root


def all_computed(part: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    n, entries = len(part), len(book)
    bounds = Bounds(np.full((n, b), entries, np.uint8), np.zeros((n, b), np.float32), np.zeros(n, np.float32))
    _beyond(bounds, np.arange(n), part, book)
    return bounds


def _beyond(bounds: Bounds, at: np.ndarray, part: np.ndarray, book: np.ndarray) -> None:
    """Compute the parts `at` anew from all entries."""
    entries, b = len(book), bounds.near.shape[1]
    root = _put(bounds, at, np.broadcast_to(np.arange(entries, dtype=np.int64), (len(at), entries)).copy(), distances(part[at], book), entries)
    bounds.outer[at] = root[:, b] * _DOWN if entries > b else np.inf
    if entries < b:
        bounds.near[at, entries:], bounds.far[at, entries:] = entries, np.inf


def moved(bounds: Bounds, part: np.ndarray, book: np.ndarray, drift: np.ndarray, depths: np.ndarray) -> None:
    """Let the bounds follow entries that moved by `drift` at most (its last number: the largest), and find each part's nearest
    entry. depths counts parts by how many bounds their distance reached: none, before or after it was computed, up to all."""
    b = bounds.near.shape[1]
    bounds.far[:, 0] = (bounds.far[:, 0].astype(np.float64) + drift[bounds.near[:, 0]]) * _UP
    lower = np.concatenate([bounds.far[:, 1:].astype(np.float64) - drift[bounds.near[:, 1:]], bounds.outer[:, None].astype(np.float64) - drift[-1]], axis=1)
    lower = np.minimum.accumulate(np.maximum(lower, 0)[:, ::-1], axis=1)[:, ::-1] * _DOWN
    bounds.far[:, 1:], bounds.outer[:] = lower[:, :-1], lower[:, -1]
    # as they are stored, so that each is compared with what the next round knows
    open_ = np.flatnonzero(bounds.far[:, 0] >= (bounds.far[:, 1] if b > 1 else bounds.outer))
    depths[0] += len(part) - len(open_)
    if not len(open_):
        return
    first = bounds.near[open_, :1].astype(np.int64)
    upper = np.sqrt(_to(part[open_], book, first)[:, 0].astype(np.float64)) * _UP
    bounds.far[open_, 0] = upper
    depth = (bounds.far[open_, 1:] <= upper[:, None]).sum(1) + (bounds.outer[open_] <= upper)
    depths[: b + 1] += np.bincount(depth, minlength=b + 1)
    for m in range(1, b):
        if len(at := open_[depth == m]):
            named = bounds.near[at, : m + 1].astype(np.int64)
            _put(bounds, at, named, _to(part[at], book, named), len(book))
    if len(at := open_[depth == b]):
        _beyond(bounds, at, part, book)


def resized(bounds: Bounds, b: int, entries: int) -> Bounds:
    """The bounds with b entries a part: what goes lowers the outer bound, what comes isn't known yet."""
    had = bounds.near.shape[1]
    if b <= had:
        return Bounds(bounds.near[:, :b], bounds.far[:, :b], np.minimum(bounds.far[:, b:].min(axis=1, initial=np.inf), bounds.outer).astype(np.float32))
    near, far = np.full((len(bounds.near), b), entries, np.uint8), np.repeat(bounds.outer[:, None], b, axis=1)
    near[:, :had], far[:, :had] = bounds.near, bounds.far
    return Bounds(near, far, bounds.outer)


def _packed(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of n rows, side by side, as one binary value a row."""
    raw = np.concatenate([np.ascontiguousarray(x).reshape(len(x), -1).view(np.uint8) for x in rows], axis=1)
    held, size = raw.tobytes(), raw.shape[1]
    return pa.array([held[i : i + size] for i in range(0, len(held), size)], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _bounds_of(raw: np.ndarray, parts: int, b: int) -> list[Bounds]:
    n, a = len(raw), parts * b
    near = raw[:, :a].reshape(n, parts, b)
    far = np.ascontiguousarray(raw[:, a : 5 * a]).view(np.float32).reshape(n, parts, b)
    outer = np.ascontiguousarray(raw[:, 5 * a :]).view(np.float32)
    return [Bounds(near[:, p].copy(), far[:, p].copy(), outer[:, p].copy()) for p in range(parts)]


@dataclass
class Sums:
    """Of a task: parts and their sums by position and entry, and depths."""

    shape: Shape
    counts: np.ndarray = field(init=False)
    totals: np.ndarray = field(init=False)
    depths: np.ndarray = field(init=False)

    def __post_init__(self):
        s = self.shape
        self.counts, self.totals = np.zeros((s.parts, s.entries), np.int64), np.zeros((s.parts, s.entries, s.width), np.int64)
        self.depths = np.zeros(s.entries + 1, np.int64)

    def add(self, p: int, part: np.ndarray, nearest: np.ndarray) -> None:
        own = nearest[:, None] == np.arange(self.shape.entries)
        self.counts[p] += own.sum(0)
        # a batch's sums are whole numbers below 2 ** 53
        self.totals[p] += (own.T.astype(np.float64) @ part.astype(np.float64)).astype(np.int64)

    def flat(self) -> list[int]:
        return np.concatenate([self.counts.ravel(), self.totals.ravel(), self.depths]).tolist()


#: What a round adds to a row's id and the columns that are carried along.
_STATE = (("held", pa.binary(), "binary"), ("bounds", pa.binary(), "binary"), ("sums", pa.list_(pa.int64()), "array<long>"))


def _round(shape: Shape, book: np.ndarray, drift: np.ndarray | None, b: int, wanted: int, carried: tuple[str, ...]):
    """One round over rows with numbers (the first: drift is None) or with whole parts and bounds of b entries. The last row of a
    task has its sums and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, schema = Sums(shape), None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(c).with_nullable(True) for c in carried), *((n, k) for n, k, _ in _STATE)])
            if not batch.num_rows:
                continue
            if drift is None:
                whole = shape.whole(batch.column("numbers").flatten().to_numpy(zero_copy_only=False))
                bounds = [all_computed(whole[:, p], book[p], wanted) for p in range(shape.parts)]
                sums.depths[-1] += len(whole) * shape.parts
            else:
                whole = _unpacked(batch.column("held")).view(np.int32).reshape(-1, shape.parts, shape.width)
                bounds = [resized(own, wanted, shape.entries) for own in _bounds_of(_unpacked(batch.column("bounds")), shape.parts, b)]
                for p, own in enumerate(bounds):
                    moved(own, whole[:, p], book[p], drift[p], sums.depths)
            for p, own in enumerate(bounds):
                sums.add(p, whole[:, p], own.near[:, 0])
            stacked = [np.stack([getattr(own, f) for own in bounds], axis=1) for f in ("near", "far", "outer")]
            own_columns = [_packed([whole]), _packed(stacked), pa.nulls(len(whole), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *own_columns], schema=schema)
        if schema is not None:
            nothing = [pa.nulls(1, f.type) for f in schema][:-1]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([sums.flat()], pa.list_(pa.int64()))], schema=schema)

    return run


def _coded(shape: Shape, book: np.ndarray, carried: tuple[str, ...]):
    """The codes that the last round's bounds name, and their errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, whole = _unpacked(batch.column("bounds")), _unpacked(batch.column("held")).view(np.int32).reshape(-1, shape.parts, shape.width)
            b = (raw.shape[1] // shape.parts - 4) // 5
            nearest = raw[:, : shape.parts * b : b]
            error = sum(_to(whole[:, p], book[p], nearest[:, p : p + 1].astype(np.int64))[:, 0] for p in range(shape.parts))
            digits, size = np.ascontiguousarray(nearest).tobytes().hex(), 2 * shape.parts
            codes = pa.array([digits[i : i + size] for i in range(0, len(digits), size)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), codes, pa.array(error, pa.int64())], names=[*carried, "code", "error"])

    return run


@dataclass(frozen=True)
class Codes:
    """rows: the id column, the kept ones, code (two hexadecimal digits a part) and error (squared, of all parts). codebooks:
    parts x entries x numbers of a part. looked: of each round, parts by how deep they were looked at, see moved()."""

    rows: DataFrame
    codebooks: list[list[list[int]]]
    looked: list[list[int]]

    def digest(self) -> str:
        """SHA-256 of all numbers of the codebooks."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for entry in book for x in entry).encode()).hexdigest()


def _finite(column: str):
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))


def compress_vectors(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (),
) -> Codes:
    """Codes of all vectors, from codebooks fitted on all of them.

    A component x counts as floor(scale * x), and is held within Shape.limit (thousands of times a normalised vector's), so
    that an error fits into 63 bits. A vector is cut into `parts` equal parts. The codebooks begin as the parts of the vectors
    of the smallest ids (null ids come last, repeated ones in order of their vectors). A round gives each part the nearest
    entry, the first of equally near ones, and then moves each entry to its parts' mean, rounded down; an entry without parts
    stays. After the last round parts are dealt once more.

    Left out are vectors that are null, hold null or non-finite components, are empty, can't be cut into equal parts, or
    haven't the length of the one with the smallest id. Repeated rows are rows of their own. Columns in `keep` come along;
    others aren't read. An empty table gives no rows and no codebooks. The driver holds `entries` vectors and the codebooks.
    """
    if not 1 <= entries <= 255:
        raise ValueError("a code has two digits")
    spark = vectors.sparkSession
    named = {f"carried_{k}": c for k, c in enumerate((id_col, *keep))}
    numbers = vectors.select(*(F.col(c).alias(n) for n, c in named.items()), F.col(vector_col).cast("array<double>").alias("numbers"))
    valid = numbers.where(_finite("numbers") & (F.size("numbers") > 0) & (F.size("numbers") % parts == 0))

    def smallest(of: DataFrame) -> list[list[float]]:
        return [r["numbers"] for r in of.orderBy(F.col("carried_0").asc_nulls_last(), "numbers").select("numbers").limit(entries).collect()]

    first = smallest(valid)
    if not first:
        none = vectors.select(F.col(id_col), *keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
        return Codes(none, [], [])
    size = len(first[0])
    valid = valid.where(F.size("numbers") == size)
    if any(len(x) != size for x in first):
        first = smallest(valid)
    shape = Shape(parts, size // parts, len(first), scale)
    book = shape.whole(np.array(first)).astype(np.int64).transpose(1, 0, 2)
    kinds = ", ".join(f"{n} {valid.schema[n].dataType.simpleString()}" for n in named)
    place = f"{shared_dir(spark)}/vector-codes-{uuid.uuid4().hex}"
    now, drift, looked, b, wanted = valid, None, [], FIRST_B, min(FIRST_B, max(1, shape.entries - 1))
    for k in range(rounds + 1):
        # two tables in turn: one is read while the other is written
        made = now.mapInArrow(_round(shape, book, drift, b, wanted, tuple(named)), f"{kinds}, {', '.join(f'{n} {ddl}' for n, _, ddl in _STATE)}")
        made.write.mode("overwrite").parquet(f"{place}-{k % 2}")
        state, b = spark.read.schema(made.schema).parquet(f"{place}-{k % 2}"), wanted
        now = state.where("sums IS NULL")
        totals = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        flat = [0] * len(totals)
        for r in totals:
            flat[r["at"]] = int(r["n"])
        cells = shape.parts * shape.entries
        looked.append(flat[cells * (1 + shape.width) :])
        if k == rounds:
            break
        moved_to = np.array([
            [total // n for total in flat[cells + at * shape.width : cells + (at + 1) * shape.width]] if (n := flat[at]) else book[at // shape.entries, at % shape.entries].tolist() for at in range(cells)
        ], np.int64).reshape(book.shape)
        apart = np.sqrt(((moved_to - book).astype(np.float64) ** 2).sum(2)) * _UP
        book, drift = moved_to, np.concatenate([apart, apart.max(axis=1, keepdims=True)], axis=1)
        wanted = adapted(looked[-1], wanted, shape.entries) if k else wanted
    coded = now.mapInArrow(_coded(shape, book, tuple(named)), f"{kinds}, code string, error long")
    return Codes(saved(coded, "codes").withColumnsRenamed(named), book.tolist(), looked)


def adapted(depths: list[int], b: int, entries: int) -> int:
    """b for the next round: so deep that one part in DEEPER at most would look beyond; one more where b wasn't."""
    total, most = sum(depths), max(1, entries - 1)
    for k in range(LEAST_B, b + 1):
        if sum(depths[k:]) * DEEPER <= total:
            return min(k, most)
    return min(b + 1, most)


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """Add label_error: the errors of all rows with the label added up, rows without a label together. Sums beyond 63 bits stay at
    the largest number. A label of any share of the rows is added up before it meets them."""
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = codes.groupBy(F.col(label_col).alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    return codes.join(small(sums, "label-errors"), F.col(label_col).eqNullSafe(F.col("__label"))).drop("__label")


def decode_vectors(codes: DataFrame, codebooks: list[list[list[int]]], scale: int = 4096, code_col: str = "code") -> DataFrame:
    """Add `decoded`, the vector that the code stands for: its entries, divided by scale. Null codes give null."""
    entries = F.lit([[[x / scale for x in entry] for entry in book] for book in codebooks])
    digits = F.transform(F.sequence(F.lit(1), F.lit(len(codebooks))), lambda p: F.element_at(F.element_at(entries, p), F.conv(F.substr(F.col(code_col), 2 * p - 1, F.lit(2)), 16, 10).cast("int") + 1))
    return codes.withColumn("decoded", F.when(F.col(code_col).isNotNull(), F.flatten(digits)))
