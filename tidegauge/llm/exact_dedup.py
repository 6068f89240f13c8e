"""Exact de-duplication with counting quotient filters.

Every partition builds a counting quotient filter of the 64-bit fingerprints of its normalised texts, one per range of
fingerprints. The filters of a range merge without loss, by their sorted remainders. Only texts whose fingerprint has a
count above one are compared byte for byte; all others are known to be unique and are not compared at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import U64, saved

#: Suspect fingerprints are broadcast up to this many (8 MB); more of them are joined by a shuffle.
BROADCAST_FINGERPRINTS = 1 << 20
#: Fingerprints that a range of the merged filter holds, about.
RANGE_ROWS = 1 << 17

# A run of white space becomes one space; a single space already is one and isn't touched.
_RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


class CountingQuotientFilter:
    """A set of fingerprints with counts: a quotient addresses a run of sorted remainders.

    `occupied` has a bit for each quotient, `run_ends` one for each slot, `remainders` the slots in order; counters
    stand beside the slots whose count is above one.
    """

    def __init__(self, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counted: np.ndarray, counters: np.ndarray, bits: int):
        self.occupied, self.run_ends, self.remainders, self.counted, self.counters, self.bits = occupied, run_ends, remainders, counted, counters, bits

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, key_bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints below 2**key_bits."""
        n = len(fingerprints)
        quotient_bits = min(key_bits, max(3, int(np.ceil(np.log2(max(n, 1) / 0.75)))))
        bits = key_bits - quotient_bits
        quotients = (fingerprints >> U64(bits)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, dtype=bool)
        occupied[quotients] = True
        run_ends = np.ones(n, dtype=bool)
        run_ends[:-1] = quotients[1:] != quotients[:-1]
        counted = np.flatnonzero(counts > 1)
        return cls(occupied, run_ends, fingerprints & U64((1 << bits) - 1), counted, counts[counted], bits)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and their counts."""
        ends = np.flatnonzero(self.run_ends)
        lengths = np.diff(ends, prepend=-1)
        quotients = np.repeat(np.flatnonzero(self.occupied), lengths).astype(U64)
        counts = np.ones(len(self.remainders), dtype=np.int64)
        counts[self.counted] = self.counters
        return (quotients << U64(self.bits)) | self.remainders, counts

    def to_bytes(self) -> bytes:
        width = max(1, -(-self.bits // 8))
        low = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        head = np.array([self.bits, len(self.occupied), len(self.remainders), len(self.counted)], dtype="<i8")
        return b"".join((head.tobytes(), np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(), low.tobytes(), self.counted.astype("<i8").tobytes(), self.counters.astype("<i8").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, quotients, slots, counted = (int(x) for x in np.frombuffer(data, "<i8", 4))
        at, width = 32, max(1, -(-bits // 8))

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        occupied = np.unpackbits(take(-(-quotients // 8), "u1"), count=quotients).astype(bool)
        run_ends = np.unpackbits(take(-(-slots // 8), "u1"), count=slots).astype(bool)
        wide = np.zeros((slots, 8), dtype=np.uint8)
        wide[:, :width] = take(slots * width, "u1").reshape(slots, width)
        return cls(occupied, run_ends, wide.reshape(-1).view("<u8"), take(counted, "<i8"), take(counted, "<i8"), bits)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter], key_bits: int) -> CountingQuotientFilter:
        """One filter with the counts of all, merged by sorted remainders."""
        parts = [f.entries() for f in filters]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")  # merges the sorted parts
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
        return cls.of(keys[first], np.add.reduceat(counts, first) if len(first) else counts, key_bits)


def _filters(range_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) for b in batches]
        prints, counts = np.unique(np.concatenate(held).view(U64) if held else np.zeros(0, U64), return_counts=True)
        key_bits = 64 - range_bits
        ranges = (prints >> U64(key_bits)).astype(np.int64) if range_bits else np.zeros(len(prints), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(prints) else []
        for a, b in zip(cuts, [*cuts[1:], len(prints)]):
            own = CountingQuotientFilter.of(prints[a:b] & U64((1 << key_bits) - 1), counts[a:b], key_bits)
            yield pa.RecordBatch.from_pydict({"part": pa.array([ranges[a]], pa.int32()), "filter": pa.array([own.to_bytes()], pa.binary())})

    return build


def _suspects(range_bits: int):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        key_bits = 64 - range_bits
        one = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")], key_bits)
        prints, counts = one.entries()
        prints = prints[counts > 1] | (U64(key[0].as_py()) << U64(key_bits) if range_bits else U64(0))
        return pa.table({"suspect": pa.array(prints.view(np.int64), pa.int64()), "seen": pa.array(counts[counts > 1], pa.int64())})

    return merge


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (a single long column) that occur more than once: suspect, seen."""
    range_bits = max(4, int(np.ceil(np.log2(max(rows, 1) / RANGE_ROWS))))
    filters = prints.mapInArrow(_filters(range_bits), "part int, filter binary")
    return filters.groupBy("part").applyInArrow(_suspects(range_bits), "suspect long, seen long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256, and text_print, a 64-bit hash of the
    normalised text that tells rows of one id apart.

    Texts are equal when identical after replacing each run of white space by one space; of equal texts the row with the
    smallest id stays. Null texts are empty texts and equal each other. Rows that repeat id and text count in group_size
    and share their decision. A null id never is the smallest; where all ids of a group are null, keep_id is null and
    kept is true. Other columns of docs, whatever their names, aren't read. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    slim = saved(source.select("id", F.xxhash64("norm").alias("print"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")), "prints")
    suspects = saved(repeated_fingerprints(slim.select("print"), slim.count()), "suspects")
    few = suspects.count() <= BROADCAST_FINGERPRINTS
    marked = source.withColumn("print", F.xxhash64("norm"))
    routed = marked.join(F.broadcast(suspects) if few else suspects, F.col("print") == F.col("suspect"), "left_semi")
    classes = (
        routed.groupBy("print", "norm")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("class_sha"), "first_id", "size")
    )
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first_id"))
    return slim.join(classes, F.col("sha") == F.col("class_sha"), "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("print").alias("text_print"),
    )
