"""Removal of lines that many documents repeat, with two Bloom filters.

A first pass over the documents builds two Bloom filters in each partition, of line hashes seen once and seen twice. Segments of
the filters are merged apart from each other, bit by bit. Only lines that the merged second filter has leave their documents: they are counted exactly, by the line's own text, and the last document that
holds them keeps them. Too small a filter makes more lines travel, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import elias_fano
from tidegauge.llm.common import U64, WHITE, batched, mix, rows_of, saved, small

PROBES = 4
#: Documents of a key that counts as very common.
COMMON = 1 << 10
#: Bits of one segment of the filters (64 KB); segments are merged apart from each other.
SEGMENT_BITS = 1 << 19


def line_key(line: str) -> str:
    """The line without white space at its ends and with A-Z in lower case."""
    return line.strip(WHITE).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _keys(text: str | None, least: int) -> Iterator[tuple[int, bytes]]:
    """Line number and key of the lines whose key is long enough."""
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip(WHITE)
        if len(line) >= least:
            yield i, line.encode("utf-8", "surrogatepass").lower()


def _places(hashes: np.ndarray) -> np.ndarray:
    """Bits that each hash sets within its segment, by double hashing."""
    a, b = mix(hashes), mix(hashes ^ U64(0x5851F42D4C957F2D)) | U64(1)
    return np.stack([((a + b * U64(i)) >> U64(20)) & U64(SEGMENT_BITS - 1) for i in range(PROBES)]).astype(np.int64)


def _segment(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _filters(least: int, segment_bits: int):
    """The two filters of each partition, segment by segment: the sorted places of the bits that are set, in Elias-Fano form. A
    line of two documents of the partition is in both."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, U64)]
        for batch in batches:
            own: list[int] = []
            for text in batch.column(0).to_pylist():
                own.extend({xxhash.xxh3_64_intdigest(k) for _, k in _keys(text, least)})
            held.append(np.array(own, dtype=U64))
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        part = _segment(hashes, segment_bits)
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(hashes) else []
        for a, b in zip(cuts, [*cuts[1:], len(hashes)]):
            once, twice = (elias_fano.encode(np.unique(_places(h)).astype(U64)) for h in (hashes[a:b], hashes[a:b][counts[a:b] > 1]))
            yield pa.RecordBatch.from_pydict({"segment": pa.array([part[a]], pa.int32()), "once": pa.array([once], pa.binary()), "twice": pa.array([twice], pa.binary())})

    return build


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The twice-seen filter of a segment over all partitions: bits of any partition's twice-seen filter, and those that the
    once-seen filters of two partitions both have. A line of two partitions has all its bits among them."""
    once, twice = np.zeros(SEGMENT_BITS, dtype=bool), np.zeros(SEGMENT_BITS, dtype=bool)
    for a, b in zip(table.column("once"), table.column("twice")):
        seen, again = (elias_fano.EliasFano(np.frombuffer(x.as_py(), np.uint8)).all().astype(np.int64) for x in (a, b))
        twice[again] = True
        twice[seen[once[seen]]] = True
        once[seen] = True
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})


def _suspected(least: int, segment_bits: int, shared):
    schema = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("line", pa.int32()), ("key", pa.string())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: np.frombuffer(v, np.uint8) for k, v in shared.value.items()}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids, prints = batch.column("id").to_pylist(), batch.column("print").to_pylist()
                found = [(r, i, k) for r, text in enumerate(batch.column("text").to_pylist()) if ids[r] is not None for i, k in _keys(text, least)]
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for _, _, k in found), dtype=U64, count=len(found))
                hit, part, places = np.zeros(len(found), bool), _segment(hashes, segment_bits), _places(hashes)
                for s in np.unique(part):
                    if (bits := filters.get(int(s))) is not None:
                        own = np.flatnonzero(part == s)
                        p = places[:, own]
                        hit[own] = ((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=0)
                for j in np.flatnonzero(hit):
                    r, i, k = found[j]
                    yield ids[r], prints[r], i, k.decode("utf-8", "surrogatepass")

        yield from batched(rows(), schema)

    return probe


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])

    def rows() -> Iterator[tuple]:
        for key, text, gone in rows_of(batches, "id", "text", "gone"):
            lines = (text or "").split("\n")
            if gone:
                out = set(gone)
                yield key, len(lines), len(out), "\n".join(x for i, x in enumerate(lines) if i not in out)
            else:
                yield key, len(lines), 0, text or ""

    yield from batched(rows(), schema, 1024)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, bits_per_line: int = 12, max_filter_bytes: int = 64 << 20
) -> DataFrame:
    """One row for each row of docs: id_col, n_lines, n_dropped, text (its lines that stay, joined by newlines).

    Lines are what stands between newlines; a null or empty text is one empty line. Keys (see line_key) of at least
    min_chars code points found in at least min_docs documents lose all their lines, except in the document with the
    largest id that holds the key, which keeps all of its own. Rows of the same id count as one document; a row with a
    null id keeps all its lines and isn't counted. Other columns aren't read. An empty table gives an empty result.

    The twice-seen filter has bits_per_line bits for each line, max_filter_bytes at most; beyond that more lines are
    confirmed exactly, with the same result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.select(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    wanted = min(max(n * bits_per_line, 1), max_filter_bytes * 8) / SEGMENT_BITS
    segment_bits = max(4, int(np.ceil(np.log2(max(wanted, 1)))))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    filters = source.where("id is not null").select("text").mapInArrow(_filters(min_chars, segment_bits), "segment int, once binary, twice binary")
    merged = filters.groupBy("segment").applyInArrow(_merge, "segment int, bits binary")
    shared = spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in merged.toLocalIterator()})
    marked = source.withColumn("print", F.xxhash64("text"))
    found = saved(marked.mapInArrow(_suspected(min_chars, segment_bits, shared), "id long, print long, line int, key string"), "lines")
    repeated = found.groupBy("key").agg(F.countDistinct("id").alias("held"), F.max("id").alias("last")).where(F.col("held") >= min_docs)
    repeated = saved(repeated.select(F.col("key").alias("gone_key"), "held", "last"), "repeated")
    # occurrences of the commonest keys stay where they are; they are told apart before the others are dealt by their key
    common = small(repeated.where(F.col("held") > COMMON).select("gone_key", "last"), "common")
    same, drops = F.col("key") == F.col("gone_key"), F.col("id") != F.col("last")
    rest = found.join(common, same, "left_anti").join(repeated.where(F.col("held") <= COMMON).select("gone_key", "last"), same & drops)
    gone = found.join(common, same & drops).select("id", "print", "line").unionByName(rest.select("id", "print", "line"))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("print").alias("gone_print")).agg(F.collect_set("line").alias("gone"))
    kept = marked.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("print") == F.col("gone_print")), "left").select("id", "text", "gone")
    return kept.mapInArrow(_without, "id long, n_lines long, n_dropped long, text string").withColumnsRenamed({"id": id_col, "text": text_col})
