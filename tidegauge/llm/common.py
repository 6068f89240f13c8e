"""What the operators of this subpackage share: the shared folder, written cuts in the lineage, and hashing of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.sources.stored import shared_dir, stored  # noqa: F401  (operators take shared_dir from here)

#: White space as the contracts define it; bytes.split() and bytes.strip() use the same six characters.
WHITE = " \t\n\x0b\x0c\r"

U64 = np.uint64


#: Rows of a table that may be broadcast whole, and bytes of their texts, once they are counted.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 64 << 20
#: Longer words aren't remembered by any cache, which so are bounded in bytes too.
LONGEST = 64


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors, and gives the planner exact sizes."""
    return stored(df, name)


def small(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, with a broadcast hint if it has few enough rows and bytes; else it is joined as Spark sees fit."""
    held = saved(df, name)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in held.dtypes if kind in ("string", "binary")]
    rows, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
    return F.broadcast(held) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else held


def few_by_hash(df: DataFrame, hash_: Column, n: int) -> DataFrame:
    """Rows of df with one of its n smallest distinct hashes, which column `hash` has.

    A count tells below which bound about enough hashes lie, so that the driver gets hashes from below it only: a few more
    than n of them at any size, and no rows.
    """
    rows, total = df.withColumn("hash", hash_), df.count()
    reach = (2 * n + 64) / max(total, 1)
    while True:
        top = (1 << 63) - 1 if reach >= 1 else int(reach * (1 << 64)) - (1 << 63)
        found = [r["hash"] for r in rows.where(F.col("hash") <= top).select("hash").distinct().orderBy("hash").limit(n).collect()]
        if len(found) >= n or reach >= 1:
            return rows.where(F.col("hash") <= (found[-1] if found else top))
        reach *= 16  # rows repeat


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered for as many words as fit into a bounded cache."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the constants are SplitMix64's fixed values)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples, a batch at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Python tuples as Arrow batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
