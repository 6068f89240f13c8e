"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has a fixed number of bins. In each round every shingle is hashed to a bin and a value, and bins keep their least
value; values of later rounds are larger, so that a bin is decided by the first round that reaches it. After as many rounds
as bins, the round's own bin takes all shingles: every bin fills. Bins agree with the probability of the sets' Jaccard
similarity, with concentration as of independent hashes.

Documents with equal shingle sets are one class. Classes that agree in a band of bins meet in a bucket, and are compared on
full sets with the bucket's first class. What meets a first class and stays in different components then is compared with
each other, in pairs of bounded blocks: no link between two classes of a bucket is lost, and no bucket's pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import U64, WordHashes, batched, mix, rows_of, saved, small, words_of
from tidegauge.llm.components import components

BINS = 128
#: Probability that two sets just at the threshold share no band, at most.
MISS = 1e-6
#: Documents whose sketches are computed together, and their shingles at most (unless one document has more).
DOCS, SHINGLES = 256, 1 << 19
#: Ids of documents to compare are broadcast up to this many (8 MB); more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Classes that one task compares with a bucket's first class.
SHARE = 256
#: Classes of a block that is compared with other blocks, and shingles of one matrix product.
BLOCK, COLUMNS = 256, 1 << 13

_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of `size` words in a row; fewer words are one shingle, none have none."""
    if not words:
        return np.zeros(0, U64)
    h = hashes.of(words)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = mix(h[:n])
    for k in range(1, size):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of `bins` values for each set; rows of empty sets stay at the largest value."""
    out = np.full(len(sets) * bins, _EMPTY)
    active = np.array([len(s) > 0 for s in sets])
    sizes = np.array([len(s) for s in sets])
    owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, U64)
    low = U64((1 << 55) - 1)
    for turn in range(2 * bins):
        mine = active[owner]
        owner, every = owner[mine], every[mine]
        if not len(owner):
            break
        h = mix(every + mix(U64(turn + 1) * np.ones(1, U64)))
        place = (h >> U64(40)).astype(np.int64) % bins if turn < bins else turn - bins
        np.minimum.at(out, owner * bins + place, (U64(turn) << U64(55)) | (mix(h) & low))
        active = (out.reshape(-1, bins) == _EMPTY).any(axis=1) & active
    return out.reshape(-1, bins)


def bands_for(percent: int, bins: int = BINS) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest bands that miss a pair at the threshold with MISS at most."""
    for rows in range(12, 0, -1):
        if (1 - (percent / 100) ** rows) ** (bins // rows) <= MISS:
            return rows, bins // rows
    return 1, bins


def _sketch(size: int, percent: int):
    rows, bands = bands_for(percent)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def signed(x: np.ndarray) -> pa.Array:
        return pa.array(x.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def made(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            bins = sketches(sets)[:, : rows * bands].reshape(len(sets), bands, rows)
            key = np.zeros((len(sets), bands), U64) + mix(np.arange(bands, dtype=U64) + U64(1))
            for k in range(rows):
                key = mix(key * U64(0x9E3779B97F4A7C15) + bins[:, :, k])
            n = np.array([len(s) for s in sets], np.int64)
            h1 = np.array([s.sum(dtype=U64) for s in sets], U64)
            h2 = np.array([mix(s).sum(dtype=U64) for s in sets], U64)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), signed(h1), signed(h2), pa.ListArray.from_arrays(offsets, signed(key.reshape(-1)))], schema=schema)

        ids, sets, total = [], [], 0
        for key, text in rows_of(batches, "id", "text"):
            own = shingles(words_of(text), size, hashes)
            ids.append(key)
            sets.append(own)
            total += len(own)
            if len(ids) >= DOCS or total >= SHINGLES:
                yield made(ids, sets)
                ids, sets, total = [], [], 0
        if ids:
            yield made(ids, sets)

    return run


def _compare(size: int, percent: int):
    """Rows by group, the group's first class before the others: exact intersections with the first class."""
    schema = pa.schema([("first", pa.int64()), ("other", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows() -> Iterator[tuple]:
            group, firsts = None, []
            for first, part, other, text in rows_of(batches, "first", "part", "other", "text"):
                own = shingles(words_of(text), size, hashes)
                if (first, part) != group:
                    group, firsts = (first, part), []
                if other == first:
                    firsts.append(own)  # more than one only where rows repeat an id
                    continue
                for base in firsts:
                    common = _common(base, own)
                    union = len(base) + len(own) - common
                    yield first, other, 100 * common >= percent * union

        yield from batched(rows(), schema)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted sets, by searching the smaller one's in the larger."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _fetched(rows: DataFrame, texts: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the texts of the documents that key names. Few enough ids are broadcast, and only their texts travel."""
    ids = saved(rows.select(F.col(key).alias("needed")).distinct(), f"{name}-ids")
    few = ids.count() <= BROADCAST_IDS
    needed = texts.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("needed"), "left_semi")
    return needed.hint("shuffle_merge").join(rows, F.col("id") == F.col(key))


def _with_parts(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """rows with the number of parts of their first class; only classes with more than one are looked up, and those are few."""
    large = small(sizes.where("parts > 1").select(F.col("first_of").alias("large"), "parts"), f"{name}-large")
    return rows.join(large, F.col("first") == F.col("large"), "left").drop("large").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """first, other, linked of the pairs, on full shingle sets; hot first classes are spread over tasks."""
    sizes = saved(pairs.groupBy(F.col("first").alias("first_of")).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts")), f"{name}-sizes")
    others = _with_parts(pairs, sizes, name).select("first", F.expr("pmod(xxhash64(other), parts)").cast("int").alias("part"), "other")
    firsts = sizes.select(F.col("first_of").alias("first"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("first_of").alias("other"))
    wanted = saved(others.unionByName(firsts), f"{name}-wanted")
    found = _fetched(wanted, texts, "other", name).select("first", "part", "other", "text")
    dealt = found.repartition("first", "part").sortWithinPartitions("first", "part", F.col("other") != F.col("first"))
    return saved(dealt.mapInArrow(_compare(size, percent), "first long, other long, linked boolean"), name)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, class_id, component_id, kept.

    Words are runs of anything but white space, A-Z in lower case; a document's set has its distinct shingles of `size`
    words, or its whole sequence where it has fewer; null and empty texts have no shingles and link with nothing. Documents
    with 100 * |intersection| >= percent * |union| are linked. class_id is the smallest id with the same set, component_id
    the smallest id reachable by links; kept says whether that is the row's own id.

    Rows that share an id are one document, whose links are those of any of its texts. A row with a null id links with
    nothing, and its class_id and component_id are null. Other columns aren't read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    drawn = saved(texts.mapInArrow(_sketch(size, percent), "id long, n long, h1 long, h2 long, bands array<long>"), "sketches")
    classes = drawn.where("id is not null and n > 0").groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "bands")).alias("first"))
    classes = saved(classes.select("n", "h1", "h2", F.col("first.id").alias("class"), F.col("first.bands").alias("bands")), "classes")
    entries = classes.select("class", F.explode("bands").alias("key"))
    buckets = entries.groupBy(F.col("key").alias("bucket")).agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = saved(entries.join(buckets, F.col("key") == F.col("bucket")).select("bucket", "held", "class"), "met")
    # the first class of a bucket is the one that meets most others in all its buckets: in the middle of its group, it links
    # with more of them than the smallest id would
    weights = met.groupBy(F.col("class").alias("weighed")).agg(F.sum("held").alias("weight"))
    weighed = saved(met.join(weights, F.col("class") == F.col("weighed")).select("bucket", "class", "weight"), "weighed")
    firsts = weighed.groupBy(F.col("bucket").alias("of")).agg(F.max(F.struct("weight", (-F.col("class")).alias("less"))).alias("first"))
    members = saved(weighed.join(firsts, F.col("bucket") == F.col("of")).select("bucket", (-F.col("first.less")).alias("first"), F.col("class").alias("other")), "members")
    stars = _verified(members.where("other != first").select("first", "other").distinct(), texts, size, percent, "stars")
    links = stars.where("linked").select("first", "other")
    joined = saved(components(links, "first", "other"), "joined")
    rest = saved(_unsettled(members, joined), "rest")
    if not rest.isEmpty():
        more = saved(_settled(rest, texts, size, percent), "more")
        joined = saved(components(links.unionByName(more), "first", "other"), "joined")
    named = classes.select("n", "h1", "h2", "class").join(joined, F.col("class") == F.col("node"), "left").select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "class", F.coalesce("component", "class").alias("component"))
    same = (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("id").isNotNull()
    out = drawn.select("id", "n", "h1", "h2").join(named, same, "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class", "id").alias("class_id"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _unsettled(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Classes that meet the same first class and aren't all in one component with it: first, other, component."""
    met = members.select("first", "other").distinct()
    placed = met.join(joined, F.col("other") == F.col("node"), "left").select("first", "other", F.coalesce("component", "other").alias("component"))
    mixed = placed.groupBy(F.col("first").alias("mixed")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("held")).where("low < high AND held > 2").select("mixed")
    mixed = small(mixed, "mixed")
    return placed.where("other != first").join(mixed, F.col("first") == F.col("mixed"), "left_semi")


def _settled(rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components among the classes of each first class, as few as connect them: first, other.

    Classes are dealt into blocks, and each pair of blocks is one task's group: a bounded number of documents, whose
    intersections come from one matrix product.
    """
    sizes = saved(rest.groupBy(F.col("first").alias("first_of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "rest-sizes")
    dealt = _with_parts(rest, sizes, "rest").withColumn("own", F.expr("pmod(xxhash64(other), parts)").cast("int"))
    pairs = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("first", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "other", "component")
    found = _fetched(pairs, texts, "other", "rest").select("first", "low", "high", "own", "other", "component", "text")
    dealt = found.repartition("first", "low", "high").sortWithinPartitions("first", "low", "high", "other")
    return dealt.mapInArrow(_blocks(size, percent), "first long, other long")


def _blocks(size: int, percent: int):
    schema = pa.schema([("first", pa.int64()), ("other", pa.int64())])

    def links(ids: list[int], own: np.ndarray, components: list[int], sets: list[np.ndarray], low: int, high: int) -> Iterator[tuple]:
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shared = times[column] > 1  # shingles of one document are in no intersection
        row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        common, width = np.zeros((len(a), len(b))), int((times > 1).sum())
        for lo in range(0, width, COLUMNS):
            inside = (column >= lo) & (column < lo + COLUMNS)
            has = np.zeros((len(sets), min(COLUMNS, width - lo)), np.float32)
            has[row[inside], column[inside] - lo] = 1
            common += has[a] @ has[b].T
        n = np.array([len(s) for s in sets])
        union = n[a][:, None] + n[b][None, :] - common
        root = {c: c for c in components}

        def find(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        for i, j in zip(*np.nonzero(100 * common >= percent * union)):
            x, y = find(components[a[i]]), find(components[b[j]])
            if x != y:
                root[max(x, y)] = min(x, y)
                yield ids[a[i]], ids[b[j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows() -> Iterator[tuple]:
            group, held = None, []

            def done() -> Iterator[tuple]:
                if len({h[2] for h in held}) > 1:
                    ids, own, components, sets = zip(*held)
                    yield from links(list(ids), np.array(own), list(components), list(sets), group[1], group[2])

            for first, low, high, own, other, component, text in rows_of(batches, "first", "low", "high", "own", "other", "component", "text"):
                if (first, low, high) != group:
                    yield from done()
                    group, held = (first, low, high), []
                held.append((other, own, component, shingles(words_of(text), size, hashes)))
            yield from done()

        yield from batched(rows(), schema)

    return run
