"""Near-duplicate vectors by dual traversal of cover trees.

Equal vectors of a label are one class. Classes are dealt into blocks around a few pivots, and every block becomes a cover
tree: nested levels whose covering radii halve. Pairs of blocks of a label that the triangle inequality doesn't rule out
are traversed together: a pair of nodes further apart than their covering radii and the threshold allow is pruned, one
close enough links as a whole, others are opened down to their leaves. All pairs at the threshold are found.

Distances are those of unit vectors, d * d = 2 - 2 * cosine. Data without any structure leaves nothing to prune: then the
work of a label grows with the square of its classes, whatever the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import batched, few_by_hash, rows_of, saved
from tidegauge.llm.components import components

#: Classes of a block, about.
BLOCK = 1024
#: Pivots at most, and the vectors they are chosen from (those of the smallest hashes).
PIVOTS, PIVOT_SAMPLE = 256, 2048
#: Members of a node that is not opened further.
LEAF = 48
#: What rounding may do to a distance.
SLACK = 1e-7


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, row by row or against one."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b if b.ndim == 1 else np.einsum("ij,ij->i", a, b))))


class CoverTree:
    """Nodes in level order: their centre, covering radius, members (a range of `order`) and children (a range of nodes)."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        order = np.arange(n)
        nodes = [[0, 0, n, 0.0, 0, 0]]  # centre, from, to, radius, first child, end of children
        at, level = 0, [0]
        reach = 2.0
        while level:
            reach /= 2
            following: list[int] = []
            for k in level:
                centre, lo, hi = nodes[k][:3]
                own = order[lo:hi].copy()
                away = _distances(unit[own], unit[centre])
                nodes[k][3] = float(away.max()) if len(own) else 0.0
                if hi - lo <= LEAF or nodes[k][3] <= SLACK:
                    continue
                # children: centres further than `reach` from each other, the node's own centre first
                nodes[k][4] = len(nodes)
                left, done = np.arange(len(own)), lo
                pick = int(np.flatnonzero(own == centre)[0])
                # all distances at once, where that is no more than a block's
                every = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit[own] @ unit[own].T))) if len(own) <= 2 * BLOCK else None
                while len(left):
                    d = every[pick, left] if every is not None else _distances(unit[own[left]], unit[own[pick]])
                    near = (d <= reach) | (left == pick)
                    taken = own[left[near]]
                    order[done : done + len(taken)] = taken
                    nodes.append([int(own[pick]), done, done + len(taken), 0.0, 0, 0])
                    following.append(len(nodes) - 1)
                    done += len(taken)
                    left = left[~near]
                    if len(left):
                        pick = int(left[0])
                nodes[k][5] = len(nodes)
            level = following
        table = np.array(nodes, dtype=float)
        self.order = order
        self.centre, self.lo, self.hi, self.first, self.end = (table[:, c].astype(np.int64) for c in (0, 1, 2, 4, 5))
        self.radius = table[:, 3]

    def to_bytes(self) -> bytes:
        return b"".join((np.array([len(self.order), len(self.centre)], "<i8").tobytes(), self.order.astype("<i8").tobytes(), *(x.astype("<i8").tobytes() for x in (self.centre, self.lo, self.hi, self.first, self.end)), self.radius.astype("<f8").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        tree, (n, m) = cls.__new__(cls), np.frombuffer(data, "<i8", 2)
        tree.order = np.frombuffer(data, "<i8", n, 16)
        at = 16 + 8 * n
        tree.centre, tree.lo, tree.hi, tree.first, tree.end = (np.frombuffer(data, "<i8", m, at + 8 * m * k) for k in range(5))
        tree.radius = np.frombuffer(data, "<f8", m, at + 40 * m)
        return tree


class _Forest:
    """Links among the classes of two blocks as a spanning forest."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self._root(a), self._root(b)
        if ra != rb:
            self.up[rb] = ra
            self.edges.append((a, b))


def dual_links(a: np.ndarray, ta: CoverTree, wa: np.ndarray, b: np.ndarray, tb: CoverTree, wb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Linked weight of each vector of a and of b, and a spanning forest of the links (b's vectors numbered after a's).

    With `same`, a and b are one block: each pair counts once, and no vector links with itself.
    """
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    forest = _Forest(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    i, j, d = np.zeros(1, np.int64), np.zeros(1, np.int64), _distances(a[ta.centre[:1]], b[tb.centre[:1]])
    while len(i):
        spread = ta.radius[i] + tb.radius[j]
        open_ = d - spread <= limit + SLACK
        i, j, d, spread = i[open_], j[open_], d[open_], spread[open_]
        leaf_a, leaf_b = ta.end[i] == 0, tb.end[j] == 0
        whole = (d + spread <= limit - SLACK) & ~((i == j) & same)
        for x, y, every in zip(i[whole | (leaf_a & leaf_b)], j[whole | (leaf_a & leaf_b)], whole[whole | (leaf_a & leaf_b)]):
            p, q = ta.order[ta.lo[x] : ta.hi[x]], tb.order[tb.lo[y] : tb.hi[y]]
            if every:
                na[p] += wb[q].sum()
                nb[q] += wa[p].sum()
                for k in q.tolist():
                    forest.link(int(p[0]), shift + k)
                for k in p.tolist():
                    forest.link(k, shift + int(q[0]))
                continue
            hit = a[p] @ b[q].T >= cosine
            if same and x == y:
                hit = np.triu(hit, 1)
            if hit.any():
                na[p] += hit @ wb[q]
                nb[q] += wa[p] @ hit
                for r, c in zip(*np.nonzero(hit)):
                    forest.link(int(p[r]), shift + int(q[c]))
        rest = np.flatnonzero(~whole & ~(leaf_a & leaf_b))
        out: list[tuple[np.ndarray, ...]] = []
        for x, y in zip(i[rest], j[rest]):
            # the children of both (a leaf stays), all their distances at once; only pairs that aren't pruned go on
            u, v = (np.arange(t.first[k], t.end[k]) if t.end[k] else np.array([k]) for t, k in ((ta, x), (tb, y)))
            apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a[ta.centre[u]] @ b[tb.centre[v]].T)))
            near = apart - ta.radius[u][:, None] - tb.radius[v][None, :] <= limit + SLACK
            if same and x == y:  # a node with itself: its pairs of children, each once
                near = np.triu(near)
            r, c = np.nonzero(near)
            out.append((u[r], v[c], apart[r, c]))
        i, j, d = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return na, nb, forest.edges


def _unit(rows: list) -> np.ndarray:
    v = np.array(rows, dtype=float)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other: the first, then always the one furthest from all chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    away = _distances(sample, sample[0])
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(sample, sample[chosen[-1]]))
    return sample[chosen]


def _assign(shared):
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64())), ("pivot", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value

        def rows() -> Iterator[tuple]:
            for row in rows_of(batches, "label", "dim", "rep", "copies", "vector"):
                near = int((pivots @ _unit([row[4]])[0]).argmax()) if len(pivots) and pivots.shape[1] == row[1] else 0
                yield (*row, near)

        yield from batched(rows(), schema, 1024)

    return run


_BLOCKS = "label string, dim int, block long, centre array<double>, radius double, reps binary, copies binary, vectors binary, tree binary"


def _plant(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("rep")
    unit = _unit(table.column("vector").to_pylist())
    tree = CoverTree(unit)
    label, dim, block = (k.as_py() for k in key)
    one = {
        "label": [label], "dim": [dim], "block": [block], "centre": [unit[tree.centre[0]].tolist()], "radius": [float(tree.radius[0])],
        "reps": [table.column("rep").to_numpy().astype("<i8").tobytes()], "copies": [table.column("copies").to_numpy().astype("<i8").tobytes()], "vectors": [unit.astype("<f8").tobytes()], "tree": [tree.to_bytes()],
    }
    return pa.table(one, schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("block", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("reps", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("tree", pa.binary())]))


def _traverse(cosine: float):
    schema = pa.schema([("rep", pa.int64()), ("linked", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(row: dict, which: str) -> tuple:
            reps = np.frombuffer(row[f"reps_{which}"], "<i8")
            return np.frombuffer(row[f"vectors_{which}"], "<f8").reshape(len(reps), -1), CoverTree.from_bytes(row[f"tree_{which}"]), np.frombuffer(row[f"copies_{which}"], "<i8"), reps

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    (a, ta, wa, ra), (b, tb, wb, rb) = side(row, "a"), side(row, "b")
                    same = row["block_a"] == row["block_b"]
                    na, nb, edges = dual_links(a, ta, wa, b, tb, wb, cosine, same)
                    names = ra if same else np.concatenate([ra, rb])
                    for reps, n in ((ra, na), (rb, nb)):
                        for at in np.flatnonzero(n):
                            yield int(reps[at]), int(n[at]), None
                    for x, y in edges:
                        yield int(names[x]), 0, int(names[y])

        yield from batched(rows(), schema)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of vectors: id_col, class_id, n_links, component_id, kept.

    Vectors of the same label (not null) and length with a cosine of at least `cosine`, in double precision, are linked.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. class_id is the smallest id
    with an equal vector and label, n_links the number of other rows linked directly, component_id the smallest id
    reachable; kept says whether that is the row's own id. Repeated rows are vectors of their own and link with each other.
    Rows with a null id are counted as links of others, and have null class_id and component_id unless a row with an id equals them. Other columns aren't
    read. An empty table gives an empty result.
    """  # noqa: E501
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    classes = rows.where("valid").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = saved(classes.where("rep is not null").select("label", F.size("vector").alias("dim"), "vector", "rep", "copies"), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    sample = sorted(few_by_hash(classes.select("rep", "dim", "vector"), F.xxhash64("rep"), PIVOT_SAMPLE).collect(), key=lambda r: r["hash"])
    common = max({r["dim"] for r in sample}, key=[r["dim"] for r in sample].count, default=0)
    pivots = _pivots(_unit([r["vector"] for r in sample if r["dim"] == common]) if common else np.zeros((0, 0)), min(PIVOTS, math.ceil(largest / BLOCK)))
    dealt = classes.select("label", "dim", "rep", "copies", "vector").mapInArrow(_assign(spark.sparkContext.broadcast(pivots)), "label string, dim int, rep long, copies long, vector array<double>, pivot int")
    dealt = saved(dealt, "dealt")
    sizes = dealt.groupBy(F.col("label").alias("sl"), F.col("dim").alias("sd"), F.col("pivot").alias("sp")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    held = dealt.join(sizes, (F.col("label") == F.col("sl")) & (F.col("dim") == F.col("sd")) & (F.col("pivot") == F.col("sp")))
    held = held.select("label", "dim", F.expr("pivot * 4294967296L + pmod(xxhash64(rep), parts)").alias("block"), "rep", "copies", "vector")
    blocks = saved(held.groupBy("label", "dim", "block").applyInArrow(_plant, _BLOCKS), "blocks")
    stats = blocks.select("label", "dim", "block", "centre", "radius")
    a, b = stats.withColumnsRenamed({"block": "block_a", "centre": "ca", "radius": "ra"}), stats.select(F.col("label").alias("lb"), F.col("dim").alias("db"), F.col("block").alias("block_b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) - F.col("ra") - F.col("rb") <= math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    pairs = a.join(b, (F.col("label") == F.col("lb")) & (F.col("dim") == F.col("db")) & (F.col("block_a") <= F.col("block_b")) & near).select("label", "dim", "block_a", "block_b")
    for s in ("a", "b"):
        full = blocks.select(F.col("label").alias(f"l{s}"), F.col("dim").alias(f"d{s}"), F.col("block").alias(f"k{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("reps", "copies", "vectors", "tree")))
        pairs = pairs.join(full, (F.col("label") == F.col(f"l{s}")) & (F.col("dim") == F.col(f"d{s}")) & (F.col(f"block_{s}") == F.col(f"k{s}"))).drop(f"l{s}", f"d{s}", f"k{s}")
    found = saved(pairs.drop("label", "dim").mapInArrow(_traverse(cosine), "rep long, linked long, other long"), "links")
    linked = found.groupBy(F.col("rep").alias("lr")).agg(F.sum("linked").alias("linked"))
    joined = components(found.where("other is not null"), "rep", "other")
    named = classes.join(linked, F.col("rep") == F.col("lr"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("label").alias("nl"), F.col("vector").alias("nv"), "rep", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, F.col("valid") & (F.col("label") == F.col("nl")) & (F.col("vector") == F.col("nv")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("rep", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
