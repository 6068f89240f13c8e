"""Scores of texts under an n-gram model, held as an Elias-Fano trie in memory-mapped files.

Level 1 has the hashes of the training words in order, whose ranks are the words' ids, and their counts. In level k an
entry is a word id after the (k-1)-gram that is its parent. The entries of a level are one monotone sequence, in which a
parent's successors start at a base of its own; monotone pointers say where they are. A search for a successor
stays within its context. Probabilities and back-off weights are quantised to 16 bits.

Counting and building are Spark jobs: every task counts its own documents and sends sorted, compressed counts to the part
of the level that they belong to; parts are files in the shared folder, which scoring tasks map into memory.
"""

from __future__ import annotations

import functools
import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import elias_fano
from tidegauge.llm.common import U64, shared_dir
from tidegauge.llm.elias_fano import EliasFano

#: Absolute discount of the counts above level 1.
DISCOUNT = 0.75
#: Quantised log10 probabilities: steps of 1 / STEPS down to 65535 / STEPS.
STEPS = 4096
#: Training tokens whose counts a part of a level holds, about.
PART_TOKENS = 1 << 21
#: Bytes of text that are counted or scored together (unless one text has more), and counts that a task holds unmerged.
BYTES, HELD = 6 << 20, 1 << 22
#: Ranges of words into which level 2 is split beside its ranges of parents: what follows the commonest words spreads out.
WORD_RANGES = 4
#: The hash of a text's end, which is a token and the first word's context.
END = xxhash.xxh3_64_intdigest(b"\n")


@dataclass(frozen=True)
class Part:
    path: str
    entries: int


@dataclass(frozen=True)
class NgramModel:
    """Where the parts of each level are. Parts split level 1 by ranges of hashes; of a higher level, part
    range * ranges_of_words + word's range has what follows a range of parents."""

    order: int
    tokens: int
    words: int
    levels: list[list[Part]] = field(default_factory=list)

    def word_ranges(self, k: int) -> int:
        return WORD_RANGES if k == 2 else 1

    def parent_range(self, k: int, parts: int, parents: int) -> int:
        """Parents of a part of level k that has so many parts."""
        return -(-parents // (parts // self.word_ranges(k)))

    def part_of(self, k: int, parts: int, parents: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        own, ranges = parent // self.parent_range(k, parts, parents), self.word_ranges(k)
        return own if ranges == 1 else own * ranges + np.maximum(word, 0) * ranges // self.words

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of (count + 1) / (tokens + words + 1)."""
        return np.log10((counts + 1) / (self.tokens + self.words + 1))


def _local(path: str) -> str | None:
    """The path as a local one, if it is in the local file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def _write(path: str, *parts: bytes) -> None:
    """Write a file whole or not at all: a task that runs twice leaves one of two equal files."""
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    padded = [p + bytes(-len(p) % 8) for p in parts]
    temporary = f"{path}.{uuid.uuid4().hex}"
    if (at := _local(temporary)) is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.writelines([np.array([len(parts)], "<i8").tobytes(), head, *padded])
        os.replace(at, _local(path))
        return
    store, at = arrow_fs.FileSystem.from_uri(temporary)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as f:
        for p in (np.array([len(parts)], "<i8").tobytes(), head, *padded):
            f.write(p)
    store.move(at, arrow_fs.FileSystem.from_uri(path)[1])


def _delete(paths: list[str]) -> None:
    """Files, or folders with all that is in them."""
    for path in paths:
        store, at = (arrow_fs.LocalFileSystem(), own) if (own := _local(path)) is not None else arrow_fs.FileSystem.from_uri(path)
        store.delete_dir(at) if store.get_file_info(at).type == arrow_fs.FileType.Directory else store.delete_file(at)


@functools.lru_cache(maxsize=2048)
def _mapped(path: str) -> list[np.ndarray]:
    """The byte arrays of a file that _write has written, memory-mapped."""
    if (at := _local(path)) is not None:
        data = np.asarray(np.memmap(at, np.uint8, "r"))
    else:  # another store: map a copy that goes with the process
        store, where = arrow_fs.FileSystem.from_uri(path)
        with tempfile.TemporaryFile() as copy, store.open_input_stream(where) as f:
            while chunk := f.read(1 << 20):
                copy.write(chunk)
            copy.flush()
            data = np.asarray(np.memmap(copy, np.uint8, "r"))
    n = int(data[:8].view("<i8")[0])
    sizes, at, out = data[8 : 8 + 8 * n].view("<i8"), 8 + 8 * n, []
    for size in sizes.tolist():
        out.append(data[at : at + size])
        at += size + -size % 8
    return out


def _split(key: np.ndarray, parts: int, universe: int) -> np.ndarray:
    """Which of equal ranges of the universe each key is in."""
    width = -(-universe // parts)
    return (key // U64(width)).astype(np.int64) if key.dtype == U64 else key // width


def _groups(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the places that have it, in order; part numbers below 2**15 sort by radix."""
    if not len(part):
        return
    small = part.astype(np.int16) if part.max() < 1 << 15 else part
    order = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order]) != 0) + 1
    for a, b in zip([0, *cuts], [*cuts, len(order)]):
        yield int(part[order[a]]), order[a:b]


class Trie:
    """A model's levels as a task reads them."""

    def __init__(self, model: NgramModel):
        self.model = model
        self.offsets = [np.concatenate(([0], np.cumsum([p.entries for p in level]))).astype(np.int64) for level in model.levels]
        self.end = int(self.find_words(np.array([END], U64))[0])

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by their hashes, -1 for unknown ones."""
        level, out = self.model.levels[0], np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        for p, own in _groups(_split(hashes[order], len(level), 1 << 64)):
            own = order[own]
            at = EliasFano(_mapped(level[p].path)[0]).find(hashes[own]) if level[p].entries else out[own]
            out[own] = np.where(at >= 0, at + self.offsets[0][p], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of word ids, 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        part = np.where(ids >= 0, np.searchsorted(self.offsets[0], ids, side="right") - 1, -1)
        for p, own in _groups(part):
            if p >= 0:
                out[own] = _mapped(self.model.levels[0][p].path)[1].view("<i8")[ids[own] - self.offsets[0][p]]
        return out

    def successors(self, k: int, parents: np.ndarray, words: np.ndarray, weights: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each parent (a position in level k-1) and word: position in level k or -1, and with `weights` its log10
        probability and, of words that aren't found, the parent's back-off (else zeros). The back-off is 0 for parents that
        nothing follows."""
        level, n, model = self.model.levels[k - 1], int(self.offsets[k - 2][-1]), self.model
        base, ranges = model.parent_range(k, len(level), n), model.word_ranges(k)
        at, prob, back = np.full(len(parents), -1, np.int64), np.zeros(len(parents)), np.zeros(len(parents))
        for p, own in _groups(model.part_of(k, len(level), n, parents, words)):
            parent, word = parents.take(own) - p // ranges * base, words.take(own)
            found = self._found(level[p], parent, word)
            hit = np.flatnonzero(found >= 0)
            if weights and len(hit) < len(own):
                missed = np.flatnonzero(found < 0)
                backs = _mapped(f"{level[p - p % ranges].path}.weights")[2].view("<u2")
                back[own.take(missed)] = -backs.take(parent.take(missed)).astype(float) / STEPS
            if len(hit):
                own, found = own.take(hit), found.take(hit)
                at[own] = found + self.offsets[k - 1][p]
                if weights:
                    prob[own] = -_mapped(f"{level[p].path}.weights")[1].view("<u2").take(found).astype(float) / STEPS
        return at, prob, back

    def _found(self, part: Part, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Positions in a part of words after its parents, -1 where they aren't found."""
        known = np.flatnonzero(word >= 0)
        if not part.entries or not len(known):
            return np.full(len(word), -1, np.int64)
        if len(known) < len(word):
            found = np.full(len(word), -1, np.int64)
            found[known] = self._found(part, parent.take(known), word.take(known))
            return found
        (entries,), pointer = _mapped(f"{part.path}.entries"), EliasFano(_mapped(f"{part.path}.weights")[0])
        key, which = np.unique(parent * self.model.words + word, return_inverse=True)
        local = key // self.model.words
        # keys are sorted by parent: the pointers of each parent are looked up once, and parents without successors go
        turn = np.flatnonzero(np.diff(local, prepend=-1))
        first, times = local.take(turn), np.diff(turn, append=len(local))
        lo, hi = (pointer.get(first + d).view(np.int64) for d in (0, 1))
        lo, some = np.repeat(lo, times), np.repeat(hi > lo, times)
        hi, found = np.repeat(hi, times), np.full(len(key), -1, np.int64)
        found[some] = EliasFano(entries).find(key[some].view(U64), lo[some], hi[some])
        return found.take(which)


@functools.lru_cache(maxsize=2)
def _trie(key: str) -> list:
    return []


def _open(shared) -> Trie:
    """One trie for each worker and model."""
    held = _trie(shared.value.levels[0][0].path + str(len(shared.value.levels)))
    if not held:
        held.append(Trie(shared.value))
    return held[0]


@dataclass
class Words:
    """The words of some texts: the distinct ones, by their place there all of them in order, and each text's number."""

    distinct: list[bytes]
    places: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Arrow's ASCII white space is that of the contract. It leaves an empty word where a text starts or ends with it."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        encoded = lists.flatten().cast(pa.binary()).dictionary_encode()
        places, sizes = encoded.indices.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if (empty := pc.index(encoded.dictionary, b"").as_py()) >= 0:
            gone = places == empty
            sizes = sizes - np.add.reduceat(gone, np.cumsum(sizes) - sizes)
            places = places[~gone]
        return cls(distinct, places, sizes)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), U64, len(self.distinct))


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of batches of at most BYTES of text, and their words."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        first, total = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if k > first and total + n > BYTES:
                yield (own := batch.slice(first, k - first)), Words.of(own.column(column))
                first, total = k, 0
            total += n
        if first < batch.num_rows:
            yield (own := batch.slice(first)), Words.of(own.column(column))


def _tokens(trie: Trie, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and training counts of all tokens, each text's end included, and where texts start."""
    starts = np.concatenate(([0], np.cumsum(words.sizes + 1)))
    end = np.array([trie.end])
    ids, counts = np.full(starts[-1], trie.end, np.int64), np.full(starts[-1], trie.counts(end)[0], np.int64)
    inside = np.ones(len(ids), bool)
    inside[starts[1:] - 1] = False
    known = trie.find_words(words.hashes())
    ids[inside], counts[inside] = known[words.places], trie.counts(known)[words.places]
    return ids, counts, starts[:-1]


def _walk(trie: Trie, ids: np.ndarray, starts: np.ndarray, deepest: int, weights: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Level by level from 2 to `deepest`: the position in the level below of the words before each token (-1 where there is
    none), the tokens that have one, and the tokens' positions, probabilities and back-offs in the level.

    A token's position with the words before it is the context of the next token, one level deeper.
    """
    def shifted(x: np.ndarray, first: int) -> np.ndarray:
        out = np.concatenate((x[:1], x[:-1]))
        out[starts] = first
        return out

    context = shifted(ids, trie.end)
    for k in range(2, deepest + 1):
        some = np.flatnonzero(context >= 0)
        found = trie.successors(k, context[some], ids[some], weights)
        yield context, some, *found
        at = np.full(len(ids), -1, np.int64)
        at[some] = found[0]
        context = shifted(at, -1)
    yield context, np.flatnonzero(context >= 0)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    key, count = np.concatenate(keys or [np.zeros(0, U64)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _packed(part: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part that has some of the sorted keys: the keys in Elias-Fano form, which of them came more than once,
    the counts of those as bytes, and counts that no byte holds."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        several = count[a:b] > 1
        more = count[a:b][several]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part[a]], pa.int32()), "keys": pa.array([elias_fano.encode(key[a:b])], pa.binary()), "several": pa.array([np.packbits(several).tobytes()], pa.binary()),
            "counts": pa.array([np.minimum(more, 255).astype("u1").tobytes()], pa.binary()), "large": pa.array([more[more >= 255].astype("<i8").tobytes()], pa.binary()),
        })


_PACKED = "part int, keys binary, several binary, counts binary, large binary"


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for row in zip(*(table.column(c) for c in ("keys", "several", "counts", "large"))):
        own, several, more, large = (np.frombuffer(x.as_buffer(), np.uint8) for x in row)
        keys.append(EliasFano(own).all())
        count = np.ones(len(keys[-1]), np.int64)
        more = more.astype(np.int64)
        more[more == 255] = large.view("<i8")
        count[np.unpackbits(several, count=len(count)).astype(bool)] = more
        counts.append(count)
    return _counted(keys, counts)


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for _, words in _chunks(batches, "text"):
            keys += [np.array([END], U64), words.hashes()]
            counts += [np.array([len(words.sizes)], np.int64), np.bincount(words.places, minlength=len(words.distinct))]
            if sum(map(len, keys[1:])) > HELD:
                key, count = _counted(keys, counts)
                keys, counts = [key], [count]
        key, count = _counted(keys, counts)
        some = count > 0  # the empty word is none
        key, count = key[some], count[some]
        yield from _packed(_split(key, parts, 1 << 64), key, count)

    return run


_BUILT = "part int, entries long, tokens long"


def _built(part: int, entries: int, tokens: int) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int32()), "entries": pa.array([entries], pa.int64()), "tokens": pa.array([tokens], pa.int64())})


def _build_words(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, counts = _merged(table)
        _write(f"{folder}/1-{key[0].as_py()}", elias_fano.encode(hashes), counts.astype("<i8").tobytes())
        return _built(key[0].as_py(), len(hashes), int(counts.sum()))

    return run


_TOKENS = "ids binary, starts binary"


def _as_ids(shared):
    """Chunks of texts as the ids of their tokens, which every level is counted from, and where texts start."""
    schema = pa.schema([("ids", pa.binary()), ("starts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _open(shared)
        kind = "<u4" if trie.model.words < 1 << 32 else "<u8"
        for _, words in _chunks(batches, "text"):
            ids, _, starts = _tokens(trie, words)
            yield pa.RecordBatch.from_arrays([pa.array([ids.astype(kind).tobytes()], pa.binary()), pa.array([starts.astype("<i8").tobytes()], pa.binary())], schema=schema)

    return run


def _count_grams(shared, k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _open(shared)
        model, parents = trie.model, int(trie.offsets[k - 2][-1])
        base, ranges, kind = model.parent_range(k, parts, parents), model.word_ranges(k), "<u4" if model.words < 1 << 32 else "<u8"

        def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            part, key = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for p, own in _groups(part):
                found, count = np.unique(key[own], return_counts=True)
                yield from _packed(np.full(len(found), p), found, count)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for own_ids, own_starts in zip(batch.column("ids"), batch.column("starts")):
                ids, starts = np.frombuffer(own_ids.as_buffer(), kind).astype(np.int64), np.frombuffer(own_starts.as_buffer(), "<i8")
                *_, (context, seen) = _walk(trie, ids, starts, k - 1, False)  # all but texts' first tokens, above level 2
                part = model.part_of(k, parts, parents, context[seen], ids[seen])
                held.append((part.astype(np.int32), (context[seen] - part // ranges * base).astype(U64) * U64(model.words) + ids[seen].astype(U64)))
                if sum(len(x) for x, _ in held) > HELD:
                    yield from counted(held)
        if held:
            yield from counted(held)

    return run


def _build_grams(shared, folder: str, k: int, parts: int):
    """A part's entries, and its weights where it has all that follows its parents. Else those wait for the counts of the
    other ranges of words, and the part's counts and kinds by parent are written beside."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        trie, part = _open(shared), key[0].as_py()
        path = f"{folder}/{k}-{part}"
        entry, counts = _merged(table)
        parent, word = _split_entries(trie, entry)
        _write(f"{path}.entries", elias_fano.encode(entry))
        if trie.model.word_ranges(k) == 1:
            held = _held(trie, k, part, parts)
            total, kinds = np.bincount(parent, weights=counts, minlength=held), np.bincount(parent, minlength=held)
            _write_weights(trie, path, k, part, parts, parent, word, counts, total, kinds)
        else:
            first = np.flatnonzero(np.diff(parent, prepend=-1))
            total, kinds = np.add.reduceat(counts, first) if len(first) else counts, np.diff(first, append=len(parent))
            _write(f"{path}.counts", np.minimum(counts, 255).astype("u1").tobytes(), counts[counts >= 255].astype("<i8").tobytes(), parent[first].astype("<i8").tobytes(), total.astype("<i8").tobytes(), kinds.astype("<i8").tobytes())
        return _built(part, len(entry), int(counts.sum()))

    return run


def _held(trie: Trie, k: int, part: int, parts: int) -> int:
    """Parents in the range of a part."""
    parents, ranges = int(trie.offsets[k - 2][-1]), trie.model.word_ranges(k)
    base = trie.model.parent_range(k, parts, parents)
    return max(min(base, parents - part // ranges * base), 0)


def _split_entries(trie: Trie, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents, within the part's range, and words of entries."""
    return (entry // U64(trie.model.words)).astype(np.int64), (entry % U64(trie.model.words)).astype(np.int64)


def _write_weights(trie: Trie, path: str, k: int, part: int, parts: int, parent: np.ndarray, word: np.ndarray, counts: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
    """Pointers, probabilities, and, once for each range of parents, back-offs."""
    ranges = trie.model.word_ranges(k)
    with np.errstate(divide="ignore", invalid="ignore"):
        back = np.where(kinds > 0, np.log10(DISCOUNT * kinds / total), 0.0)
    start = part // ranges * trie.model.parent_range(k, parts, int(trie.offsets[k - 2][-1]))
    lower = 10.0 ** _lower(trie, k, parent + start, word)
    prob = np.log10((counts - DISCOUNT) / total[parent] + 10.0 ** back[parent] * lower)
    pointers = np.concatenate(([0], np.cumsum(np.bincount(parent, minlength=len(total)))))
    _write(f"{path}.weights", elias_fano.encode(pointers.astype(U64)), _codes(prob), _codes(back) if part % ranges == 0 else b"")


def _add_weights(shared, folder: str, k: int, entries: dict[int, int], parts: int):
    """Weights of parts that have only a range of the words after their parents: totals are summed over all ranges."""

    def build(part: int) -> None:
        trie = _open(shared)
        ranges, held = trie.model.word_ranges(k), _held(trie, k, part, parts)
        total, kinds = np.zeros(held, np.int64), np.zeros(held, np.int64)
        for p in range(part - part % ranges, part - part % ranges + ranges):
            if p in entries:
                at, own_total, own_kinds = (x.view("<i8") for x in _mapped(f"{folder}/{k}-{p}.counts")[2:])
                total[at] += own_total
                kinds[at] += own_kinds
        entry, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        if part in entries:
            small, more = _mapped(f"{folder}/{k}-{part}.counts")[:2]
            entry, counts = EliasFano(_mapped(f"{folder}/{k}-{part}.entries")[0]).all(), small.astype(np.int64)
            counts[counts == 255] = more.view("<i8")
        parent, word = _split_entries(trie, entry)
        _write_weights(trie, f"{folder}/{k}-{part}", k, part, parts, parent, word, counts, total, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                build(part)
            yield batch
        _mapped.cache_clear()  # the counts go

    return run


def _codes(log10: np.ndarray) -> bytes:
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype("<u2").tobytes()


def _lower(trie: Trie, k: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 probability of words after their parents' contexts without the first word, in the levels below k."""
    before: list[np.ndarray] = []  # the parents' words, the last one first
    for d in range(k - 1, 1, -1):
        parent, last = _entry(trie, d, parent)
        before.append(last)
    contexts = []
    for depth in range(1, k - 1):
        at = before[depth - 1]
        for d in range(2, depth + 1):
            at = trie.successors(d, at, before[depth - d])[0]
        contexts.append(at)
    return _probability(trie, contexts, word, trie.model.unigram(trie.counts(word)))


def _entry(trie: Trie, k: int, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents and words of entries of level k."""
    level, parents = trie.model.levels[k - 1], int(trie.offsets[k - 2][-1])
    base, ranges, words = trie.model.parent_range(k, len(level), parents), trie.model.word_ranges(k), trie.model.words
    up, last = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
    for p, own in _groups(np.searchsorted(trie.offsets[k - 1], position, side="right") - 1):
        value = EliasFano(_mapped(f"{level[p].path}.entries")[0]).get(position[own] - trie.offsets[k - 1][p])
        up[own], last[own] = (value // U64(words)).astype(np.int64) + p // ranges * base, (value % U64(words)).astype(np.int64)
    return up, last


def _probability(trie: Trie, contexts: list[np.ndarray], word: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """log10 probabilities of words: after the longest context that the word follows, with the back-offs of longer ones."""
    out, open_, weight = unigram.copy(), np.ones(len(word), bool), np.zeros(len(word))
    for k in range(len(contexts) + 1, 1, -1):
        some = np.flatnonzero(open_ & (contexts[k - 2] >= 0))
        at, prob, back = trie.successors(k, contexts[k - 2][some], word[some])
        hit = at >= 0
        out[some[hit]] = weight[some[hit]] + prob[hit]
        open_[some[hit]] = False
        weight[some[~hit]] += back[~hit]
    out[open_] += weight[open_]
    return out


def _levels(rows: list, folder: str, k: int, parts: int) -> list[Part]:
    entries = {r["part"]: r["entries"] for r in rows}
    return [Part(f"{folder}/{k}-{p}", entries.get(p, 0)) for p in range(parts)]


def fit_ngram_model(docs: DataFrame, order: int = 2, text_col: str = "text") -> NgramModel:
    """Count and build levels 1 to `order` from all rows of docs; a row without text is an end alone.

    The driver gets one small row for each part of a level.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(2, math.ceil(math.log2(max(size / 6 / PART_TOKENS, 1))))
    folder = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    rows = texts.mapInArrow(_count_words(parts), _PACKED).groupBy("part").applyInArrow(_build_words(folder), _BUILT).collect()
    model = NgramModel(order, sum(r["tokens"] for r in rows), sum(r["entries"] for r in rows), [_levels(rows, folder, 1, parts)])
    if order > 1 and model.words:
        ids = f"{folder}/ids"
        texts.mapInArrow(_as_ids(spark.sparkContext.broadcast(model)), _TOKENS).write.option("compression", "zstd").parquet(ids)
    for k in range(2, order + 1 if model.words else 2):
        shared = spark.sparkContext.broadcast(model)
        counted = spark.read.schema(_TOKENS).parquet(ids).mapInArrow(_count_grams(shared, k, parts), _PACKED)
        rows = counted.groupBy("part").applyInArrow(_build_grams(shared, folder, k, parts), _BUILT).collect()
        entries = {r["part"]: r["entries"] for r in rows}
        # parts without entries have weights only as the holders of their range's back-offs
        split, missing = model.word_ranges(k) > 1, [p for p in range(parts) if p not in entries]
        if todo := list(range(parts)) if split else missing:
            jobs = spark.createDataFrame([(p,) for p in todo], "part int").repartition(len(todo), "part")
            jobs.mapInArrow(_add_weights(shared, folder, k, entries, parts), "part int").write.format("noop").mode("overwrite").save()
        if split:
            _delete([f"{folder}/{k}-{p}.counts" for p in entries])
        model = NgramModel(order, model.tokens, model.words, [*model.levels, _levels(rows, folder, k, parts)])
    if order > 1 and model.words:
        _delete([ids])
    return model


def _scores(shared):
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _open(shared)
        for batch, words in _chunks(batches, "text"):
            ids, counts, starts = _tokens(trie, words)
            base = trie.model.unigram(counts)
            score = base.copy()
            for level in _walk(trie, ids, starts, len(trie.model.levels), True):
                if len(level) == 5:  # a word that follows the context has a probability there, others the back-off too
                    _, some, at, prob, back = level
                    score[some] = np.where(at >= 0, prob, score[some] + back)
            total = lambda x: pa.array(np.add.reduceat(x, starts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words.sizes + 1), total((counts > 0).astype(np.int64)), total(base), total(score)], schema=schema)

    return run


def lm_scores(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z in lower case, and one end; null and empty texts are an end alone. n_known counts the tokens
    seen in training. base_score is the log10 probability under add-one unigrams, score under the model: interpolated
    absolute discounting over those unigrams. Repeated rows get a row each, null ids stay null. Other columns aren't read.
    An empty table gives an empty result; a model of no documents gives 0 for any text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(_scores(shared), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
