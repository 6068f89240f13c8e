"""Operators on documents: small cases by hand and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import bpe as B
from tidegauge.llm import exact_dedup as E
from tidegauge.llm import line_dedup as L
from tidegauge.llm import lm_score as M
from tidegauge.llm import minhash_dedup as N
from tidegauge.llm import packing as P
from tidegauge.llm import sentencepiece as S
from tidegauge.llm import toxicity as T
from tidegauge.llm.elias_fano import EliasFano, encode
from tidegauge.llm.common import mix
from tidegauge.llm.queries import op3_sentencepiece, op5_lm_score, op8_best_fit_packing

ODD = [(0, None), (1, ""), (2, "  a\t\nb "), (3, " a b "), (3, " a b "), (4, "a b"), (5, "x" * 200_000), (6, "x" * 200_000), (None, "a b"), (7, "ünï 漢字 🎉   \\n")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- exact duplicates


@pytest.mark.parametrize("extra", [False, True])
def test_exact_duplicates(table, extra):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_duplicates(table(ODD, extra)).collect()}
    assert got == {(0, 0, 2, True), (1, 0, 2, False), (2, 2, 3, True), (3, 2, 3, False), (4, 4, 2, True), (None, 4, 2, False), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True)}
    sha = {r["doc_id"]: r["text_sha256"] for r in E.exact_duplicates(table(ODD)).collect()}
    assert sha[3] == hashlib.sha256(b" a b ").hexdigest() and sha[0] == hashlib.sha256(b"").hexdigest()


def test_exact_duplicates_of_nothing(table):
    assert E.exact_duplicates(table([])).count() == 0


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [np.unique(rng.integers(0, 5000, n).astype(np.uint64) * np.uint64(0x1234567890AB), return_counts=True) for n in (0, 1, 700, 3000)]
    filters = [E.CountingQuotientFilter.from_bytes(E.CountingQuotientFilter.of(k, c, 60).to_bytes()) for k, c in parts]
    want = Counter()
    for k, c in parts:
        want.update(dict(zip(k.tolist(), c.tolist())))
    keys, counts = E.CountingQuotientFilter.merged(filters, 60).entries()
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(want) and (np.diff(keys.astype(np.int64)) > 0).all()


# -- lines


def test_repeated_lines(table):
    line = "This line is long enough to count"
    docs = [(1, f"{line}\nown one"), (2, f" {line.upper()}\t\nb"), (3, f"{line}\n{line}\nc"), (4, "short\nshort"), (5, "short"), (6, "short"), (7, None), (8, "\n\n"), (None, line), (9, f"twice only, in two documents\n{'y' * 100_000}"), (10, "twice only, in two documents")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in L.drop_repeated_lines(table(docs, True)).collect()}
    assert got[1] == (2, 1, "own one") and got[2] == (2, 1, "b") and got[3] == (3, 0, docs[2][1])
    assert got[4] == (2, 0, "short\nshort") and got[7] == (1, 0, "") and got[8] == (3, 0, "\n\n") and got[None] == (1, 0, line)
    assert got[9][1] == got[10][1] == 0
    assert L.drop_repeated_lines(table([])).count() == 0


def test_common_lines_give_the_same(table, monkeypatch):
    """Lines of very many documents go another way than others."""
    docs = [(i, "\n".join(f"line number {k} of this corpus" for k in range(i % 9)) + "\n" + "a line that is in all of them") for i in range(30)]
    plain = rows(L.drop_repeated_lines(table(docs)))
    monkeypatch.setattr(L, "COMMON", 5)
    assert rows(L.drop_repeated_lines(table(docs))) == plain


def test_filters_of_partitions_merge(table):
    """A line that two partitions have, or that one has twice, is in the merged twice-seen filter; hardly any other line is."""
    import pyarrow as pa

    lines = [f"this is line number {i} of many others" for i in range(400)]
    parts = [[*lines[:150], lines[200]], [lines[200], *lines[140:160]], [lines[300], f"{lines[301]}\n{lines[302]}", lines[301]]]
    sent = [b for p in parts for b in L._filters(20, 4)(iter([pa.RecordBatch.from_pydict({"text": pa.array(p)})]))]
    table_ = pa.Table.from_batches(sent)
    twice = {s: L._merge((pa.scalar(s),), table_.filter(pa.compute.equal(table_.column("segment"), s))).column("bits")[0].as_py() for s in set(table_.column("segment").to_pylist())}

    class Shared:
        value = twice

    ask = pa.RecordBatch.from_pydict({"id": pa.array([1]), "print": pa.array([1]), "text": pa.array(["\n".join(lines)])})
    found = {k for b in L._suspected(20, 4, Shared)(iter([ask])) for k in b.column("key").to_pylist()}
    assert set(lines[140:150]) | {lines[200], lines[301]} <= found and len(found) <= 15


def test_a_full_filter_gives_the_same(table):
    docs = [(i, "\n".join(f"line number {random.Random(i * 31 + k).randrange(40)} of this corpus" for k in range(12))) for i in range(40)]
    full = L.drop_repeated_lines(table(docs), bits_per_line=1, max_filter_bytes=1)
    assert rows(full) == rows(L.drop_repeated_lines(table(docs)))


# -- near duplicates


def _brute(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_brute_force(table, size, percent):
    rng = random.Random(size)
    words = [f"w{k}" for k in range(3000)]
    docs = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 300]))]
        for _ in range(25):  # chains of edits: many pairs lie just beside the threshold
            base = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                base[rng.randrange(len(base))] = rng.choice(words)
            docs.append((len(docs), " ".join(base)))
    docs += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "two words"), (905, "Two\twords")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(table(docs, True), size, percent).collect()}
    assert got == _brute(docs, size, percent)


def test_near_duplicates_blocks(table, monkeypatch):
    """A group whose members aren't all linked goes through the comparison of blocks."""
    rng = random.Random(3)
    base = [f"v{k}" for k in range(200)]
    docs = []
    for i in range(40):
        own = list(base)
        for k in rng.sample(range(200), 12):
            own[k] = f"e{i % 20}-{k}"
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(N, "BLOCK", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(table(docs), 3, 85).collect()}
    assert got == _brute(docs, 3, 85)


def test_near_duplicates_odd_rows(table):
    got = {(r["doc_id"], r["class_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(table([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A B C")])).collect()}
    assert got == {(None, None, None, True), (1, 1, 1, True), (2, 1, 1, False)}
    assert N.near_duplicates(table([])).count() == 0


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(5)
    one = rng.integers(0, 2**63, 1)
    big = np.unique(rng.integers(0, 2**63, 4000)).astype(np.uint64)
    drawn = N.sketches([one.astype(np.uint64), big[:3000], big[1000:], np.zeros(0, np.uint64)])
    assert (drawn[:3] != N._EMPTY).all() and (drawn[3] == N._EMPTY).all()
    assert abs((drawn[1] == drawn[2]).mean() - 0.5) < 0.2  # 2000 of 4000


# -- tokenizers


TRICKY = ["", " ", "  ", "a", " a", "a ", "a  b", "\n b", "a \n b", "a\n\n b ", "it's <|endoftext|> ok", "x y z", "\x00 a", "　 日本", "don't 's \t'S", "漢字 🎉▁x ▁"]


@pytest.fixture(scope="module")
def library(bpe):
    """Ids by the library that the contract names."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_texts_encode_like_the_library(spark, sf, bpe, library):
    """Odd texts, long runs, characters of every block, and all texts of a given table."""
    e = B.TextTokens(bpe)
    every = [chr(c) for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    runs = ["a" * 50_000, "-=" * 20_000, " " * 50_000 + "x", "\n" * 9_999, "漢" * 20_000]
    table = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = TRICKY + runs + [f"a{c} {c}1 .{c}  {c}" for c in every] + table
    assert [e.encode(t).tolist() for t in texts] == library(texts)
    assert e.count("") == 0


def test_pieces_are_the_librarys(pieces):
    import sentencepiece

    m, own = S.PieceModel(pieces), sentencepiece.SentencePieceProcessor(model_file=pieces)
    texts = [t for t in TRICKY if S.SPACE not in t and "\x00" not in t] + ["The quick brown föx " * 50, "a" * 300, " " * 40 + "x"]
    assert [np.frombuffer(x, "<i4").tolist() for x in m.encode_all(texts)] == own.encode(texts)


def test_best_segmentation_is_brute_force(pieces):
    m = S.PieceModel(pieces)
    m.by_merges = False  # as for a unigram model: the highest sum of scores

    def brute(t):
        best = [0.0] + [-math.inf] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - 20), e):
                score = m.pieces[t[s:e]][2] if t[s:e] in m.pieces else m.unknown_score if e - s == 1 else -math.inf
                best[e] = max(best[e], best[s] + score)
        return best[-1]

    for t in ("▁thereonly", "▁für", "日本x", "▁▁▁a", "z\u0001z"):
        assert m.best(t)[1] == pytest.approx(brute(t))


def test_query_encodes_a_table(spark, sf, pieces):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: np.array(r["ids"]).tolist() for r in S.encode_texts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), pieces).collect()}
    same = [i for i, t in docs.items() if S.SPACE not in t and "\x00" not in t]  # the library can't give these two back
    assert [got[i] for i in same] == own.encode([docs[i] for i in same]) and len(same) > 0.9 * len(docs)
    shown = {r["doc_id"]: r for r in op3_sentencepiece(spark, sf).collect()}
    assert {i: (r["n_ids"], r["decoded_sha256"]) for i, r in shown.items()} == {i: (len(got[i]), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()}


def test_round_trip(table, pieces):
    docs = [(i, t) for i, t in enumerate(TRICKY)] + [(None, None), (99, "x y " * 30_000)]
    encoded = S.encode_texts(table(docs, True), pieces)
    back = {r["doc_id"]: r["text"] for r in S.decode_ids(encoded, pieces).collect()}
    assert back == {i: t or "" for i, t in docs}
    assert S.encode_texts(table([]), pieces).count() == 0


# -- packing


def test_packing(table, bpe, library):
    docs = [(i, " ".join(["word"] * random.Random(i).randrange(0, 900))) for i in range(60)] + [(100, None), (101, ""), (102, "long text " * 4000), (None, "a"), (3, "again")]
    df = table(docs, True)
    placed = P.pack_documents(df, bpe)
    got = placed.collect()
    ids = [np.array([*x, 2], "<u4").tobytes() for x in library([t or "" for _, t in docs])]
    assert sum(r["length"] for r in got) == sum(len(x) for x in ids) // 4
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    long_ = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 102)
    whole = ids[[i for i, _ in docs].index(102)]
    assert all(n == 1024 for _, _, n, _ in long_[1:]) and all(zlib.crc32(whole[4 * s : 4 * (s + n)]) == c for _, s, n, c in long_)
    assert len(by) <= -(-sum(r["length"] for r in got) // 1024) + 1
    assert P.pack_documents(table([]), bpe).count() == 0


def test_sequences_hold_the_documents(table, bpe, library):
    docs = [(i, f"text {i} " * (i * 7)) for i in range(30)]
    df = table(docs)
    placed = P.pack_documents(df, bpe).cache()
    ids = [np.array([*x, 2], "<u4") for x in library([t for _, t in docs])]
    pieces = {(r["doc_id"], r["sequence_id"], r["offset"]): (r["start"], r["length"]) for r in placed.collect()}
    for s in P.sequences(df, placed, bpe).collect():
        own = sorted((o, d) for d, q, o in pieces if q == s["sequence_id"])
        want = b"".join(ids[d][(at := pieces[d, s["sequence_id"], o])[0] : at[0] + at[1]].tobytes() for o, d in own)
        assert bytes(s["ids"]) == want and s["doc_ids"] == [d for _, d in own]


def _fewest(lengths, size):
    """The fewest bins, by trying all."""
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            put(k + 1, [r - lengths[k] * (i == j) for j, r in enumerate(rooms)])
        put(k + 1, [*rooms, size - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best if lengths else 0


def _improves(bins, lengths, size):
    """Whether some move, one for one, two for one or one for two raises the sum of squared fills."""
    for a in bins:
        for b in bins:
            if a is b or not sum(lengths[i] for i in a) <= sum(lengths[i] for i in b) < size:
                continue
            room = size - sum(lengths[i] for i in b)
            sums = lambda x: {*(lengths[i] for i in x)} | {lengths[x[i]] + lengths[x[j]] for i in range(len(x)) for j in range(i)}
            if any(0 < g <= room for g in (*(lengths[i] - n for i in a for n in sums(b)), *(n - lengths[j] for j in b for n in sums(a)), *(lengths[i] for i in a))):
                return True
    return False


def test_local_search():
    optimal = extra = 0
    for seed in range(60):
        rng = random.Random(seed)
        n = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 13))]
        bins = P.pack(n, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(n))) and all(sum(n[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(P.best_fit(n, 100)) and not _improves(bins, n, 100)
        optimal += len(bins) == _fewest(n, 100)
        extra = max(extra, len(bins) - _fewest(n, 100))
    assert optimal >= 57 and extra <= 1
    rng = random.Random(1)
    n = [rng.randrange(1, 12) for _ in range(3000)]  # very many tiny pieces in a bin
    bins = P.pack(n, 1024)
    assert len(bins) == -(-sum(n) // 1024) and sorted(i for b in bins for i in b) == list(range(3000))
    assert not _improves([b for b in bins], n, 1024)


def test_query_packs_a_table(spark, sf, library):
    """Every id of every document once, in pieces as the contract cuts them, in gapless sequences of at most 1024."""
    got = op8_best_fit_packing(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: np.array([*x, 2], "<u4") for i, x in zip(docs, library(list(docs.values())))}
    by, total = {}, 0
    for i in docs:
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert [p for p, *_ in own] == list(range(len(own))) and own[0][1] == 0 and sum(n for _, _, n, _ in own) == len(ids[i])
        assert all(a[1] + a[2] == b[1] and b[2] == 1024 for a, b in zip(own, own[1:])) and (len(own) == 1) == (len(ids[i]) <= 1024)
        assert all(zlib.crc32(ids[i][s : s + n].tobytes()) == c for _, s, n, c in own)
        total += len(ids[i])
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        ends = [0]
        for offset, n in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 1024
    assert len(by) <= -(-total // 1024) + 2


# -- language model


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 5), (33, 40), (1000, 2**63), (5000, 6000)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        e = EliasFano(np.frombuffer(encode(v), np.uint8))
        assert (e.all() == v).all()
        ask = np.concatenate([v, rng.integers(0, top, 50).astype(np.uint64)])
        at = {int(x): i for i, x in enumerate(v)}
        assert e.find(ask).tolist() == [at.get(int(x), -1) for x in ask]
        if len(v):
            pick = rng.integers(0, len(v), 40)
            assert (e.get(pick) == v[pick]).all()


def test_elias_fano_with_clusters_and_bounds():
    """Dense runs between wide gaps, blocks that aren't full, and searches that pointers bound."""
    rng = np.random.default_rng(5)
    for n in (1, 31, 32, 33, 2000):
        v = np.unique(np.concatenate([np.arange(i, i + rng.integers(1, 40)) for i in rng.integers(0, 2**61, n)]).astype(np.uint64))
        e = EliasFano(np.frombuffer(encode(v), np.uint8))
        assert (e.all() == v).all() and (e.get(np.arange(len(v))) == v).all()
        ask = np.unique(np.concatenate([v, v + np.uint64(1), v - np.minimum(v, np.uint64(1))]))
        place = np.searchsorted(v, ask)
        want = np.where((place < len(v)) & (v[np.minimum(place, len(v) - 1)] == ask), place, -1)
        assert (e.find(ask) == want).all()
        begin = np.minimum(np.maximum(place - rng.integers(0, 50, len(ask)), 0), len(v) - 1)
        end = np.minimum(np.maximum(place, begin) + rng.integers(1, 50, len(ask)), len(v))
        assert (e.find(ask, begin, end) == want).all()


def test_a_lookup_reads_few_values(monkeypatch):
    """Values of one block rarely share their high part, and where all do, what they share is halved."""
    reads, low = [0], EliasFano._low

    def counted(self, where, place):
        reads[0] += len(place)
        return low(self, where, place)

    monkeypatch.setattr(EliasFano, "_low", counted)
    rng = np.random.default_rng(6)
    for top, most in ((2**33, 1.5), (2**36, 1.5), (2**40, 1.5), (None, 6)):
        v = np.unique(rng.integers(0, top, 50_000).astype(np.uint64)) if top else (np.arange(3200) // 32 * 2**40 + np.arange(3200) % 32 + (np.arange(3200) % 32 == 31) * 2**30).astype(np.uint64)
        e = EliasFano(np.frombuffer(encode(v), np.uint8))
        reads[0] = 0
        assert (e.find(v) == np.arange(len(v))).all()
        assert reads[0] < most * len(v)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_the_formula(table, order):
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(0, 12)))) for i in range(40)] + [(40, None), (41, ""), (None, "a B\tz")]
    train = docs[:30]
    got = {r["doc_id"]: r for r in M.lm_scores(table(docs, True), M.fit_ngram_model(table(train), order)).collect()}
    counts = [Counter() for _ in range(order + 1)]
    for _, t in train:
        w = ["$", *(t or "").lower().split(), "$"]
        for j in range(1, len(w)):
            for k in range(1, min(order, j + 1) + 1):
                counts[k][tuple(w[j - k + 1 : j + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    total, kinds = Counter(), Counter()
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (counts[1][g] + 1) / (n + v + 1)
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        return max(counts[len(g)][g] - M.DISCOUNT, 0) / total[h] + M.DISCOUNT * kinds[h] / total[h] * p(g[1:])

    for i, t in docs:
        w = ["$", *(t or "").lower().split(), "$"]
        want = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(1, len(w)))
        base = sum(math.log10((counts[1][(x,)] + 1) / (n + v + 1)) for x in w[1:])
        r = got[i]
        assert r["score"] == pytest.approx(want, abs=2e-3 * len(w)) and r["base_score"] == pytest.approx(base)
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(w) - 1, n, sum(counts[1][(x,)] > 0 for x in w[1:]))


def test_probabilities_sum_to_one(table):
    train = [(0, "a b a c"), (1, "b b")]
    model = M.fit_ngram_model(table(train), 2)
    # of all words after "a", and of one unknown word
    ask = [(0, "a a"), (1, "a b"), (2, "a c"), (3, "a"), (4, "a zz")]
    got = {r["doc_id"]: r["score"] for r in M.lm_scores(table([*ask, (9, "")]), model).collect()}
    assert model.words == 4 and got  # a, b, c and the end
    shared = M.Trie(model)
    a = shared.find_words(np.array([__import__("xxhash").xxh3_64_intdigest(b"a")], np.uint64))
    words = np.array([0, 1, 2, 3, -1])
    unigram = model.unigram(shared.counts(words))
    assert (10 ** M._probability(shared, [np.repeat(a, 5)], words, unigram)).sum() == pytest.approx(1, abs=1e-3)


def test_query_scores_with_two_words_of_context(table, tmp_path):
    rng = random.Random(4)
    docs = table([(i, " ".join(rng.choice("abcd") for _ in range(30))) for i in range(60)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    train = docs.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 <> 2")
    got = {r["doc_id"]: r["score"] for r in op5_lm_score(docs.sparkSession, str(tmp_path)).collect()}
    two, three = ({r["doc_id"]: r["score"] for r in M.lm_scores(docs, M.fit_ngram_model(train, n)).collect()} for n in (2, 3))
    assert got == pytest.approx(three, abs=1e-9)
    assert max(abs(three[i] - two[i]) for i in three) > 0.1


def test_model_of_nothing(table):
    model = M.fit_ngram_model(table([]), 2)
    assert M.lm_scores(table([]), model).count() == 0
    assert M.lm_scores(table([(1, "a b")]), model).first()["n_known"] == 0


# -- toxicity


def test_ratios_are_plain_counts(table, monkeypatch):
    """Documents of each class that have an n-gram, against a plain computation over strings."""
    import pyarrow as pa

    texts = [(1, "You awful fool"), (0, "a fine day, fool"), (1, "awful awful"), (0, None), (0, "day")]
    batch = pa.RecordBatch.from_pydict({"label": pa.array([y for y, _ in texts], pa.int32()), "text": pa.array([t for _, t in texts])})
    got = {r["bucket"]: (r["n0"], r["n1"]) for b in T._frequencies(iter([batch])) for r in b.to_pylist()}
    want = {}
    for y, t in texts:
        grams = {w[k : k + n] for w in (f"<{x}>" for x in re.findall("[a-z]+", (t or "").lower())) for n in T.SIZES for k in range(len(w) - n + 1)}
        for g in grams:
            value = 0
            for c in g:
                value = (value * 0x100000001B3 + ord(c)) % 2**64
            bucket = int(mix(np.array([(value + len(g)) % 2**64], np.uint64))[0]) >> (64 - 18)
            want.setdefault(bucket, [set(), set()])[y].add(id(t))
    assert got == {b: (len(x[0]), len(x[1])) for b, x in want.items()}


def test_toxicity(spark, table):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "lomar" for b in "tenis" for c in ("ion", "ing", "er")]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = "scum" + rng.choice(["", "my", "bag"])
        docs.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, 1 if bad else 0))
    labels += [(5, None), (6, 7), (1, 0), (1, 0)]
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit_toxicity(table(docs), truth)
    odd = [(1000, None), (1001, ""), (None, "scum"), (1002, "SCUMmy " * 20_000)]
    got = {r["doc_id"]: r["score"] for r in T.with_toxicity(table([*docs, *odd], True), model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert got[1000] == got[1001] < 0.5 < got[1002]
    assert T.with_toxicity(table([]), model).count() == 0
    assert T.fit_toxicity(table(docs), truth.where("toxic = 0")).bias < 0
    assert T.fit_toxicity(table([]), truth).bias == 0


def _plain_toxicity(texts, labels):
    """Scores of texts by a model fitted on them, in plain Python: n-grams as strings, sums term by term."""
    grams = [Counter(w[k : k + n] for w in {f"<{x}>" for x in re.findall("[a-z0-9]+", t.lower())} for n in T.SIZES for k in range(len(w) - n + 1)) for t in texts]
    n1 = sum(labels)
    n0 = len(labels) - n1
    share, ratio = n1 / (n0 + n1), {}
    for g in set().union(*grams):
        a, b = (sum(g in x for x, y in zip(grams, labels) if y == label) for label in (1, 0))
        r = math.log((a + T.SMOOTHING * share) / n1) - math.log((b + T.SMOOTHING * (1 - share)) / n0)
        if abs(r) >= T.LEAST_RATIO:
            ratio[g] = r
    rows = [{g: c * ratio[g] for g, c in x.items() if g in ratio} for x in grams]
    w, bias, w2, bias2 = dict.fromkeys(ratio, 0.0), 0.0, dict.fromkeys(ratio, 1e-8), 1e-8
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for _ in range(T.STEPS):
        error = [(sigmoid(sum(v * w[g] for g, v in x.items()) + bias) - y) / len(rows) for x, y in zip(rows, labels)]
        slope = {g: T.RIDGE * w[g] for g in w}
        for e, x in zip(error, rows):
            for g, v in x.items():
                slope[g] += e * v
        for g, d in slope.items():
            w2[g] += d * d
            w[g] -= T.STEP * d / math.sqrt(w2[g])
        bias2 += sum(error) ** 2
        bias -= T.STEP * sum(error) / math.sqrt(bias2) * 4
    return [sigmoid(sum(v * w[g] for g, v in x.items()) + bias) for x in rows]


def test_the_fit_is_a_plain_one(spark, table):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(80):
        w = [rng.choice(["harbour", "tide", "wind", "boat", "sail", "rope", "deck"]) for _ in range(rng.randrange(1, 12))]
        labels.append(int(i % 3 == 0))
        texts.append(" ".join([*w, *(["Scum"] if labels[-1] and rng.random() < 0.9 else []), *(["vile"] if rng.random() < 0.2 + 0.6 * labels[-1] else [])]))
    docs, truth = table(list(enumerate(texts))), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in T.with_toxicity(docs, T.fit_toxicity(docs, truth)).collect()}
    want = _plain_toxicity(texts, labels)
    assert max(want) > 0.8 > 0.3 > min(want)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-9)


def test_values_beyond_the_bound_stay_away_from_the_driver(spark, table):
    rows = spark.createDataFrame([(h, n) for h, n in ((-5, 4), (-5, 3), (1, 2), (7, 0), (9, 50))], "hash long, held long")
    kept = lambda most: sorted((r["hash"], r["held"]) for r in T._within(rows, most).collect())
    assert kept(59) == [(-5, 3), (-5, 4), (1, 2), (7, 0), (9, 50)]
    assert kept(58) == kept(9) == [(-5, 3), (-5, 4), (1, 2), (7, 0)]
    assert kept(8) == [(-5, 3), (-5, 4)] and kept(6) == [] and T._within(rows.limit(0), 0).count() == 0
    docs = [(i, "scum of the sea" if i % 2 else "a fine day") for i in range(40)]
    truth = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert T.fit_toxicity(table(docs), truth, fit_values=0).bias == 0
