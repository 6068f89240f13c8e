"""Decomposed documents, coded vectors and repaired conversations."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common, line_dedup
from tidegauge.llm import conversation_repair as C
from tidegauge.llm import length_buckets as B
from tidegauge.llm import vector_codes as Q
from tidegauge.llm.chat_format import chat_windows
from tidegauge.llm.queries import op12_conversation_repair, op13_packing, oracle_sql, queries

# -- documents in pieces of powers of two


def test_binary_pieces():
    for n in range(1, 9000, 7):
        pieces = list(B.binary_pieces(n, 2048))
        assert [s for s, _ in pieces] == list(np.cumsum([0, *(k for _, k in pieces)])[:-1])
        assert sum(k for _, k in pieces) == n
        assert all(k & (k - 1) == 0 and k <= 2048 for _, k in pieces)
        assert len(pieces) == n // 2048 + bin(n % 2048).count("1")  # no decomposition has fewer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _whole(rows, texts, library, end_id):
    """Each document's ids, taken from the pieces' digests one after the other."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids, at = [*library(texts[doc]), end_id], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = ids[at : at + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)


def test_op13_on_the_table(spark, sf, library):
    rows = op13_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    _whole(rows, texts, library, 1)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["offset"] == 0 and r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 for r in rows)


def test_decompose_odd_rows(spark, table, library):
    texts = {1: None, 2: "", 3: "word " * 60_000, 4: "<|endoftext|> a", 5: "퟿\U0001f600" * 700}
    got = B.decompose_documents(table(list(texts.items()), extra=True), public_tokenizers.path("byte_bpe_50k.json"), size=256, batch_tokens=512)
    _whole(got.collect(), texts, library, 1)
    twice = B.decompose_documents(table([(7, "same"), (7, "same"), (None, "x")]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter(r["doc_id"] for r in twice if r["start"] == 0) == {7: 2, None: 1}
    assert len({r["sequence_id"] for r in twice}) == len(twice)
    assert B.decompose_documents(table([]), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        B.decompose_documents(table([]), public_tokenizers.path("byte_bpe_50k.json"), size=1000)


def test_batches_and_buckets(spark, table, library, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table([(i, "some words of a text " * (i % 90)) for i in range(300)])
    made = B.bucketed_sequences(docs, path, size=128, batch_tokens=256)
    B.write_buckets(made, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.where("length != shiftleft(1, bucket) OR size(ids) != length").count() == 0
    batches = back.groupBy("batch_id").agg(F.countDistinct("bucket").alias("buckets"), F.sum("length").alias("tokens"), F.first("bucket").alias("bucket"))
    assert batches.where("buckets > 1 OR tokens > 256").count() == 0
    tasks = docs.rdd.getNumPartitions()
    assert batches.where("tokens < 256").count() <= tasks * 8
    one = back.where("doc_id = 77").orderBy("start").collect()
    assert [i for r in one for i in r["ids"]] == [*library("some words of a text " * 77), 1]


# -- conversations


def _plain_repair(turns):
    """(cost, letters) of the cheapest edits of (role, fault): whole strings for every state, compared as they are."""
    follow = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "")}

    def with_inserts(best):
        for _ in range(3):
            for role in "ua":
                for state, to in follow[role].items():
                    if state in best:
                        best[to] = min(best.get(to, (10**9, "")), (best[state][0] + 5, best[state][1] + "I"))
        return best

    best = with_inserts(best)
    for role, fault in turns:
        now = {}

        def offer(state, cost, letters):
            now[state] = min(now.get(state, (10**9, "")), (cost, letters))

        for state, (cost, letters) in best.items():
            offer(state, cost + 2, letters + "D")
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for to_role in "sua":
                    if state in follow[to_role] and role[:1] == to_role:
                        offer(follow[to_role][state], cost + more, letters + "K")
                    elif state in follow[to_role] and to_role != "s":
                        offer(follow[to_role][state], cost + more + 1, letters + "R")
        best = with_inserts(now)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("prime", [C._PRIME, 5])
@pytest.mark.parametrize("commit", [1, 7, 10**6])
def test_repair_is_the_plain_one(monkeypatch, prime, commit):
    monkeypatch.setattr(C, "_PRIME", prime)  # 5: hashes collide all the time
    rng = random.Random(commit)
    for _ in range(250):
        roles = rng.choice((["user", "assistant"], ["user", "assistant", "system"], ["user"], ["system", "tool", "", "assistant", "aide"]))
        faults = rng.choice(([None], [None, "truncated"], [None, "blank", "duplicate", "truncated"], ["truncated"]))
        turns = [(rng.choice(roles), rng.choice(faults)) for _ in range(rng.randrange(1, 45))]
        repair, edits = C.Repair(), []
        for k, turn in enumerate(turns):
            repair.turn(*turn)
            if (k + 1) % commit == 0:
                edits += repair.shared()
        cost, rest = repair.end()
        assert rest
        assert (cost, "".join(e.letter for e in edits + rest)) == _plain_repair(turns), turns


def _by_hand(rows):
    """The report of the damaged rows (turn, role, text) of one conversation."""
    white = " \t\n\x0b\x0c\r"
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(white)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = _plain_repair([(r[1], f) for r, f in zip(rows, faults)])
    out, left = [], list(rows)
    for letter in audit:
        row = None if letter == "I" else left.pop(0)
        if letter == "K":
            out.append(f"{row[1]}:{row[2]}")
        elif letter != "D":
            system = bool(out) and out[0].startswith("s")
            out.append(f"{('user', 'assistant')[(len(out) - system) % 2]}:{row[2] if row else ''}")
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _damaged_by_hand(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = {1: "", 2: text.translate(dict.fromkeys(map(ord, ".!?")))}.get(kind, text)
    return [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repair_matches(spark, path, rows):
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).extend(_damaged_by_hand(conv, *row))
    got = op12_conversation_repair(spark, path).collect()
    assert len(got) == len(want)
    for r in got:
        expected = _by_hand(want[r["conv_id"]]) if want[r["conv_id"]] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(r[n] for n in NAMES) == expected, r["conv_id"]


def test_op12_on_the_table(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    _repair_matches(spark, path, rows)


def test_op12_odd_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 3, "user", "a."), (None, 1, "user", "x"), (None, None, "assistant", "y!"), (2, 5, "", " \n"), (3, 0, "user", "long. " * 300_000), (3, 0, "user", "long. " * 300_000), (3, 9, "assistant", "ok")]
    rows += [(4, rng.choice((None, *range(900))), rng.choice(("user", "assistant", "system", "tool", None)), rng.choice(("a.", "b", "", " \t", "what?", " ", None, "é!\r\n"))) for _ in range(3000)]
    rows += [(5, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS fault", "2 AS copy", "3 AS kind", "4 AS bare")
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    _repair_matches(spark, str(tmp_path), rows)


def test_op12_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert op12_conversation_repair(spark, str(tmp_path)).count() == 0


def test_repaired_conversations_are_sound(spark):
    turns = C.damaged(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    edits = C.repair_edits(turns)
    kept = edits.where("edit <> 'D'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edit_no", "role"))), lambda x: F.left(x["role"], F.lit(1))), "").alias("roles"))
    assert kept.where("NOT roles RLIKE '^s?(ua)+$'").count() == 0
    assert edits.where("edit <> 'I'").count() == turns.count()


# -- vectors as codes


def _plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{row number: (code, error)} and the codebooks, in Python's whole numbers."""
    ok = [(v, r) for r, (v, e) in enumerate(rows) if e and all(x is not None and math.isfinite(x) for x in e)]
    ok.sort(key=lambda x: (x[0] is None, x[0] or 0, rows[x[1]][1]))
    whole = {r: [math.floor(scale * x) for x in rows[r][1]] for _, r in ok}
    w = len(next(iter(whole.values()))) // parts
    cut = {r: [e[p * w : (p + 1) * w] for p in range(parts)] for r, e in whole.items()}
    books = [[cut[r][p] for _, r in ok[:entries]] for p in range(parts)]

    def dealt():
        return {r: [min((sum((a - b) ** 2 for a, b in zip(own[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for r, own in cut.items()}

    for _ in range(rounds):
        at = dealt()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut[r][p] for r in cut if at[r][p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    return {r: ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)) for r, found in dealt().items()}, books


def _clustered(rng, n, width, spread):
    centres = rng.normal(size=(9, width))
    return [(centres[i % 9] + rng.normal(size=width) * spread).tolist() for i in range(n)]


@pytest.mark.parametrize(("seed", "spread", "parts", "entries", "first_b"), [(1, 0.3, 4, 16, 4), (2, 0.05, 2, 5, 2), (3, 1.5, 8, 16, 1), (4, 0.3, 4, 3, 4), (5, 300.0, 2, 16, 6)])
def test_codes_are_plain_ones(spark, monkeypatch, seed, spread, parts, entries, first_b):
    monkeypatch.setattr(Q, "FIRST_B", first_b)
    rng = np.random.default_rng(seed)
    vectors = _clustered(rng, 260, 16, spread)
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[i % 7]) for i in range(60)]
    rows = [(v, [round(x, 1) for x in e] if v % 3 else e) for v, e in rows]  # equal numbers, and so equal distances
    want, books = _plain_codes(rows, parts, entries)
    got = Q.compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), parts, entries)
    assert got.codebooks == books
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got.rows.collect()} == {rows[k][0]: v for k, v in want.items()}
    assert all(sum(x) == len(rows) * parts for x in got.looked)


def test_bounds_spare_most_distances(spark):
    rows = list(enumerate(_clustered(np.random.default_rng(8), 4000, 32, 0.2)))
    looked = Q.compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4).looked
    assert looked[-1][0] > 0.8 * sum(looked[-1])  # nearly all parts are settled by their bounds


def test_bounds_hold():
    rng = np.random.default_rng(2)
    part, book = rng.integers(-5000, 5000, (800, 5)), rng.integers(-5000, 5000, (16, 5))
    bounds = Q.all_computed(part, book, 4)
    for step in range(12):
        new = book + rng.integers(-600, 600, book.shape) * (rng.random((16, 1)) < 0.4)
        apart = np.sqrt(((new - book) ** 2).sum(1)) * Q._UP
        bounds = Q.resized(bounds, (4, 2, 6, 3, 8, 1)[step % 6], 16)
        Q.moved(bounds, part, new, np.append(apart, apart.max()), np.zeros(17, np.int64))
        book, true = new, np.sqrt(((part[:, None] - new) ** 2).sum(2))
        squares = ((part[:, None] - new) ** 2).sum(2)
        assert (bounds.near[:, 0] == squares.argmin(1)).all()
        rows = np.arange(len(part))
        assert (bounds.far[:, 0] >= true[rows, bounds.near[:, 0]]).all()
        listed = np.zeros((800, 17), bool)
        for k in range(bounds.near.shape[1]):
            listed[rows, bounds.near[:, k]] = True
            known = bounds.near[:, k] < 16
            if k:
                assert (bounds.far[known, k] <= true[rows, np.minimum(bounds.near[:, k], 15)][known]).all()
        assert (np.where(listed[:, :16], np.inf, true).min(1) >= bounds.outer).all()


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=8).tolist()) for i in range(2, 40)]
    odd = [(0, None), (1, [1.0, None] * 4), (50, [math.nan] * 8), (51, [-math.inf] * 8), (52, []), (7, good[3][1]), (7, good[5][1]), (None, good[0][1]), (60, [0.0] * 8), (61, [2.0] * 8), (62, [-0.00001] * 8)]
    rows = [(v, e, k % 3 if k % 4 else None) for k, (v, e) in enumerate(good + odd)]
    df = spark.createDataFrame(rows + [(70, [1.0] * 16, 1), (71, [1.0] * 7, 1), (72, [1e300] * 8, 1)], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS held", "2 AS bounds", "3 AS sums", "4 AS code", "5 AS error", "6 AS label_error")
    got = Q.compress_vectors(df, keep=("label",))
    coded = Q.with_label_error(got.rows).collect()
    limit = Q.Shape(8, 1, 16, 4096).limit
    want, books = _plain_codes([(v, e) for v, e, _ in rows] + [(72, [limit / 4096] * 8)])
    assert got.codebooks == books
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in coded) == Counter(((rows[k][0] if k < len(rows) else 72), *v) for k, v in want.items())
    sums = Counter()
    for r in coded:
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in coded)
    back = Q.decode_vectors(got.rows.where("vec_id = 61"), got.codebooks).first()["decoded"]
    assert back == [books[p][int(got.rows.where("vec_id = 61").first()["code"][2 * p : 2 * p + 2], 16)][0] / 4096 for p in range(8)]


def test_codes_of_few_and_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    empty = Q.compress_vectors(none, keep=("label",))
    assert empty.rows.columns == ["vec_id", "label", "code", "error"] and Q.with_label_error(empty.rows).count() == 0
    one = Q.compress_vectors(spark.createDataFrame([(3, [0.5] * 8)], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in one.rows.collect()] == [(3, "00" * 8, 0)] and one.codebooks == [[[2048]]] * 8


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_conversation_repair"])
def test_equals_sql(spark, name):
    path = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for table in ("embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    ours, theirs = queries()[name](spark, path), duck.execute(oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert Counter(map(tuple, ours.select(*names).collect())) == Counter(theirs.fetchall())


# -- budgets and broadcasts


def test_windows_of_control_strings_keep_their_budget(spark, library):
    rng = random.Random(11)
    parts = ("<|", "\\", "\n", "<|im_end|>", "word ", " ", "<|im_start|>assistant\n", "\r\n", "é", "'s", "\\n")
    rows = [(c, t, rng.choice(("user", "assistant", "system", "<|" * 40, "a\nb")), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 500)))) for c in range(30) for t in range(12)]
    rows += [(100, 0, "user", "<|" * 450), (100, 1, "assistant", "<|" * 450), (101, 0, "user", "\\" * 900), (101, 1, "assistant", "ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    budget, several = 700, 0
    for w in chat_windows(df, public_tokenizers.path("byte_bpe_50k.json"), budget=budget, history_tokens=150).collect():
        assert len(library(w["formatted"])) == w["n_tokens"]
        several += w["n_own"] > 1
        own = w["formatted"].split("<|im_start|>")[1 + w["own_from"] :]
        assert w["n_tokens"] <= budget or len(own) == 1
    assert several > 10


def test_long_texts_are_not_broadcast(spark, table, monkeypatch):
    docs = table([(i, "x" * 1000) for i in range(50)])
    hinted = lambda: "broadcast" in docs.join(common.small(docs.select(F.col("text").alias("t")), "small"), F.col("text") == F.col("t"))._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 40_000)
    assert not hinted()
    monkeypatch.setattr(line_dedup, "COMMON", 1)
    lines = [(i, f"a line that is long enough to count {'y' * 30_000}\nown line number {i:09d} of this text") for i in range(6)]
    got = line_dedup.drop_repeated_lines(table(lines)).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
