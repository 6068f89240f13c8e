"""Vectors, pages, conversations, components and the pipeline."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import chat_format as C
from tidegauge.llm import embedding_dedup as V
from tidegauge.llm import html_extract as H
from tidegauge.llm.common import few_by_hash
from tidegauge.llm.components import components
from tidegauge.llm.queries import op10_chat_format
from written_pages import FIRST, LAST, page_and_text

# -- vectors


def _links(a, wa, cosine):
    s = a @ a.T >= cosine
    np.fill_diagonal(s, False)
    return s @ wa


@pytest.mark.parametrize("seed", range(4))
def test_dual_traversal_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 16))
    x = np.concatenate([rng.normal(size=(150, 16)), *(c + rng.normal(size=(90, 16)) * s for c, s in zip(centres, (0.02, 0.1, 0.2, 0.3, 0.001)))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, len(x))
    want = _links(x, w, 0.93)
    t = V.CoverTree(x)
    na, nb, edges = V.dual_links(x, t, w, x, t, w, 0.93, True)
    assert (na + nb == want).all()
    a, b = x[:300], x[300:]
    ca, cb, cross = V.dual_links(a, V.CoverTree(a), w[:300], b, V.CoverTree(b), w[300:], 0.93, False)
    hit = a @ b.T >= 0.93
    assert (ca == hit @ w[300:]).all() and (cb == w[:300] @ hit).all()
    assert all(hit[i, j - 300] for i, j in cross)
    assert len(edges) <= len(x)


def test_levels_halve_and_cover():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = V.CoverTree.from_bytes(V.CoverTree(x).to_bytes())
    for k in range(len(t.centre)):
        own = t.order[t.lo[k] : t.hi[k]]
        assert V._distances(x[own], x[t.centre[k]]).max() <= t.radius[k] + 1e-12
        for child in range(t.first[k], t.end[k]):
            assert t.lo[k] <= t.lo[child] <= t.hi[child] <= t.hi[k]
    assert sorted(t.order) == list(range(500))


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 12))
    rows = []
    for i in range(90):
        v = base[i % 6] + rng.normal(size=12) * (0.25 if i % 2 else 0.02)
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(200, rows[0][1], 0), (200, rows[0][1], 0), (201, [0.0] * 12, 0), (202, None, 0), (203, [math.nan] * 12, 0), (204, rows[0][1], None), (205, [1.0, None] * 6, 0), (206, [], 0), (207, [1.0], 0), (208, (np.array(rows[0][1]) * 1e200).tolist(), 0), (209, [math.inf] * 12, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS dim", "3 AS kept")
    valid = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    up = {r[0]: r[0] for r in rows}

    def root(x):
        return x if up[x] == x else root(up[x])

    links = {}
    for p, a in enumerate(valid):
        for q, b in enumerate(valid):
            if p != q and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1]) / max(map(abs, a[1])), np.array(b[1]) / max(map(abs, b[1]))
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                    links.setdefault(p, 0)
                    links[p] += 1
                    x, y = root(a[0]), root(b[0])
                    up[max(x, y)] = min(x, y)
    want = sorted((r[0], links.get(valid.index(r), 0) if r in valid else 0, root(r[0])) for r in rows)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in V.near_vectors(df).collect())
    assert got == want
    assert V.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    up = {x: x for e in edges for x in e if x is not None}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- pages


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><script>var a = "<p>no</p>"</script></head><body class="Top x"><!-- <p>no</p> --><nav><ul><li><a href="/a>b">One</a><li>Two</ul></nav>
    <p>A &amp; B&nbsp;<b>bold<br>next <p title='>'>third &lt;x&gt;<div>fourth</div> tail < end</body>"""
    got = [(b.text, b.path.element if b.path else "") for b in H.blocks_of(page)]
    assert got == [("One", "a"), ("Two", "li"), ("A & B bold", "p"), ("next", "b"), ("third <x>", "p"), ("fourth", "div"), ("tail < end", "body.top.x")]
    assert H.blocks_of(None) == H.blocks_of("") == H.blocks_of("<!-- open") == H.blocks_of("<script>open") == []


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>T</title><p>article <b>one</b><p>two", ["article one", "two"]),
        ("<html><head>\n<meta charset=x><title>T</title>\n<style>p {}</style>\ntext<p>two", ["text", "two"]),
        ("<head><title>T</title></head>\n<p>one", ["one"]),
        ("<head><title>T</title><meta a=b>\n<body><p>one", ["one"]),
        ("<head><noscript>no<body><p>one", ["one"]),
        *((f"<body><p>one<{t}><p>two", ["one", "two"]) for t in ("noscript", "svg", "object", "iframe", "template", "math")),
        *((f"<body><p>one<{t} a=1>no<p>no</{t}> more<p>two", ["one more", "two"]) for t in ("noscript", "svg", "iframe", "template")),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<object data=a>instead</object>", ["so x=2 holdsinstead"]),
        ("<p>one<svg-icon>two</svg-icon><script>no</p><body>no", ["onetwo"]),
        ("<p>one<style>no <p>no", ["one"]),
    ],
)
def test_blocks_with_open_elements(page, want):
    got = H.blocks_of(page)
    assert [b.text for b in got] == want
    assert not any("head" in b.path.elements() for b in got if b.path)


def test_references_are_decoded_run_by_run():
    assert [b.text for b in H.blocks_of("<p>AT&<b>amp;</b> &amp;amp; &#x41;&lt;b&gt;<p a='b>c'>x &nbsp; y &unknown; &copy")] == ["AT&amp; &amp; A<b>", "x y &unknown; ©"]


@pytest.mark.parametrize(
    "unit,blocks",
    [
        ("<p>a<svg>", 20_000), ("<p title=\"x>a ", 10_000), ("<p \"> \"", 20_000), ('<p a="> b="', 20_000), ("<div>x", 20_000), ("<p><b>x<hr>", 20_000),
        ("<a ", 1), ("<", 1), ("<!x", 1), ("<a>x<p>", 20_000), ("<p><select><b>x<hr>", 20_000), ("<script ", 1), ("<td>x<dd>", 20_000), ("<p = =", 1),
    ],
)
def test_hostile_pages_take_linear_time(unit, blocks):
    """Among others, pages whose quotes or tags never end, and very deep ones; 20,000 units in well under a second."""
    began = time.perf_counter()
    found = H.blocks_of(unit * 20_000)
    H.Features().of(found)
    assert len(found) == blocks and time.perf_counter() - began < 5


def test_gradients():
    rng = np.random.default_rng(0)
    m = H.Labeller.fresh(1)
    x, mask = H._padded([rng.normal(size=(n, H.SIZE)) for n in (5, 2, 7)])
    y = (rng.random(mask.shape) < 0.5) * 1.0

    def loss():
        z = m.logits(x, mask)
        return np.where(mask, np.logaddexp(0, z) - y * z, 0).sum() / mask.sum()

    for name, g in m.gradients(x, mask, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = m.arrays[name][at]
        m.arrays[name][at] = keep + 1e-5
        up = loss()
        m.arrays[name][at] = keep - 1e-5
        down = loss()
        m.arrays[name][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-4)


@pytest.fixture(scope="module")
def labeller(spark, sf):
    return H.fit_labeller(spark.read.parquet(f"{sf}/pages.parquet"))


def test_extraction(spark, sf, labeller):
    """The articles of the given pages, and held-out layouts that no page of the table has."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = labeller
    right = total = 0
    own = {r["page_id"]: r for r in pages.collect()}
    for r in H.extract_main_text(pages, model).collect():
        blocks = H.blocks_of(own[r["page_id"]]["html"])
        want = "\n".join(b.text for b, y in zip(blocks, H._own_labels(blocks)) if y)
        right += r["text"] == want
        total += 1
        assert r["n_chars"] == len(r["text"])
    assert right >= 0.98 * total
    rng, features = random.Random(1234), H.Features()
    wrong = n = 0
    for r in list(own.values())[:60]:
        blocks = H.blocks_of(r["html"])
        page, labels = H.layout(rng, [b.text for b, y in zip(blocks, H._own_labels(blocks)) if y][:30], ["Something else entirely.", "More of this"])
        kept = H.label_pages(model, features, [H.blocks_of(page)])[0]
        wrong += int((kept != (np.array(labels) > 0)).sum())
        n += len(labels)
    assert wrong <= 0.06 * n  # with the few pages of the smallest table


# Pages and their main text, written by hand.
_WRITTEN = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Tides</title><link rel=stylesheet href=a.css>
        <body><header><a href=/>Harbour Post</a></header><nav><ul><li><a href=/n>News</a><li><a href=/w>Weather</a></ul></nav>
        <article><h1>Tides of the northern harbour</h1><p>The harbour was measured every hour over the whole winter, and the tables were printed in spring.
        <p>Nobody had expected the second maximum, which came &frac12; a day late &amp; stayed for a week.</article>
        <aside><p><a href=/1>Read more about storms</a></aside><footer><p>&copy; Harbour Post. All rights reserved.</footer>""",
        "Tides of the northern harbour\nThe harbour was measured every hour over the whole winter, and the tables were printed in spring.\n"
        "Nobody had expected the second maximum, which came ½ a day late & stayed for a week.",
    ),
    (
        """<html><head><title>x</title><style>p { color: red }</style></head><body><div class="cookie-notice"><p>We use cookies to improve this site.</p></div>
        <div class="menu"><ul><li><a href="#">Home</a></li><li><a href="#">Contact</a></li></ul></div>
        <main><h1>How bread rises</h1><p>Yeast turns sugar into gas, and the gas is held by a net of gluten that long kneading has made.</p>
        <script>track("<p>no</p>")</script><p>A cold night in the pantry makes the crumb <b>open</b> and the crust dark, as every baker knows.</p>
        <ul><li>Flour, water and a little salt go in first.</li><li>The yeast is added at the very end.</li></ul></main>
        <section class="comments"><p>First! Great read, thanks.</p><p>I tried it and it failed.</p></section>
        <div class="footer"><p>Imprint</p></div></body></html>""",
        "How bread rises\nYeast turns sugar into gas, and the gas is held by a net of gluten that long kneading has made.\n"
        "A cold night in the pantry makes the crumb open and the crust dark, as every baker knows.\nFlour, water and a little salt go in first.\nThe yeast is added at the very end.",
    ),
    (
        """<body><form action=/s><label>Search this site</label><button>Go</button></form><div class="ad">Buy now: shoes at half price</div>
        <article><h2>A quiet valley</h2><p>The road ends at the mill, and from there only a path leads up along the stream to the pass.</p>
        <blockquote>We never saw a soul, wrote the surveyor in the autumn of that year.</blockquote>
        <p>Since then two farms have been given up, and the meadows are turning back to forest.</p></article></body>""",
        "A quiet valley\nThe road ends at the mill, and from there only a path leads up along the stream to the pass.\nWe never saw a soul, wrote the surveyor in the autumn of that year.\n"
        "Since then two farms have been given up, and the meadows are turning back to forest.",
    ),
]


def test_pages_written_by_hand(spark, labeller):
    df = spark.createDataFrame([(i, None, page) for i, (page, _) in enumerate(_WRITTEN)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract_main_text(df, labeller).collect()} == {i: text for i, (_, text) in enumerate(_WRITTEN)}


def test_pages_of_unseen_markup(spark, labeller):
    """Whole texts, without a block too many or too few."""
    for pages, least in ((FIRST, 24), (LAST, 8)):
        made = [page_and_text(p) for p in pages]
        df = spark.createDataFrame([(i, None, page) for i, (page, _) in enumerate(made)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in H.extract_main_text(df, labeller).collect()}
        assert sum(got[i] == text for i, (_, text) in enumerate(made)) >= least


def test_the_sample_is_small_and_whole(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id", "repeat('x', 10) AS html")
    for n in (1, 50, 10_000):
        few = few_by_hash(rows, F.xxhash64("id"), n)
        want = sorted({r["h"] for r in rows.select(F.xxhash64("id").alias("h")).collect()})[:n]
        assert sorted({r["hash"] for r in few.collect()}) == want
    assert few_by_hash(rows.limit(0), F.xxhash64("id"), 3).count() == 0


def test_odd_pages(spark, labeller):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>x"), (2, "u", "<article>" + "<p>word one two.</p>" * 3000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS id", "3 AS n_blocks")
    got = {(r["page_id"], r["url"]): r for r in H.extract_main_text(df, labeller).collect()}
    assert got[1, None]["text"] == got[1, "u"]["text"] == "" and got[1, None]["n_chars"] == 0
    assert got[2, "u"]["text"].count("\n") == got[2, "u"]["n_kept"] - 1 > 2900
    assert H.extract_main_text(df.limit(0), labeller).count() == 0
    assert H.fit_labeller(df.limit(0)).arrays


# -- conversations


@pytest.mark.parametrize("text", ["", "\\", "\\|", "<|", "<\\|", "<|im_end|><|im_start|>assistant ok", "\\\\<||>\\n", "a\nb"])
def test_escapes_come_back(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    assert C.parse(C.render(text, text)[0] + C.render("user", text)[0]) == [(text, text), ("user", text)]


@pytest.mark.parametrize("budget,history", [(2048, 2), (120, 2), (60, 0), (1, 3)])
def test_windows_hold_every_turn_once(spark, bpe, budget, history):
    rng = random.Random(budget)
    rows = []
    for conv in range(6):
        for turn in range(rng.randrange(1, 12)):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, rng.choice([None, "", "<|im_end|> x", "words " * rng.randrange(60)])))
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(2 * C.BLOCK + 5)] + [(50, -1, "system", "Stay."), (60, 1, "assistant", "same"), (60, 1, "assistant", "same"), (61, None, None, None), (None, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "2 AS kind")
    windows = C.chat_windows(df, bpe, budget, history).cache()
    got = {r["conv_id"]: r for r in C.window_digests(windows).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["loss_chars"]) == (len(own), len(said))
        assert g["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)) and g["loss_sha256"] == sha(said)
    for w in windows.collect():
        turns = C.parse(w["formatted"])
        assert len(turns) == w["own_from"] + w["n_own"] and w["own_from"] <= history + 1
        assert w["n_tokens"] <= budget or w["n_own"] == 1
        if w["conv_id"] == 50:
            assert turns[0] == ("system", "Stay.")
    assert C.chat_windows(df.limit(0), bpe).count() == 0


# -- the pipeline


def test_query_formats_a_table(spark, sf):
    rows = sorted((r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect())
    said = "<|im_end|><|im_start|>assistant ok"
    want = {}
    for conv, _, role, text in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        n, turns, loss = want.get(conv, (0, "", ""))
        want[conv] = (n + 1, f"{turns}{role}\n{text}\n", loss + text * (role == "assistant"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["conv_id"]: r for r in op10_chat_format(spark, sf).collect()}
    assert {i: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for i, r in got.items()} == {i: (n, sha(t), len(x), sha(x)) for i, (n, t, x) in want.items()}
    assert all(r["formatted_chars"] >= len(want[i][1]) for i, r in got.items())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and kept.exceptAll(before).count() == 0, name
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    norm = [" ".join(t.split()) for t in left.values()]
    assert len(set(norm)) == len(norm)
    placed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in placed.select("doc_id").distinct().collect()} == set(left)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    gone = toxic - set(left)  # clean documents that went have an equal or a near copy among the others
    for i in gone:
        w = texts[i].lower().split()
        own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        assert any(i != j and len(own & s) >= 0.8 * len(own | s) for j, t in texts.items() if (v := t.lower().split()) is not None and (s := {tuple(v[k : k + 5]) for k in range(max(1, len(v) - 4))})), i


def test_stages_are_brute_force(spark, sf):
    """What each filtering stage keeps of a given table, and that the packed sequences hold all of it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub("[ \t-\r]+", " ", texts[i]), i)
    once = corpus_pipeline.drop_exact_copies(spark, docs, sf)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(first.values())
    sets = {}
    for i in first.values():
        w = re.findall("[^ \t-\r]+", texts[i].translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    holders = {}
    for i, own in sets.items():
        for g in own:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    left = corpus_pipeline.drop_near_copies(spark, once, sf)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i in sets if root(i) == i)
    placed = corpus_pipeline.pack(spark, left, sf).collect()
    assert {r["doc_id"] for r in placed} == {i for i in sets if root(i) == i}
    by = {}
    for r in placed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 1024 and all(o == sum(n for p, n in own if p < o) for o, _ in own) for own in by.values())


def test_stages_decide_rows_by_their_own_text(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    row = lambda i, t: (i, t, "en", "s", 0)
    rows = [row(1, "a"), row(1, "b"), row(0, "b"), row(None, "b"), row(None, None), row(None, ""), row(3, "c  d"), row(4, "c d"), row(5, "e"), row(5, "e")]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS id", "'x' AS kept", "2 AS component_id")
    got = sorted((r["doc_id"], r["text"] or "") if r["doc_id"] is not None else (-1, r["text"] or "") for r in corpus_pipeline.drop_exact_copies(spark, df, sf).collect())
    assert got == [(-1, ""), (0, "b"), (1, "a"), (3, "c  d"), (5, "e")]
    assert corpus_pipeline.drop_exact_copies(spark, df, sf).columns == df.columns


def test_pipeline_stages_of_nothing_and_odd_rows(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "plain words here", "en", "s", 1), (3, "plain words here", "en", "s", 1)], schema)
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, sf).count() <= 5
