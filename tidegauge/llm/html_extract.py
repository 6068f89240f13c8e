"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block tags, each with the path of open tags above it. A
bidirectional LSTM in numpy reads a vector of the hashed tag path, the hashed words and a few figures for every block, and
labels each one with the whole page as context. The text is that of the blocks labelled as content.

The labeller is trained here, on a bounded sample of the pages: on those that mark their article themselves, and on pages
that are put together from their paragraphs with the furniture of other layouts around and inside the article.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WordHashes, few_by_hash

#: Pages that the labeller is fitted on, at most: those of the smallest hashes of their ids, up to this many characters.
FIT_PAGES, FIT_CHARS = 256, 1 << 16
#: Made-up layouts of their paragraphs, in all.
LAYOUTS = 3072
PATH, WORDS, FIGURES, HIDDEN = 128, 64, 14, 24
SIZE = PATH + WORDS + FIGURES
EPOCHS, BATCH, RATE = 14, 64, 0.014
#: Last epochs whose weights are averaged.
AVERAGED = 4
#: Blocks that are labelled together, with padding (unless one page has more).
TOGETHER = 1 << 14

# Elements of HTML by what they do to the text in them.
# Scripts and styles run to the end of the page where nothing ends them. These others are silent up to their end tag or the
# body; where there is neither, they are ordinary tags.
_SILENT = frozenset("noscript template svg iframe title".split())
#: What can stand in a head; anything else ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul br".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCK - {"br", "button", "label", "option", "optgroup", "select", "textarea"}
_ALONE = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SCOPE = frozenset("ul ol table select dl menu body html article section div main aside nav".split())
_STOPS = _SCOPE | {"p", *_ALONE}
# Tags by which a page says itself what is its article and what is around it.
_ARTICLE, _AROUND = frozenset(["article", "main"]), frozenset(["nav", "aside", "footer", "header", "form", "menu", "dialog"])
_TELLING = _ARTICLE | _AROUND

_QUOTED = r"""(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+"""


def _tokens(attributes: str) -> re.Pattern:
    """A comment, a script or style with what is in it, a tag, a declaration, or a run of text."""
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(script|style)(?![^\s/>]){attributes}(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({attributes})>|<[!?][^>]*>|([^<]+|<)", re.S | re.I
    )


#: Tags whose values may hold a >; and, for what follows a tag whose quotes never end, tags up to the next >.
_STRICT, _PLAIN = _tokens(_QUOTED), _tokens("[^>]*+")
_ENDS = {name: re.compile(rf"</{name}\s*>|(?=<body\b)", re.I) for name in _SILENT}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECES = re.compile(r"[a-z]+")


class Path:
    """An open element and those around it. What the labeller makes of it is kept with it, so that a path costs no more than
    its last element, however deep it is."""

    __slots__ = ("parent", "element", "sums", "tags")

    def __init__(self, parent: Path | None, element: str):
        self.parent, self.element, self.sums = parent, element, None
        self.tags: frozenset[str] = parent.tags if parent else frozenset()
        if (tag := element.split(".", 1)[0]) in _TELLING:
            self.tags |= {tag}

    def elements(self) -> Iterator[str]:
        """From the innermost element out."""
        at: Path | None = self
        while at is not None:
            yield at.element
            at = at.parent


@dataclass(slots=True)
class Block:
    text: str
    path: Path | None
    linked: int  # characters inside links


class _Open:
    """The stack of open elements, with what makes each look at it independent of its depth: how many of a kind are open, and
    for each element the nearest one at or below it that ends the search for an element to close."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[Path] = []
        self.stops: list[int] = []
        self.many: dict[str, int] = {}

    def push(self, tag: str, element: str) -> None:
        self.stops.append(len(self.tags) if tag in _STOPS else self.stops[-1] if self.stops else -1)
        self.tags.append(tag)
        self.paths.append(Path(self.paths[-1] if self.paths else None, element))
        self.many[tag] = self.many.get(tag, 0) + 1

    def cut(self, at: int) -> None:
        for tag in self.tags[at:]:
            self.many[tag] -= 1
        del self.tags[at:], self.paths[at:], self.stops[at:]

    def close(self, tag: str) -> None:
        """The innermost element of the tag, and all inside it."""
        if self.many.get(tag):
            at = len(self.tags) - 1
            while self.tags[at] != tag:
                at -= 1
            self.cut(at)

    def close_near(self, wanted: frozenset[str] | set[str]) -> None:
        """The innermost element with one of the tags, unless a list, table or section is open inside it."""
        if not any(self.many.get(t) for t in wanted):
            return
        at = self.stops[-1]
        while at >= 0 and self.tags[at] not in wanted:
            if self.tags[at] in _SCOPE:
                return
            at = self.stops[at - 1] if at else -1
        if at >= 0:
            self.cut(at)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order. Tags that are never closed end with the block tag around them, a head without an end
    at the first text or element that can't stand in it. A tag whose quotes never end is one up to the next >, as are all
    after it; a < that no > follows is text. Time grows with the page's length."""
    open_, out, text, endless = _Open(), [], [], set()
    linked, path = 0, None

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block(whole, path, min(linked, len(whole))))
            text.clear()
        linked = 0

    def end_head() -> None:
        if open_.many.get("head"):
            flush()
            open_.cut(open_.tags.index("head"))

    page = page or ""
    at, last, token = 0, page.rfind(">"), _STRICT
    while m := token.match(page, at):
        run = m[5]
        if run == "<" and token is _STRICT and at < last and (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/"):
            token = _PLAIN
            continue
        at = m.end()
        if run is not None:
            if m.start() > last:  # no tag can follow
                run, at = page[m.start() :], len(page)
            if open_.tags and open_.tags[-1] == "head":
                if run.isspace():
                    continue
                end_head()
            if not text:
                path = open_.paths[-1] if open_.paths else None
            run = html.unescape(run)
            text.append(run)
            if open_.many.get("a"):
                linked += len(run)
            continue
        if m[3] is None:
            continue
        name, closing, rest = m[3].lower(), m[2], m[4]
        if not closing and name in _SILENT and name not in endless and not rest.endswith("/"):
            if end := _ENDS[name].search(page, at):
                at = end.end()
                continue
            endless.add(name)
        if name in _BLOCK:
            flush()
        if closing:
            open_.close(name)
            continue
        if name not in _IN_HEAD and name != "head":
            end_head()
        if name in _CLOSES_P:
            open_.close_near({"p"})
        if name in _ALONE:
            open_.close_near(_ALONE[name])
        if name not in _VOID and not rest.endswith("/"):
            named = "".join(f".{x}" for g in _NAMES.findall(rest) for x in _PIECES.findall("".join(g).lower())) if rest else ""
            open_.push(name, name + named)
    flush()
    return out


def _bucket(text: str, n: int) -> tuple[int, float]:
    h = xxhash.xxh32_intdigest(text)
    return h % n, 1.0 if h & 0x10000 else -1.0


#: Signs that stand between links or begin a notice of rights, and digits.
_MARKS, _DIGITS = re.compile(r"[|·•»›©®/]"), re.compile(r"\d")


def _containers(blocks: list[Block]) -> list[tuple[float, ...]]:
    """For each block: whether it shares its container with the block before and after it, which share of the page's unlinked
    text stands in its container and in the one around that, the containers' linked share, and how many blocks its own has."""
    own = [(b.path.parent, b.path.parent.parent if b.path.parent else None) if b.path else (None, None) for b in blocks]
    plain: dict[tuple, int] = {}
    linked: dict[tuple, int] = {}
    held: dict[tuple, int] = {}
    for b, (inner, outer) in zip(blocks, own):
        for level, node in ((1, inner), (2, outer)):
            key = level, id(node)
            plain[key] = plain.get(key, 0) + len(b.text) - b.linked
            linked[key] = linked.get(key, 0) + b.linked
            held[key] = held.get(key, 0) + 1
    whole = max(sum(len(b.text) - b.linked for b in blocks), 1)
    out = []
    for k, (inner, outer) in enumerate(own):
        one, two = (1, id(inner)), (2, id(outer))
        out.append((
            k > 0 and own[k - 1][0] is inner, k + 1 < len(own) and own[k + 1][0] is inner, plain[one] / whole, plain[two] / whole,
            linked[one] / max(linked[one] + plain[one], 1), math.log1p(held[one]) / 4,
        ))
    return out


class Features:
    """Vectors of blocks; what an element adds is remembered."""

    ELEMENTS = 50_000

    def __init__(self):
        self.elements: dict[str, np.ndarray] = {}
        self.hashes = WordHashes()

    def _element(self, element: str, leaf: bool) -> np.ndarray:
        """The signed buckets of an element, or of its tag as the innermost one."""
        key = f"leaf {element.split('.', 1)[0]}" if leaf else element
        v = self.elements.get(key)
        if v is None:
            if len(self.elements) > self.ELEMENTS:
                self.elements.clear()
            v = np.zeros(PATH, np.float32)
            tag, *names = [key] if leaf else element.split(".")
            for token in (tag, *(f".{x}" for x in names)):
                at, sign = _bucket(token, PATH)
                v[at] += sign
            if len(key) <= 256:
                self.elements[key] = v
        return v

    def _path(self, path: Path | None) -> np.ndarray:
        if path is None:
            return np.zeros(PATH, np.float32)
        new, at = [], path
        while at is not None and at.sums is None:
            new.append(at)
            at = at.parent
        for node in reversed(new):
            own = self._element(node.element, False)
            node.sums = own if node.parent is None else node.parent.sums + own
        return np.clip(path.sums + self._element(path.element, True), -2, 2)

    def of(self, blocks: list[Block]) -> np.ndarray:
        """One row for each block of a page."""
        n = len(blocks)
        out = np.zeros((n, SIZE), np.float32)
        words = [b.text.encode("utf-8", "surrogatepass").lower().split() for b in blocks]
        sizes = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(n), sizes)
        h = self.hashes.of([x for w in words for x in w])
        bins = (h & np.uint64(WORDS - 1)).astype(np.int64)
        sign = np.where(h & np.uint64(1 << 20), 1.0, -1.0)
        out[:, PATH : PATH + WORDS] = np.bincount(owner * WORDS + bins, weights=sign, minlength=n * WORDS).reshape(n, WORDS) / np.sqrt(np.maximum(sizes, 1))[:, None]
        around = _containers(blocks)
        for k, b in enumerate(blocks):
            out[k, :PATH] = self._path(b.path)
            size = len(b.text)
            out[k, PATH + WORDS :] = (math.log1p(size) / 5, b.linked / size, math.log1p(sizes[k]) / 4, k / n, (n - k) / n, b.text[-1] in ".!?…:", min(len(_MARKS.findall(b.text)) / sizes[k], 1), len(_DIGITS.findall(b.text)) / size, *around[k])
        return out


@dataclass
class Labeller:
    """A bidirectional LSTM with one logistic output for each block. Arrays by name: for each direction the weights of inputs
    (x), of states (h) and the bias (b), gates in the order input, forget, output, candidate; then the output's weights."""

    arrays: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        arrays = {}
        for d in ("forward", "backward"):
            arrays[f"{d} x"] = rng.normal(0, 1 / math.sqrt(SIZE), (SIZE, 4 * HIDDEN))
            arrays[f"{d} h"] = rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            arrays[f"{d} b"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        arrays["out"] = rng.normal(0, 0.3, (2 * HIDDEN, 1))
        arrays["bias"] = np.zeros(1)
        return cls(arrays)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, trace: list | None) -> np.ndarray:
        """States of one direction; x: steps, pages, features. Padding leaves the state as it is."""
        a = self.arrays
        inputs = x @ a[f"{d} x"] + a[f"{d} b"]
        h = c = np.zeros((x.shape[1], HIDDEN), x.dtype)
        out = np.zeros((len(x), x.shape[1], HIDDEN), x.dtype)
        for t in range(len(x)) if d == "forward" else range(len(x) - 1, -1, -1):
            z = inputs[t] + h @ a[f"{d} h"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if trace is not None:
                trace.append((t, i, f, o, g, c, tc, h))
            h = np.where(m, o * tc, h)
            c = np.where(m, c2, c)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(d, x, mask, None) for d in ("forward", "backward")], axis=2)
        return (states @ self.arrays["out"])[:, :, 0] + self.arrays["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the blocks."""
        a, traces, parts = self.arrays, {"forward": [], "backward": []}, []
        for d in traces:
            parts.append(self._run(d, x, mask, traces[d]))
        states = np.concatenate(parts, axis=2)
        z = (states @ a["out"])[:, :, 0] + a["bias"]
        dz = np.where(mask, 1 / (1 + np.exp(-z)) - label, 0.0).astype(x.dtype) / int(mask.sum())
        out = {"out": np.einsum("tpk,tp->k", states, dz)[:, None], "bias": np.array([dz.sum()])}
        back = dz[:, :, None] * a["out"][:, 0]
        for d, own in (("forward", back[:, :, :HIDDEN]), ("backward", back[:, :, HIDDEN:])):
            gx, gh, gb = (np.zeros_like(a[f"{d} {k}"]) for k in "xhb")
            dh = dc = np.zeros((x.shape[1], HIDDEN), x.dtype)
            for t, i, f, o, g, c, tc, h in reversed(traces[d]):
                m = mask[t][:, None]
                total = dh + own[t]
                du = np.where(m, total, 0.0)
                dcell = np.where(m, dc + du * o * (1 - tc * tc), 0.0)
                dgate = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), du * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                gx += x[t].T @ dgate
                gh += h.T @ dgate
                gb += dgate.sum(axis=0)
                dh = np.where(m, dgate @ a[f"{d} h"].T, total)
                dc = np.where(m, dcell * f, dc)
            out |= {f"{d} x": gx, f"{d} h": gh, f"{d} b": gb}
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), SIZE), pages[0].dtype), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# -- training pages

def _own_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels by what the page says of itself: inside its article and no furniture; None if it has no article."""
    tags = [b.path.tags if b.path else frozenset() for b in blocks]
    label = np.array([bool(_ARTICLE & t) and not _AROUND & t for t in tags], float)
    return label if label.any() else None


# Words that furniture is often made of, and names that authors of pages give to its elements and to those of the article.
_SAID = {
    "nav": ["Home", "About", "Contact", "News", "Archive", "Login", "Menu", "Search", "Shop", "Blog", "Help", "Sport", "World", "Start", "Photos", "Links", "Guides", "Overview", "Next", "Previous", "Older posts"],
    "notice": ["We use cookies to improve this site.", "Accept all cookies", "Read our privacy policy", "Please disable your ad blocker", "This page is out of date", "Your browser is not supported.", "OK", "The site will be down for maintenance tonight."],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Cheap flights from 29 euros!", "20 % off all shoes", "Anzeige", "Offers near you"],
    "form": ["Subscribe to our newsletter", "Your email", "Send", "Name", "Search this site", "Password", "Sign up", "Log in", "Your comment"],
    "side": ["Related articles", "Most read", "Tags", "Read more", "Popular posts", "Share this", "Follow us", "Categories", "Also read", "Recent comments (4)"],
    "comments": ["Comments", "Reply", "Leave a comment", "3 comments", "Report", "Thanks, great read!", "I don't agree at all.", "Same here, it never worked for me.", "Anna, 3 May: well said.", "What about the price?"],
    "footer": ["© 2024 All rights reserved", "Terms of use", "Imprint", "Privacy", "Contact us", "Back to top", "Site map", "Powered by a small server", "Last updated 5 June 2011", "About us", "Mail to the editor", "No liability is accepted."],
}
_CALLED = {
    "nav": "nav menu navbar navigation topnav mainmenu links tabs breadcrumb crumbs pager pagination menubar", "head": "header head masthead top brand banner logo site-title hd hero",
    "ad": "ad ads advert sponsored promo ad-slot partner werbung adbox", "notice": "cookie cookie-notice notice banner alert consent popup gdpr warning message cookiebar",
    "side": "sidebar related share widget rail social tags recommended right-col teaser more", "form": "newsletter search signup login poll",
    "comments": "comments comment-list reader-comments disqus_thread respond replies discussion responses commentlist thread", "footer": "footer foot bottom site-info copyright colophon legal credits ft",
    "article": "content post article-body entry-content story text main article page-content entry copy prose blog-post single post-content maincontent bd", "comment": "comment post reply msg response",
}
_PLACES, _PAPERS = ["Town", "River", "North", "Valley", "Coast", "City", "Garden", "Kitchen"], ["Herald", "Post", "Times", "Journal", "Blog", "Weekly", "Club", "Notes"]
_NAMED, _MEANT = re.compile(r' (?:class|id|role)="[^"]*"'), re.compile(r"<(/?)(?:nav|aside|footer|header|article|main|section|menu|form)\b")


def layout(rng: random.Random, content: list[str], other: list[str]) -> tuple[str, list[int]]:
    """A page of `content` as its article, with furniture that is partly made of `other`; and the labels of its blocks.

    Names and elements that tell what they hold are missing, or mean nothing, in many pages; there furniture says what it is."""
    parts: list[str] = []
    labels: list[int] = []
    esc = html.escape
    names = rng.choices(["telling", "some", "odd", "none"], [50, 20, 12, 18])[0]
    meant = rng.random() < (0.75 if names == "telling" else 0.4)  # elements such as nav and article are used
    telling = names == "telling"

    def say(kind: str, whole: float = 0.5) -> str:
        if other and telling and rng.random() < whole:
            return rng.choice(other)
        return rng.choice(_SAID[kind])

    def site() -> str:
        return f"{rng.choice(['', '', 'The '])}{rng.choice(_PLACES)} {rng.choice(_PAPERS)}"

    def rights() -> str:
        return f"{rng.choice(['©', 'Copyright', '© Copyright', '©'])} {rng.choice(['', str(rng.randint(1998, 2030))])} {site()}{rng.choice(['', '.', ' - all rights reserved', ' · Imprint'])}"

    def called(kind: str) -> str:
        name, more = rng.choice(_CALLED[kind].split()), rng.random()
        if more < 0.15:
            name = f"{rng.choice(['c', 'l', 'm', 'site', 'page', 'my', 'block'])}-{name}"
        elif more < 0.3:
            name = f"{name}{rng.choice(['-', '_', ' ', '__'])}{rng.choice(['box', 'inner', 'wrapper', 'list', 'area', 'container', 'left', 'right', 'text'])}"
        return f'{rng.choice(["class", "class", "id"])}="{name}"'

    def put(open_: str, texts: list[str], each: str, close: str, label: int = 0) -> None:
        parts.append(open_)
        for t in texts:
            if t.strip():
                parts.append(each.replace("@", esc(t)))
                labels.append(label)
        parts.append(close)

    def line(open_: str, texts: list[str], close: str) -> None:
        """One block of all texts, most of them links."""
        each, between = rng.choice(['<a href="/x">@</a>', '<a href="/x">@</a>', "<span>@</span>", "@"]), rng.choice([" ", " | ", " / ", " » ", " · ", ""])
        parts.append(open_ + between.join(each.replace("@", esc(t)) for t in texts) + close)
        labels.append(0)

    def menu() -> None:
        o, c = rng.choice([("<nav><ul>", "</ul></nav>"), ("<nav>", "</nav>"), (f"<div {called('nav')}><ul>", "</ul></div>"), (f"<ul {called('nav')}>", "</ul>"), ('<div role="navigation"><ul>', "</ul></div>"), ("<header><nav><ul>", "</ul></nav></header>"), (f"<div {called('nav')}>", "</div>"), ("<menu>", "</menu>")])
        texts = [say("nav") for _ in range(rng.randint(1 if rng.random() < 0.2 else 2, 8))]
        if "ul" not in o and rng.random() < 0.6:
            line(o, texts if telling else [rng.choice(_SAID["nav"]) for _ in texts], c)
        else:
            put(o, texts, rng.choice(['<li><a href="/x">@</a></li>', '<li><a href="/x">@</a></li>', "<li>@</li>"]) if "ul" in o or "menu" in o else rng.choice(['<div><a href="/x">@</a></div>', '<p><a href="/x">@</a></p>', '<a href="/x">@</a><br>']), c)

    def boxes() -> None:
        kind = rng.choice(["ad", "notice", "side", "form"])
        n = rng.randint(1, 3)
        if kind == "ad" and rng.random() < 0.35:
            put("", [say("ad", 0.8)], f"<p {called('ad')}>@</p>", "")
        elif kind == "ad":
            put(f"<{(t := rng.choice(['div', 'aside', 'section']))} {called('ad')}>", [say("ad", 0.8) for _ in range(n)], rng.choice(["<p>@</p>", "<div>@</div>"]), f"</{t}>")
        elif kind == "notice":
            put(f"<div {called('notice')}>", [say("notice") for _ in range(n)], rng.choice(["<p>@</p>", "<div>@</div>", "<button>@</button>"]), "</div>")
        elif kind == "side":
            tag = rng.choice(["aside", "aside", "div", "div", "div", "section"])
            inside = [say("side", 0.7) for _ in range(rng.choice([1, 1, 2, 3, 4, 6]))]
            if rng.random() < 0.3:
                inside = [f"{rng.choice(['Also read', 'More', 'Related', 'See also'])}: {cut(t, 6)}" if rng.random() < 0.5 else cut(t, 6) for t in inside]
            if rng.random() < 0.25:
                line(f"<{tag} {called('side')}>", inside[:3], f"</{tag}>")
            else:
                put(f"<{tag} {called('side')}>", inside, rng.choice(['<li><a href="/x">@</a></li>', "<p>@</p>", "<h3>@</h3>", '<div><a href="#">@</a></div>', '<p><a href="#">@</a></p>']), f"</{tag}>")
        else:
            o, c = rng.choice([('<form action="/s">', "</form>"), (f"<form {called('form')}>", "</form>"), (f"<div {called('form')}>", "</div>")])
            put(o, [say("form", 0.3) for _ in range(n)], rng.choice(["<label>@</label>", "<button>@</button>", "<p>@</p>", "<option>@</option>", "<label>@</label><input><br>"]), c)

    def comments() -> None:
        tag = rng.choice(["section", "div", "div", "div", "ol"])
        parts.append(f"<{tag} {called('comments')}>")
        if not telling or rng.random() < 0.4:
            put("", [rng.choice(_SAID["comments"][:4] + ["2 replies", "Discussion", "Leave a reply"])], f"<{(h := rng.choice(['h2', 'h3', 'h4', 'p']))}>@</{h}>", "")
        inner = rng.choice(_CALLED["comment"].split())
        put("", [say("comments", 0.8) for _ in range(rng.randint(1, 6))], rng.choice(["<p>@</p>", f'<div class="{inner}"><p>@</p></div>', f'<li class="{inner}">@</li>', f'<article class="{inner}"><p>@</p></article>', "<li>@</li>"]), f"</{tag}>")

    def cut(t: str, most: int) -> str:
        return " ".join(t.split()[: rng.randint(1, most)])

    def article() -> None:
        tag = rng.choice(["article", "article", "main", "main", *[f"div {called('article')}" for _ in range(6)], f"section {called('article')}", "section", "div", 'div role="main"', ""])
        inner = rng.random() < 0.25 and f"<div {called('article')}>"
        parts.append((f"<{tag}>" if tag else "") + (inner or ""))
        loose, short = rng.random() < 0.15, rng.random() < 0.5
        for k, t in enumerate(content):
            if k == 0 and rng.random() < 0.75:
                put("", [cut(t, 9)], f"<{(h := rng.choice(['h1', 'h1', 'h2', 'h2']))}>@</{h}>", "", 1)
                continue
            if short and k > 8 and rng.random() < 0.5:
                break
            if short and rng.random() < 0.8:  # a sentence or two
                words = t.split()
                t = " ".join(words[: rng.randint(8, 40)])
                t += "" if t[-1:] in ".!?" else "."
            form = rng.choices(
                ["<p>@</p>", "<p>@", "<p><b>@<br>", "<h2>@</h2>", "<ul><li>@</li></ul>", "<blockquote>@</blockquote>", "<div>@</div>", "<table><tr><td>@</td></tr></table>", "<pre>@</pre>", "linked", "list", "heading", "figure"],
                [34, 6, 3, 1, 1, 2, 4, 1, 1, 2, 3, 3, 1],
            )[0]
            if loose:
                put("", [t], "@<br>", "", 1)
            elif form == "list":
                o, c = rng.choice([("<ul>", "</ul>"), ("<ol>", "</ol>"), ("<table><tr>", "</tr></table>")])
                end = rng.choice(["", "."])
                put(o, [cut(t, 12).rstrip(".") + end for _ in range(rng.randint(2, 6))], "<td>@</td>" if "table" in o else "<li>@</li>", c, 1)
                put("", [t], "<p>@</p>", "", 1)
            elif form == "linked":
                words, at = t.split(), rng.randint(0, 6)
                a, b, c = " ".join(words[:at]), " ".join(words[at : at + 4]), " ".join(words[at + 4 :])
                parts.append(f'<p>{esc(a)} <a href="/y">{esc(b or "here")}</a> {esc(c)}</p>')
                labels.append(1)
            elif form == "heading":
                put("", [cut(t, 7)], "<h2>@</h2>" if rng.random() < 0.6 else "<h3>@</h3>", "", 1)
                put("", [t], "<p>@</p>", "", 1)
            elif form == "figure":
                put("<figure>", [cut(t, 12)], "<figcaption>@</figcaption>", "</figure>", 1)
            else:
                put("", [t], form, "", 1)
            if rng.random() < 0.06:
                boxes()
        if rng.random() < 0.1:
            comments()
        parts.append(("</div>" if inner else "") + (f"</{tag.split()[0]}>" if tag else ""))

    parts.append('<!DOCTYPE html><html><head><title>x</title><script>var a="<p>";</script></head><body>')
    if rng.random() < 0.1:
        line("", [rng.choice(_SAID["nav"]) for _ in range(rng.randint(1, 4))], rng.choice(["<hr>", "<p>"]))
    if rng.random() < 0.5:
        o, c = rng.choice([("<header>", "</header>"), (f"<div {called('head')}>", "</div>"), (f"<div {called('head')}>", "</div>")])
        put(o, [site() if rng.random() < 0.5 else say("nav", 0.4) for _ in range(rng.choice([1, 1, 2, 3]))], rng.choice(["<div>@</div>", "<p>@</p>", "<h2>@</h2>", "<h1>@</h1>", "<h1>@</h1>", "<span>@</span><br>", '<a href="/">@</a><br>', "@<br>"]), c)
    if rng.random() < 0.75:
        menu()
    for _ in range(rng.choice([0, 0, 1, 2])):
        boxes()
    o, c = rng.choice([("", ""), ("", ""), ("", ""), ('<div class="page"><div class="row">', "</div></div>"), ('<div class="wrap">', "</div>"), ("<table><tr><td>", "</td></tr></table>")])
    parts.append(o)
    article()
    if rng.random() < 0.4:
        comments()
    for _ in range(rng.choice([0, 0, 1, 2])):
        boxes()
    parts.append(c)
    if rng.random() < 0.85:
        texts = [rights() if rng.random() < 0.4 else say("footer", 0.5) for _ in range(rng.choice([1, 1, 2, 3, 4]))]
        kind = rng.random()
        if kind < 0.2:
            put("", [rights() if rng.random() < 0.6 else rng.choice(_SAID["footer"])], rng.choice(["@", "<hr>@", "<center>@</center>", "<span>@</span>", "<p>@</p>", "<hr><font>@</font>"]), "")
        else:
            o, c = rng.choice([("<footer>", "</footer>"), ("<footer>", "</footer>"), (f"<div {called('footer')}>", "</div>"), (f"<div {called('footer')}>", "</div>")])
            if kind < 0.4:
                line(o, [rights(), *(rng.choice(_SAID["footer"]) for _ in texts[1:])], c)
            else:
                put(o, texts, rng.choice(["<p>@</p>", "<div>@</div>", '<li><a href="/z">@</a></li>', "@<br>"]), c)
    page = "".join(parts) + "</body></html>"
    if names != "telling":
        odd = {}  # an odd name stands for one telling name throughout a page

        def other_name(m: re.Match) -> str:
            if names == "none" or names == "some" and rng.random() < 0.5:
                return ""
            if names == "some":
                return m[0]
            return odd.setdefault(m[0], f' class="{"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 6)))}"')

        page = _NAMED.sub(other_name, page)
    return page if meant else _MEANT.sub(r"<\1div", page), labels


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES, seed: int = 7) -> Labeller:
    """Fit on a bounded sample: fit_pages pages, one for each id, of those of at most FIT_CHARS characters (a parameter of this
    module; longer pages are labelled like all others, but don't teach). Without any page, the labeller is as it starts."""
    short = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.length("html") <= FIT_CHARS)
    chosen = few_by_hash(short, F.xxhash64("id"), fit_pages).groupBy("hash").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    return fitted([r["html"] for r in sorted(chosen.collect(), key=lambda r: r["hash"])], seed)


def fitted(sample: list[str], seed: int) -> Labeller:
    """A labeller that has learned from the sample's own articles, and from made-up layouts of their paragraphs."""
    features, rng, data, texts = Features(), random.Random(seed), [], []
    for page in sample:
        blocks = blocks_of(page)
        label = _own_labels(blocks) if blocks else None
        if label is not None:
            data.append((features.of(blocks), label))
            texts.append([b.text for b, y in zip(blocks, label) if y])
        elif own := [b.text for b in blocks if len(b.text) >= 60 and b.linked * 4 < len(b.text)]:
            texts.append(own)  # a page that doesn't mark its article only lends its longer blocks to made-up layouts
    for k in range(LAYOUTS if texts else 0):
        page, labels = layout(rng, [t for t in texts[k % len(texts)] if t][:40], rng.choice(texts))
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            data.append((features.of(blocks), np.array(labels, float)))
    model = Labeller({k: a.astype(np.float32) for k, a in Labeller.fresh(seed).arrays.items()})
    m = {k: np.zeros_like(v) for k, v in model.arrays.items()}
    v = {k: np.zeros_like(x) for k, x in model.arrays.items()}
    mean = {k: np.zeros_like(x) for k, x in model.arrays.items()}
    step, drop = 0, np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 8, rng.random()))
        starts = list(range(0, len(order), BATCH))
        rng.shuffle(starts)
        for s in starts:
            own = [data[i] for i in order[s : s + BATCH]]
            x, mask = _padded([p for p, _ in own])
            x[:, :, PATH : PATH + WORDS] *= drop.random((1, x.shape[1], 1)) < 0.5  # words must not decide alone
            label = np.zeros(mask.shape, x.dtype)
            for k, (_, y) in enumerate(own):
                label[: len(y), k] = y
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, g in model.gradients(x, mask, label).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.arrays[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if epoch >= EPOCHS - AVERAGED:
            for k, a in model.arrays.items():
                mean[k] += a / AVERAGED
    return Labeller(mean)


def label_pages(model: Labeller, features: Features, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is content."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        own, size = [], 0
        while order and (not own or (len(own) + 1) * len(pages[order[0]]) <= TOGETHER):
            own.append(order.pop(0))
        x, mask = _padded([features.of(pages[i]) for i in own])
        z = model.logits(x, mask)
        for k, i in enumerate(own):
            out[i] = z[: len(pages[i]), k] > 0
    return out


def _extract(shared):
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int32()), ("n_kept", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [blocks_of(h) for h in part.column("html").to_pylist()]
                kept = label_pages(model, features, pages)
                texts = ["\n".join(b.text for b, k in zip(p, y) if k) for p, y in zip(pages, kept)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(p) for p in pages], pa.int32()), pa.array([int(y.sum()) for y in kept], pa.int32())], schema=schema)

    return run


def extract_main_text(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id_col, url_col, text, n_chars, n_blocks, n_kept.

    text joins the blocks labelled as content, in page order, by one newline; character references are decoded and white
    space in a block is one space. Null and empty html have no text (empty, 0 characters); null ids and urls stay null.
    Repeated rows get a row each. Other columns aren't read. An empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    out = source.mapInArrow(_extract(shared), "id long, url string, text string, n_blocks int, n_kept int")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
