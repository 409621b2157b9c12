"""HTML main text by a linear-chain conditional random field over DOM leaf blocks (operator 7).

A tolerant scan, linear in the page however deep its elements nest, turns it into blocks: runs of text between
block-level tags, with the open ancestors.
Each block has features of its ancestor tags and attribute words, of its text and of its place. The chain
has two states (main, other); weights of features by state and of transitions are trained by gradient ascent
on the exact conditional likelihood (forward-backward) of labelled pages, and Viterbi decodes.

The labelled pages are made by `labelled_pages`: layouts in several styles (semantic tags, divs with
class or id words, tables), with bodies whose labels are known as they are written. Nothing is taken from the
pages to be extracted. The training set's size is a documented parameter and independent of the data.

Text inside script, style, template, noscript, svg, head, form controls and comments never enters a block.
Character references are decoded, white space becomes one space, blocks are joined by a line feed.

Nulls: a null or empty page has an empty text. Repeated rows each give a row; empty tables give no rows; a
null page_id or url is kept. Further columns are ignored."""

from __future__ import annotations

import html as references
import random
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_arrow, plain, table

MAIN, OTHER = 0, 1
PAGES = 240
STEPS = 120

# HTML's elements by how a block scan treats them.
SKIPPED = frozenset("script style template noscript svg annotation annotation-xml iframe object canvas select textarea button datalist audio video head title".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input picture source map area basefont nobr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr basefont frame keygen".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
OWN_CLOSE = {"li": ("li", frozenset("ul ol menu".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])), "tr": ("tr td th", frozenset("table tbody thead tfoot".split())), "td": ("td th", frozenset(["tr"])), "th": ("td th", frozenset(["tr"])), "option": ("option", frozenset(["select"]))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:\b(?:class|id|role|itemprop)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)


@dataclass
class Block:
    """A run of text: the block elements around it (all, the innermost, the two outermost), words of their attributes, linked code points."""

    text: str
    tags: frozenset[str]
    last: str
    outer: tuple[str, ...]
    names: frozenset[str]
    linked: int


def _words(attributes: str) -> frozenset[str]:
    found = set()
    for m in _NAMES.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "")
        found.update(w for w in re.split(r"[^a-z]+", value.lower()) if len(w) > 1)
    return frozenset(found)


def hides(attributes: str) -> bool:
    """Whether attributes hide their element, each by its own name."""
    if not _MAY_HIDE.search(attributes):
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of a name holds
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(found.get("style", "")))


def breaks(tag: str) -> bool:
    """Whether an element begins and ends a block. What shows no text does not."""
    return tag not in INLINE and tag not in SKIPPED


class _Open:
    """The open elements. Each question about them takes a step, however deep they are."""

    def __init__(self):
        self.tags: list[str] = []
        self.own: list[tuple[frozenset[str], bool]] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []  # places of block elements
        self.names: dict[str, int] = {}
        self.hidden = self.links = 0

    def push(self, tag: str, names: frozenset[str], hidden: bool) -> None:
        self.where[tag].append(len(self.tags))
        if tag not in INLINE:
            self.walls.append(len(self.tags))
        self.tags.append(tag)
        self.own.append((names, hidden))
        self.hidden += hidden
        self.links += tag == "a"
        for x in names:
            self.names[x] = self.names.get(x, 0) + 1

    def last(self, *tags: str) -> int:
        """Place of the innermost element of these, or -1."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def wall(self) -> int:
        return self.walls[-1] if self.walls else -1

    def pop(self, to: int) -> None:
        """Closes all from a place on."""
        while len(self.tags) > to:
            tag, (names, hidden) = self.tags.pop(), self.own.pop()
            self.where[tag].pop()
            if not self.where[tag]:
                del self.where[tag]
            if tag not in INLINE:
                self.walls.pop()
            self.hidden -= hidden
            self.links -= tag == "a"
            for x in names:
                self.names[x] -= 1
                if not self.names[x]:
                    del self.names[x]


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page, in page order, whatever state its markup is in."""
    out: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            outer = tuple(stack.tags[i] for i in stack.walls[:2])
            out.append(Block(text, frozenset(stack.where) - INLINE, stack.tags[stack.walls[-1]] if stack.walls else "", outer, frozenset(stack.names), linked))
        parts.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if text and not stack.hidden:
            text = references.unescape(text)
            parts.append(text)
            if stack.links:
                linked += len(text)

    def pop(to: int):
        if any(breaks(stack.tags[i]) for i in stack.walls[bisect_left(stack.walls, to) :]):
            flush()  # while its elements are open
        stack.pop(to)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(references.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif tag == "p" and stack.last("p") < 0:
                flush()
            elif (i := stack.last(tag)) >= 0 and not (tag in INLINE and stack.wall() > i):
                pop(i)
            continue
        if tag in CLOSES_P and stack.walls and stack.tags[stack.wall()] == "p":
            pop(stack.wall())
        if tag in OWN_CLOSE:
            ends, scope = OWN_CLOSE[tag]
            if (i := stack.last(*ends.split())) > stack.last(*scope):
                pop(i)
        if breaks(tag) and tag != "br":
            flush()
        if tag in EMPTY:
            if tag == "br":
                parts.append(" ")
            continue
        if tag == "body" and (heads := stack.where.get("head")):  # an open head ends here
            pop(heads[0])
        attributes = m[3] or ""
        if attributes.rstrip().endswith("/") and (tag in ("svg", "path", "use") or tag in MATH):
            continue
        hidden = tag in SKIPPED or bool(attributes) and hides(attributes)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.push(tag, _words(attributes) if attributes else frozenset(), hidden)
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Features of each block: ancestors, attribute words, text, links."""
    out = []
    for k, b in enumerate(found):
        words = b.text.split()
        n = len(words)
        x = ["bias", f"size:{min(7, n.bit_length())}", f"links:{int(4 * min(1, b.linked / len(b.text)))}"]
        x += [f"in:{t}" for t in sorted(b.tags)] + [f"tag:{b.last}"] + [f"name:{w}" for w in sorted(b.names)]
        if b.text[-1] in ".!?:;\"»”…":
            x.append("stop")
        if "©" in b.text or re.search(r"(?i)\b(?:copyright|all rights reserved)\b", b.text):
            x.append("rights")
        if re.search(r"(?i)\b(?:cookies?|subscribe|sign in|log in|newsletter|advertisement|sponsored)\b", b.text):
            x.append("notice")
        if not k or not found[k - 1].outer or found[k - 1].outer != b.outer:
            x.append("turn")
        out.append(x)
    return out


@dataclass
class Chain:
    """Weights by feature and state, of moves between states, and of the first state."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray
    first: np.ndarray

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        none = (0.0, 0.0)
        return np.array([[sum(self.weights.get(f, none)[s] for f in x) for s in (MAIN, OTHER)] for x in rows]).reshape(-1, 2)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely states (Viterbi)."""
        if not rows:
            return []
        e = self.emissions(rows).tolist()
        (mm, mo), (om, oo) = self.moves.tolist()
        a, b = e[0][0] + self.first[0], e[0][1] + self.first[1]
        back = []
        for x, y in e[1:]:
            from_a, from_b = (a + mm >= b + om), (a + mo > b + oo)
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + mm if from_a else b + om) + x, (a + mo if from_b else b + oo) + y
        state = MAIN if a >= b else OTHER
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS) -> Chain:
    """Maximises the conditional log likelihood of labelled chains, with a ridge."""
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for x in rows for f in x}))}
    w, moves, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    at = [[[names[f] for f in x] for x in rows] for rows, _ in pages]
    flat = [(np.repeat(np.arange(len(r)), [len(x) for x in r]), np.array([i for x in r for i in x], np.int64)) for r in at]
    memory = [np.zeros_like(x) for x in (w, moves, first)]
    for _ in range(steps):
        gw, gm, gf = -0.01 * w, -0.01 * moves, -0.01 * first
        for (rows, states), (owner, feature) in zip(pages, flat, strict=True):
            n = len(rows)
            e = np.zeros((n, 2))
            np.add.at(e, owner, w[feature])
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = e[0] + first
            for k in range(1, n):
                forward[k] = e[k] + np.logaddexp.reduce(forward[k - 1][:, None] + moves, axis=0)
            for k in range(n - 2, -1, -1):
                backward[k] = np.logaddexp.reduce(moves + e[k + 1] + backward[k + 1], axis=1)
            z = np.logaddexp.reduce(forward[-1])
            y = np.eye(2)[states]
            rest = y - np.exp(forward + backward - z)
            np.add.at(gw, feature, rest[owner])
            gf = gf + rest[0]
            for k in range(1, n):
                gm -= np.exp(forward[k - 1][:, None] + moves + e[k] + backward[k] - z)
                gm[states[k - 1], states[k]] += 1
        for x, g, m in zip((w, moves, first), (gw, gm, gf), memory, strict=True):
            m += g * g
            x += 0.5 * g / (np.sqrt(m) + 1e-8)
    return Chain({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, moves, first)


def labelled_pages(count: int = PAGES, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages in several layouts with the state of each of their blocks."""
    rng = random.Random(seed)
    syllables = "ta re no mi sel vor en ar ku pi da lo stra chen eau ion er und la os".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def sentence(a=5, b=22):
        return (" ".join(word() for _ in range(rng.randint(a, b))) + rng.choice(".... !?")).strip().capitalize()

    def paragraph():
        return " ".join(sentence() for _ in range(rng.randint(1, 6))) if rng.random() < 0.85 else sentence(1, 4)

    def name(*words):
        return f'{rng.choice(["class", "class", "id"])}="{rng.choice(words)}"'

    out = []
    for _ in range(count):
        parts: list[tuple[str, list[int]]] = []
        semantic = rng.random() < 0.6

        def menu():
            n = rng.randint(2, 8)
            items = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
            box = ("<nav>", "</nav>") if semantic or rng.random() < 0.4 else (f"<div {name('nav', 'menu', 'navbar', 'site-navigation', 'breadcrumb')}>", "</div>")
            return f"{box[0]}<ul>{items}</ul>{box[1]}", [OTHER] * n

        def aside(words, tag="div", n=(1, 2)):
            k = rng.randint(*n)
            return f"<{tag} {name(*words)}>" + "".join(f"<p>{paragraph() if rng.random() < 0.6 else sentence(1, 5)}</p>" for _ in range(k)) + f"</{tag}>", [OTHER] * k

        def advert():
            return aside(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), rng.choice(["div", "div", "aside"]), (1, 1))

        def advert_text():
            return f"<div {name('ad', 'ads', 'advert', 'sponsor', 'promo')}>{sentence()}</div>", [OTHER]

        def notice():
            return aside(("cookie", "cookie-notice", "notice", "consent", "alert", "newsletter", "popup"), "div", (1, 2))

        def header():
            box = ("header", "") if semantic else ("div", " " + name("header", "masthead", "site-header", "top"))
            return f"<{box[0]}{box[1]}><p>{sentence(1, 4)}</p><p>{sentence(1, 6)}</p></{box[0]}>", [OTHER] * 2

        def side():
            box = ("aside", "") if semantic and rng.random() < 0.7 else ("div", " " + name("sidebar", "related", "widget", "share", "social", "recommended"))
            n = rng.randint(1, 4)
            return f"<{box[0]}{box[1]}>" + "".join(f"<p>{sentence()}</p>" for _ in range(n)) + f"</{box[0]}>", [OTHER] * n

        def form():
            return f"<form><p>{sentence(1, 4)}</p><label>{word()}</label><input type=text></form>", [OTHER] * 2

        def comments():
            n = rng.randint(1, 4)
            return f"<section {name('comments', 'comment-list', 'discussion', 'disqus', 'replies')}>" + "".join(f"<div {name('comment', 'reply')}><p>{paragraph()}</p></div>" for _ in range(n)) + "</section>", [OTHER] * n

        def footer():
            text = rng.choice([f"&copy; {word()} &middot; {sentence()}", sentence(2, 8), "Copyright 2020 " + sentence(2, 4)])
            box = ("footer", "") if semantic else ("div", " " + name("footer", "site-footer", "bottom", "copyright"))
            return f"<{box[0]}{box[1]}>{text}</{box[0]}>", [OTHER]

        def article():
            body, states = "", []
            if rng.random() < 0.85:
                body, states = f"<h1>{sentence(2, 9)}</h1>", [MAIN]
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                if kind < 0.7:
                    body += f"<p>{paragraph()}</p>"
                    states.append(MAIN)
                elif kind < 0.78:
                    body += f"<h2>{sentence(1, 6)}</h2>"
                    states.append(MAIN)
                elif kind < 0.86:
                    n = rng.randint(1, 4)
                    body += f"<ul>{''.join(f'<li>{sentence(1, 12)}</li>' for _ in range(n))}</ul>"
                    states += [MAIN] * n
                elif kind < 0.9:
                    body += f"<blockquote><p>{paragraph()}</p></blockquote>"
                    states.append(MAIN)
                elif kind < 0.93:
                    body += f"<table><tr><td>{sentence(1, 3)}</td><td>{sentence(1, 3)}</td></tr></table>"
                    states += [MAIN] * 2
                else:
                    ad = rng.choice([advert, advert_text, side])()
                    body += ad[0]
                    states += ad[1]
            box = rng.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>")]) if semantic else (f"<div {name('content', 'article', 'post', 'entry', 'entry-content', 'story', 'post-body', 'main', 'text')}>", "</div>")
            return f"{box[0]}{body}{box[1]}", states

        for maker, chance in ((header, 0.4), (menu, 0.8), (notice, 0.3), (advert_text, 0.5), (advert, 0.2), (form, 0.15), (side, 0.2), (article, 1.0), (side, 0.3), (comments, 0.3), (advert, 0.15), (menu, 0.15), (footer, 0.85)):
            if rng.random() < chance:
                parts.append(maker())
        page = f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style></head><body>" + "".join(p for p, _ in parts) + "</body></html>"
        out.append((page, [s for _, states in parts for s in states]))
    return out


@lru_cache(maxsize=2)
def trained(count: int = PAGES) -> Chain:
    pages = []
    for page, states in labelled_pages(count):
        found = blocks(page)
        if len(found) != len(states):
            raise AssertionError(f"a labelled page has {len(states)} labels for {len(found)} blocks")
        pages.append((features(found), states))
    return fit(pages)


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    states = chain.decode(features(found))
    return "\n".join(b.text for b, s in zip(found, states, strict=True) if s == MAIN)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def extract(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), shared.value) for p in plain(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), extract, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
