"""Operator 4: main text of web pages by a recurrent block labeller.

A page is read into blocks: stretches of text between block-level tags, each with the path of its open
elements.  A block's vector holds hashed tags, classes, ids and roles of the path, hashed words of its
text and a few figures (length, share of links, punctuation, place).  A bidirectional LSTM in numpy
reads all blocks of a page, so each is labelled with the whole page as context; blocks labelled as
article make the text.

The network is trained here by backpropagation through time on made-up pages (``specimen``) that
combine containers, menus, notices, adverts, forms, comments and articles of many shapes; no row of
any table is used.  Training is seeded and takes seconds; a process keeps the result.

Defined results: null and empty pages give an empty text; scripts, styles, the head and comments of the
markup are no blocks, all other elements' text is; white space (also no-break) inside a block becomes one blank,
line breaks of the markup too; character references are decoded once; whole pages are read, in
time that grows with their length; rows are independent; input columns with the names of results are replaced.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_BYTES, slices
from folioscope.llm.shingles import words

#: Elements that end a block where they begin and end.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page; those of ``RAW`` end at their own end tag only.
SKIP = frozenset("script style title head".split())
RAW = frozenset("script style title".split())
#: Elements that close an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Elements inside which nothing outside is closed unasked.
HOLDS = frozenset("table ul ol dl select article div section".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))

#: No part gives back what it took, so a tag is read in time that grows with its length.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_BLANKS = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in RAW}
#: Elements at which a search for an open one to close may end; the stack keeps their places.
_STOPS = HOLDS | HEADINGS | frozenset().union({"p"}, *CLOSES.values())

PATH_SIZE, WORD_SIZE, FIGURES = 64, 24, 8


@lru_cache(50_000)
def _hashed(token: str) -> tuple[int, float]:
    code = zlib.crc32(token.encode())
    return code % PATH_SIZE, 1.0 if code & 0x10000 else -1.0


@lru_cache(50_000)
def _element(name: str, marks: str) -> np.ndarray:
    """Hashed name and marks of one element."""
    out = np.zeros(PATH_SIZE, np.float32)
    for token in (name, *(f".{w}" for w in marks.split(",") if w)):
        slot, sign = _hashed(token)
        out[slot] += sign
    return out


class _Stack:
    """Open elements: names, the sum of their vectors, how many of each name, places of stops."""

    def __init__(self):
        self.names: list[str] = []
        self.sums: list[np.ndarray] = [np.zeros(PATH_SIZE, np.float32)]
        self.open: dict[str, int] = {}
        self.stops: list[int] = []

    def push(self, name: str, marks: str) -> None:
        if name in _STOPS:
            self.stops.append(len(self.names))
        self.names.append(name)
        self.sums.append(self.sums[-1] + _element(name, marks))
        self.open[name] = self.open.get(name, 0) + 1

    def cut(self, depth: int) -> list[str]:
        """Closes all from that depth on."""
        gone = self.names[depth:]
        for name in gone:
            self.open[name] -= 1
        del self.names[depth:], self.sums[depth + 1 :]
        while self.stops and self.stops[-1] >= depth:
            self.stops.pop()
        return gone

    def last(self, names: frozenset[str] | set[str]) -> int:
        """Depth of the innermost open element of these names, or -1."""
        if not any(self.open.get(n) for n in names):
            return -1
        return next(i for i in range(len(self.names) - 1, -1, -1) if self.names[i] in names)

    def shut(self, names: frozenset[str] | set[str]) -> int:
        """Depth of the innermost open element of these names that nothing holds, or -1."""
        for i in reversed(self.stops):
            if self.names[i] in names:
                return i
            if self.names[i] in HOLDS:
                break
        return -1

    def vector(self) -> np.ndarray:
        out = self.sums[-1].copy()
        slot, sign = _hashed(f"^{self.names[-1]}" if self.names else "^")
        out[slot] += sign
        if not self.names:
            slot, sign = _hashed("")
            out[slot] += sign
        return np.clip(out, -3, 3)


def blocks(page: str) -> list[tuple[np.ndarray, str, int]]:
    """(hashed path, text, characters inside links) of a page's blocks, in order."""
    out: list[tuple[np.ndarray, str, int]] = []
    stack = _Stack()
    buffer: list[str] = []
    linked = at = skipping = 0
    path = None
    last = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _BLANKS.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                out.append((path, text, linked))
            buffer.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked, path
        if piece and not skipping:
            if not buffer:
                path = stack.vector()
            buffer.append(piece)
            if stack.open.get("a"):
                linked += len(piece)

    while at <= last and (m := _TAG.search(page, at)):  # behind the last ">" no tag ends
        text(page[at : m.start()])
        at = m.end()
        close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            depth = stack.last(HEADINGS if name in HEADINGS else {name})
            if depth >= 0:
                if any(n in BLOCK for n in stack.names[depth:]):
                    flush()
                skipping -= sum(n in SKIP for n in stack.cut(depth))
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            flush()
            shut = CLOSES.get(name) or (HEADINGS if name in HEADINGS else {"p"})
            while (depth := stack.shut(shut)) >= 0:
                skipping -= sum(n in SKIP for n in stack.cut(depth))
        if name in VOID or rest.endswith("/"):
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at, last + 1)
            at = end.end() if end else len(page)
            continue
        if name == "body":
            stack.cut(0)
            skipping = 0
        skipping += name in SKIP
        marks = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if rest else ""
        stack.push(name, ",".join(w.lower() for w in _CAMEL.findall(marks)))
    rest = page[at:]
    text(rest[: rest.index("<!--")] if "<!--" in rest else rest)
    flush()
    return out


SIZE = PATH_SIZE + WORD_SIZE + FIGURES
HIDDEN = 16


def vectors(pages: list[list[tuple[np.ndarray, str, int]]]) -> np.ndarray:
    """One row for each block of all pages."""
    texts = [b[1].encode() for p in pages for b in p]
    n = len(texts)
    out = np.zeros((n, SIZE), np.float32)
    if not n:
        return out
    out[:, :PATH_SIZE] = [b[0] for p in pages for b in p]
    hashes, first = words(texts, WORD_BYTES)
    counts = np.diff(first)
    slot = (hashes % np.uint64(WORD_SIZE)).astype(np.int64) + WORD_SIZE * np.repeat(np.arange(n), counts)
    bag = np.bincount(slot, minlength=n * WORD_SIZE).reshape(n, WORD_SIZE)
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = bag / np.maximum(1, counts)[:, None] ** 0.5
    i = 0
    for p in pages:
        for k, (_, text, linked) in enumerate(p):
            size = len(text)
            out[i, PATH_SIZE + WORD_SIZE :] = (
                np.log1p(size) / 6, min(1.0, linked / size), float(text[-1] in ".!?…。:"), min(1.0, 10 * text.count(". ") / size), min(1.0, 10 * text.count(",") / size), k / len(p), (len(p) - k) / len(p), 1 / len(p)
            )
            i += 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Bidirectional LSTM with one output for each block."""

    def __init__(self, rng: np.random.Generator, size: int = SIZE, hidden: int = HIDDEN):
        self.h = hidden
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = [draw(size, 4 * hidden) for _ in range(2)]
        self.u = [draw(hidden, 4 * hidden) for _ in range(2)]
        self.b = [np.zeros(4 * hidden, np.float32) for _ in range(2)]
        self.out = draw(2 * hidden + size, 1)
        self.level = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.out, self.level]

    def _side(self, k: int, x: np.ndarray, active: list[int]):
        """States for steps x pages (longest first), with what the way back needs."""
        h, n = self.h, x.shape[1]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        states, kept = np.zeros((len(x), n, h), np.float32), []
        for t, m in enumerate(active):
            before, held = state[:m], cell[:m]
            g = x[t, :m] @ self.w[k] + before @ self.u[k] + self.b[k]
            i, f, o = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h] + 1), _sigmoid(g[:, 2 * h : 3 * h])
            c = np.tanh(g[:, 3 * h :])
            cell = f * held + i * c
            squashed = np.tanh(cell)
            state = o * squashed
            states[t, :m] = state
            kept.append((before, held, i, f, o, c, squashed))
        return states, kept

    def _back(self, k: int, x: np.ndarray, active: list[int], kept: list, d_states: np.ndarray):
        h = self.h
        dw, du, db = np.zeros_like(self.w[k]), np.zeros_like(self.u[k]), np.zeros_like(self.b[k])
        dh, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            before, held, i, f, o, c, squashed = kept[t]
            own = dh[:m] + d_states[t, :m]
            cell = dc[:m] + own * o * (1 - squashed**2)
            g = np.concatenate((cell * c * i * (1 - i), cell * held * f * (1 - f), own * squashed * o * (1 - o), cell * i * (1 - c * c)), 1)
            dw += x[t, :m].T @ g
            du += before.T @ g
            db += g.sum(0)
            dh[:m] = g @ self.u[k].T
            dc[:m] = cell * f
        return dw, du, db

    @staticmethod
    def pack(rows: np.ndarray, sizes: list[int]):
        """Steps x pages, longest page first, read forwards and backwards; and where each row went."""
        order = np.argsort([-s for s in sizes], kind="stable")
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        longest = max(sizes)
        active = [int(np.searchsorted([-sizes[p] for p in order], -t)) for t in range(longest)]
        forward = np.zeros((longest, len(sizes), rows.shape[1]), np.float32)
        backward = np.zeros_like(forward)
        step, page, back = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for place, p in enumerate(order):
            part = slice(starts[p], starts[p] + sizes[p])
            forward[: sizes[p], place] = rows[part]
            backward[: sizes[p], place] = rows[part][::-1]
            step[part], page[part], back[part] = np.arange(sizes[p]), place, np.arange(sizes[p])[::-1]
        return forward, backward, active, step, page, back

    def scores(self, rows: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Log-odds of being article text, for each row; ``sizes`` are the pages' numbers of rows.

        Pages go side by side, longest first, each step for those that still have a row; nothing is padded.
        """
        out = (rows @ self.out[2 * self.h :])[:, 0] + self.level[0]
        order = np.argsort(-np.array(sizes, np.int64), kind="stable")
        long = np.array(sizes, np.int64)[order]
        ends = np.cumsum(sizes)[order] if len(order) else long
        h, half = self.h, np.ones(4 * self.h, np.float32)
        half[: 3 * h] = 0.5
        active = np.searchsorted(-long, -np.arange(int(long.max(initial=0))))
        for k in range(2):
            given, u = (rows @ self.w[k] + self.b[k]) * half, self.u[k] * half
            given[:, h : 2 * h] += 0.5
            mine = np.ascontiguousarray(self.out[k * h : (k + 1) * h, 0])
            state, cell = np.zeros((len(order), h), np.float32), np.zeros((len(order), h), np.float32)
            for t, m in enumerate(active.tolist()):
                at = ends[:m] - long[:m] + t if k == 0 else ends[:m] - 1 - t
                g = np.tanh(given[at] + state[:m] @ u)
                gates = 0.5 * g[:, : 3 * h] + 0.5
                cell = gates[:, h : 2 * h] * cell[:m] + gates[:, :h] * g[:, 3 * h :]
                state = gates[:, 2 * h :] * np.tanh(cell)
                out[at] += state @ mine
        return out

    def gradients(self, rows: np.ndarray, sizes: list[int], y: np.ndarray):
        forward, backward, active, step, page, back = self.pack(rows, sizes)
        a, kept_a = self._side(0, forward, active)
        b, kept_b = self._side(1, backward, active)
        both = np.concatenate((a[step, page], b[back, page], rows), 1)
        z = (both @ self.out)[:, 0] + self.level[0]
        p = _sigmoid(z)
        loss = float(np.mean(np.logaddexp(0, z) - y * z))
        d = ((p - y) / len(y)).astype(np.float32)[:, None]
        d_both = d @ self.out.T
        da, db = np.zeros_like(a), np.zeros_like(b)
        da[step, page] = d_both[:, : self.h]
        db[back, page] = d_both[:, self.h : 2 * self.h]
        f, r = self._back(0, forward, active, kept_a, da), self._back(1, backward, active, kept_b, db)
        return loss, [f[0], r[0], f[1], r[1], f[2], r[2], both.T @ d, d.sum(0)]


# ---- made-up pages ----------------------------------------------------------------------------------

_LETTERS = ("aeiourstlnmdp", "aeiouäöüßschn", "aeiouéèçêlrt", "aeiouñóíárs", "аеионтсрвл")


def _word(rng: np.random.Generator) -> str:
    letters = _LETTERS[rng.integers(len(_LETTERS))]
    return "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(2, 10)))


def _words(rng: np.random.Generator, lo: int, hi: int) -> str:
    return " ".join(_word(rng) for _ in range(rng.integers(lo, hi + 1)))


def _sentences(rng: np.random.Generator, lo: int, hi: int) -> str:
    tails = (".", ".", ".", "!", "?", ".***", "%%%", "")
    return " ".join(_words(rng, 1, 14).capitalize() + tails[rng.integers(len(tails))] for _ in range(rng.integers(lo, hi + 1)))


def _pick(rng: np.random.Generator, *choices: str) -> str:
    return choices[rng.integers(len(choices))]


def _links(rng: np.random.Generator, lo: int = 2, hi: int = 9) -> str:
    items = [f'<a href="/{_word(rng)}">{_words(rng, 1, 3)}</a>' for _ in range(rng.integers(lo, hi + 1))]
    shape = rng.integers(3)
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if shape == 0 else " | ".join(items) if shape == 1 else "".join(f"<div>{x}</div>" for x in items)


def _furniture(rng: np.random.Generator) -> str:
    """A part of a page that is no article text."""
    kind = rng.integers(10)
    prose = lambda lo=1, hi=4: _pick(rng, f"<p>{_sentences(rng, lo, hi)}</p>", _sentences(rng, lo, hi), f"<h3>{_words(rng, 1, 4)}</h3><p>{_sentences(rng, lo, hi)}</p>")
    if kind == 0:
        return _pick(rng, f"<nav>{_links(rng)}</nav>", f'<div class="{_pick(rng, "menu", "nav-bar", "navigation", "breadcrumb", "topnav", "main-menu")}">{_links(rng)}</div>', f'<ul id="menu">{_links(rng)}</ul>')
    if kind == 1:
        return f"<header>{_pick(rng, '', f'<h1>{_words(rng, 1, 4)}</h1>', f'<p>{_sentences(rng, 1, 2)}</p>')}{_links(rng, 1, 5)}</header>" if rng.integers(2) else f'<div id="{_pick(rng, "header", "masthead", "site-header", "banner")}"><h1>{_words(rng, 1, 4)}</h1>{prose(1, 1)}</div>'
    if kind == 2:
        said = f"&copy; {_word(rng)}.example {_sentences(rng, 1, 3)}"
        return _pick(rng, f"<footer>{said}</footer>", f"<footer><p>{said}</p>{_links(rng)}</footer>", f'<div class="{_pick(rng, "footer", "site-footer", "copyright", "bottom")}"><p>{said}</p></div>')
    if kind == 3:
        return _pick(rng, f"<aside>{prose()}{_links(rng)}</aside>", f"<aside>{prose(1, 6)}</aside>", f'<div class="{_pick(rng, "sidebar", "side-bar", "widget", "related", "related-posts", "recommended", "trending")}">{prose()}{_links(rng)}</div>')
    if kind == 4:
        return f'<div class="{_pick(rng, "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad")}">{prose()}</div>'
    if kind == 5:
        return f'<div {_pick(rng, "class", "id")}="{_pick(rng, "cookie", "cookie-notice", "notice", "consent", "gdpr", "newsletter", "subscribe", "popup", "modal", "alert", "paywall")}">{prose()}<button>{_word(rng)}</button></div>'
    if kind == 6:
        return f'<form action="/{_word(rng)}"><label>{_words(rng, 1, 3)}</label><input name="q"><p>{_sentences(rng, 1, 2)}</p><select><option>{_word(rng)}<option>{_word(rng)}</select><button>{_words(rng, 1, 2)}</button></form>'
    if kind == 7:
        one = lambda: _pick(rng, f'<div class="comment"><p>{_sentences(rng, 1, 6)}</p></div>', f'<li class="comment"><b>{_word(rng)}</b><p>{_sentences(rng, 1, 5)}</p></li>', f'<article class="comment"><header>{_word(rng)}</header><p>{_sentences(rng, 1, 4)}</p></article>')
        many = "".join(one() for _ in range(rng.integers(1, 6)))
        return _pick(rng, f'<section id="comments"><h2>{_words(rng, 1, 2)}</h2>{many}</section>', f'<div class="comments">{many}</div>', f'<ol class="comment-list">{many}</ol>', f'<div id="{_pick(rng, "disqus", "responses", "discussion", "replies", "reader-comments")}">{many}</div>')
    if kind == 8:
        return f'<div class="{_pick(rng, "share", "social", "social-share", "tags", "pagination", "byline-links", "pager")}">{_links(rng, 2, 5)}</div>'
    return f"<script>{_word(rng)}()</script><!-- {_word(rng)} -->"


def _article_parts(rng: np.random.Generator) -> list[str]:
    parts = [f"<h1>{_words(rng, 1, 10)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.integers(1, 14)):
        kind = rng.integers(12)
        if kind == 0:
            level = rng.integers(2, 5)
            parts.append(f"<h{level}>{_words(rng, 1, 7)}</h{level}>")
        elif kind == 1:
            parts.append("<ul>" + "".join(f"<li>{_sentences(rng, 1, 2)}</li>" for _ in range(rng.integers(1, 6))) + "</ul>")
        elif kind == 2:
            parts.append(f"<blockquote><p>{_sentences(rng, 1, 3)}</p></blockquote>")
        elif kind == 3:
            parts.append("<table>" + "".join(f"<tr><td>{_words(rng, 1, 3)}</td><td>{_words(rng, 1, 3)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
        elif kind == 4:
            parts.append(f"<pre>{_words(rng, 3, 20)}</pre>")
        elif kind == 5:
            parts.append(f"<p><b>{_sentences(rng, 1, 2)}<br>")
        elif kind == 6:
            parts.append(f'<p>{_sentences(rng, 1, 3)} <a href="/{_word(rng)}">{_words(rng, 1, 4)}</a> {_sentences(rng, 1, 2)}</p>')
        elif kind == 7:
            parts.append(f"<p>{_words(rng, 1, 3)}.</p>")
        else:
            parts.append(f"<p>{_sentences(rng, 1, 9)}</p>")
    return parts


_SHELLS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"), ('<div class="post">', "</div>"),
    ('<div class="entry-content">', "</div>"), ('<section class="article-body">', "</section>"), ('<div class="content"><article class="post">', "</article></div>"), ("<div>", "</div>"), ("", ""),
)


def specimen(rng: np.random.Generator) -> list[tuple[str, bool]]:
    """Pieces of a made-up page in order, with whether their text belongs to the article."""
    if rng.random() < 0.03:
        return [(_sentences(rng, 1, 8), True)]
    out = [('<html><head><meta charset="utf-8"><title>x</title><style>p{}</style></head><body>', False)]
    wrapped = rng.random() < 0.3
    if wrapped:
        out.append((f'<div {_pick(rng, "class", "id")}="{_pick(rng, "page", "wrapper", "container", "site", "layout")}">', False))
    out += [(_furniture(rng), False) for _ in range(rng.integers(0, 5))]
    if rng.random() < 0.95:
        opening, closing = _SHELLS[rng.integers(len(_SHELLS))] if rng.random() < 0.5 else _SHELLS[0]
        out.append((opening, False))
        for part in _article_parts(rng):
            out.append((part, True))
            if rng.random() < 0.08:
                out.append((_furniture(rng), False))
        out.append((closing, False))
    out += [(_furniture(rng), False) for _ in range(rng.integers(0, 5))]
    out.append(("</div>" * wrapped + ("</body></html>" if rng.random() < 0.9 else ""), False))
    return out


_INK, _MARK = "", ""


def labelled(rng: np.random.Generator) -> tuple[list[tuple[np.ndarray, str, int]], list[bool]]:
    """Blocks of a made-up page and whether each is article text; told by marks put into the text."""
    page = "".join(re.sub(r">([^<]*[^<\s][^<]*)|^([^<]*[^<\s][^<]*)", lambda m: (">" if m[0].startswith(">") else "") + (m[1] or m[2] or "") + (_INK if wanted else _MARK), part) for part, wanted in specimen(rng))
    found = blocks(page)
    y = [_INK in text for _, text, _ in found]
    clean = [(p, re.sub(f"[{_INK}{_MARK}]", "", text).strip(), n) for p, text, n in found]
    keep = [i for i, b in enumerate(clean) if b[1]]
    return [clean[i] for i in keep], [y[i] for i in keep]


@lru_cache(1)
def trained(pages: int = 1500, rounds: int = 400, batch: int = 48, seed: int = 11) -> Labeller:
    rng = np.random.default_rng(seed)
    made = [x for x in (labelled(rng) for _ in range(pages)) if x[0]]
    rows = [vectors([b]) for b, _ in made]
    net = Labeller(rng)
    weights = net.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        pick = rng.integers(0, len(made), batch)
        y = np.array([v for p in pick for v in made[p][1]], np.float32)
        _, grads = net.gradients(np.concatenate([rows[p] for p in pick]), [len(rows[p]) for p in pick], y)
        rate = 0.02 * (1 - step / (rounds + 1)) + 0.0005
        for w, g, m, v in zip(weights, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


#: Pages, and blocks unless one page has more, that go through the network together.
GROUP = 256
GROUP_BLOCKS = 50_000
_RESULT = "struct<text:string,blocks:int,kept:int>"


def extract(pages: list[str], net: Labeller) -> list[tuple[str, int, int]]:
    """(text, blocks, blocks kept) of each page."""
    out: list[tuple[str, int, int]] = []
    found: list[list[tuple[np.ndarray, str, int]]] = []

    def label() -> None:
        scores = net.scores(vectors(found), [len(b) for b in found])
        at = 0
        for b in found:
            keep = [text for (_, text, _), s in zip(b, scores[at : at + len(b)].tolist(), strict=True) if s > 0]
            out.append(("\n\n".join(keep), len(b), len(keep)))
            at += len(b)
        found.clear()

    held = 0
    for page in pages:
        own = blocks(page)
        if found and (held + len(own) > GROUP_BLOCKS or len(found) == GROUP):
            label()
            held = 0
        found.append(own)
        held += len(own)
    if found:
        label()
    return out


def main_text(pages: DataFrame, net: Labeller | None = None, html_col: str = "html", out: str = "main") -> DataFrame:
    """``pages`` with a struct column ``out``: text, number of blocks, number of blocks kept."""
    shared = pages.sparkSession.sparkContext.broadcast(net or trained())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [r for part in slices(batch) for r in extract([x or "" for x in part.to_pylist()], shared.value)]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["text", "blocks", "kept"])

    return pages.withColumn(out, F.arrow_udf(run, _RESULT)(F.col(html_col)))


def report(pages: DataFrame) -> DataFrame:
    found = main_text(pages.select("page_id", "url", "html"), out="_m")
    return found.select("page_id", "url", F.col("_m.text").alias("text"), F.char_length("_m.text").cast("long").alias("n_chars"))
