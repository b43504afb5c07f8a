"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks of text, each with its path of open elements. Blocks become
vectors (hashed tag-path and class words, hashed words of the text, a few numbers), and a
bidirectional LSTM in numpy reads the page's blocks as one sequence, so that every block is
labelled with the whole page as context. Main blocks are joined in page order.

The labeller is trained by this module's script, from pages that a seeded generator lays out in many ways and
whose blocks are known to be main text or not; its weights are stored beside it. Character references are decoded, white
space becomes one space. Null, empty and markup-only pages give an empty text. Markup that
is cut off or badly nested is read as far as it goes. Pages that repeat are read each.
"""

from __future__ import annotations

import collections
import functools
import html
import io
import os
import pickle
import pkgutil
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import storage, textscan

PATHS, WORDS, NUMBERS, HIDDEN = 192, 48, 6, 20
#: The share of training pages whose names say nothing.
UNNAMED = 0.48

#: Elements that end the block of text before and after them.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes if it is open within the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_OPEN = re.compile(r"</?([a-z][a-z0-9:-]*)", re.I)
_STOP = re.compile(r"""[>"']""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAME = re.compile(r"[a-z]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page in order; kind: "text", "open" or "close". Comments, declarations, scripts and styles are left out.

    A page is read in time linear in its length: no place is searched for an end twice. Once a
    quoted attribute is found not to end, quotes mean nothing in the rest of the page. A tag that no `>` ends takes the rest.
    """
    at, size, quotes = 0, len(page), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield "text", page[at:lt], ""
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        m = _OPEN.match(page, at)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at += 1
            continue
        end, pos = -1, m.end()
        while quotes:
            stop = _STOP.search(page, pos)
            if not stop:
                break
            if stop[0] == ">":
                end = stop.start()
                break
            pos = page.find(stop[0], stop.end()) + 1
            if not pos:
                break
        if end < 0:
            quotes, end = False, page.find(">", m.end())
            if end < 0:
                return
        name = m[1].lower()
        close = page[at + 1] == "/"
        yield "close" if close else "open", name, page[m.end() : end]
        at = end + 1
        if not close and name in _RAW_END:
            raw = _RAW_END[name].search(page, at)
            at = raw.end() if raw else size


@functools.lru_cache(maxsize=65536)
def _bits(names: str) -> tuple[int, int]:
    """The bits that an element's names set in the vectors of all that it holds, and of its own text."""
    path = leaf = 0
    for name in names.split():
        path |= 1 << zlib.crc32(name.encode()) % (PATHS - 32)
        leaf |= 1 << zlib.crc32(b"leaf" + name.encode()) % 32
    return path, leaf


def blocks(page: str) -> list[tuple[tuple[int, int], str, int]]:
    """(path, text, characters within links) of every block that has text, in page order.

    A path is the bits of the open elements and of the innermost one, so depth costs no memory.
    """
    stack: list[tuple[str, int, int]] = []
    count: collections.Counter[str] = collections.Counter()
    out: list[tuple[tuple[int, int], str, int]] = []
    text: list[str] = []
    links = inside = 0
    path: tuple[int, int] | None = None

    def here() -> tuple[int, int]:
        return stack[-1][1:] if stack else (0, 0)

    def pop() -> None:
        count[stack.pop()[0]] -= 1

    def flush() -> None:
        nonlocal text, links
        if text:
            raw = "".join(text)
            joined = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if joined:
                out.append((path, joined, links))
            text, links = [], 0

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            path = path or here()
            text.append(tag)
            if inside:
                links += len(tag)
            continue
        if tag not in BLOCK:
            if tag == "br":
                text.append(" ")
                path = path or here()
            elif tag == "a":
                inside = kind == "open"
            continue
        flush()
        path = None
        if kind == "close":
            if count[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            inside = 0
            continue
        if stack and stack[-1][0] == "p":
            pop()
        close = CLOSES.get(tag)
        while close and stack and stack[-1][0] in close:
            pop()
        if tag in VOID:
            continue
        names = [tag]
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                names += [f".{w}" for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
            if _HIDDEN.search(attributes):
                names.append("hidden!")
        mine, leaf = _bits(" ".join(names))
        stack.append((tag, here()[0] | mine, leaf))
        count[tag] += 1
    flush()
    return out


@functools.lru_cache(maxsize=4096)
def _path_vector(path: tuple[int, int]) -> np.ndarray:
    whole = path[0] | path[1] << (PATHS - 32)
    return np.unpackbits(np.frombuffer(whole.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


def features(page: list[list[tuple[tuple[int, int], str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all blocks of some pages, one after the other, and each page's first block."""
    flat = [b for p in page for b in p]
    first = np.concatenate([[0], np.cumsum([len(p) for p in page])]).astype(np.int64)
    if not flat:
        return np.zeros((0, PATHS + WORDS + NUMBERS), np.float32), first
    x = np.zeros((len(flat), PATHS + WORDS + NUMBERS), np.float32)
    for k, (path, _, _) in enumerate(flat):
        x[k, :PATHS] = _path_vector(path)
    buf, offs = next((b, o) for _, _, b, o in textscan.slices(pa.array([t for _, t, _ in flat], pa.large_string()), 1 << 62))
    low = textscan.LOWER[buf]
    starts, ends, words = textscan.word_spans(low, offs, textscan.NON_ALNUM)
    n = np.diff(words)
    hashed = (textscan.span_hashes(low, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(flat)), n) * WORDS + hashed, minlength=len(flat) * WORDS).reshape(-1, WORDS)
    x[:, PATHS : PATHS + WORDS] = counts / np.maximum(n, 1)[:, None]
    chars = np.diff(offs)
    x[:, -6] = np.log1p(n) / 5
    x[:, -5] = np.minimum(1, np.array([c for _, _, c in flat]) / np.maximum(chars, 1))
    x[:, -4] = np.array([t[-1] in ".!?…\"”" for _, t, _ in flat])
    x[:, -3] = np.array([t[0] in "©|»›" for _, t, _ in flat])
    place = np.arange(len(flat)) - np.repeat(first[:-1], np.diff(first))
    x[:, -2] = place / np.maximum(np.repeat(np.diff(first), np.diff(first)), 1)
    x[:, -1] = 1
    return x, first


class Labeller:
    """A bidirectional LSTM with one logistic output a block."""

    def __init__(self, seed: int):
        r, d = np.random.default_rng(seed), PATHS + WORDS + NUMBERS
        self.w = [r.normal(0, 0.08, (d, 8 * HIDDEN)).astype(np.float32), *(r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)), r.normal(0, 0.2, (2 * HIDDEN, 1)).astype(np.float32), np.zeros(1, np.float32)]

    def _run(self, z: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """z: time, page, gates. The hidden states, and what the way back needs."""
        h = c = np.zeros((z.shape[1], HIDDEN), np.float32)
        out, kept, k = np.empty((z.shape[0], z.shape[1], HIDDEN), np.float32), [], 3 * HIDDEN
        for t in range(z.shape[0]):
            a = z[t] + h @ u
            s, g = 1 / (1 + np.exp(-a[:, :k])), np.tanh(a[:, k:])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            old, c = c, f * c + i * g
            th = np.tanh(c)
            if keep:
                kept.append((i, f, o, g, old, th, h))
            h = o * th
            out[t] = h
        return out, kept

    def _back(self, dout: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dz, du = np.empty((*dout.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
        dh = dc = np.zeros(dout.shape[1:], np.float32)
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, old, th, h = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - th * th)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
            du += h.T @ dz[t]
            dh, dc = dz[t] @ u.T, dc * f
        return dz, du

    @staticmethod
    def _padded(x: np.ndarray, first: np.ndarray, which: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x by time and page; backward: each page from its end. And the places in x (len(x): padding)."""
        n = np.diff(first)[which]
        t = np.arange(n.max())[:, None]
        at = np.where(t < n, first[which] + (n - 1 - t if backward else t), len(x))
        return np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])[at], at

    def logits(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        out, z = np.zeros(len(x)), x @ self.w[0]
        n = np.diff(first)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        k = 0
        while k < len(order):
            j = k + 1
            while j < len(order) and j - k < 256 and n[order[j]] * (j + 1 - k) <= 40_000:
                j += 1
            for d in (0, 1):
                part, at = self._padded(z[:, 4 * HIDDEN * d : 4 * HIDDEN * (d + 1)], first, order[k:j], bool(d))
                y = (self._run(part, self.w[1 + d], False)[0] @ self.w[3][HIDDEN * d : HIDDEN * (d + 1)])[:, :, 0]
                out[at[at < len(x)]] += y[at < len(x)]
            k = j
        return out + self.w[4][0]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.015, batch: int = 48) -> None:
        r, m = np.random.default_rng(seed), [(np.zeros_like(w), np.zeros_like(w)) for w in self.w]
        pages, step = np.flatnonzero(np.diff(first)), 0
        for epoch in range(epochs):
            order = r.permutation(pages)
            for k in range(0, len(order), batch):
                which = order[k : k + batch]
                p, ways = np.zeros(len(x), np.float32), []
                for d in (0, 1):
                    raw, at = self._padded(x, first, which, bool(d))
                    part = raw @ self.w[0][:, 4 * HIDDEN * d : 4 * HIDDEN * (d + 1)]
                    h, kept = self._run(part, self.w[1 + d], True)
                    ways.append((raw, at, h, kept))
                    p[at[at < len(x)]] += (h @ self.w[3][HIDDEN * d : HIDDEN * (d + 1)])[:, :, 0][at < len(x)]
                p = 1 / (1 + np.exp(-np.clip(p + self.w[4][0], -30, 30)))
                err = np.append((p - y) / sum(int(first[i + 1] - first[i]) for i in which), 0).astype(np.float32)
                g = [np.zeros_like(w) for w in self.w]
                for d, (raw, at, h, kept) in enumerate(ways):
                    e = err[at][:, :, None]
                    dz, g[1 + d] = self._back(e * self.w[3][HIDDEN * d : HIDDEN * (d + 1)][:, 0], kept, self.w[1 + d])
                    g[0][:, 4 * HIDDEN * d : 4 * HIDDEN * (d + 1)] = np.tensordot(raw, dz, ((0, 1), (0, 1)))
                    g[3][HIDDEN * d : HIDDEN * (d + 1)] = (h * e).sum((0, 1))[:, None]
                    if not d:
                        g[4][0] = e.sum()
                step += 1
                now = rate * (0.2 if epoch >= epochs * 2 // 3 else 1)
                for w, gw, (a, b) in zip(self.w, g, m, strict=True):
                    gw = np.clip(gw, -1, 1)
                    a += 0.1 * (gw - a)
                    b += 0.001 * (gw * gw - b)
                    w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


# The generator's vocabulary: element names and class words that sites use for each kind of part.
_CONTENT = ["article", "main", "main article", "div.content", "div.post", "div.entry-content", "div.article-body", "section.story", "div#main-text", "article.post", "main div.page", "div.container article", "div.text", "section", "div"]
_ADVERT = ["div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.sponsored", "div.banner", "div.promo", "section.ad-slot", "div#ad-top", "p.ad", "div.sponsor"]
_NOTICE = ["div.notice", "div.cookie-notice", "div.cookie-banner", "div.alert", "div.consent", "section.cookies", "div#gdpr", "p.notice", "div.popup", "dialog", "div.modal", "aside.notice", "div.message"]
_SIDE = ["aside", "aside.sidebar", "div.sidebar", "div.widget", "div.related", "section.related", "div#sidebar", "aside.related-links", "div.recommended", "div.newsletter", "div.share", "div.social", "div.trending", "div.author-box"]
_COMMENTS = ["div.comments", "section.comments", "section#comments", "div#comments", "div.comment-list", "ol.comments", "div.reader-comments", "div.replies", "section.discussion", "div.responses"]
_NAV = ["nav", "nav.menu", "div.menu", "div.navbar", "ul.nav", "div.breadcrumbs", "nav.breadcrumb", "div#menu", "div.navigation", "div.toolbar"]
_HEADER = ["header", "div.header", "div#header", "header.site-header", "div.masthead", "div.topbar", "header.top"]
_FOOTER = ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom"]
_MAIN_MARK, _OTHER_MARK = "\ue001", "\ue000"


def _element(spec: str, inner: str) -> str:
    out, close = "", ""
    for one in spec.split():
        tag = re.match(r"[a-z0-9]+", one)[0]
        cls, name = re.search(r"\.([\w-]+)", one), re.search(r"#([\w-]+)", one)
        out += f"<{tag}{f' class="{cls[1]}"' if cls else ''}{f' id="{name[1]}"' if name else ''}>"
        close = f"</{tag}>{close}"
    return out + inner + close


def synthetic_page(r: np.random.Generator, unnamed: float = 0.0) -> str:
    """A page whose blocks begin with a mark of their label.

    unnamed: the share of pages whose class names and ids say nothing or are absent, half of them
    without elements that say what they hold, so that the labeller learns to do without them.
    """
    if r.random() >= unnamed:
        return _laid_out(r)
    keep = r.uniform(0, 0.7) if r.random() < 0.5 else 0.0
    name = lambda: "".join("bcdfghjklmnpqrstvwxyz0123456789"[int(k)] for k in r.integers(0, 31, int(r.integers(1, 8))))
    page = re.sub(r' (class|id)=("[^"]*"|\'[^\']*\')', lambda m: m[0] if r.random() < keep else f' {m[1]}="{name()} {name()}"' if r.random() < 0.7 else "", _laid_out(r))
    return re.sub(r"<(/?)(article|main|section|header|footer|nav|aside|dialog)\b", r"<\1div", page) if r.random() < 0.5 else page


def _laid_out(r: np.random.Generator) -> str:
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    syllables = ["ta", "en", "er", "on", "is", "the", "ment", "un", "ing", "la", "que", "re", "ció", "sch", "éa", "ly", "of", "de"]

    def words(lo: int, hi: int) -> str:
        n = int(np.exp(r.uniform(np.log(lo), np.log(hi + 1))))
        s = " ".join("".join(pick(syllables) for _ in range(int(r.integers(1, 4)))) for _ in range(max(1, n)))
        return s[0].upper() + s[1:] + (pick([".", ".", ".", "!", ""]) if r.random() < 0.9 else "")

    main = lambda lo=1, hi=120: _MAIN_MARK + words(lo, hi)
    other = lambda lo=1, hi=30: _OTHER_MARK + words(lo, hi)
    link = lambda: f'<a href="/x">{other(1, 4)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(int(r.integers(2, 8)))) + "</ul>"

    def some(texts: list[str]) -> str:
        return "".join(pick(["<p>%s</p>", "<p>%s</p>", "<div>%s</div>", "%s<br>" if len(texts) == 1 else "<p>%s</p>"]) % t for t in texts)

    def boiler(kind: list[str], lo: int = 1, hi: int = 40) -> str:
        body = some([other(lo, hi) for _ in range(int(r.integers(1, 4)))]) if r.random() < 0.6 else other(lo, hi)
        return _element(pick(kind), (f"<h3>{other(1, 3)}</h3>" if r.random() < 0.25 else "") + (links() if r.random() < 0.3 else "") + body)

    def hidden() -> str:
        return pick(["<div hidden>%s</div>", '<p style="display:none">%s</p>', '<div aria-hidden="true">%s</div>', '<section hidden=""><p>%s</p></section>']) % other(1, 40)

    def form() -> str:
        return "<form>" + "".join(f"<label>{other(1, 3)}</label><input><br>" if r.random() < 0.5 else f"<p>{other(1, 8)}</p>" for _ in range(int(r.integers(1, 4)))) + f"<button>{other(1, 2)}</button></form>"

    def comments() -> str:
        one = lambda: pick(["<div class='comment'><p>%s</p></div>", "<p>%s</p>", "<li>%s</li>", "<div>%s</div>"]) % other(1, 80)
        said = lambda: f"<h3>{other(1, 4)}</h3>" + "<ul>" + "".join(f"<li>{other(1, 60)}</li>" for _ in range(int(r.integers(1, 6)))) + "</ul>"
        if r.random() < 0.15:
            return said()
        return _element(pick(_COMMENTS), (f"<h3>{other(1, 2)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(int(r.integers(1, 6)))) + (form() if r.random() < 0.3 else ""))

    def inside() -> str:
        k = r.random()
        if k < 0.72:
            return f"<p>{main()}</p>"
        if k < 0.78:
            return f"<h2>{main(1, 8)}</h2>"
        if k < 0.82:
            return "<ul>" + "".join(f"<li>{main(1, 20)}</li>" for _ in range(int(r.integers(1, 5)))) + "</ul>"
        if k < 0.85:
            return f"<blockquote><p>{main(3, 40)}</p></blockquote>"
        if k < 0.87:
            return f"<p><b>{main(1, 30)}<br><p>{main(1, 30)}</p>"
        if k < 0.89:
            return f"<table><tr><td>{main(1, 5)}</td><td>{main(1, 5)}</td></tr></table>"
        if k < 0.91:
            return f"<figure><img><figcaption>{main(1, 12)}</figcaption></figure>"
        if k < 0.92:
            return f"<pre>{main(1, 30)}</pre>"
        return boiler(pick([_ADVERT, _SIDE, _NOTICE])) if k < 0.97 else form() if k < 0.985 else hidden()

    def bare() -> str:
        """A page of little but its text, some paragraphs in one element or in none."""
        text = (f"<h1>{main(1, 14)}</h1>" if r.random() < 0.4 else "") + "".join(pick(["<p>%s</p>", "<p>%s</p>", "<div>%s</div>"]) % main() for _ in range(int(r.integers(1, 7))))
        before = _element(pick(_NAV), links() if r.random() < 0.5 else " ".join(link() for _ in range(int(r.integers(2, 6))))) if r.random() < 0.3 else ""
        after = _element(pick(_FOOTER), f"{_OTHER_MARK}© {words(1, 12)}") if r.random() < 0.3 else ""
        return before + (_element(pick(_CONTENT), text) if r.random() < 0.85 else text) + after

    def cells() -> str:
        """A page laid out by a table: a column of links, one of text, and rows above and below."""
        between = pick([" ", "<br>", " | ", "<br><br>", ""])
        menu = links() if r.random() < 0.25 else "".join(f"<p>{link()}</p>" for _ in range(int(r.integers(2, 8)))) if r.random() < 0.25 else between.join(link() for _ in range(int(r.integers(2, 8))))
        text = (f"<h1>{main(1, 14)}</h1>" if r.random() < 0.7 else "") + ("".join(inside() for _ in range(int(r.integers(1, 12)))) if r.random() < 0.8 else "<br><br>".join([main(5, 120)] + [words(5, 120) for _ in range(int(r.integers(0, 4)))]))
        columns = [f"<td>{menu}</td>", f"<td>{text}</td>"] + ([f"<td>{boiler(pick([_ADVERT, _SIDE]))}</td>"] if r.random() < 0.3 else [])
        if r.random() < 0.2:
            columns[0], columns[1] = columns[1], columns[0]
        above = f"<tr><td colspan=2>{other(1, 6)}</td></tr>" if r.random() < 0.5 else f"<tr><td>{between.join(link() for _ in range(int(r.integers(2, 6))))}</td></tr>" if r.random() < 0.3 else ""
        below = f"<tr><td colspan=2>{_OTHER_MARK}© {words(1, 12)}</td></tr>" if r.random() < 0.5 else ""
        return f"<table width=100%>{above}<tr>{''.join(columns)}</tr>{below}</table>"

    shape = r.random()
    if shape < 0.32:
        title = f"<title>{other(1, 14)}</title>" if r.random() < 0.6 else ""
        return f"<html><head>{title}</head><body>{bare() if shape < 0.22 else cells()}</body></html>"
    body = []
    if r.random() < 0.4:
        body.append(_element(pick(_HEADER), (f"<h1>{other(1, 5)}</h1>" if r.random() < 0.4 else some([other(1, 8)])) + (links() if r.random() < 0.4 else "")))
    if r.random() < 0.8:
        body.append(_element(pick(_NAV), links() if r.random() < 0.7 else " | ".join(link() for _ in range(int(r.integers(2, 6))))))
    for kind, chance in ((_NOTICE, 0.3), (_ADVERT, 0.5), (_SIDE, 0.15)):
        if r.random() < chance:
            body.append(boiler(kind))
    title = f"<h1>{main(1, 14)}</h1>" if r.random() < 0.85 else ""
    if title and r.random() < 0.2:
        title = f"<header>{title}</header>"
    text = title + "".join(inside() for _ in range(int(np.exp(r.uniform(0, np.log(40))))))
    tail = comments() if r.random() < 0.12 else ""
    body.append(_element(pick(_CONTENT), text + tail))
    for make, chance in ((lambda: boiler(_SIDE), 0.35), (lambda: boiler(_ADVERT), 0.2), (comments, 0.35), (form, 0.2)):
        if r.random() < chance:
            body.append(make())
    if r.random() < 0.85:
        body.append(_element(pick(_FOOTER), pick([lambda: f"{_OTHER_MARK}© {words(1, 12)}", lambda: other(1, 20), lambda: some([other(1, 12), other(1, 12)]), lambda: links() + other(1, 10)])()))
    whole = "".join(body)
    if r.random() < 0.15:
        whole = f"<div class='{pick(['wrapper', 'container', 'page', 'site'])}'>{whole}</div>"
    page = f"<!DOCTYPE html><html><head><title>{other(1, 14)}</title></head><body>{whole}</body></html>"
    return page[: int(len(page) * r.uniform(0.5, 1))] if r.random() < 0.1 else page


def training_set(pages: int, seed: int, unnamed: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, made, labels = np.random.default_rng(seed), [], []
    for _ in range(pages):
        bs = [b for b in blocks(synthetic_page(r, unnamed)) if b[1][0] in _MAIN_MARK + _OTHER_MARK and len(b[1]) > 1]
        labels += [b[1][0] == _MAIN_MARK for b in bs]
        made.append([(p, re.sub("[\ue000\ue001]", "", t).strip() or "x", n) for p, t, n in bs])
    x, first = features(made)
    return x, first, np.array(labels, np.float32)


def fitted(pages: int, epochs: int, seed: int) -> list[np.ndarray]:
    """The weights of a labeller trained on generated pages; the same for the same parameters."""
    x, first, y = training_set(pages, seed, UNNAMED)
    m = Labeller(seed)
    m.fit(x, first, y, epochs, seed)
    return m.w


#: The parameters of the stored weights: generated pages, epochs, seed.
STORED = (3400, 10, 11)
_FILE = "labeller.npz"
_trained: dict[tuple[int, int, int], list[np.ndarray]] = {}


def stored() -> list[np.ndarray]:
    """The weights that `python -m sigweave.llm.htmltext` has made: `fitted(*STORED)`."""
    with np.load(io.BytesIO(pkgutil.get_data("sigweave.llm", _FILE))) as f:
        return [f[f"w{i}"] for i in range(len(f.files))]


def train(spark: SparkSession, pages: int = STORED[0], epochs: int = STORED[1], seed: int = STORED[2]) -> Labeller:
    """A labeller: with the stored weights if the parameters are theirs, else trained by one task on an executor; kept for the life of the driver."""
    key, m = (pages, epochs, seed), Labeller(seed)
    if key == STORED:
        m.w = stored()
        return m
    if key not in _trained:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in batches):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(*key))], pa.binary())], names=["w"])

        _trained[key] = pickle.loads(spark.range(1).repartition(1).mapInArrow(run, "w binary").first()["w"])
    m.w = _trained[key]
    return m


def main_text(m: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p or "") for p in pages]
    x, first = features(cut)
    keep = m.logits(x, first) > 0
    return [" ".join(b[1] for b, k in zip(bs, keep[first[i] : first[i + 1]], strict=True) if k) for i, bs in enumerate(cut)]


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars", model: Labeller | None = None) -> DataFrame:
    """pages with the main text and its number of code points."""
    sent, place = pages.sparkSession.sparkContext.broadcast((model or train(pages.sparkSession)).w), pages.columns.index(html_col)

    def start() -> object:
        m = Labeller(0)
        m.w = sent.value

        def run(b: pa.RecordBatch) -> list:
            out, col, k = [], b.column(place), 0
            size = np.asarray(pc.fill_null(pc.binary_length(col), 0))
            while k < len(col):  # some pages at a time, for bounded memory
                j = k + 1
                while j < len(col) and j - k < 400 and size[k:j].sum() < 1 << 21:
                    j += 1
                out += main_text(m, col.slice(k, j - k).to_pylist())
                k = j
            return [out, [len(x) for x in out]]

        return run

    return storage.map_columns(pages, [(text_col, T.StringType()), (chars_col, T.LongType())], start)


if __name__ == "__main__":
    np.savez_compressed(os.path.join(os.path.dirname(os.path.abspath(__file__)), _FILE), **{f"w{i}": w for i, w in enumerate(fitted(*STORED))})
