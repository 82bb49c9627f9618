"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks of text; each has a vector of its tag path (hashed tags, classes and ids of all elements around
it), a vector of its hashed words, and a few measures. A bidirectional LSTM reads the blocks of a page in order,
so each is classified with the whole page as context. The network is trained here, in numpy, on pages that a generator writes from
a seed: articles in many kinds of containers among menus, headers, footers, sidebars, notices, adverts, forms, related
links and reader comments. Nothing of the pages to be read is used.

Defined results: null or empty html gives an empty text; a page cut off in a tag, comment or script ends there; an open button, svg, title or
the like hides its text up to the next tag, an open head ends at the first element of a body; repeated rows
get equal rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text of a page: raw text up to the end tag, and others, of which one without an end tag hides only the text up to the next tag.
RAW, SILENT = "script|style|iframe", "title|textarea|noscript|template|svg|math|object|canvas|select|button|audio|video"
#: What may stand in a head; any other element ends it.
IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
#: Attributes of a tag: a quote counts only behind an equals sign, so an odd one ends with the tag.
INSIDE = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<({RAW})(?=[\s/>]){INSIDE}(?:>|\Z).*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    rf"|<(svg|math)(?=[\s/>]){INSIDE}(?<=/)>"
    rf"|<({SILENT})(?=[\s/>]){INSIDE}(?:>|\Z)(?:(?:(?!<\3[\s/>]).)*?</\3(?=[\s/>])[^>]*(?:>|\Z)|[^<]*(?:</?opt(?:ion|group)(?=[\s/>]){INSIDE}>[^<]*)*)"
    rf"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({INSIDE})(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Elements that stand inside a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open element of the same kind.
AGAIN = frozenset("p li dt dd tr td th option".split())
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 64, 16, 6, 20
WORD = re.compile(r"\w+")
MARKS = re.compile(r"[.,;!?]").findall
NO_PATH = np.zeros(PATH_DIM, "f4")


def blocks(page: str) -> list[tuple[str, np.ndarray, float]]:
    """(text, vector of its path, share of it inside links) of every block with text, in page order."""
    out: list[tuple[str, np.ndarray, float]] = []
    stack: list[tuple[str, np.ndarray]] = []  # tag, sum over the elements from the outermost to this one
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            out.append((text, stack[-1][1] if stack else NO_PATH, min(1.0, linked / len(text))))
        buffer.clear()
        linked = 0

    open_tags: Counter[str] = Counter()  # of the names on the stack, so that an end tag without a start costs nothing

    def close(to: int) -> None:
        for x in stack[to:]:
            open_tags[x[0]] -= 1
        del stack[to:]

    at = 0
    links = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            piece = html.unescape(raw) if "&" in raw else raw
            buffer.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        name = (m[5] or "").lower()
        if not name:
            if m[1] or m[2] or m[3]:
                flush()
            continue
        if open_tags["head"] and name not in IN_HEAD:
            close(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if name not in INLINE:
            flush()
        if m[4]:
            k = len(stack) - 1
            while open_tags[name] and stack[k][0] != name:
                k -= 1
            if open_tags[name]:
                close(k)
        elif name not in VOID:
            if name in AGAIN or (name not in INLINE and stack and any(x[0] == "p" for x in stack[-4:])):
                for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                    if stack[k][0] == ("p" if name not in AGAIN else name):
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "table", "div", "article", "section"):
                        break
            attributes = " ".join(next(filter(None, x), "") for x in ATTRIBUTE.findall(m[6])) if m[6] and "=" in m[6] else ""
            around = stack[-1][1] if stack else NO_PATH
            stack.append((name, around if name in INLINE else around + _element(f"{name} {attributes.lower()}" if attributes else name)))
            open_tags[name] += 1
        links = open_tags["a"]
    if at < len(page):
        raw = page[at:]
        buffer.append(html.unescape(raw) if "&" in raw else raw)
    flush()
    return out


@functools.lru_cache(200_000)
def _direction(token: str, dim: int) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(token.encode()) % (1 << 20)).normal(0, 1, dim).astype("f4")


@functools.lru_cache(20_000)
def _element(element: str) -> np.ndarray:
    tag, _, names = element.partition(" ")
    out = _direction("<" + tag, PATH_DIM).copy()
    for x in set(re.split(r"[^a-z]+", names)) - {""}:
        out += _direction("." + x, PATH_DIM)
    return out / 2


_WORDS = np.zeros((1 << 20, WORD_DIM), "f4")  # a row per seed of _direction, filled at first use
_FILLED = np.zeros(1 << 20, bool)


class _Rows(dict):
    """Row of _WORDS of each word between blanks, without the signs around it; 0 and a row of zeros for signs alone."""

    def __missing__(self, chunk: str) -> int:
        word = "".join(WORD.findall(chunk.lower()))
        seed = zlib.crc32(word.encode()) % (1 << 20) if word else 0
        if word and not _FILLED[seed]:
            drawn = np.frombuffer(hashlib.blake2b(seed.to_bytes(4, "little"), digest_size=2 * WORD_DIM).digest(), "<i2")
            _WORDS[seed] = drawn * np.float32(3**0.5 / (1 << 15))  # evenly over a range of variance 1
            _FILLED[seed] = True
        if len(self) > 400_000:
            self.clear()
        self[chunk] = seed
        return seed


_ROWS = _Rows()


def features(page: list[tuple[str, np.ndarray, float]]) -> np.ndarray:
    """A row per block, over all its words and the whole path."""
    x = np.zeros((len(page), PATH_DIM + WORD_DIM + MEASURES), "f4")
    chunks = [text.split() for text, _, _ in page]
    sizes = np.array([len(c) for c in chunks])
    rows = _WORDS[np.fromiter(map(_ROWS.__getitem__, itertools.chain.from_iterable(chunks)), "i8", int(sizes.sum()))]
    x[:, :PATH_DIM] = [path for _, path, _ in page]
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.add.reduceat(rows, np.cumsum(sizes) - sizes) / sizes[:, None]
    lengths = np.array([len(t) for t, _, _ in page])
    marks = np.array([len(MARKS(t)) for t, _, _ in page])
    x[:, -6] = np.log1p(lengths) / 4
    x[:, -5] = [links for _, _, links in page]
    x[:, -4] = np.minimum(1.0, marks / (1 + sizes) * 4)
    x[:, -3] = np.arange(len(page)) / len(page)
    x[:, -2] = [t[-1:] in ".!?" for t, _, _ in page]
    x[:, -1] = min(3.0, len(page) / 40)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over padded pages, and a logistic layer on both states of every block."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + MEASURES
        self.p = {}
        for k in "fb":
            self.p["W" + k] = (rng.normal(0, 1, (d, 4 * HIDDEN)) / np.sqrt(d)).astype("f4")
            self.p["U" + k] = (rng.normal(0, 1, (HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype("f4")
            self.p["c" + k] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype("f4")
        self.p["V"] = rng.normal(0, 0.2, 2 * HIDDEN).astype("f4")
        self.p["d"] = np.zeros(1, "f4")

    def run(self, x: np.ndarray, mask: np.ndarray, k: str) -> tuple[np.ndarray, list]:
        """States of every step (pages, blocks, hidden); x runs in the direction's own order."""
        n, steps, _ = x.shape
        z_in = x @ self.p["W" + k] + self.p["c" + k]
        h, c = np.zeros((n, HIDDEN), "f4"), np.zeros((n, HIDDEN), "f4")
        out, kept = np.zeros((n, steps, HIDDEN), "f4"), []
        for t in range(steps):
            z = z_in[:, t] + h @ self.p["U" + k]
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            c1 = m * new + (1 - m) * c
            tc = np.tanh(c1)
            h1 = m * (o * tc) + (1 - m) * h
            kept.append((h, c, i, f, o, g, tc, m))
            h, c = h1, c1
            out[:, t] = h
        return out, kept

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray, k: str, grads: dict) -> None:
        n, steps, _ = x.shape
        dh, dc = np.zeros((n, HIDDEN), "f4"), np.zeros((n, HIDDEN), "f4")
        dz_all = np.zeros((n, steps, 4 * HIDDEN), "f4")
        for t in range(steps - 1, -1, -1):
            h0, c0, i, f, o, g, tc, m = kept[t]
            dh = dh + d_out[:, t]
            dhm = dh * m
            dct = dc + dhm * o * (1 - tc * tc)
            dz = np.concatenate([dct * m * g * i * (1 - i), dct * m * c0 * f * (1 - f), dhm * tc * o * (1 - o), dct * m * i * (1 - g * g)], 1)
            dz_all[:, t] = dz
            grads["U" + k] += h0.T @ dz
            dc = dct * (m * f) + dct * (1 - m)
            dh = dz @ self.p["U" + k].T + dh * (1 - m)
        grads["W" + k] += np.einsum("ntd,ntk->dk", x, dz_all)
        grads["c" + k] += dz_all.sum((0, 1))

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x = np.zeros((len(pages), steps, pages[0].shape[1]), "f4")
        mask = np.zeros((len(pages), steps), "f4")
        for k, p in enumerate(pages):
            x[k, : len(p)] = p
            mask[k, : len(p)] = 1
        return x, mask

    def score(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        x, mask = self.padded(pages)
        a, _ = self.run(x, mask, "f")
        b, _ = self.run(x[:, ::-1], mask[:, ::-1], "b")
        s = _sigmoid(np.concatenate([a, b[:, ::-1]], 2) @ self.p["V"] + self.p["d"][0])
        return [s[k, : len(p)] for k, p in enumerate(pages)]

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 16):
                some = order[at : at + 16]
                x, mask = self.padded([pages[k] for k in some])
                y = np.zeros(mask.shape, "f4")
                for row, k in enumerate(some):
                    y[row, : len(labels[k])] = labels[k]
                a, ka = self.run(x, mask, "f")
                xr, mr = x[:, ::-1], mask[:, ::-1]
                b, kb = self.run(xr, mr, "b")
                h = np.concatenate([a, b[:, ::-1]], 2)
                g = (_sigmoid(h @ self.p["V"] + self.p["d"][0]) - y) * mask / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["V"] += np.einsum("nt,nth->h", g, h)
                grads["d"] += g.sum()
                dh = g[:, :, None] * self.p["V"]
                self.back(x, ka, dh[:, :, :HIDDEN], "f", grads)
                self.back(xr, kb, dh[:, ::-1, HIDDEN:], "b", grads)
                t += 1
                for k, v in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    s[k] = 0.99 * s[k] + 0.01 * grads[k] ** 2
                    v -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)


#: What a generated page's parts may be called.
NAMES = {
    "article": "content,article,post,entry,story,article body,post content,entry content,main content,article text,news body,text",
    "nav": "nav,menu,navbar,main menu,site nav,navigation,links,topnav,breadcrumbs,breadcrumb",
    "header": "header,site header,masthead,banner,top,logo",
    "footer": "footer,site footer,bottom,copyright,legal,colophon",
    "aside": "sidebar,side,widget,related,aside,recommended,more stories,tags,trending",
    "ad": "ad,ads,advert,advertisement,sponsored,promo,banner ad,adbox",
    "notice": "notice,cookie,cookie banner,consent,gdpr,alert,popup,modal,paywall",
    "form": "form,newsletter,signup,subscribe,search,login,contact",
    "comments": "comments,comment list,discussion,responses,reader comments,reviews,replies",
    "share": "share,social,share buttons,follow,byline,meta",
}
PHRASES = {
    "footer": "copyright all rights reserved|privacy policy terms of use|© 2024|contact us about imprint",
    "notice": "we use cookies to improve your experience|accept all|this site uses cookies|please log in to continue",
    "form": "subscribe to our newsletter|enter your email|search|sign up|send",
    "ad": "advertisement|sponsored|buy now|limited offer",
    "share": "share this|follow us|tweet|print",
    "comments": "reply|posted by|2 comments|leave a comment|says",
}


def generated(rng: np.random.Generator) -> tuple[str, list[tuple[str, int]]]:
    """A page and the (text, label) of its blocks."""
    truth: list[tuple[str, int]] = []
    syllables = ["ra", "te", "lo", "mi", "an", "en", "ou", "st", "ri", "ka", "bel", "tion"]

    def words(low: int, high: int) -> str:
        n = int(rng.integers(low, high + 1))
        out = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(n)]
        for k in range(n):
            if rng.random() < 0.1:
                out[k] += str(rng.choice([".", ",", "!", ";"]))
        return " ".join(out)

    def text(kind: str, low: int, high: int) -> str:
        if kind in PHRASES and rng.random() < 0.5:
            return str(rng.choice(PHRASES[kind].split("|")))
        return words(low, high)

    def leaf(tag: str, body: str, label: int, link: bool = False) -> str:
        truth.append((" ".join(body.split()), label))
        inner = f'<a href="/x">{body}</a>' if link else body
        return f"<{tag}>{inner}</{tag}>" if rng.random() < 0.9 else f"<{tag}>{inner}"

    def wrap(kind: str, tags: str, body: str) -> str:
        tag = str(rng.choice(tags.split(",")))
        name = "" if rng.random() < 0.3 and tag != "div" else f' {rng.choice(["class", "id"])}="{rng.choice(NAMES[kind].split(","))}"'
        return f"<{tag}{name}>{body}</{tag}>"

    def links(kind: str, n: int) -> str:
        return "<ul>" + "".join(leaf("li", text(kind, 1, 4), 0, rng.random() < 0.9) for _ in range(n)) + "</ul>"

    def para(label: int, low: int = 5, high: int = 120) -> str:
        end = str(rng.choice([".", "", "!"]))
        body = words(low, high) + end
        if rng.random() < 0.15:
            parts = body.split(" ")
            if len(parts) > 2:
                truth.append((" ".join(parts[:1]), label))
                truth.append((" ".join(parts[1:]), label))
                return f"<p>{parts[0]}<br>{' '.join(parts[1:])}</p>"
        return leaf("p", body, label)

    def maybe(p: float, make) -> str:
        return make() if rng.random() < p else ""

    def article() -> str:
        body = maybe(0.8, lambda: leaf(str(rng.choice(["h1", "h2"])), words(2, 12), 1))
        for _ in range(int(rng.choice([1, 2, 3, 5, 8, 12, 20]))):
            body += para(1, 1 if rng.random() < 0.2 else 6)
            body += maybe(0.12, lambda: leaf(str(rng.choice(["h2", "h3", "blockquote", "pre"])), words(2, 8), 1))
            body += maybe(0.08, lambda: "<ul>" + "".join(leaf("li", words(1, 12), 1) for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            body += maybe(0.06, lambda: "<table>" + "".join("<tr>" + leaf("td", words(1, 3), 1) + leaf("td", words(1, 3), 1) + "</tr>" for _ in range(2)) + "</table>")
            body += maybe(0.06, lambda: wrap("ad", "div,aside,ins", leaf("div", text("ad", 2, 14), 0)))
            body += maybe(0.05, lambda: wrap("share", "div", links("share", 2)))
            body += maybe(0.04, lambda: wrap("form", "form", leaf("label", text("form", 1, 6), 0)))
            body += maybe(0.03, lambda: wrap("notice", "div", leaf("p", text("notice", 3, 20), 0)))
        return wrap("article", "article,main,div,div,section,article", body)

    page = maybe(0.6, lambda: wrap("header", "header,div", leaf("div", words(1, 4), 0) + maybe(0.4, lambda: leaf("p", words(2, 9), 0))))
    page += maybe(0.85, lambda: wrap("nav", "nav,div,nav", links("nav", int(rng.integers(2, 9)))))
    page += maybe(0.4, lambda: wrap("notice", "div,section", para(0, 4, 30)))
    page += maybe(0.5, lambda: wrap("ad", "div,aside", leaf("div", text("ad", 2, 16), 0)))
    page += maybe(0.3, lambda: wrap("form", "form", leaf("label", text("form", 1, 6), 0)))
    side = lambda: wrap("aside", "aside,div", leaf("h3", words(1, 3), 0) + (links("aside", int(rng.integers(2, 6))) if rng.random() < 0.6 else para(0, 4, 40)))
    page += maybe(0.25, side)
    main = article()
    page += main if rng.random() < 0.6 else f"<div class=\"{rng.choice(['wrapper', 'container', 'page', 'row'])}\">{main}</div>"
    page += maybe(0.25, side)
    page += maybe(0.35, lambda: wrap("comments", "div,section", maybe(0.5, lambda: leaf("h3", text("comments", 1, 3), 0)) + "".join(f"<{t}>" + leaf("span" if t == "li" and rng.random() < 0.2 else "p", words(3, 60) if rng.random() < 0.8 else text("comments", 1, 3), 0) + f"</{t}>" for t in [str(rng.choice(["div", "li"]))] * int(rng.integers(1, 6)))))
    page += maybe(0.25, lambda: wrap("form", "form,div", leaf("p", text("form", 2, 12), 0)))
    page += maybe(0.8, lambda: wrap("footer", "footer,div,footer", leaf("p" if rng.random() < 0.5 else "div", text("footer", 3, 24), 0)))
    return f"<html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>", truth


_TRAINED: dict[tuple[int, int, int], Labeller] = {}


def trained(pages: int = 500, epochs: int = 9, seed: int = 11) -> Labeller:
    """The labeller, fitted on so many generated pages; once per process."""
    key = (pages, epochs, seed)
    if key not in _TRAINED:
        rng = np.random.default_rng(seed)
        xs, ys = [], []
        while len(xs) < pages:
            page, truth = generated(rng)
            found, at = blocks(page), 0
            y = np.zeros(len(found), "f4")
            for k, (text, _, _) in enumerate(found):  # blocks run together where a tag stays open: the label of the first
                if at < len(truth):
                    y[k] = truth[at][1]
                size = 0
                while at < len(truth) and size < len(text):
                    size += len(truth[at][0]) + 1
                    at += 1
            if len(found):
                xs.append(features(found))
                ys.append(y)
        model = Labeller()
        model.fit(xs, ys, epochs)
        _TRAINED[key] = model
    return _TRAINED[key]


def extract(pages: DataFrame, model: Labeller | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every row (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared.value
        for b in batches:
            found = [blocks(x or "") for x in b.column(2).to_pylist()]
            texts = [""] * len(found)
            order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
            at = 0
            while at < len(order):
                end = at + 1
                while end < len(order) and end - at < 256 and (end - at + 1) * len(found[order[end]]) <= 20_000:
                    end += 1
                some = order[at:end]
                for k, s in zip(some, labeller.score([features(found[k]) for k in some]), strict=True):
                    texts[k] = " ".join(x[0] for x, v in zip(found[k], s, strict=True) if v >= threshold)
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
