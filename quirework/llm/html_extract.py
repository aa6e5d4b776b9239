"""Main text of web pages: a bidirectional LSTM in numpy labels the blocks of a page."""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quirework.functions.grouped import append

# HTML's elements by kind.
#: Their content isn't text of the page.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video textarea select datalist".split())
#: Without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Within a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label input".split())
#: A start tag of the left ends an open element of the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th"}}
#: Whose open p a block's start tag doesn't end.
BARRIER = frozenset("table td th button object body html".split())

# Possessive, and every branch takes what it has met, so that no character is read twice but for the last quote of a page. A
# quote stands for a value only behind =, and only if it is closed; a tag that doesn't end takes the rest, as in browsers.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
#: Elements within elements that are told apart; deeper ones are read as if they stood there, as in browsers.
DEEPEST = 256
#: Names of an element that are looked at, at most.
NAMES = 32
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]  #: tags and words of classes, ids and roles, outermost first
    text: str
    linked: float  #: share of its characters in links


def _names(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "style":
            out += ["hidden"] if re.search(r"display\s*:\s*none", value, re.I) else []
        elif key in ("hidden", "aria-hidden"):
            out += [] if value.lower() == "false" else ["hidden"]
        else:
            out += ["." + x for x in NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())]
    return tuple(out[:NAMES])


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order: texts between tags of block elements, decoded, white space squeezed.

    Any markup is read, however broken: what isn't closed is closed by its successor or its parent, an end tag without its
    start is passed over, a comment, script or tag that doesn't end takes the rest. Time grows with the length of the page.
    """
    html = html or ""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    count: Counter[str] = Counter()
    words: list[str] = []
    link, in_links, total = 0, 0, 0

    def flush() -> None:
        nonlocal in_links, total
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append(Block(tuple(x for tag, names in open_ for x in (tag, *names)), text, in_links / max(1, total)))
        in_links = total = 0

    def take(text: str) -> None:
        nonlocal in_links, total
        if text:
            words.append(unescape(text))
            n = len(text.strip())
            total += n
            in_links += n if link else 0

    def close(i: int) -> None:
        for tag, _ in open_[i:]:
            count[tag] -= 1
        del open_[i:]

    at = 0
    while m := MARKUP.search(html, at):
        take(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                take(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag in INLINE:
                link = max(0, link - 1) if tag == "a" else link
            elif count[tag]:
                flush()
                inner = next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag)
                close(inner)
                link = 0
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            if tag not in ("noscript", "math"):
                continue
            continue
        if tag in INLINE:
            if tag == "br" or tag == "img":
                words.append(" ")
            link += tag == "a" and not m[0].endswith("/>")
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDS and any(count[x] for x in ENDS[tag]):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in ENDS[tag]:
                    close(i)
                    break
                if open_[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        elif tag not in ENDS and count["p"]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == "p":
                    close(i)
                    break
                if open_[i][0] in BARRIER:
                    break
        link = 0
        if len(open_) < DEEPEST:
            open_.append((tag, _names(m[3]) if m[3] else ()))
            count[tag] += 1
    take(html[at:])
    flush()
    return out


@dataclass(frozen=True)
class Settings:
    paths: int = 2048  #: places of hashed names of a path
    words: int = 2048  #: places of hashed words
    path_size: int = 24
    word_size: int = 8
    hidden: int = 16
    pages: int = 700  #: made pages that are learned from
    epochs: int = 10
    mute: float = 0.85  #: share of a page's blocks whose words aren't seen in a step of training
    rate: float = 0.01
    seed: int = 7


# What pages call their parts.
_DROP = {
    "menu": ["nav", "nav.main-nav", "div.menu", "div#menu", "div.navbar", "ul.nav", "div.breadcrumbs", "ol.breadcrumb", "div.pagination", "div.navigation", "div#nav", "ul.menu-items", "div.toc", "div[menu]", "div.skip-link", "div.pager"],
    "header": ["header", "div.header", "div#header", "div.masthead", "div.site-header", "div.topbar", "div.site-title", "div.logo", "header.page-header", "div[banner]", "div.branding", "div.tagline"],
    "footer": ["footer", "div.footer", "div#footer", "div.copyright", "div.site-info", "footer.site-footer", "div[contentinfo]", "div.legal", "div.colophon", "div.credits"],
    "side": ["aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.related-posts", "div.recommended", "div.trending", "div.share", "div.social", "div.tags", "div[complementary]", "aside.rail", "div.popular", "div.most-read", "div.author-box"],
    "notice": ["div.cookie", "div#cookie-banner", "div.cookie-notice", "div.consent", "div.gdpr", "div.notice", "div.newsletter", "div.subscribe", "div.popup", "div.modal", "div.alert", "section.notice", "div.privacy", "div.overlay", "p.notice", "div.paywall", "div[alert]", "div[dialog]"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.banner-ad", "section.sponsor", "ins.adsbygoogle", "div#ad-top", "aside.ad", "p.ad", "div.ad-slot", "div.promotion", "div.promoted"],
    "form": ["form", "form.search", "div.search", "form.login", "div.login", "form#signup", "fieldset", "form.contact-form", "div.signup"],
    "comment": ["div.comments", "div#comments", "section.comments", "div.comment", "ol.comment-list", "div.reply", "div.discussion", "div#disqus-thread", "section#comments", "div.respond", "div.user-comments", "article.comment", "ul.comments", "li.comment", "div.reader-comments", "div.responses"],
    "hidden": ["div{hidden}", "p{hidden}"],
}
_KEEP = ["article", "main", "article.post", "div.post", "div.entry-content", "div.content", "div#content", "div.article-body", "section.story", "div.article", "main#main", "div.post-body", "section.body", "div[main]", "div.text", "div.hentry", "article.entry", "div.story-body", "div"]
_WRAP = ["div", "div.container", "div.wrapper", "div#page", "div.row", "div.col", "section", "div.inner", "div.layout", "div.site", "div#root", "div.grid", "div.box"]
_SAY = {
    "menu": ["home", "about us", "contact", "news", "products", "archive", "next page", "previous"], "header": ["the daily site", "welcome", "our blog", "magazine"], "footer": ["© all rights reserved", "terms of use", "privacy policy", "imprint ·"], "side": ["related articles", "popular posts", "share this", "tags:", "follow us"],
    "notice": ["we use cookies", "accept all cookies", "subscribe to our newsletter", "this site uses cookies to"], "advert": ["advertisement", "sponsored", "buy now", "special offer", "limited time"], "form": ["search", "your name", "e-mail", "log in", "submit", "password"], "comment": ["reply", "great post", "comments", "says:", "leave a comment"], "hidden": ["more"],
}


def _tag(name: str) -> tuple[str, tuple[str, ...]]:
    """A block's tag and names from the shorthand of the lists above: .class, #id, [role], {hidden}."""
    tag = re.match(r"[a-z0-9]+", name)[0]
    return tag, tuple(x if x == "hidden" else "." + x for x in NAME.findall(name[len(tag) :]))


def made_page(rnd: random.Random) -> list[tuple[Block, int]]:
    """Blocks of an invented page and whether each belongs to its article."""

    def word() -> str:
        return "".join(rnd.choice("abcdefghiklmnoprstuvwzäéñß") for _ in range(rnd.randint(1, 9)))

    def prose(n: int) -> str:
        one = word() if rnd.random() < 0.15 else ""
        return " ".join(one or word() for _ in range(n)).capitalize() + rnd.choice([".", ".", ".", "", "!", "?"])

    out: list[tuple[Block, int]] = []
    base: list[str] = ["html", "body"] if rnd.random() < 0.9 else []
    for _ in range(rnd.choice([0, 0, 1, 1, 2])):
        tag, names = _tag(rnd.choice(_WRAP))
        base += [tag, *names]

    def add(path: list[str], text: str, keep: int, linked: float = 0.0) -> None:
        out.append((Block(tuple(path), text, linked), keep))

    def drop(kind: str, at: list[str]) -> None:
        tag, names = _tag(rnd.choice(_DROP[kind]))
        path = at + [tag, *names]
        listed = kind in ("menu", "side") or rnd.random() < 0.2
        for _ in range(rnd.choice([1, 1, 2, 3, 6]) if listed else rnd.choice([1, 1, 2, 3])):
            # parts are told by their names: their words are as often those of prose
            text = rnd.choice(_SAY[kind]) if rnd.random() < 0.4 else prose(rnd.choice([1, 2, 4, 10, 30]))
            inner = rnd.choice([["ul", "li"], ["div", "ul", "li"], ["ul", "li"]]) if listed else rnd.choice([[], [], ["p"], ["div"], ["h3"], ["span"], ["div", "p"], ["h1"] if kind == "header" else ["h2"], ["button"]])
            add(path + inner, text, 0, rnd.choice([0.0, 1.0, 1.0]) if listed else rnd.choice([0.0, 0.0, 0.5]))

    if rnd.random() < 0.8:
        add(["html", "head", "title"] if base[:1] == ["html"] else ["head", "title"], prose(rnd.randint(1, 12)), 0)
    for kind in rnd.sample(["header", "menu", "notice", "advert", "form", "side", "hidden"], rnd.randint(0, 5)):
        drop(kind, base)
    tag, names = _tag(rnd.choice(_KEEP))
    body = base + [tag, *names]
    for _ in range(rnd.choice([0, 0, 0, 1])):
        tag, names = _tag(rnd.choice(_WRAP + _KEEP[:5]))
        body = body + [tag, *names]
    if rnd.random() < 0.8:
        # an article's own header holds its title; a page's doesn't
        own = ["header"] if tag in ("article", "main") and rnd.random() < 0.3 else []
        add(body + own + ["h1"], prose(rnd.choice([1, 3, 8, 12])), 1)
        if own and rnd.random() < 0.7:
            add(body + own + rnd.choice([["p"], ["p", ".byline"], ["div", ".byline"], ["p", ".lead"]]), prose(rnd.choice([2, 4, 10])), 1)
    same = [prose(rnd.choice([1, 2, 5])) for _ in range(2)] if rnd.random() < 0.15 else []
    for _ in range(rnd.choice([1, 2, 3, 5, 8, 15] * 4 + [60, 150])):
        r = rnd.random()
        if r < 0.08:
            drop(rnd.choice(["advert", "side", "notice", "form", "comment", "menu", "hidden"]), body)
        else:
            inner = rnd.choice([["p"]] * 8 + [[], ["h2"], ["h3"], ["ul", "li"], ["ol", "li"], ["blockquote"], ["blockquote", "p"], ["table", "tbody", "tr", "td"], ["table", "tr", "td"], ["pre"], ["figure", "figcaption"], ["dl", "dd"], ["section", "p"], ["div"], ["div", "p"]])
            # entries of lists and cells of tables come in runs
            for _ in range(rnd.choice([1, 2, 3, 5]) if inner[-1:] in (["li"], ["td"], ["dd"]) else 1):
                add(body + inner, rnd.choice(same) if same else prose(rnd.choice([1, 1, 2, 5, 15, 40, 80, 150])), 1, rnd.choice([0.0, 0.0, 0.0, 0.2, 1.0]))
    for kind in rnd.sample(["comment", "side", "footer", "advert", "notice", "form", "menu"], rnd.randint(0, 5)):
        drop(kind, base if rnd.random() < 0.7 else body)
    return out


@functools.lru_cache(200_000)
def _place(word: str, size: int) -> int:
    return crc32(word.encode()) % size


@dataclass
class Model:
    s: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(s: Settings) -> Model:
        r = np.random.default_rng(s.seed)
        size = s.path_size + s.word_size + 1
        p = {"path": r.normal(0, 0.3, (s.paths, s.path_size)), "word": r.normal(0, 0.1, (s.words, s.word_size))}
        for d in "fb":
            p["w" + d], p["u" + d] = r.normal(0, 0.25, (size, 4 * s.hidden)), r.normal(0, 0.25, (s.hidden, 4 * s.hidden))
            p["c" + d] = np.concatenate([np.zeros(s.hidden), np.ones(s.hidden), np.zeros(2 * s.hidden)])
        p["o"], p["x"], p["z"] = r.normal(0, 0.3, 2 * s.hidden), np.zeros(size), np.zeros(1)
        return Model(s, {k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        paths = [[_place(x, self.s.paths) for x in b.path] or [0] for b in page]
        words = [[_place(x, self.s.words) for x in b.text.lower().split()] for b in page]
        return paths, words, np.array([[b.linked] for b in page], np.float32)

    def vectors(self, page: tuple) -> np.ndarray:
        paths, words, flat = page

        def mean(table: np.ndarray, ids: list[list[int]], total: bool) -> np.ndarray:
            n = np.array([len(x) for x in ids])
            out = np.add.reduceat(table[np.fromiter((y for x in ids for y in x), np.int64, n.sum())], np.concatenate([[0], np.cumsum(n)[:-1]]))
            return out if total else out / n[:, None]

        return np.concatenate([mean(self.p["path"], paths, True), mean(self.p["word"], words, False), flat], axis=1)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of x(batch, time, size); mask is 0 beyond a page's end, where the state stays."""
        b, t, _ = x.shape
        h_ = self.s.hidden
        h = c = np.zeros((b, h_), np.float32)
        out = np.zeros((b, t, h_), np.float32)
        pre = x @ self.p["w" + d] + self.p["c" + d]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = pre[:, k] + h @ self.p["u" + d]
            g = 1 / (1 + np.exp(-np.clip(a[:, : 3 * h_], -30, 30)))
            i, f, o, n = g[:, :h_], g[:, h_ : 2 * h_], g[:, 2 * h_ :], np.tanh(a[:, 3 * h_ :])
            m = mask[:, k, None]
            new = f * c + i * n
            tc = np.tanh(new)
            if keep is not None:
                keep.append((k, h, c, i, f, o, n, tc, m))
            h, c = m * o * tc + (1 - m) * h, m * new + (1 - m) * c
            out[:, k] = h
        return out

    def pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, pages))
        x, mask = np.zeros((len(pages), t, pages[0].shape[1]), np.float32), np.zeros((len(pages), t), np.float32)
        for i, v in enumerate(pages):
            x[i, : len(v)], mask[i, : len(v)] = v, 1
        return x, mask

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        hs = [self._lstm(x, mask, d, keep.setdefault(d, []) if keep is not None else None) for d in "fb"]
        both = np.concatenate(hs, axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["o"] + x @ self.p["x"] + self.p["z"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        keep: dict = {}
        p = 1 / (1 + np.exp(-self.logits(x, mask, keep)))
        e = (p - y) * mask / mask.sum()
        g = {"o": np.einsum("bt,bth->h", e, keep["both"]), "x": np.einsum("bt,bts->s", e, x), "z": np.array([e.sum()])}
        dx = e[:, :, None] * self.p["x"]
        h_ = self.s.hidden
        for d, part in (("f", slice(0, h_)), ("b", slice(h_, None))):
            from_out = e[:, :, None] * self.p["o"][part]
            da = np.zeros((*mask.shape, 4 * h_), np.float32)
            du = np.zeros_like(self.p["u" + d])
            dh = dc = np.zeros((len(x), h_), np.float32)
            for k, h, c, i, f, o, n, tc, m in reversed(keep[d]):
                dh = dh + from_out[:, k]
                do, dnew = m * dh * tc, m * dh * o * (1 - tc * tc) + m * dc
                a = np.concatenate([dnew * n * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - n * n)], axis=1)
                da[:, k] = a
                du += h.T @ a
                dh, dc = a @ self.p["u" + d].T + (1 - m) * dh, dnew * f + (1 - m) * dc
            g["u" + d], g["c" + d] = du, da.sum((0, 1))
            g["w" + d] = np.einsum("bts,btk->sk", x, da)
            dx += da @ self.p["w" + d].T
        return g, dx

    def train(self, pages: list[list[tuple[Block, int]]]) -> Model:
        s, rnd = self.s, np.random.default_rng(self.s.seed)
        ready = [(self.inputs([b for b, _ in x]), np.array([y for _, y in x], np.float32)) for x in pages if x]
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        # pages of like length make a batch, so that few steps run over padding; the batches are shuffled
        ready.sort(key=lambda r: len(r[1]))
        for epoch in range(s.epochs):
            for at in rnd.permutation(-(-len(ready) // 25)) * 25:
                batch = ready[at : at + 25]
                x, mask = self.pad([self.vectors(v) for v, _ in batch])
                y = np.zeros(mask.shape, np.float32)
                for i, (_, w) in enumerate(batch):
                    y[i, : len(w)] = w
                mute = rnd.random(mask.shape) < s.mute
                x[..., s.path_size : s.path_size + s.word_size][mute] = 0
                g, dx = self.gradients(x, mask, y)
                g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
                for i, ((paths, words, _), _) in enumerate(batch):
                    for k, (a, w) in enumerate(zip(paths, words, strict=True)):
                        np.add.at(g["path"], a, dx[i, k, : s.path_size])
                        if not mute[i, k]:
                            np.add.at(g["word"], w, dx[i, k, s.path_size : s.path_size + s.word_size] / len(w))
                step += 1
                rate = s.rate * (1 - 0.8 * epoch / s.epochs)
                for k, v in g.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, whether each of its blocks is of the article. Pages of like length are labelled together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, x in enumerate(pages) if x), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < 256 and (n + 1) * len(pages[order[at + n]]) <= 20_000:
                n += 1
            x, mask = self.pad([self.vectors(self.inputs(pages[i])) for i in order[at : at + n]])
            for i, row in zip(order[at : at + n], self.logits(x, mask), strict=True):
                out[i] = row[: len(pages[i])] > 0
            at += n
        return out


@functools.lru_cache(2)
def trained(s: Settings = Settings()) -> Model:  # noqa: B008
    """The model, learned from s.pages invented pages: no table is read, so that it is the same for any input."""
    rnd = random.Random(s.seed)
    return Model.new(s).train([made_page(rnd) for _ in range(s.pages)])


def main_texts(model: Model, pages: list[str | None]) -> list[str]:
    found = [blocks(x) for x in pages]
    return ["\n".join(b.text for b, keep in zip(page, kept, strict=True) if keep) for page, kept in zip(found, model.label(found), strict=True)]


def extract(pages: DataFrame, html: str = "html", s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """pages without html and with text and n_chars, its code points; columns called so give way.

    Blocks that the model takes for the article's, in page order, joined by one line end; nothing of them is cut. Null, empty
    and textless pages: empty text. Rows are read one by one, so that ids may be null or repeat. Empty table: no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained(s))  # some 100,000 numbers

    def found(column: pa.Array) -> list[pa.Array]:
        texts: list[str] = []
        for at in range(0, len(column), 256):
            texts += main_texts(sent.value, column[at : at + 256].to_pylist())
        return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

    return append(pages, html, T.StructType().add("text", "string").add("n_chars", "long"), found, (html,))
