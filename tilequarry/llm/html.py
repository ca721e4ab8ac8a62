"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is read once, tolerant of unclosed and stray tags, into leaf blocks: stretches of text between block-level tags,
with character references decoded and white space made single spaces. Scripts, styles, comments and the head give no
blocks, nor does what stands in templates, frames, drawings and the like; of these, one that closes itself or is never
closed takes nothing with it. Each block has features of its ancestors' tags, class and id words, and roles (also joined with being inside an
article), and of its text: length, share of link text, punctuation, place. A two-label chain (main text or not) is
trained on labelled pages by maximising the conditional likelihood (forward-backward gradients, Adam); pages are
labelled by construction: :func:`labelled_page` lays out articles among menus, headers, footers, sidebars, notices,
adverts, forms and reader comments in many forms and knows each block's part. Training takes seconds on the driver, on a
fixed number of pages (``TRAIN_PAGES``), with a fixed seed; only the weights travel.

Defined results: a null, empty or textless page has an empty text; a null page_id or url stays null; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored whatever their names. A very long page takes
time and memory in proportion to its length, whatever is unclosed in it, and depth of nesting costs no recursion.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

TRAIN_PAGES = 500
SEED = 7
# Tags without a '<' inside; other places where one may begin are looked at with care.
_PLAIN = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>|(?=[!?]|/?[a-zA-Z]))""")
_NAME_END, _MARK, _END, _COMMENT_END = re.compile(r"[\s/>]"), re.compile(r"""[>"']"""), re.compile(">"), re.compile("-->")
_HEAD_END = re.compile(r"</head\s*>|<body[\s>]", re.I)
_LONG_NUMBER = re.compile(r"&#([0-9]{100,})")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "noscript", "template", "title", "svg", "iframe", "object")}
# A start tag on the left ends what is open of the tags on the right.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = _BLOCK - {"button", "label", "option", "optgroup", "select", "textarea", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_HOME = frozenset(("article", "main", "content", "post", "entry", "story"))
_NONE: frozenset[str] = frozenset()


class Block:
    __slots__ = ("text", "about", "links")

    def __init__(self, text: str, about: frozenset[str], links: int):
        self.text, self.about, self.links = text, about, links


def _closes_itself(attributes: str) -> bool:
    """Whether the last '/' closes the tag and is not an unquoted value's."""
    if not attributes.endswith("/"):
        return False
    last = attributes.rsplit(None, 1)[-1]
    last = last[max(last.rfind('"'), last.rfind("'")) + 1 :]
    return "=" not in last[:-2] and (len(last) == 1 or not attributes[: -len(last)].rstrip().endswith("="))


def _decoded(text: str) -> str:
    """``text`` with its character references; Python does not read decimal numbers of thousands of digits."""
    if "&" not in text:
        return text
    return unescape(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0") or "0")[:9], text))


class _Tags:
    """The tags of a page. What a search that may run to the page's end has found is kept, so that all together take time
    in proportion to the page: places asked for ascend, and an opening quote is followed once where no tag ends after it."""

    def __init__(self, html: str):
        self.html = html
        self.found: dict[re.Pattern[str], int] = {}
        self.dead: set[int] = set()

    def _next(self, pattern: re.Pattern[str], at: int) -> int:
        if self.found.get(pattern, -1) < at:
            m = pattern.search(self.html, at)
            self.found[pattern] = m.start() if m else len(self.html)
        return self.found[pattern]

    def _quoted_end(self, at: int) -> int:
        """The first '>' that is not in quotes, or the page's length."""
        html, none = self.html, len(self.html)
        met = []
        at = self._next(_MARK, at)
        while at < none and html[at] != ">":
            end = -1 if at in self.dead else html.find(html[at], at + 1)
            met.append(at)
            m = _MARK.search(html, end + 1) if end >= 0 else None
            at = m.start() if m else none
        if at == none:
            self.dead.update(met)
        return at

    def first(self, at: int) -> tuple[int, int, str, str, str] | None:
        """start, end, '/' of an end tag, name (none: a comment or the like) and attributes of the first tag from ``at`` on.

        A '>' in quotes does not end a tag, unless none follows outside quotes; a comment that is not closed ends there too.
        """
        html, none = self.html, len(self.html)
        while m := _PLAIN.search(html, at):
            start = m.start()
            if m[2]:
                return start, m.end(), m[1], m[2], m[3]
            if html.startswith("<!--", start):
                end = self._next(_COMMENT_END, start + 4)
                return start, end + 3 if end < none else min(self._next(_END, start + 4) + 1, none), "", "", ""
            if html[start + 1] in "!?":
                end = self._next(_END, start + 2)
                if end < none:
                    return start, end + 1, "", "", ""
            else:
                close = "/" if html[start + 1] == "/" else ""
                name = start + 1 + len(close)
                stop = self._next(_NAME_END, name + 1)
                end = self._quoted_end(stop)
                if end == none:
                    end = self._next(_END, stop)
                if end < none:
                    return start, end + 1, close, html[name:stop], html[stop:end]
            at = start + 1
        return None


def blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order, with the features of their ancestors (only those in ``known``, where given, so
    that deep nesting does not pile up features that no weight speaks of)."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool]] = []
    depths: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    same: dict[frozenset[str], frozenset[str]] = {}
    tags = _Tags(html)
    about, home, parts, links, anchors, at = _NONE, False, [], 0, 0, 0

    def end_block() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, about, links))
        parts, links = [], 0

    def pop_to(tag: str) -> None:
        nonlocal about, home, anchors
        while True:
            t = stack.pop()[0]
            depths[t].pop()
            if t == "a":
                anchors -= 1
            if t == tag:
                break
        about, home = stack[-1][1:] if stack else (_NONE, False)

    def add(text: str) -> None:
        nonlocal links
        text = _decoded(text)
        parts.append(text)
        if anchors:
            links += len(text)

    def innermost(*names: str) -> int:
        return max((depths[t][-1] for t in names if depths.get(t)), default=-1)

    while True:
        found = tags.first(at)
        if not found:
            add(html[at:])
            break
        start, end, close, tag, attributes = found
        if start > at:
            add(html[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag in _BLOCK:
                end_block()
            if depths.get(tag):
                pop_to(tag)
            continue
        if tag in _RAW:
            parts.append(" ")
            if tag in ("svg", "object") and _closes_itself(attributes):
                continue
            raw = None if tag in unclosed else _RAW[tag].search(html, at)
            end = html.find(">", raw.end()) if raw else -1
            if end >= 0:
                at = end + 1
            elif tag in ("script", "style"):
                at = len(html)
            else:
                unclosed.add(tag)
            continue
        if tag == "head":
            end = None if tag in unclosed else _HEAD_END.search(html, at)
            if end:
                at = end.start()
            else:
                unclosed.add(tag)
            continue
        if tag in _BLOCK:
            end_block()
            if tag in _ENDS_P and depths.get("p"):
                pop_to("p")
            for t in _CLOSES.get(tag, ()):
                if depths.get(t) and innermost(t) >= innermost("ul", "ol", "table", "dl", "select"):
                    pop_to(t)
        elif tag == "br":
            parts.append(" ")
        if tag in _VOID:
            continue
        own = ["t:" + tag]
        if attributes and "=" in attributes:
            for x in _NAMED.findall(attributes):
                own += ["c:" + w.lower() for w in _PART.findall(x[0] or x[1] or x[2])]
        home = home or tag in _HOME or any(x[2:] in _HOME for x in own)
        if home:
            own += ["in " + x for x in own] + ["home"]
        if not about.issuperset(own := own if known is None else known.intersection(own)):
            about = about.union(own)
            about = same.setdefault(about, about)
        stack.append((tag, about, home))
        depths.setdefault(tag, []).append(len(stack))
        anchors += tag == "a"
    end_block()
    return out


def _text_features(b: Block, k: int, n: int, seen_h1: bool) -> list[str]:
    t = b.text
    words = t.count(" ") + 1
    share = b.links / len(t)
    out = ["w%d" % min(words.bit_length(), 7), "l%d" % min(int(share * 3.01), 3), "e:" + (t[-1] if t[-1] in ".!?:,;" else "a" if t[-1].isalnum() else "x"), "h1" if seen_h1 else "no h1"]
    if not any(c in t for c in ".!?"):
        out.append("flat")
    if "©" in t or "|" in t or "»" in t:
        out.append("mark")
    if k == 0:
        out.append("first")
    if k == n - 1:
        out.append("last")
    return out


def features(page: list[Block]) -> list[frozenset[str]]:
    out, seen = [], False
    for k, b in enumerate(page):
        seen = seen or "t:h1" in b.about
        out.append(b.about.union(_text_features(b, k, len(page), seen)))
    return out


class Chain:
    """Weights of the field: ``weights[f]`` speaks for label 1 against 0; ``start`` and ``step`` are log potentials."""

    def __init__(self, weights: dict[str, float], bias: float, start: np.ndarray, step: np.ndarray):
        self.weights, self.bias = weights, bias
        self.known = frozenset(weights) | {"t:h1"}
        self.start, self.step = start.tolist(), step.tolist()

    def labels(self, page: list[frozenset[str]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        get, ((s00, s01), (s10, s11)) = self.weights.get, self.step
        a = b = 0.0
        back = []
        for k, f in enumerate(page):
            e = self.bias + sum([get(x, 0.0) for x in f])
            if k:
                from0 = b + s10 > a + s00
                from1 = b + s11 > a + s01
                back.append((from0, from1))
                a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + e
            else:
                a, b = self.start[0], self.start[1] + e
        out = [int(b > a)]
        for x in reversed(back):
            out.append(int(x[out[-1]]))
        return out[::-1] if page else []


def train(pages: list[tuple[list[frozenset[str]], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by Adam, all pages at once; padded positions take no part."""
    names = sorted({x for f, _ in pages for s in f for x in s})
    number = {x: i for i, x in enumerate(names)}
    n, length = len(pages), max(len(y) for _, y in pages)
    rows, cols = [], []
    y, inside = np.zeros((n, length), int), np.zeros((n, length), bool)
    for p, (f, labels) in enumerate(pages):
        y[p, : len(labels)], inside[p, : len(labels)] = labels, True
        for k, s in enumerate(f):
            cols += [number[x] for x in s]
            rows += [p * length + k] * len(s)
    rows, cols = np.array(rows), np.array(cols)
    theta = np.zeros(len(names) + 7)  # weights, bias, start (2), step (4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    last = inside.sum(1) - 1
    for t in range(1, rounds + 1):
        w, bias, start, step = theta[: len(names)], theta[len(names)], theta[-6:-4], theta[-4:].reshape(2, 2)
        emit = np.zeros((n, length, 2))
        emit[:, :, 1] = (np.bincount(rows, w[cols], n * length).reshape(n, length) + bias) * inside
        ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = start + emit[:, 0]
        for k in range(1, length):
            ahead[:, k] = np.logaddexp(ahead[:, k - 1, :1] + step[0], ahead[:, k - 1, 1:] + step[1]) + emit[:, k]
        total = np.logaddexp(*ahead[np.arange(n), last].T)
        for k in range(length - 2, -1, -1):
            x = emit[:, k + 1] + behind[:, k + 1]
            got = np.logaddexp(step[:, 0] + x[:, :1], step[:, 1] + x[:, 1:])
            behind[:, k] = np.where((k < last)[:, None], got, 0)
        node = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
        pair = ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        pair = np.where(inside[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0)
        gap = (y * inside - node[:, :, 1]).ravel()
        both = inside[:, 1:]
        real = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)])
        grad = np.concatenate((np.bincount(cols, gap[rows], len(names)), [gap.sum()], [(y[:, 0] == i).sum() - node[:, 0, i].sum() for i in (0, 1)], (real - pair.sum((0, 1))).ravel())) / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Chain({x: float(theta[i]) for x, i in number.items()}, float(theta[len(names)]), theta[-6:-4], theta[-4:].reshape(2, 2))


def labelled_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout and the blocks of its main text, in order."""
    word = lambda: "".join(r.choice(["ta", "ren", "mi", "sol", "que", "en", "the", "und", "é", "ou", "st", "ver"]) for _ in range(r.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=20: some(a, b).capitalize() + r.choice(".....!?")
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 6)))
    junk = lambda: " ".join(w + r.choice(["###", "%%%", "***"]) for w in some(5, 40).split())
    pick = r.choice
    main: list[str] = []

    def keep(text: str) -> str:
        main.append(text)
        return text

    link = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'

    def listing(k: int) -> str:
        t = pick(["ul", "ul", "ol"])
        return f"<{t}>" + "".join(f"<li>{link()}" + pick(["</li>", ""]) for _ in range(k)) + f"</{t}>"

    def menu() -> str:
        return pick([lambda: f"<nav>{listing(r.randint(2, 8))}</nav>", lambda: f'<div class="{pick(["menu", "nav", "navbar", "topnav", "breadcrumb", "breadcrumbs", "pagination"])}">' + pick([" | ", " ", " &raquo; "]).join(link() for _ in range(r.randint(2, 7))) + "</div>", lambda: f'<ul id="{pick(["menu", "nav", "navigation"])}">' + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7))) + "</ul>", lambda: f'<menu>{listing(3)}</menu>', lambda: f'<div role="navigation">{listing(4)}</div>'])()

    def header() -> str:
        inner = pick([f"<h1>{some(1, 3)}</h1>", f"<p>{some(1, 4)}</p>", f'<a href="/">{some(1, 2)}</a>', f"<h2>{some(1, 3)}</h2><p>{sentence()}</p>"])
        return pick([f"<header>{inner}{pick(['', menu()])}</header>", f'<div class="{pick(["header", "site-header", "masthead", "topbar", "logo"])}">{inner}</div>', f'<div id="header">{inner}</div>'])

    def footer() -> str:
        inner = pick([f"&copy; {word()}.example.com &middot; {prose()}", f"<p>&copy; 20{r.randint(10, 30)} {some(1, 3)}. {sentence()}</p>", listing(4), f"<p>{prose()}</p><p>{link()} | {link()}</p>"])
        return pick([f"<footer>{inner}</footer>", f'<div class="{pick(["footer", "site-footer", "copyright", "bottom"])}">{inner}</div>', f'<div id="footer">{inner}</div>'])

    def sidebar() -> str:
        inner = pick([f"<h3>{some(1, 3)}</h3>{listing(4)}", f"<p>{prose()}</p>", f"<h4>{some(1, 2)}</h4><p>{sentence()}</p><p>{link()}</p>"])
        return pick([f"<aside>{inner}</aside>", f'<div class="{pick(["sidebar", "widget", "related", "sidebar-right", "rail", "social", "share", "tags", "promo-box"])}">{inner}</div>', f'<div id="sidebar">{inner}</div>', f'<section class="related-posts">{inner}</section>'])

    def notice() -> str:
        inner = pick([prose(), f"<p>{sentence()}</p><button>{some(1, 2)}</button>", f"{sentence()} {link()}"])
        return pick([f'<div class="{pick(["notice", "cookie", "cookie-notice", "banner", "alert", "gdpr", "consent", "popup", "modal", "newsletter", "disclaimer", "paywall", "message"])}">{inner}</div>', f'<div id="cookie-banner">{inner}</div>', f'<div role="alert">{inner}</div>', f'<p class="notice">{sentence()}</p>', f"<dialog>{inner}</dialog>"])

    def advert() -> str:
        inner = pick([prose(), f"<p>{prose()}</p>", f"<a href='//x.example/{word()}'>{sentence()}</a>"])
        return f"<!-- ad {r.randint(0, 99)} -->" * r.randint(0, 1) + pick([f'<div class="{pick(["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "ad-box", "adsense", "banner-ad"])}">{inner}</div>', f'<div id="ad-{r.randint(1, 9)}">{inner}</div>', f'<aside class="ad">{inner}</aside>', f'<ins class="adsbygoogle">{sentence()}</ins>', f'<section class="sponsored">{inner}</section>'])

    def form() -> str:
        inner = pick([f"<label>{some(1, 3)}</label><input name=q><button>{word()}</button>", f"<p>{sentence()}</p><input type=email><button type=submit>{some(1, 2)}</button>", f"<fieldset><legend>{some(1, 3)}</legend><select><option>{word()}<option>{word()}</select><textarea>{sentence()}</textarea></fieldset>"])
        return pick([f"<form action='/{word()}'>{inner}</form>", f'<div class="search"><form>{inner}</form></div>', f'<form class="subscribe">{inner}</form>'])

    def comments() -> str:
        one = lambda: pick([f"<b>{word()}</b>: {prose()}", f'<p class="author">{word()}</p><p>{prose()}</p><a href="#r">{word()}</a>', f"<p>{prose()}</p>"])
        k = r.randint(1, 5)
        body = pick([lambda: "".join(f'<div class="comment">{one()}</div>' for _ in range(k)), lambda: "<ol class='comment-list'>" + "".join(f"<li>{one()}</li>" for _ in range(k)) + "</ol>", lambda: "".join(f"<article class='comment'>{one()}</article>" for _ in range(k))])()
        return pick([f'<section class="comments"><h3>{some(1, 2)}</h3>{body}</section>', f'<div id="comments"><h2>{r.randint(1, 99)} {word()}</h2>{body}</div>', f'<section id="respond" class="discussion">{body}</section>', f'<div class="{pick(["comments-area", "replies", "reader-comments", "responses"])}">{body}</div>'])

    def inline(text: str) -> str:
        words = text.split(" ")
        k = r.randrange(len(words))
        words[k] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<code>{}</code>", "<i class='k'>{}</i>", "<b>{}", "<strong>{}</strong>"]).format(words[k])
        return " ".join(words)

    def paragraph() -> str:
        kind = r.random()
        text = keep(junk() if kind < 0.05 else some(3, 40) if kind < 0.15 else sentence(1, 3) if kind < 0.25 else prose())
        shown = inline(text) if r.random() < 0.4 else text
        return pick(["<p>{}</p>"] * 6 + ["<p>{}", "<p>{}<br>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<p class='lead'>{}</p>", "<pre>{}</pre>"]).format(shown)

    def article() -> str:
        parts = []
        title = some(2, 10).capitalize() if r.random() < 0.9 else ""
        if title:
            head = f"<{(h := pick(['h1', 'h1', 'h1', 'h2']))}>{keep(title)}</{h}>"
            parts.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.08:
                parts.append(f"<h2>{keep(some(1, 6))}</h2>")
            elif kind < 0.15:
                parts.append("<ul>" + "".join(f"<li>{keep(pick([sentence(), some(1, 5)]))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.18:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{keep(some(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.21:
                parts.append(f"<figure><img src=x><figcaption>{keep(sentence())}</figcaption></figure>")
            elif kind < 0.29:
                parts.append(pick([advert, advert, sidebar, notice, form])())
            else:
                parts.append(paragraph())
        if r.random() < 0.12:
            parts.append(comments())
        body = "".join(parts)
        return pick([lambda: f"<article>{body}</article>"] * 4 + [lambda: f"<main>{body}</main>", lambda: f"<main><article>{body}</article></main>", lambda: f'<div id="content">{body}</div>', lambda: f'<div class="{pick(["content", "post", "entry-content", "article-body", "story", "post-content", "text"])}">{body}</div>', lambda: f'<table><tr><td class="content">{body}</td></tr></table>', lambda: f'<div class="wrap"><div>{body}</div></div>', lambda: f'<article class="post">{body}'])()

    before = [menu, header, notice, advert, form, sidebar]
    after = [footer, comments, sidebar, advert, form, notice, menu]
    top = "".join(pick(before)() for _ in range(r.randint(0, 4)))
    middle = article()
    bottom = "".join(pick(after)() for _ in range(r.randint(0, 3))) + pick([footer(), footer(), ""])
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{some(1, 5)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body class="{word()}">{top}{middle}{bottom}' + pick(["</body></html>", "", "</body>"])
    return page, main


def labelled(r: random.Random) -> tuple[list[frozenset[str]], list[int]]:
    """Features and labels of a labelled page's blocks."""
    html, main = labelled_page(r)
    page, at, labels = blocks(html), 0, []
    for b in page:
        hit = at < len(main) and b.text == " ".join(main[at].split())
        labels.append(int(hit))
        at += hit
    return features(page), labels


@lru_cache(maxsize=4)
def trained(n_pages: int = TRAIN_PAGES, seed: int = SEED) -> Chain:
    r = random.Random(seed)
    return train([p for p in (labelled(r) for _ in range(n_pages)) if p[1]])


def main_text(html: str | None, chain: Chain) -> str:
    page = blocks(html or "", chain.known)
    return "\n".join([b.text for b, y in zip(page, chain.labels(features(page))) if y]) if page else ""


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    store.small_batches(pages.sparkSession)
    chain = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = [main_text(h, chain) for h in b.column(2).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), b.column(1).slice(at, 256), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
