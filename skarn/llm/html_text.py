"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is read as tags and text, forgiving of unclosed and truncated markup. Text between two block-level tags is a leaf
block; scripts, styles and other elements that show no running text are no blocks. Those of raw text (``RAW``) reach to
their end tag or, as in the HTML standard, to the end of the page; the others (``UNSHOWN``) to the end tag of their own
depth, and without one they hide nothing; a self-closed svg is empty. Each block has features of its open
ancestors (tag names; words of class, id and role) and of its text. Ancestors differ by what they hold: one around most
of the page's prose and its first heading is page-wide, and tells less by its name than one around a part, so its
features are of a kind of their own, and those of html and body do not count; of the others the nearest three count
apart from the rest; a header or footer inside an article is told from the page's. A two-label chain, content or not, is
trained on labelled pages by stochastic gradient ascent on the log-likelihood and decoded by Viterbi; content blocks are
joined in page order.

Labelled pages are a table of one's own, or those of ``labelled_pages``: layouts written here, with invented words.

Defined results: a null or empty page has the empty text; a page without content blocks too; text outside any element is
a block; a wrapper around the whole page, of whatever tag or class, hides nothing; repeated rows give repeated rows; null ids stay; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skarn.llm.common import claim, pick, slices

#: Elements whose tags do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q ruby rt rp s samp small source span strike strong sub sup time tt u var wbr".split()
)
#: Elements that show no running text: raw up to their end tag, and those with elements inside.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "iframe")
UNSHOWN = frozenset("select button object svg canvas audio video".split())
#: Elements without an end tag.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: The rest of a tag. A quote opens a value only right after "=", and closes it only in front of white space, "/" or ">";
#: any other quote is an ordinary character, so a stray one does not hide what follows the tag.
_ATTRIBUTES = r"""((?>=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+)"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([A-Za-z][^\s/>]*)" + _ATTRIBUTES + r">|<[!?/][^>]*>|<[A-Za-z/!?][^<>]*\Z|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
#: What stands behind the last ">" of a page: no tag ends there.
_TAIL = re.compile(r"<!--.*\Z|<[A-Za-z/!?][^<>]*\Z|[^<]+|<", re.DOTALL)
#: The tags of unshown elements; those in comments and scripts do not count (group 2 is empty).
_UNSHOWN_TAG = re.compile(
    r"<!--.*?-->|<script(?=[\s/>])[^>]*(?<!/)>.*?</script(?=[\s/>])[^>]*>|<(/?)(" + "|".join(sorted(UNSHOWN)) + r")(?=[\s/>])" + _ATTRIBUTES + ">",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z]+")


#: Elements that make a header or footer inside them one of a part.
PARTS = frozenset(("article", "main", "section"))
#: The least length of a block of prose (where a page has any), and the share of all prose that makes an element around the first heading page-wide; without a heading.
PROSE, WIDE, WIDE_ALONE = 60, 0.5, 0.9


@dataclass
class Element:
    tag: str
    names: tuple[str, ...]
    prose: int = 0
    blocks: int = 0


@dataclass
class Block:
    text: str
    features: list[str] = field(default_factory=list)
    within: tuple[Element, ...] = ()
    in_links: int = 0
    n_links: int = 0


def _unshown(page: str) -> dict[int, int]:
    """Where each closed element of UNSHOWN starts and ends. A button or select is not inside another: the next one closes it."""
    opened: dict[str, list[int]] = {name: [] for name in UNSHOWN}
    out: dict[int, int] = {}
    for m in _UNSHOWN_TAG.finditer(page, 0, page.rfind(">") + 1):
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if opened[name]:
                out[opened[name].pop()] = m.end()
        elif name == "svg" and m.group(3).endswith("/"):
            out[m.start()] = m.end()
        else:
            if name in ("button", "select"):
                opened[name].clear()
            opened[name].append(m.start())
    return out


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with their features."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    links = [0, 0, False]  # characters in links, links, whether inside one

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Block(text, [], tuple(stack), links[0], links[1]))
        links[0] = links[1] = 0

    page, at = page or "", 0
    ends: dict[int, int] | None = None
    last = page.rfind(">")
    while at < len(page):
        m = (_TOKEN if at < last else _TAIL).match(page, at)
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            parts.append(token)
            if links[2]:
                links[0] += len(token)
            continue
        name = (m.group(3) or "").lower() if m.re is _TOKEN else ""
        if not name:
            if m.re is _TOKEN and m.group(1):
                flush()
            continue
        closing = m.group(2) == "/"
        if name in UNSHOWN:
            flush()
            if not closing:
                ends = _unshown(page) if ends is None else ends
                at = max(at, ends.get(m.start(), at))
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            if name == "a":
                links[2] = not closing
                links[1] += not closing
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        while stack and (stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(name, ())):
            stack.pop()
        if name not in EMPTY:
            words: list[str] = []
            if m.group(4):
                for found in _NAMES.findall(m.group(4)):
                    words += (w.lower() for w in _WORDS.findall(" ".join(found)))
            stack.append(Element(name, tuple(words)))
    flush()
    _describe(out)
    return out


def _prose(b: Block) -> int:
    """The length of a block that reads like running text, else 0."""
    return len(b.text) if len(b.text) >= PROSE and b.in_links <= 0.3 * len(b.text) and b.text[-1] in ENDS else 0


def _describe(page: list[Block]) -> None:
    """Give every block its features, once all of the page is known."""
    sizes = [_prose(b) for b in page]
    if not any(sizes):  # a page of short lines: all that is not links
        sizes = [len(b.text) if b.in_links <= 0.3 * len(b.text) else 0 for b in page]
    total = sum(sizes)
    for b, n in zip(page, sizes, strict=True):
        for e in b.within:
            e.prose += n
            e.blocks += 1
    headed = next((b for b in page if any(e.tag == "h1" for e in b.within)), None)
    around = {id(e) for e in headed.within} if headed else set()
    share = WIDE if headed else WIDE_ALONE
    wide = {id(e) for b in page for e in b.within if total and e.blocks > 1 and e.prose >= share * total and (not headed or id(e) in around)}
    for b in page:
        b.features = _features(b, wide)
        b.within = ()


#: What ends a sentence, or a quotation of one.
ENDS = ".!?…”\"»)"


def _features(b: Block, wide: set[int]) -> list[str]:
    got, text, depth, inside = {"bias"}, b.text, 0, False
    tags = []
    for e in b.within:  # from the outermost
        tag = f"inner-{e.tag}" if inside and e.tag in ("header", "footer") else e.tag
        inside |= e.tag in PARTS
        tags.append((tag, e))
    for tag, e in reversed(tags):
        if e.tag in ("html", "body"):
            continue
        if id(e) in wide:
            got.add(f"wide:{tag}")
            got.update(f"wide-name:{n}" for n in e.names)
            continue
        got.add(f"in:{tag}")
        got.update(f"name:{n}" for n in e.names)
        if depth < 3:
            got.add(f"tag{depth}:{tag}" if depth < 2 else f"near:{tag}")
            got.update(f"near-name:{n}" for n in e.names)
        depth += 1
    if not depth:
        got.add("in:nothing")
    n = len(text)
    words = text.split(" ")
    got.add(f"length:{min(6, n.bit_length() // 2)}")
    got.add(f"words:{min(5, len(words).bit_length())}")
    share = b.in_links / n
    got.add("links:all" if share > 0.8 else "links:some" if share > 0.3 else "links:few" if b.n_links else "links:none")
    if "©" in text[:60]:
        got.add("copyright")
    if text[-1] in ENDS:
        got.add("ends")
    if len(words) < 4:
        got.add("short")
    return sorted(got)


# --- the model ------------------------------------------------------------------------------------------------------


@dataclass
class ChainField:
    """Label 1 is content. weights: one pair a feature; steps: from label to label; first: of the first block."""

    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def emissions(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for k, b in enumerate(page):
            at = [self.index[f] for f in b.features if f in self.index]
            if at:
                out[k] = self.weights[at].sum(axis=0)
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not page:
            return []
        e, (s00, s01), (s10, s11) = self.emissions(page).tolist(), self.steps[0].tolist(), self.steps[1].tolist()
        a, b = self.first[0] + e[0][0], self.first[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            p, q = a + s00 >= b + s10, a + s01 > b + s11
            back.append((0 if p else 1, 0 if q else 1))
            a, b = (a + s00 if p else b + s10) + x, (a + s01 if q else b + s11) + y
        labels = [0 if a >= b else 1]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def gradient(model: ChainField, feats: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A page's log-likelihood and its gradient: features and that of their weights, that of the steps, that of the first block's labels.

    ``feats`` are the places of each block's features among the weights.
    """
    n, flat = len(feats), np.concatenate(feats)
    owner = np.repeat(np.arange(n), [len(at) for at in feats])
    e = np.zeros((n, 2))
    np.add.at(e, owner, model.weights[flat])
    (s00, s01), (s10, s11) = model.steps.tolist()
    rows = e.tolist()
    ahead = [(model.first[0] + rows[0][0], model.first[1] + rows[0][1])]
    for x, y in rows[1:]:
        a, b = ahead[-1]
        ahead.append((_sum(a + s00, b + s10) + x, _sum(a + s01, b + s11) + y))
    behind = [(0.0, 0.0)]
    for x, y in reversed(rows[1:]):
        a, b = behind[-1]
        behind.append((_sum(s00 + x + a, s01 + y + b), _sum(s10 + x + a, s11 + y + b)))
    forward, backward = np.array(ahead), np.array(behind[::-1])
    total = _sum(*ahead[-1])
    own = float(model.first[labels[0]] + e[np.arange(n), labels].sum() + model.steps[labels[:-1], labels[1:]].sum() - total)
    expected = -np.exp(forward + backward - total)
    expected[np.arange(n), labels] += 1.0
    pairs = np.zeros((2, 2))
    if n > 1:
        both = forward[:-1, :, None] + model.steps[None] + (e[1:] + backward[1:])[:, None, :] - total
        pairs = -np.exp(both).sum(axis=0)
        np.add.at(pairs, (labels[:-1], labels[1:]), 1.0)
    which, at = np.unique(flat, return_inverse=True)
    up = np.zeros((len(which), 2))
    np.add.at(up, at, expected[owner])
    return own, which, up, pairs, expected[0]


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.3, penalty: float = 1e-4, seed: int = 7) -> ChainField:
    """Stochastic gradient ascent on the chains' log-likelihood, step sizes by AdaGrad; deterministic."""
    names = sorted({f for page, _ in pages for b in page for f in b.features})
    model = ChainField({f: i for i, f in enumerate(names)}, np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2))
    rows = [([np.array([model.index[f] for f in b.features]) for b in page], np.array(labels)) for page, labels in pages if page]
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.steps, model.first)]
    rng = np.random.default_rng(seed)

    def climb(which: int, target: np.ndarray, at, up: np.ndarray) -> None:
        up = up - penalty * target[at]
        squares[which][at] += up**2
        target[at] += rate * up / np.sqrt(squares[which][at])

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            _, which, up, pairs, first = gradient(model, *rows[k])
            climb(0, model.weights, which, up)
            climb(1, model.steps, slice(None), pairs)
            climb(2, model.first, slice(None), first)
    return model


# --- labelled pages -------------------------------------------------------------------------------------------------

_SYLLABLES = "an be con dar el fin gor hal is jun kel lo mer nat os pra quin ras sol tur un ver wis zan".split()
#: Containers of a page's own text, and of what surrounds it: (opening tag, closing tag).
_MAIN = [
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"),
    ('<div id="main-content"><div class="post-body entry">', "</div></div>"),
    ('<section class="article-body story">', "</section>"),
    ('<div class="main"><article class="post">', "</article></div>"),
    ('<div role="main">', "</div>"),
]
_MENU = [
    ("<nav>", "</nav>"),
    ("<header><nav>", "</nav></header>"),
    ('<div class="menu navbar">', "</div>"),
    ('<div id="nav" class="navigation">', "</div>"),
    ('<ul class="breadcrumb breadcrumbs">', "</ul>"),
    ('<div role="navigation" class="top topbar">', "</div>"),
]
_AROUND = [
    ("<aside>", "</aside>"),
    ('<div class="sidebar side widget">', "</div>"),
    ('<div class="ad">', "</div>"),
    ('<div class="ads advert advertisement banner">', "</div>"),
    ('<div class="sponsored promo promotion">', "</div>"),
    ('<div class="cookie cookies notice consent gdpr">', "</div>"),
    ('<div id="popup" class="notification alert modal overlay">', "</div>"),
    ('<section class="related recommended more">', "</section>"),
    ('<div class="newsletter subscribe signup">', "</div>"),
    ('<div class="share social sharing">', "</div>"),
    ("<form>", "</form>"),
    ('<form class="search login">', "</form>"),
    ('<div role="complementary">', "</div>"),
    ('<div role="alert" class="banner">', "</div>"),
]
_COMMENTS = [
    ('<section class="comments">', "</section>"),
    ('<div id="comments" class="comment-list">', "</div>"),
    ('<div class="comment reply user">', "</div>"),
    ('<ol class="comments discussion responses">', "</ol>"),
]
_END = [("<footer>", "</footer>"), ('<div class="footer bottom copyright">', "</div>"), ('<div role="contentinfo" id="footer">', "</div>")]


_LAYOUT = "col row grid block box item left right inner wrap first last clearfix".split()
#: Wrappers around a whole page or its middle: tags, and class words that say how the page looks, not what the wrapper holds.
_WRAP_TAGS = ["div", "div", "div", "section", "form", "center", "main"]
_WRAP_WORDS = (
    "wrapper container page site layout grid row col sidebar-right sidebar has-sidebar with-sidebar no-sidebar left-sidebar comments-open comments-closed has-comments nav-fixed fixed-nav"
    " menu-open navbar-top header-sticky footer-fixed sticky-footer ad-free has-ads cookie-ok promo-page related-on share-enabled modal-open popup-ready widget-area banner-top social-on"
    " newsletter-page notice-seen search-page login-page post hentry single post-template content body"
).split()


def labelled_pages(n: int = 800, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of varied layouts with the label of each leaf block, from a seed. Half have wrappers around all, or around the article and what follows."""
    rng = np.random.default_rng(seed)

    def word() -> str:
        return "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4)).tolist())

    def phrase(lo: int, hi: int, end: str = "") -> str:
        sizes = rng.integers(1, 4, rng.integers(lo, hi)).tolist()
        parts = iter(rng.integers(0, len(_SYLLABLES), sum(sizes)).tolist())
        return " ".join("".join(_SYLLABLES[next(parts)] for _ in range(k)) for k in sizes).capitalize() + end

    def one(options: list) -> tuple[str, str]:
        """One of the containers, now and then with a word of layout among its classes."""
        a, b = options[rng.integers(len(options))]
        if a.count(' class="') == 1 and rng.random() < 0.3:
            a = a.replace(' class="', f' class="{_LAYOUT[rng.integers(len(_LAYOUT))]} ')
        return a, b

    out = []
    for k in range(n):
        page, labels = ["<!DOCTYPE html><html><head><title>", phrase(2, 6), "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"], []

        def add(markup: str, label: int) -> None:
            page.append(markup)
            labels.append(label)

        def surrounding(pair: tuple[str, str]) -> None:
            deep = int(rng.integers(0, 3)) if rng.random() < 0.4 else 0
            page.append(pair[0] + "<div class='inner'>" * deep)
            kind = rng.integers(4)
            if kind == 0:  # bare text
                add(phrase(2, 40, "." if rng.random() < 0.7 else ""), 0)
            for _ in range(rng.integers(1, 4) if kind else 0):
                tag = ("p", "div", "li", "h3", "h4")[rng.integers(5)]
                body = phrase(1, 40, "." if rng.random() < 0.6 else "")
                add(f"<{tag}>{f'<a href=/x>{body}</a>' if kind == 1 else body}</{tag}>", 0)
            page.append("</div>" * deep + pair[1])

        def menu() -> None:
            pair = one(_MENU)
            page.append(pair[0] + "<ul>" * (k % 2))
            for _ in range(rng.integers(2, 8)):
                add(f"<li><a href='/{word()}'>{phrase(1, 3)}</a></li>", 0)
            page.append("</ul>" * (k % 2) + pair[1])

        def wrapper() -> tuple[str, str]:
            tag, words = _WRAP_TAGS[rng.integers(len(_WRAP_TAGS))], rng.choice(_WRAP_WORDS, rng.integers(0, 4))
            kind = "id" if rng.random() < 0.2 else "class"
            return f"<{tag}{f' {kind}="{' '.join(words)}"' if len(words) else ''}>", f"</{tag}>"

        around = [wrapper() for _ in range(rng.integers(1, 3))] if rng.random() < 0.5 else []
        page.extend(w for w, _ in around)
        if rng.random() < 0.3:
            page.append("<header class=masthead>")
            add(f"<{'h1' if k % 3 else 'div'}>{phrase(1, 5)}</{'h1' if k % 3 else 'div'}>", 0)
            page.append("</header>")
        if rng.random() < 0.85:
            menu()
        for _ in range(rng.integers(0, 3)):
            surrounding(one(_AROUND))
        middle = wrapper() if rng.random() < 0.3 else ("", "")
        pair = one(_MAIN) if rng.random() < (0.7 if middle[0] else 0.92) else ("", "")
        page.append(middle[0] + pair[0])
        if rng.random() < 0.85:
            headed = rng.random() < 0.3
            page.append("<header>" * headed)
            add(f"<h1>{phrase(1, 10, '.' if rng.random() < 0.3 else '')}</h1>", 1)
            if headed and rng.random() < 0.5:
                add(f"<p>{phrase(2, 12, '.' if rng.random() < 0.5 else '')}</p>", 1)
            page.append("</header>" * headed)
        for i in range(rng.integers(1, 16)):
            kind = rng.random()
            if kind < 0.72:
                add(f"<p>{phrase(1, 90, '.')}</p>", 1)
            elif kind < 0.8:
                add(f"<p>{phrase(3, 20)} <a href=/y>{phrase(1, 4)}</a>, {phrase(2, 20, '.')}", 1)
            elif kind < 0.86:
                add(f"<h2>{phrase(1, 6)}</h2>", 1)
            elif kind < 0.92:
                page.append("<ul>")
                for _ in range(rng.integers(1, 4)):
                    add(f"<li>{phrase(2, 20, '.' if rng.random() < 0.5 else '')}</li>", 1)
                page.append("</ul>")
            elif kind < 0.95:
                add(f"<blockquote>{phrase(3, 40, '.')}</blockquote>", 1)
            elif i:
                surrounding(one(_AROUND))
        inside = rng.random() < 0.3
        if not inside:
            page.append(pair[1])
        if rng.random() < 0.4:
            comments = one(_COMMENTS)
            page.append(comments[0])
            if rng.random() < 0.4:
                add(f"<h3>{phrase(1, 4)}</h3>", 0)
            for _ in range(rng.integers(1, 5)):
                tag = ("p", "div", "li")[rng.integers(3)]
                own = rng.random() < 0.4
                page.append("<div class='comment-body'>" * own)
                if own:
                    add(f"<div>{phrase(1, 3)}</div>", 0)
                add(f"<{tag}>{phrase(1, 50, '.')}</{tag}>", 0)
                page.append("</div>" * own)
            page.append(comments[1])
        for _ in range(rng.integers(0, 3)):
            surrounding(one(_AROUND))
        if inside:
            page.append(pair[1])
        page.append(middle[1])
        if rng.random() < 0.85:
            end = one(_END)
            page.append(end[0])
            for i in range(rng.integers(1, 4)):
                tag = ("", "", "p", "div", "li")[rng.integers(5)] if i == 0 else ("p", "div", "li")[rng.integers(3)]
                line = ("&copy; " if i == 0 and rng.random() < 0.7 else "") + phrase(1, 12, "." if rng.random() < 0.5 else "")
                line = f"<a href=/z>{line}</a>" if rng.random() < 0.3 else line
                add(f"<{tag}>{line}</{tag}>" if tag else line, 0)
            page.append(end[1])
        page.extend(w for _, w in reversed(around))
        out.append(("".join(page) + "</body></html>", labels))
    return out


_fitted: dict[tuple[int, int], ChainField] = {}


def default_model(n: int = 800, seed: int = 11) -> ChainField:
    """The chain trained on ``labelled_pages``; the driver trains it once."""
    if (n, seed) not in _fitted:
        rows = []
        for page, labels in labelled_pages(n, seed):
            found = blocks(page)
            if len(found) != len(labels):
                raise ValueError("a labelled page whose blocks and labels differ in number")
            rows.append((found, labels))
        _fitted[n, seed] = train(rows)
    return _fitted[n, seed]


def extract(page: str | None, model: ChainField) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, model.decode(found), strict=True) if label)


def main_text(pages: DataFrame, model: ChainField | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("html_text")
        for b in slices(batches, 2):
            texts = pa.array([extract(h, shipped.value) for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["id", "url", "text"])

    slim = pick(pages, id=id_col, url=url_col, html=html_col)
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, url string, text string")
