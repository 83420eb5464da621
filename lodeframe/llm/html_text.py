"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed into elements and runs of text (tags may be left open; script, style and the like are raw text).
Each node has features of its tag, the tokens of its attributes, its depth and ancestors, the density of text, links and
punctuation in its subtree, and its siblings. The trees give the probability that a node has main text in it. A node can
have some only if its parent has, so the most probable labelling under that rule is found by dynamic programming from
the leaves up; no descendant of a dropped node is kept, and no kept text lies in a dropped one.

The trees are trained here, in numpy, on ``PAGES`` generated pages whose menus, headers, footers, sidebars, notices, adverts,
forms and reader comments are known. The model is a few thousand numbers.

Defined cases: null and empty html give an empty text; html without tags is judged as one run of text; pages cut off
inside a tag lose that tag; comments, declarations and raw text are dropped; repeated rows each have a result; null page_id
and url are kept; no rows give no rows; further columns are not looked at.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

PAGES, TREES, LEVELS, RATE, BINS, SEED = 500, 30, 4, 0.3, 32, 5

# Element names by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
#: What an element's implied end doesn't reach beyond.
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "option": frozenset(["select"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "p": frozenset("button table td th caption object".split()), "head": frozenset()}

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")

# Attribute tokens, by what they tell of an element.
TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip tabs",
    "head": "header masthead banner topbar logo hero",
    "foot": "footer copyright legal colophon bottom",
    "side": "sidebar aside side rail complementary widget related recommended recommendations more popular trending",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion dfp adsense outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog toast paywall disclaimer",
    "form": "form search login signup signin subscribe subscription newsletter register contact",
    "reply": "comment comments commentlist discussion reply replies respond disqus feedback reviews review",
    "share": "share sharing social tags meta byline author tools buttons follow",
    "hidden": "hidden none invisible",
    "main": "article content main post entry body story text page prose articlebody maincontent",
}
_GROUP = {w: i for i, words in enumerate(TOKENS.values()) for w in words.split()}
_TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "ol", "li", "a", "table", "button", "h1", "h2", "h3", "blockquote", "pre", "figure", "#text", "body", "head", "dialog"]
_TAG_INDEX = {t: i for i, t in enumerate(_TAGS)}


class Page:
    """The nodes of a page in page order, the root first: element names, parents, attribute marks, runs of text.

    A run of text has the name #text, and ``breaks`` tells whether a block begins or ends between it and the run before it.
    """

    __slots__ = ("tags", "parents", "marks", "texts", "breaks", "depths", "places")

    def __init__(self):
        self.tags, self.parents, self.marks, self.texts, self.breaks, self.depths, self.places = ["#root"], [0], [0], [""], [True], [0], [0]


def _marks(attributes: str) -> int:
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in value.lower()) or (name == "style" and "none" in value.lower()):
            found |= 1 << _GROUP["hidden"]
        elif name not in ("style", "aria-hidden"):
            for w in _TOKEN.findall(value.lower()):
                if w in _GROUP:
                    found |= 1 << _GROUP[w]
    return found


def parse(page: str | None) -> Page:
    """The page's tree. Raw text isn't in it."""
    out, page, at = Page(), page or "", 0
    tags, parents, marks, texts, breaks, depths, places = out.tags, out.parents, out.marks, out.texts, out.breaks, out.depths, out.places
    stack, names, children, parted = [0], ["#root"], [0], True  # open elements, their names and numbers of children so far

    def add(tag: str, text: str, mark: int) -> None:
        tags.append(tag)
        parents.append(stack[-1])
        marks.append(mark)
        texts.append(text)
        breaks.append(parted)
        depths.append(len(stack))
        places.append(children[-1])
        children[-1] += 1

    find = _TAG.search
    while at < len(page):
        m = find(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            raw = page[at:stop]
            add("#text", entities.unescape(raw) if "&" in raw else raw, 0)
            parted = False
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, rest = m[2].lower(), m[3]
        if not rest.endswith(">"):
            break  # cut off inside a tag
        inline, cut = tag in INLINE, 0
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if names[i] == tag:
                    cut = i
                    break
                if inline and names[i] not in INLINE:
                    break
        else:
            for i in range(len(stack) - 1, 0, -1):
                open_ = names[i]
                if tag in CLOSED_BY.get(open_, ()):
                    cut = i
                    break
                if open_ not in INLINE and open_ not in CLOSED_BY or tag in SCOPE.get(open_, ()):
                    break
        if cut:
            parted = parted or any(x not in INLINE for x in names[cut:])
            del stack[cut:], names[cut:], children[cut:]
        if m[1]:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        parted = parted or not inline
        add(tag, "", _marks(rest) if len(rest) > 1 else 0)
        if tag not in VOID and not rest.endswith("/>"):
            stack.append(len(tags) - 1)
            names.append(tag)
            children.append(0)
    return out


_PUNCT = str.maketrans("", "", ".,;:!?")


class Forest:
    """The nodes of several pages in one row of arrays, by depth."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tags) for p in pages], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.root = np.repeat(self.starts, sizes)
        self.parent = np.concatenate([np.array(p.parents, dtype=np.int64) for p in pages]) + self.root
        self.depth = np.concatenate([np.array(p.depths, dtype=np.int64) for p in pages])
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1])[1:]


def features(pages: list[Page], forest: Forest) -> np.ndarray:
    """One row for each node of the pages."""
    parent, levels = forest.parent, forest.levels
    n, other, text_tag, link_tag = len(parent), len(_TAGS), _TAG_INDEX["#text"], _TAG_INDEX["a"]
    tag = np.array([_TAG_INDEX.get(t, other) for p in pages for t in p.tags], dtype=np.int64)
    marks = np.concatenate([np.array(p.marks, dtype=np.int64) for p in pages])
    size = np.array([len(x) for p in pages for x in p.texts], dtype=np.float64)
    punct = np.array([len(x) - len(x.translate(_PUNCT)) if x else 0 for p in pages for x in p.texts], dtype=np.float64)
    place = np.concatenate([np.array(p.places, dtype=np.int64) for p in pages])
    own = np.bincount(parent, np.where(tag == text_tag, size, 0), n)
    bit = np.int64(1) << tag
    above, above_marks, in_link = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), tag == link_tag
    for level in levels:
        up = parent[level]
        above[level] = above[up] | bit[up]
        above_marks[level] = above_marks[up] | marks[up]
        in_link[level] |= in_link[up]
    totals = np.stack([size, punct, tag == link_tag, tag == _TAG_INDEX["p"], np.where(in_link, size, 0.0), np.ones(n)])
    below_marks = marks.copy()
    for level in reversed(levels):
        up = parent[level]
        for row in totals:
            row += np.bincount(up, row[level], n) if len(level) > n // 8 else 0
        if len(level) <= n // 8:
            np.add.at(totals.T, up, totals.T[level])
        np.bitwise_or.at(below_marks, up, below_marks[level])
    is_child = np.concatenate(levels) if levels else np.zeros(0, dtype=np.int64)
    count = np.bincount(parent[is_child], minlength=n)
    # brothers, in order of parent and place: the text of the one before and the one after
    by = is_child[np.lexsort((place[is_child], parent[is_child]))]
    before, after = np.zeros(n), np.zeros(n)
    if len(by) > 1:
        same = parent[by][1:] == parent[by][:-1]
        before[by[1:][same]] = totals[0, by[:-1][same]]
        after[by[:-1][same]] = totals[0, by[1:][same]]
    brothers = np.where(parent == np.arange(n), 0, count[parent])
    whole, t = np.maximum(totals[0, forest.root], 1.0), np.maximum(totals[0], 1.0)
    bits = lambda x, k: (x[:, None] >> np.arange(k) & 1).astype(np.float32)
    numbers = np.stack(
        [np.log1p(totals[0]), np.log1p(own), totals[0] / whole, totals[4] / t, totals[1] / t, np.log1p(totals[2]), np.log1p(totals[3]), np.log1p(totals[5]),
         forest.depth, place / np.maximum(brothers, 1), np.log1p(brothers), np.log1p(before), np.log1p(after), totals[0, parent] / whole],
        axis=1,
    )
    k = len(TOKENS)
    return np.concatenate([bits(bit, other), bits(above, other), bits(marks, k), bits(above_marks, k), bits(below_marks, k), numbers], axis=1).astype(np.float32)


# ---------------------------------------------------------------- boosted trees


class Boosted:
    """Complete trees of ``LEVELS`` levels for the logistic loss, split at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, rate: float = RATE):
        self.levels = levels
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(len(y), self.start)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**levels - 1, dtype=np.int64), np.full(2**levels - 1, np.inf, dtype=np.float32)
            for level in range(levels):
                first, width = 2**level - 1, 2**level
                gain, best = np.full(width, 1e-6), np.zeros((width, 2), dtype=np.int64)
                g_all, h_all = np.bincount(node, grad, width), np.bincount(node, hess, width)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = len(c) + 1
                    key = node * k + binned[:, f]
                    g, h = np.bincount(key, grad, width * k).reshape(width, k).cumsum(1)[:, :-1], np.bincount(key, hess, width * k).reshape(width, k).cumsum(1)[:, :-1]
                    got = g**2 / (h + 1) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + 1) - (g_all**2 / (h_all + 1))[:, None]
                    at = got.argmax(1)
                    better = got[np.arange(width), at] > gain
                    gain = np.where(better, got[np.arange(width), at], gain)
                    best[better] = np.stack([np.full(width, f), at], axis=1)[better]
                right = np.zeros(len(y), dtype=np.int64)
                for w in range(width):
                    if gain[w] > 1e-6:
                        f, at = best[w]
                        feature[first + w], cut[first + w] = f, cuts[f][at]
                        mine = node == w
                        right[mine] = binned[mine, f] > at
                node = 2 * node + right
            g, h = np.bincount(node, grad, 2**levels), np.bincount(node, hess, 2**levels)
            value = -rate * g / (h + 1)
            score += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.levels):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - (2**self.levels - 1)]
        return score


def decode(forest: Forest, odds: np.ndarray) -> np.ndarray:
    """The most probable labels in which a node has main text only if its parent has. ``odds``: natural log-odds."""
    best, parent = odds.copy(), forest.parent  # gain of keeping a subtree over dropping it whole
    for level in reversed(forest.levels):
        good = level[best[level] > 0]
        np.add.at(best, parent[good], best[good])
    keep = np.ones(len(odds), dtype=bool)
    for level in forest.levels:
        keep[level] = keep[parent[level]] & (best[level] > 0)
    return keep


def joined(page: Page, keep: list[bool]) -> str:
    """The kept runs of text; block elements and line breaks part them, inline elements don't."""
    out, parted = [], False
    for tag, text, cut, good in zip(page.tags, page.texts, page.breaks, keep):
        if tag == "#text":
            parted = parted or cut
            if good:
                out.append(f" {text}" if parted else text)
                parted = False
    return " ".join("".join(out).split())


# ---------------------------------------------------------------- generated pages


def _generated(rng: random.Random) -> str:
    """A page; main text is written between \\x02 and \\x03, which parse() leaves in the text."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvéäñ") for _ in range(rng.randint(1, 11)))

    def prose(a, b):
        w = [word() for _ in range(rng.randint(a, b))]
        for i in range(len(w)):
            r = rng.random()
            if r < 0.1:
                w[i] += rng.choice([".", ".", ",", "!", " |", "?"])
        return " ".join(w)

    def good(s):
        return f"\x02{s}\x03"

    def inline(s):
        r = rng.random()
        return f"<b>{s}</b>" if r < 0.1 else f"<em>{s}</em>" if r < 0.15 else f"<a href='/x'>{s}</a>" if r < 0.22 else f"<b>{s}" if r < 0.27 else s

    def name(*choices):
        return rng.choice([f' class="{rng.choice(choices)}"', f' id="{rng.choice(choices)}"', f" class='x1 {rng.choice(choices)}-box'", f' class="{rng.choice(choices)} wide"'])

    def links(k):
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a>{"</li>" if rng.random() < 0.9 else ""}' for _ in range(k)) + "</ul>"

    def sort_of(tag, *names):
        return (f"<{tag}{name(*names) if rng.random() < 0.5 else ''}>", f"</{tag}>") if rng.random() < 0.7 else (f"<div{name(*names)}>", "</div>")

    def menu():
        a, b = sort_of("nav", "nav", "menu", "navigation", "breadcrumb")
        return a + links(rng.randint(2, 10)) + b

    def head():
        a, b = sort_of("header", "header", "masthead", "banner", "topbar")
        return a + rng.choice([f"<h1>{prose(1, 4)}</h1>", f"<p>{prose(2, 12)}</p>", links(4), prose(2, 8)]) + (menu() if rng.random() < 0.3 else "") + b

    def foot():
        a, b = sort_of("footer", "footer", "copyright", "legal")
        return a + rng.choice([f"&copy; {word()}.example &middot; {prose(1, 25)}", links(5), f"<p>{prose(3, 30)}</p>"]) + (b if rng.random() < 0.85 else "")

    def side():
        a, b = sort_of("aside", "sidebar", "widget", "related", "recommended", "rail")
        return a + rng.choice([f"<h3>{prose(1, 3)}</h3>" + links(rng.randint(2, 6)), f"<p>{prose(3, 50)}</p>", prose(2, 30)]) + b

    def advert():
        return rng.choice([f"<div{name('ad', 'ads', 'advert', 'sponsored', 'promo')}>{prose(2, 30)}</div>", f"<div{name('ad', 'advertisement')}><p>{prose(3, 40)}</p><a href='#'>{prose(1, 3)}</a></div>"])

    def notice():
        return rng.choice([f"<div{name('cookie', 'cookies', 'consent', 'notice', 'alert', 'popup', 'modal')}>{rng.choice(['', '<p>'])}{prose(4, 40)}<button>{word()}</button></div>", f'<div role="alert">{prose(4, 30)}</div>', f"<dialog>{prose(4, 30)}</dialog>"])

    def form():
        return rng.choice([f"<form{rng.choice(['', name('search', 'newsletter', 'login', 'subscribe')])}><label>{prose(1, 5)}</label><input name=q><button>{word()}</button></form>", f"<div{name('newsletter', 'subscribe', 'signup')}><p>{prose(3, 20)}</p><form><input><select><option>{word()}<option>{word()}</select></form></div>"])

    def reply():
        one = lambda: rng.choice([f"<div{name('comment', 'reply')}><b>{word()}</b><p>{prose(3, 60)}</p></div>", f"<li><p>{prose(3, 60)}</p></li>", f"<article{name('comment', 'reply')}><p>{prose(3, 60)}</p></article>", f"<p>{prose(3, 60)}</p>"])
        a, b = (f"<section{name('comments', 'comment-list', 'discussion', 'replies', 'respond')}>", "</section>") if rng.random() < 0.5 else (f"<div{name('comments', 'discussion', 'disqus', 'commentlist')}>", "</div>")
        return a + (f"<h2>{prose(1, 3)}</h2>" if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 5))) + b

    def share():
        return f"<div{name('share', 'social', 'tags', 'byline')}>{rng.choice([links(3), prose(1, 6)])}</div>"

    def block():
        r = rng.random()
        if r < 0.74:
            parts = inline(good(prose(1, rng.choice([4, 20, 160])))) + (f"<br>{good(prose(1, 20))}" if rng.random() < 0.2 else "") + (inline(good(" " + prose(1, 9))) if rng.random() < 0.3 else "")
            return f"<p{rng.choice(['', '', '', name('text', 'lead')])}>{parts}" + ("</p>" if rng.random() < 0.85 else "")
        if r < 0.82:
            return f"<h2>{good(prose(1, 8))}</h2>"
        if r < 0.89:
            return "<ul>" + "".join(f"<li>{inline(good(prose(1, 18)))}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if r < 0.93:
            return f"<blockquote><p>{good(prose(3, 40))}</p></blockquote>"
        if r < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{good(prose(1, 4))}</td>" for _ in range(3)) for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<div>{good(prose(2, 40))}</div>"

    body = ([f"<h1>{good(prose(1, 14))}</h1>"] if rng.random() < 0.85 else []) + [block() for _ in range(rng.choice([0, 1, 3, 8, 14, 25]))]
    for extra, often in ((advert, 0.25), (share, 0.25), (form, 0.15), (side, 0.12), (notice, 0.1)):
        if rng.random() < often:
            body.insert(rng.randint(0, len(body)), extra())
    if rng.random() < 0.2:
        body.append(reply())
    a, b = rng.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>")] * 2 + [("<main><article>", "</article></main>"), (f"<div{name('content', 'article', 'post', 'entry', 'story')}>", "</div>"), ("<div id=main><div class=post>", "</div></div>"), (f"<article{name('post', 'entry')}><div>", "</div></article>"), ("<section class=content>", "</section>")])
    middle = a + "".join(body) + (b if rng.random() < 0.92 else "")
    before = [f() for f, often in ((head, 0.4), (menu, 0.8), (notice, 0.3), (advert, 0.5), (form, 0.2)) if rng.random() < often]
    after = [f() for f, often in ((reply, 0.35), (side, 0.4), (advert, 0.3), (form, 0.2), (notice, 0.15), (foot, 0.85)) if rng.random() < often]
    rng.shuffle(before)
    wrap = rng.choice([("", "")] * 3 + [('<div class="page">', "</div>"), ('<div id="wrapper"><div class="container">', "</div></div>")])
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{prose(1, 9)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{wrap[0]}{''.join(before)}<!-- {word()} -->{middle}{''.join(after)}{wrap[1]}</body></html>"


def train(pages: int = PAGES, seed: int = SEED) -> Boosted:
    rng = random.Random(seed)
    made = [parse(_generated(rng)) for _ in range(pages)]
    forest = Forest(made)
    y = np.array(["\x02" in x for p in made for x in p.texts], dtype=np.float64)
    for p in made:
        p.texts = [x.replace("\x02", "").replace("\x03", "") for x in p.texts]
    for level in reversed(forest.levels):
        np.maximum.at(y, forest.parent[level], y[level])
    return Boosted(features(made, forest), y)


_model: list[Boosted] = []


def model() -> Boosted:
    """Trained once for each driver."""
    if not _model:
        _model.append(train())
    return _model[0]


def main_texts(pages: list[str | None], trees: Boosted) -> list[str]:
    parsed = [parse(x) for x in pages]
    if not parsed:
        return []
    forest = Forest(parsed)
    keep = decode(forest, trees.log_odds(features(parsed, forest))).tolist()
    return [joined(p, keep[a : a + len(p.tags)]) for p, a in zip(parsed, forest.starts.tolist())]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    common.small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model())

    def run(it):
        for batch in common.batches(it, 64, 2 << 20):
            texts = main_texts(batch.column("html").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(common.tidy(run), "page_id long, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
