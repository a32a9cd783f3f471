"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with the
element that it lies in.  Every block is described by its ancestors (tags, words of class and
id, sections, repeated siblings, forms, names that mark noise in the labelled pages, whether the page has an article elsewhere) and its text (length, share of links, end mark).  The field labels the whole
sequence as main text or not; it is trained by gradient ascent on the likelihood of labelled
pages and decoded by Viterbi.

Reading and scoring take time and memory in proportion to the page: blocks share their elements, and an element holds what it adds to its parent.

The labelled pages are made here, from layouts with a known answer; part of them name their elements with words that are met nowhere else.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released

#: Elements whose content is never text of the page.
RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object", "canvas", "math", "textarea", "select", "button"}
#: Those of them that run to the end of the page if they are not closed, and those that may be closed in their own tag.
TO_THE_END = {"script", "style", "textarea"}
FOREIGN = {"svg", "math"}
#: Elements that may stand in a head; any other start tag ends it.
HEAD = {"html", "head", "title", "base", "link", "meta", "basefont", "bgsound", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Start tags that end an open element of the second kind, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
SECTIONS = {"article", "main", "nav", "aside", "header", "footer", "form", "section", "dialog", "body"}
#: Elements that make what is around them look like a form.
CONTROLS = {"form", "input", "textarea", "select", "button", "fieldset", "label"}
_OTHER = r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)"
#: A tag, its attributes with quoted values; else a comment, declaration or instruction.  From where a quote is not closed on, a tag ends at the first ``>``.
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|{_OTHER}|(<)(?=/?[a-zA-Z])""", re.S)
_LOOSE = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|{_OTHER}""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block-level element: its parent, and the features that it adds to those of its ancestors."""

    __slots__ = ("parent", "tag", "names", "fresh", "section", "again", "form", "article", "head", "known")

    def __init__(self, parent: Node | None, tag: str, names: str, fresh: tuple[str, ...], section: str, article: bool):
        self.parent, self.tag, self.names, self.fresh, self.section, self.article = parent, tag, names, fresh, section, article
        self.head = tag in ("head", "title") or parent is not None and parent.head
        self.again = self.form = False  # has a sibling of the same names; has a form, or something of one, in or beside it
        self.known: tuple[float, bool, bool, bool] | None = None


Block = tuple[Node, str, int]


@lru_cache(maxsize=1 << 16)
def _element_features(tag: str, names: str, inside: frozenset[str]) -> tuple[str, ...]:
    return tuple({f"tag {tag}", *(f"{tag} in {outer}" for outer in inside), *(f"name {w}" for w in _WORD.findall(names))})


class _Reader:
    """The open elements while a page is read."""

    def __init__(self) -> None:
        self.root = Node(None, "", "", ("any",), "none", False)
        self.tags: list[str] = []
        self.nodes: list[Node | None] = []  # None for inline elements
        self.own: list[tuple[str, ...]] = []
        self.where: dict[str, list[int]] = defaultdict(list)  # places of the open elements by tag
        self.blocks: list[int] = []  # places of the open block-level elements
        self.child: list[Node | None] = [None]  # the last child of the root and of each of those
        self.open: Counter[str] = Counter()  # features of the open elements
        self.sections: Counter[str] = Counter()
        self.inside: frozenset[str] = frozenset()
        self.node = self.root

    def push(self, tag: str, names: str) -> None:
        self.where[tag].append(len(self.tags))
        self.tags.append(tag)
        if tag in INLINE:
            self.nodes.append(None)
            self.own.append(())
            return
        own = _element_features(tag, names, self.inside)
        fresh = tuple(f for f in own if not self.open[f])
        self.open.update(own)
        node = Node(self.node, tag, names, fresh, tag if tag in SECTIONS else self.node.section, self.node.article or tag in ("article", "main"))
        before = self.child[-1]
        if names and before is not None and (before.tag, before.names) == (tag, names):
            before.again = node.again = True
        self.child[-1] = node
        self.child.append(None)
        self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.own.append(own)
        self.node = node
        if tag in SECTIONS:
            self.sections[tag] += 1
            self.inside |= {tag}

    def close(self, k: int) -> None:
        """End the open elements from place ``k`` on."""
        while len(self.tags) > k:
            tag, node, own = self.tags.pop(), self.nodes.pop(), self.own.pop()
            self.where[tag].pop()
            if node is None:
                continue
            self.open.subtract(own)
            self.blocks.pop()
            self.child.pop()
            self.node = node.parent
            if tag in SECTIONS:
                self.sections[tag] -= 1
                if not self.sections[tag]:
                    self.inside -= {tag}

    def last(self, tags: set[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags, -1 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def control(self) -> None:
        """Mark the elements near a part of a form, up to the section that they are in."""
        node = self.node
        for _ in range(3):
            if node.parent is None or node.tag in SECTIONS - {"form", "section", "aside"} or node.form:
                return
            node.form, node = True, node.parent


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order: the element they lie in, text, characters inside links."""
    out: list[Block] = []
    open_ = _Reader()
    ends: dict[str, int] = {}  # where the next end tag of an element without text stands
    pattern = _TAG
    parts: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((open_.node, text, linked))
            parts, linked = [], 0

    while at < n:
        m = pattern.search(page, at)
        if m and pattern is _TAG and m[4]:  # its quotes are not closed, nor will those of later tags be
            pattern = _LOOSE
            m = pattern.search(page, at)
        end = m.start() if m else n
        if end > at:
            piece = page[at:end]
            if open_.tags and open_.tags[-1] == "head" and not piece.isspace():
                flush()
                open_.close(len(open_.tags) - 1)
            parts.append(piece)
            if open_.where.get("a"):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in CONTROLS and not closing and tag != "form":
            open_.control()
        if tag in RAW:
            if not closing and not (tag in FOREIGN and attributes.rstrip().endswith("/")):
                if ends.get(tag, -1) < at:
                    ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                    ends[tag] = ended.start() if ended else n
                if ends[tag] < n:
                    after = page.find(">", ends[tag])
                    at = after + 1 if after >= 0 else n
                elif tag in TO_THE_END:
                    at = n
            continue
        if not closing and tag not in HEAD and "head" in open_.tags[:2]:  # a head whose end tag is left out
            flush()
            open_.close(open_.tags.index("head"))
        inline = tag in INLINE
        if tag == "br" or tag == "img":
            parts.append(" ")
            continue
        if not inline:
            flush()
        if closing:
            k = open_.last((tag,))
            if k >= 0 and not (inline and open_.blocks and open_.blocks[-1] > k):
                open_.close(k)
            continue
        if tag in VOID:
            continue
        if not inline:
            if tag in IMPLIED:
                k = open_.last(IMPLIED[tag][0])
                if k > open_.last(IMPLIED[tag][1]):
                    open_.close(k)
            elif open_.blocks:  # a block ends an open paragraph or heading
                own = open_.node.tag
                if own == "p" or (tag[0] == "h" and tag[1:].isdigit() and own[0] == "h" and own[1:].isdigit()):
                    open_.close(open_.blocks[-1])
        names = ""
        if attributes:
            names = " ".join(w.strip("\"'").lower() for w in _NAMES.findall(attributes))
            if _HIDDEN.search(attributes):
                names += " hidden"
            if inline and attributes.rstrip().endswith("/"):
                continue
        open_.push(tag, names)
        if tag == "form":
            open_.control()
    flush()
    return out


#: Names that layouts give to what is not the article, by kind, and to what is.
NAMES = {
    "nav": ["menu", "nav", "navigation", "navbar", "breadcrumb", "topnav", "site-nav", "tabs", "pagination", "toc"],
    "header": ["header", "masthead", "site-header", "page-header", "top-bar", "branding", "logo"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "legal", "bottom", "colophon"],
    "aside": ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more-stories", "author-box", "tags", "share", "social"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "banner", "promo", "sponsored", "sponsor", "adsense"],
    "notice": ["notice", "cookie", "cookies", "cookie-notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "warning"],
    "form": ["form", "login", "search", "signup", "contact-form", "search-form", "subscribe"],
    "comments": ["comments", "comment", "comment-list", "responses", "discussion", "replies", "disqus", "reader-comments"],
    "main": ["content", "article", "post", "entry", "story", "article-body", "post-content", "main", "text", "body", "entry-content", "page"],
}
def _last_features(tag: str, section: str, again: bool, form: bool, noisy: bool, beside: bool) -> list[str]:
    """What the innermost element says: those features are not handed down."""
    how = "noisy" if noisy else "clean"
    out = [f"section {section}, {how}", f"own {tag}, {how}", f"own {tag} in {section}"]
    if again:
        out += ["repeated", f"repeated in {section}"]
    if form:
        out.append("with a form")
    if beside:
        out.append("beside the article")
    return out


def path_features(node: Node, elsewhere: bool, noise: frozenset[str]) -> list[str]:
    """What a block's element and its ancestors say of it; ``elsewhere``: the page has an article; ``noise``: words of names that mark what is not main text."""
    out, own, again, form, noisy = [], node, False, False, False
    while node is not None:
        out += node.fresh
        again |= node.again
        form |= node.form
        noisy |= any(w in noise for w in _WORD.findall(node.names))
        node = node.parent
    return sorted([*out, *_last_features(own.tag, own.section, again, form, noisy, elsewhere and not own.article)])


def noise_words(pages: list[tuple[list[Block], list[bool]]]) -> frozenset[str]:
    """The words of names under which labelled pages hardly have main text."""
    under: Counter[str] = Counter()
    main: Counter[str] = Counter()
    for blocks, answer in pages:
        for (node, _, _), y in zip(blocks, answer, strict=True):
            words: set[str] = set()
            while node is not None:
                words.update(_WORD.findall(node.names))
                node = node.parent
            under.update(words)
            if y:
                main.update(words)
    return frozenset(w for w, n in under.items() if n >= LEAST_BLOCKS and main[w] <= NOISE_SHARE * n)


def has_article(blocks: list[Block]) -> bool:
    return any(node.article for node, _, _ in blocks)


def text_features(text: str, linked: int) -> list[str]:
    """What a block's text says of it."""
    words = text.count(" ") + 1
    share = min(1.0, linked / max(1, len(text)))
    return [f"words {min(7, words.bit_length())}", f"links {math.ceil(4 * share)}", f"ends {text[-1] in '.!?:;,'}"]


#: A word of a name marks noise if so many blocks of the labelled pages lie under it, and at most this share of them is main text.
LEAST_BLOCKS, NOISE_SHARE = 20, 0.05


class Field:
    """Weights of features for main text against the rest, and of neighbouring labels."""

    def __init__(self, weights: dict[str, float], first: np.ndarray, change: np.ndarray, noise: frozenset[str]):
        self.weights, self.first, self.change, self.noise = weights, first.tolist(), change.tolist(), noise
        self.memo: dict[tuple, float] = {}

    def handed_down(self, node: Node) -> tuple[float, bool, bool, bool]:
        """The score of what an element and its ancestors have together, and their marks; each element is looked at once."""
        chain = []
        while node is not None and node.known is None:
            chain.append(node)
            node = node.parent
        known = node.known if node is not None else (0.0, False, False, False)
        for own in reversed(chain):
            both = self.memo.get((own.fresh, own.names))
            if both is None:
                if len(self.memo) >= 200_000:
                    self.memo.clear()
                both = self.memo[own.fresh, own.names] = (sum(self.weights.get(f, 0.0) for f in own.fresh), any(w in self.noise for w in _WORD.findall(own.names)))
            known = own.known = (known[0] + both[0], known[1] or own.again, known[2] or own.form, known[3] or both[1])
        return known

    def score(self, node: Node, text: str, linked: int, elsewhere: bool) -> float:
        base, *marks = self.handed_down(node)
        key = (node.tag, node.section, *marks, elsewhere and not node.article)
        last = self.memo.get(key)
        if last is None:
            last = self.memo[key] = sum(self.weights.get(f, 0.0) for f in _last_features(*key))
        return base + last + sum(self.weights.get(f, 0.0) for f in text_features(text, linked))

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        elsewhere = has_article(blocks)
        (stay0, to1), (to0, stay1) = self.change
        back: list[tuple[bool, bool]] = []
        a = b = 0.0
        for k, block in enumerate(blocks):
            s = self.score(*block, elsewhere)
            if not k:
                a, b = self.first[0], self.first[1] + s
                continue
            from0, from1 = (a + stay0, b + to0), (a + to1, b + stay1)
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            a, b = max(from0), max(from1) + s
        label = b > a
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 120, decay: float = 1e-4) -> Field:
    """Fit the field to labelled block sequences: Adagrad on the mean log-likelihood, gradients by forward-backward over all pages at once."""
    index: dict[str, int] = {}
    noise = noise_words(pages)
    rows, columns, starts, labels = [], [], [], []
    n = 0
    for blocks, answer in pages:
        if not blocks:
            continue
        starts.append(n)
        elsewhere = has_article(blocks)
        for block, y in zip(blocks, answer, strict=True):
            for f in {*path_features(block[0], elsewhere, noise), *text_features(*block[1:])}:
                rows.append(n)
                columns.append(index.setdefault(f, len(index)))
            labels.append(y)
            n += 1
    row, column, y = np.array(rows), np.array(columns), np.array(labels, int)
    starts = np.array(starts)
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths)
    starts, lengths = starts[order], lengths[order]
    w, first, change = np.zeros(len(index)), np.zeros(2), np.zeros((2, 2))
    past = [np.full_like(x, 1e-8) for x in (w, first, change)]
    inner = np.setdiff1d(np.arange(n), starts)
    seen = np.bincount(column, y[row], len(index))
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[inner - 1], y[inner]), 1)
    opening = np.bincount(y[starts], minlength=2)
    for _ in range(rounds):
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(row, w[column], n)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[starts] = local[starts] + first
        longest = int(lengths.max())
        live = [starts[lengths > t] + t for t in range(longest)]
        for t in range(1, longest):
            i = live[t]
            alpha[i] = np.logaddexp(alpha[i - 1, :1] + change[0], alpha[i - 1, 1:] + change[1]) + local[i]
        for t in range(longest - 1, 0, -1):
            i = live[t]
            ahead = beta[i] + local[i]
            beta[i - 1] = np.logaddexp(ahead[:, :1] + change[:, 0], ahead[:, 1:] + change[:, 1])
        whole = np.logaddexp(*(alpha + beta).T)
        mean = np.exp(alpha + beta - whole[:, None])
        joint = alpha[inner - 1][:, :, None] + change + (local + beta)[inner][:, None, :]
        joint = np.exp(joint - whole[inner][:, None, None]).sum(axis=0)
        steps = (seen - np.bincount(column, mean[row, 1], len(index))) / len(starts) - decay * w, (opening - mean[starts].sum(axis=0)) / len(starts), (pairs - joint) / len(starts) - decay * change
        for x, g, p in zip((w, first, change), steps, past, strict=True):
            p += g * g
            x += 0.5 * g / np.sqrt(p)
    return Field({f: float(w[k]) for f, k in index.items()}, first, change, noise)


def labelled_page(seed: int, strange: bool | None = None) -> tuple[str, list[str]]:
    """A made page and the blocks of its main text; ``strange``: its elements have names that say nothing (by chance if None)."""
    r = random.Random(seed)
    strange = r.random() < 0.4 if strange is None else strange
    marks = ["", "", "", ".", ".", ",", "!!", "%%%", " |", " &amp;", "***"]

    def word() -> str:
        return "".join(r.choice(["the", "an", "er", "in", "ou", "ti", "es", "on", "re", "st", "ha", "la", "é", "ö", "ch"]) for _ in range(r.randint(1, 4)))

    def line(lo: int = 1, hi: int = 40) -> str:
        words = [word() + r.choice(marks) for _ in range(r.randint(lo, hi))]
        if r.random() < 0.08:
            words = [w.upper() for w in words]
        if r.random() < 0.08:
            words[0] = r.choice(["Copyright", "&copy; 2020", "License:", "Subscribe", "Comments", "Share", "Advertisement", "http://x.example.com/", "user@example.com"])
        return " ".join(words).strip() + r.choice(["", ".", ".", "."])

    def named(kind: str) -> str:
        how = r.random()
        name = r.choice(NAMES[kind]) if kind in ("ad", "notice", "form") or not strange else word() + word()
        return f' class="{name}"' if how < 0.6 else f' id="{name}"' if how < 0.8 else f' class="{name} {word()}"'

    def listing(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' if r.random() < 0.9 else f"<li>{line(1, 3)}</li>" for _ in range(n)) + "</ul>"

    def para() -> str:
        text = line(1, r.choice([3, 15, 60]))
        if r.random() < 0.2:
            text = f"<b>{text}<br>" if r.random() < 0.5 else f"<b>{text}</b>"
        elif r.random() < 0.15:
            text += f' <a href="/x">{word()}</a> {line(1, 5)}'
        return f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}"

    def noise(kind: str) -> str:
        body = "".join(r.choice([para, lambda: f"<div>{line(1, 12)}</div>", lambda: line(1, 12)])() for _ in range(r.randint(1, 3)))
        if kind == "nav":
            return f"<nav{named('nav') if r.random() < 0.4 else ''}>{listing(r.randint(3, 12))}</nav>" if r.random() < 0.6 else f"<div{named('nav')}>{listing(r.randint(3, 12))}</div>"
        if kind == "form":
            inside = f'<label>{line(1, 3)}</label><input name="q"><button>{line(1, 2)}</button>' + (f"<p>{line(1, 10)}</p>" if r.random() < 0.4 else "")
            return f"<form{named('form') if r.random() < 0.5 else ''}>{inside}</form>"
        if kind == "comments":
            each = "".join(r.choice([f'<div class="comment">{para()}</div>', f'<li class="comment">{para()}</li>', f'<article class="comment">{para()}</article>', para()]) for _ in range(r.randint(1, 6)))
            head = f"<h{r.randint(2, 4)}>{line(1, 3)}</h2>" if r.random() < 0.6 else ""
            if strange:
                t, one = r.choice(["div", "li", "section"]), f' class="{word()}"'
                each = "".join(f"<{t}{one}><p>{line(1, 3)}</p>{para()}<button>{line(1, 1)}</button></{t}>" for _ in range(r.randint(1, 6)))
            if strange or r.random() < 0.4:
                each += f"<form><label>{line(1, 2)}</label><textarea></textarea><button>{line(1, 2)}</button></form>"
            return f"<{(t := r.choice(['section', 'div', 'ol', 'aside']))}{named('comments')}>{head}{each}</{t}>"
        if kind in ("ad", "notice"):
            tag = r.choice(["div", "div", "div", "section", "aside", "p"])
            return f"<{tag}{named(kind)}>{body if tag != 'p' else line(1, 12)}</{tag}>"
        tag = kind if r.random() < 0.6 else "div"
        names = named(kind) if tag == "div" or r.random() < 0.4 else ""
        return f"<{tag}{names}>{r.choice([body, listing(r.randint(2, 6)), body + listing(3)])}</{tag}>"

    answer: list[str] = []

    def kept(source: str) -> str:
        answer.extend(text for _, text, _ in blocks_of(source))
        return source

    def article() -> str:
        out = []
        if r.random() < 0.85:
            title = kept(f"<h1>{line(3, 10)}</h1>")
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.randint(1, 14)):
            roll = r.random()
            if roll < 0.75:
                out.append(kept(para()))
            elif roll < 0.8:
                out.append(kept(f"<h{r.randint(2, 4)}>{line(1, 6)}</h2>"))
            elif roll < 0.83:
                out.append(kept("<ul>" + "".join(f"<li>{line(1, 20)}</li>" for _ in range(r.randint(1, 4))) + "</ul>"))
            elif roll < 0.86:
                out.append(kept(f"<{(t := r.choice(['blockquote', 'pre', 'div', 'section']))}>{line(2, 30)}</{t}>"))
            elif roll < 0.87:
                out.append(f"<button>{line(1, 3)}</button>")
            elif roll < 0.89:
                out.append(kept(f"<table><tr><td>{line(1, 4)}<td>{line(1, 4)}</table>"))
            else:
                out.append(noise(r.choice(["ad", "ad", "aside", "form", "notice", "nav"])))
        if r.random() < 0.25:
            out.append(noise("comments"))
        if r.random() < 0.1:
            out.append(noise("footer"))
        return "".join(out)

    how = 0.84 * r.random() if strange else r.random()
    if how < 0.6:
        main = ("<article>", "</article>")
    elif how < 0.7:
        main = (f"<article{named('main')}>", "</article>")
    elif how < 0.85:
        main = (f"<main{named('main') if r.random() < 0.5 else ''}>" + r.choice(["", "<article>"]), "</main>")
    else:
        main = (f"<div{named('main')}>", "</div>")
    before = [noise(k) for k in ("header", "nav", "notice", "ad", "aside") if r.random() < 0.45]
    after = [noise(k) for k in ("comments", "aside", "ad", "form", "notice", "footer") if r.random() < 0.35]
    r.shuffle(before)
    inner = main[0] + article() + main[1]
    if r.random() < 0.3:
        inner = f'<div class="{r.choice(["wrapper", "container", "layout", "row", "page-wrap"])}">{inner}</div>'
    page = f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title><script>var t='</p>';</script></head><body>" + "".join(before) + "<!-- x -->" + inner + "".join(after) + "</body></html>"
    return page, answer


def labels_for(blocks: list[Block], answer: list[str]) -> list[bool]:
    """Mark the blocks that spell the answer, in order."""
    out, k = [], 0
    for _, text, _ in blocks:
        hit = k < len(answer) and text == answer[k]
        out.append(hit)
        k += hit
    if k != len(answer):
        raise ValueError("the answer's blocks do not all stand in the page")
    return out


def body_blocks(page: str) -> list[Block]:
    """The blocks of a page outside its head."""
    return [b for b in blocks_of(page) if not b[0].head]


@lru_cache(maxsize=1)
def trained(pages: int = 1500) -> Field:
    """The field trained on ``pages`` labelled pages; the same one each time."""
    data = []
    for seed in range(pages):
        page, answer = labelled_page(seed)
        blocks = body_blocks(page)
        data.append((blocks, labels_for(blocks, answer)))
    return train(data)


def main_text(page: str | None, field: Field) -> str:
    """The main text of one page, one line per block; empty if there is none."""
    blocks = body_blocks(page or "")
    return "\n".join(text for (_, text, _), main in zip(blocks, field.decode(blocks), strict=True) if main)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A null html counts as empty and gives an empty text; null ids and urls are returned as they are; repeated rows are each returned; whole pages are
    used, whatever their length; further columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    field = trained()
    sent = pages.sparkSession.sparkContext.broadcast((field.weights, np.array(field.first), np.array(field.change), field.noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for batch in batches:
            texts = [main_text(p, own) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(released(run), "page_id long, url string, text string, n_chars long")
