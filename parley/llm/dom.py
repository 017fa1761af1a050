"""A small forgiving HTML reader: elements in page order, their texts, and numbers about them."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "xmp")}
_ATTRS = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style|data-main)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# HTML's own element lists (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"html", "head", "body", "title", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "select"}
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}

#: Groups of tags that are features of their own, and words of class names, ids and roles, as
#: public naming habits go (fixed values).
TAG_GROUPS = (
    ("article", "main"), ("section",), ("div",), ("p",), ("h1", "h2"), ("h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"),
    ("a",), ("nav",), ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset", "input", "button", "select", "option", "textarea", "label", "legend"),
    ("table", "tbody", "thead", "tr", "td", "th"), ("blockquote", "pre", "code", "figure", "figcaption"), ("head", "title", "meta"),
    ("script", "style", "noscript", "iframe", "template"))
WORDS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar skip skiplink toc",
    "head": "header masthead topbar banner logo brand site",
    "foot": "footer bottom copyright legal colophon imprint",
    "side": "sidebar aside rail widget widgets complementary related recommended popular trending more",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion dfp adsense outbrain taboola banner",
    "note": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog paywall newsletter subscribe subscription signup",
    "talk": "comment comments commentlist reply replies respond disqus discussion reader readers feedback",
    "form": "form search login input register contact",
    "share": "share sharing social follow tweet facebook like rating tags tag byline author meta",
    "main": "article content main post entry story body text page hentry prose",
}
GROUP_OF = {w: k for k, ws in enumerate(WORDS.values()) for w in ws.split()}
N_TAGS, N_WORDS = len(TAG_GROUPS), len(WORDS)
_TAG_GROUP = {t: k for k, ts in enumerate(TAG_GROUPS) for t in ts}


class Page(NamedTuple):
    """Elements in page order: parent, end of the subtree, tag, word groups, hidden, label; texts as (element, starts a block, text)."""

    parent: list[int]
    end: list[int]
    tag: list[str]
    words: list[list[int]]
    hidden: list[bool]
    label: list[bool]
    texts: list[tuple[int, bool, str]]


def parse(source: str) -> Page:
    """Read any string as a page. Element 0 is the page itself. Unclosed and stray tags are mended as browsers do."""
    page = Page([-1], [0], ["#page"], [[]], [False], [False], [])
    stack, open_ = [0], {"#page": 1}
    fresh, at, n = True, 0, len(source)

    def pop_to(depth: int) -> None:
        nonlocal fresh
        while len(stack) > depth:
            i = stack.pop()
            page.end[i] = len(page.tag)
            open_[page.tag[i]] -= 1
            fresh |= page.tag[i] in BLOCK

    def nearest(tags: tuple[str, ...], stops: tuple[str, ...]) -> int:
        """Depth of the outermost of ``tags`` above the last of ``stops``; -1 if there is none."""
        found = -1
        if any(open_.get(t) for t in tags):
            for d in range(len(stack) - 1, 0, -1):
                tag = page.tag[stack[d]]
                if tag in stops:
                    break
                if tag in tags:
                    found = d
        return found

    def text(upto: int) -> None:
        nonlocal fresh
        if upto > at and not (chunk := source[at:upto]).isspace():
            page.texts.append((stack[-1], fresh, html.unescape(chunk) if "&" in chunk else chunk))
            fresh = False
        elif upto > at and page.texts and not fresh:
            page.texts.append((stack[-1], False, " "))

    while m := _TOKEN.search(source, at):
        text(m.start())
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if open_.get(tag):
                d = len(stack) - 1
                while page.tag[stack[d]] != tag:
                    d -= 1
                pop_to(d)
            fresh |= tag in BLOCK
            continue
        if tag in CLOSES_P and open_.get("p") and (d := nearest(("p",), ("td", "th", "button", "caption"))) >= 0:
            pop_to(d)
        if tag in CLOSED_BY and (d := nearest(*CLOSED_BY[tag])) >= 0:
            pop_to(d)
        if tag == "br":
            if not fresh:
                page.texts.append((stack[-1], False, " "))
            continue
        i = len(page.tag)
        words, hidden, label = [], False, False
        if m["attrs"] and len(m["attrs"]) > 3:
            for name, a, b, c in _ATTRS.findall(m["attrs"]):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    words += [g for w in _TOKENS.findall(value) if (g := GROUP_OF.get(w.lower())) is not None]
                elif name == "hidden" or (name == "style" and _HIDDEN.search(value)):
                    hidden = True
                elif name == "data-main":
                    label = True
        page.parent.append(stack[-1]), page.end.append(i + 1), page.tag.append(tag)
        page.words.append(words), page.hidden.append(hidden), page.label.append(label)
        fresh |= tag in BLOCK
        if tag in VOID:
            continue
        if tag in _RAW_END:
            close = _RAW_END[tag].search(source, at)
            stop = close.start() if close else n
            if tag == "title":
                stack.append(i), open_.__setitem__(tag, open_.get(tag, 0) + 1)
                text(stop)
                pop_to(len(stack) - 1)
            at = source.find(">", stop) + 1 if close else n
            at = at or n
            continue
        stack.append(i)
        open_[tag] = open_.get(tag, 0) + 1
    text(n)
    pop_to(1)
    page.end[0] = len(page.tag)
    return page


N_FEATURES = 18 + 2 * N_TAGS + 2 * N_WORDS


def features(page: Page) -> np.ndarray:
    """A row per element: its tag and words, those of its ancestors, its subtree's texts, and its siblings."""
    n = len(page.tag)
    parent, end = np.array(page.parent), np.array(page.end)
    own = np.zeros((n, 6))  # letters, letters in links, sentence marks, texts, links, fields
    group = np.fromiter((_TAG_GROUP.get(t, -1) for t in page.tag), np.int64, n)
    linked = np.zeros(n, bool)
    above = np.zeros((n, N_WORDS + N_TAGS), np.float32)
    word = np.zeros((n, N_WORDS), np.float32)
    tags = np.zeros((n, N_TAGS), np.float32)
    tags[np.flatnonzero(group >= 0), group[group >= 0]] = 1
    depth = np.zeros(n)
    for i in range(1, n):
        p = page.parent[i]
        for g in page.words[i]:
            word[i, g] = 1
        above[i, :N_WORDS] = np.maximum(above[p, :N_WORDS], word[p])
        above[i, N_WORDS:] = np.maximum(above[p, N_WORDS:], tags[p])
        depth[i] = depth[p] + 1
        linked[i] = linked[p] or page.tag[i] == "a"
    for i, _, text in page.texts:
        size = len(text)
        own[i, 0] += size
        own[i, 1] += size if linked[i] else 0
        own[i, 2] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
        own[i, 3] += size > 1
    own[:, 4] = group == _TAG_GROUP["a"]
    own[:, 5] = group == _TAG_GROUP["form"]
    total = np.concatenate([np.zeros((1, 6)), own.cumsum(0)])
    sub = total[end] - total[np.arange(n)]
    hidden = np.array(page.hidden, float)
    siblings = np.bincount(np.maximum(parent, 0), minlength=n) - (np.arange(n) == 0)
    by_parent = np.zeros(n)
    np.add.at(by_parent, np.maximum(parent[1:], 0), sub[1:, 0])
    p = np.maximum(parent, 0)
    n_sib = np.maximum(1, siblings[p])
    same = np.zeros(n)
    keys = p * 64 + group + 1
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    same[:] = count[inverse]
    before = np.r_[0.0, sub[:-1, 0]]
    whole = max(1.0, sub[0, 0])
    tags_in = end - np.arange(n)
    letters = np.maximum(1.0, sub[:, 0])
    numbers = np.stack([
        np.minimum(depth, 20), np.log1p(sub[:, 0]), sub[:, 1] / letters, sub[:, 2] / letters * 50, np.log1p(tags_in), np.log1p(sub[:, 0] / tags_in),
        sub[:, 0] / whole, total[:-1, 0] / whole, np.log1p(sub[:, 4]), np.log1p(sub[:, 5]), np.log1p(own[:, 0]), hidden, np.log1p(siblings[p]),
        np.log1p(by_parent[p] / n_sib), same / n_sib, np.log1p(before), sub[:, 0] / np.maximum(1.0, by_parent[p]), np.log1p(sub[:, 3])], axis=1)
    return np.concatenate([numbers, tags, word, above], axis=1).astype(np.float32)


def texts_of(page: Page, kept: np.ndarray) -> str:
    """The texts of kept elements: white space to one blank inside a block, blocks joined by a line feed."""
    blocks: list[str] = []
    part: list[str] = []
    for i, fresh, text in page.texts:
        if fresh and part:
            blocks.append(" ".join("".join(part).split()))
            part = []
        if kept[i]:
            part.append(text)
    blocks.append(" ".join("".join(part).split()))
    return "\n".join(b for b in blocks if b)
