"""Main text of web pages: boosted trees over DOM elements, decoded over the whole tree."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import boosting
from parley.llm.common import text_of
from parley.llm.dom import WORDS, Page, features, parse, texts_of
from parley.llm.registry import query, table

#: Labelled pages that the trees are fitted on, and the seed of their layouts.
PAGES, SEED = 1200, 20240611
#: Log odds against dropping a child of a kept element.
CHANGE = 1.5


class Layouts:
    """Labelled pages of many layouts. Elements whose own text is main text carry ``data-main``."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int, stops: bool = True) -> str:
        r = self.r
        out = ["".join(r.choice(("an", "ter", "on", "li", "su", "ma", "re", "ko", "é", "th")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(7, len(out), 9):
            out[i] += r.choice((". ", ", ")).strip() if stops else ""
        return " ".join(out).capitalize() + ("." if stops else "")

    def name(self, group: str, often: float = 0.8) -> str:
        r = self.r
        if r.random() > often:
            return r.choice(("", ' class="c%d"' % r.randint(1, 99), ' class="row"', ' id="x%d"' % r.randint(1, 9)))
        word = r.choice(WORDS[group].split())
        more = r.choice(("", "-box", "_area", " col-3", "-wrapper", " js-x"))
        return f' {r.choice(("class", "class", "id"))}="{word}{more}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3, False)}</a>' for k in range(self.r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def boiler(self, kind: str, inside: bool = False) -> str:
        """Something around the main text; inside it, only its tag or a name tells it from the text."""
        r = self.r
        named = self.name(kind, 1 if inside else 0.95)
        bare = "" if r.random() < 0.6 else named
        if kind == "menu":
            return r.choice((f"<nav{bare}>{self.links(3, 9)}</nav>", f"<div{named}>{self.links(3, 9)}</div>", f"<ul{named}><li><a href='/'>{self.words(1, 2, False)}</a></li></ul>"))
        if kind == "head":
            inner = r.choice((f"<h1><a href='/'>{self.words(1, 3, False)}</a></h1>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 4, False)}</div>")) + (self.links(2, 6) if r.random() < 0.5 else "")
            return r.choice((f"<header{bare}>{inner}</header>", f"<div{named}>{inner}</div>"))
        if kind == "foot":
            inner = r.choice((f"&copy; {self.words(2, 12)}", f"<p>&copy; {self.words(2, 25)}</p>", self.links(2, 8) + f"<p>{self.words(3, 20)}</p>"))
            return r.choice((f"<footer{bare}>{inner}</footer>", f"<div{named}>{inner}</div>"))
        if kind == "side":
            inner = r.choice((f"<h3>{self.words(1, 3, False)}</h3>{self.links(2, 7)}", f"<p>{self.words(4, 40)}</p>", f"<h4>{self.words(1, 3, False)}</h4><p>{self.words(4, 25)}</p>"))
            return r.choice((f"<aside{bare}>{inner}</aside>", f"<div{named}>{inner}</div>", f"<section{named}>{inner}</section>"))
        if kind in ("ad", "note"):
            inner = r.choice((self.words(2, 25), f"<p>{self.words(2, 30)}</p>", f"<p>{self.words(2, 15)}</p><button>{self.words(1, 2, False)}</button>", f"<a href='/x'>{self.words(2, 9)}</a>"))
            return r.choice((f"<div{named}>{inner}</div>", f"<div{named}>{inner}</div>", f"<section{named}>{inner}</section>", f"<aside{named}>{inner}</aside>", f"<p{named}>{self.words(2, 20)}</p>"))
        if kind == "talk":
            one = lambda: r.choice((f"<div{self.name('talk')}><b>{self.words(1, 2, False)}</b><p>{self.words(3, 60)}</p></div>", f"<li{self.name('talk')}><p>{self.words(3, 60)}</p></li>", f"<article{self.name('talk', 1)}><p>{self.words(3, 60)}</p></article>", f"<p>{self.words(3, 60)}</p>"))
            inner = (f"<h3>{self.words(1, 3, False)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
            return f"<{(t := r.choice(('section', 'div', 'div', 'ol', 'ul')))}{self.name('talk', 1)}>{inner}</{t}>"
        if kind == "form":
            return f"<form{bare}><label>{self.words(1, 4, False)}</label><input name='q'>{r.choice(('', f'<p>{self.words(3, 15)}</p>'))}<button>{self.words(1, 2, False)}</button></form>"
        return r.choice((f"<div{named}>{self.links(2, 5)}</div>", f"<div{named}><p>{self.words(1, 10, False)}</p></div>", f"<ul{named}><li>{self.words(1, 2, False)}</li></ul>"))

    def main_block(self) -> str:
        r = self.r
        if r.random() < 0.72:
            low, high = r.choice(((1, 3), (5, 30), (20, 90), (60, 160)))
            text = self.words(low, high) if r.random() < 0.9 else self.words(1, 3, False).lower()
            if r.random() < 0.2:
                text = f"<b data-main>{text}</b>"
            if r.random() < 0.2:
                text += f' <a data-main href="/z">{self.words(1, 4, False)}</a> {self.words(3, 20)}'
            if r.random() < 0.12:
                return f"<p data-main><b data-main>{self.words(low, high)}<br>"
            return f"<p data-main>{text}</p>"
        return r.choice((
            f"<h2 data-main>{self.words(1, 7, False)}</h2>", f"<h3 data-main>{self.words(1, 7, False)}</h3>",
            "<ul data-main>" + "".join(f"<li data-main>{self.words(1, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
            f"<blockquote data-main><p data-main>{self.words(5, 40)}</p></blockquote>", f"<pre data-main>{self.words(3, 30, False)}</pre>",
            f"<div data-main>{self.words(5, 60)}</div>", f"<figure data-main><img src='i'><figcaption data-main>{self.words(2, 15)}</figcaption></figure>",
            "<table data-main>" + "".join(f"<tr data-main><td data-main>{self.words(1, 5, False)}</td><td data-main>{self.words(1, 5)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"))

    def page(self) -> str:
        r = self.r
        tiny = r.random() < 0.12
        blocks = [f"<p data-main>{self.words(1, 3)}</p>"] * r.randint(1, 2) if tiny else [self.main_block() for _ in range(r.choice((1, 2, 3, 6, 10, 16, 25)))]
        inside = [k for k in ("ad", "share", "side", "note", "form", "talk", "menu") if r.random() < 0.15]
        for k in inside:
            blocks.insert(r.randint(0, len(blocks)) if k != "talk" else len(blocks), self.boiler(k, True))
        title = f"<h1 data-main>{self.words(1, 2 if tiny else 12, tiny)}</h1>"
        if r.random() < 0.1:
            title = f"<header data-main>{title}</header>"
        body = (title if r.random() < 0.85 else "") + "".join(blocks)
        shell = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        named = self.name("main", 0.4 if shell in ("article", "main") else 0.85)
        main = f"<{shell}{named} data-main>{body}</{shell}>"
        if r.random() < 0.35:
            side = self.boiler("side") if r.random() < 0.5 else ""
            outer = r.choice(("main", "div", "div", "section"))
            main = f"<{outer}{self.name('main', 0.5)} data-main>" + (side + main if r.random() < 0.5 else main + side) + f"</{outer}>"
        top = [self.boiler(k) for k in ("head", "menu", "ad", "note", "form", "side") if r.random() < 0.45]
        bottom = [self.boiler(k) for k in ("talk", "side", "ad", "share", "form", "note", "menu") if r.random() < 0.3] + ([self.boiler("foot")] if r.random() < 0.85 else [])
        r.shuffle(top)
        script = "<script>var a='<p>x</p>';</script>" if r.random() < 0.5 else ""
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9, False)}</title><style>p{{}}</style></head><body>{''.join(top)}{script}{main}{''.join(bottom)}{end}"


def labels(page: Page) -> np.ndarray:
    """Main elements, and with them all that they stand in."""
    y = np.array(page.label)
    for i in range(len(y) - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = True
    return y


def train(pages: int = PAGES, seed: int = SEED) -> boosting.Boosted:
    """Fit on generated pages, a bounded number of them; the given pages have no labels to learn from."""
    layouts = Layouts(seed)
    read = [parse(layouts.page()) for _ in range(pages)]
    return boosting.fit(np.concatenate([features(p)[1:] for p in read]), np.concatenate([labels(p)[1:] for p in read]).astype(float))


def decode(page: Page, logit: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The likeliest choice for the whole tree in which no dropped element holds a kept one.

    From the leaves up: an element is dropped with all that it holds, or kept with the best
    choice for each child. Below the body most children go the way of their parent, so a child
    that is dropped from a kept one costs ``change``. Then from the top: kept where its parent is kept and
    keeping wins.
    """
    log_keep, log_drop = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    run = np.r_[0.0, log_drop.cumsum()]
    n = len(page.tag)
    dropped = run[np.array(page.end)] - run[np.arange(n)]
    keep, drop = log_keep.tolist(), dropped.tolist()
    for i in range(n - 1, 0, -1):
        if page.tag[page.parent[i]] not in ("#page", "html", "body"):
            drop[i] -= change
        keep[page.parent[i]] += max(keep[i], drop[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
    return kept


@lru_cache(maxsize=1)
def _model(pages: int, seed: int) -> boosting.Boosted:
    return train(pages, seed)


def extract(sources: list[str], model: boosting.Boosted) -> list[str]:
    """Main texts of pages, scored together."""
    pages = [parse(s) for s in sources]
    sizes = [len(p.tag) for p in pages]
    logits = np.split(model.logit(np.concatenate([features(p) for p in pages])), np.cumsum(sizes)[:-1]) if pages else []
    return [texts_of(p, decode(p, z)) for p, z in zip(pages, logits, strict=True)]


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and the main text of every page.

    The whole source is read, however broken; a null or empty one gives an empty text, and so
    does one without main text. Other columns are left out; rows may repeat; no rows give none.
    """
    model = _model(PAGES, SEED)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = extract(part.column(part.num_columns - 1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string())], [*keep, out_col])

    return pages.select(*keep, text_of(html_col).alias("_html")).mapInArrow(run, f"{kinds}, `{out_col}` string")


@query("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
