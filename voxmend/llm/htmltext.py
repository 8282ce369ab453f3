"""Main text of web pages: boosted trees say which DOM nodes hold article text, and a pass over the tree keeps them consistent."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxmend.llm.boosting import Boosted, boost
from voxmend.llm.common import only, shipped
from voxmend.llm.dom import Page, features

#: Stands before main text in training pages; it never reaches the features' text.
MARK = "\ue000"
TRAINING_PAGES = 700
SEED = 3
#: Pages whose nodes are scored at once.
BATCH_PAGES = 256


class Writer:
    """Invents labelled pages: templates of many kinds around an article, the article's text marked."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        sizes = self.rng.integers(1, 4, int(self.rng.integers(low, high + 1)))
        parts = self.rng.integers(0, 60, int(sizes.sum()))
        out, at = [], 0
        for s in sizes:
            out.append("".join("bcdfglmnprst"[k % 12] + "aeiou"[k // 12] for k in parts[at : at + s]))
            at += s
        return " ".join(out)

    def sentences(self, n: int) -> str:
        return " ".join(self.words(3, 16).capitalize().replace(" ", ", ", int(self.chance(0.4))) + "." for _ in range(n))

    def named(self, tag: str, *names: str) -> str:
        """A start tag with one of the names as its class or id, or none."""
        name = self.pick(*names) if names else ""
        if not name or self.chance(0.08):
            return f"<{tag}>"
        if self.chance(0.3):
            name = f"{self.words(1, 1)} {name}" if self.chance(0.5) else f"{name} {self.words(1, 1)}"
        return f'<{tag} {self.pick("class", "class", "id")}="{name}">'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' for _ in range(int(self.rng.integers(low, high + 1)))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick(" | ", " ", "&middot; ").join(items)

    def menu(self) -> str:
        if self.chance(0.6):
            return f"<nav>{self.links(3, 9)}</nav>"
        return self.named("div", "menu", "navbar", "main-nav", "navigation", "topbar", "breadcrumbs") + self.links(3, 9) + "</div>"

    def header(self) -> str:
        inside = self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 3)}</div>", f"<p>{self.sentences(1)}</p>", self.words(1, 5)) + (self.menu() if self.chance(0.4) else "")
        if self.chance(0.7):
            return f"<header>{inside}</header>"
        return self.named("div", "header", "masthead", "site-header", "banner", "top") + inside + "</div>"

    def footer(self) -> str:
        inside = self.pick(f"&copy; {self.words(1, 3)} &middot; {self.sentences(2)}", f"<p>{self.sentences(int(self.rng.integers(1, 4)))}</p>", f"<p>&copy; 2020 {self.words(1, 3)}</p>{self.links(2, 6)}", self.links(2, 8))
        if self.chance(0.7):
            return f"<footer>{inside}</footer>"
        return self.named("div", "footer", "site-footer", "copyright", "bottom", "legal") + inside + "</div>"

    def advert(self) -> str:
        inside = self.pick(self.sentences(int(self.rng.integers(1, 4))), f"<p>{self.sentences(int(self.rng.integers(1, 4)))}</p>", f'<a href="/x">{self.words(2, 8)}</a>', f"<h3>{self.words(1, 4)}</h3><p>{self.sentences(2)}</p>")
        return self.named(self.pick("div", "div", "section", "p"), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-box", "ad-banner", "sponsor", "promotion").replace("<p>", "<p class=ad>").replace("<div>", '<div class="ad">').replace("<section>", '<section class="ad">') + inside + "</div></section>"

    def notice(self) -> str:
        inside = self.pick(f"<p>{self.sentences(int(self.rng.integers(1, 3)))}</p><button>OK</button>", self.sentences(2), f"<h3>{self.words(2, 4)}</h3><p>{self.sentences(1)}</p>")
        return self.named("div", "cookie-notice", "cookie", "notice", "consent", "newsletter", "alert", "popup", "gdpr-banner", "subscribe", "cookie-banner").replace("<div>", '<div class="notice">') + inside + "</div>"

    def sidebar(self) -> str:
        inside = "".join(self.pick(f"<h3>{self.words(1, 3)}</h3>{self.links(3, 8)}", f"<p>{self.sentences(2)}</p>", self.advert(), f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(1)}</p>") for _ in range(int(self.rng.integers(1, 4))))
        if self.chance(0.55):
            return f"<aside>{inside}</aside>"
        return self.named("div", "sidebar", "related", "widget", "side", "popular", "recommended", "right-rail", "more-stories").replace("<div>", '<div class="sidebar">') + inside + "</div>"

    def comments(self) -> str:
        def one() -> str:
            return self.pick(
                f'<div class="comment"><p>{self.sentences(int(self.rng.integers(1, 5)))}</p></div>',
                f'<li class="comment"><b>{self.words(1, 2)}</b> {self.sentences(int(self.rng.integers(1, 4)))}</li>',
                f"<p>{self.sentences(int(self.rng.integers(1, 5)))}</p>",
                f"<div><h4>{self.words(1, 2)}</h4><p>{self.sentences(int(self.rng.integers(1, 4)))}</p></div>",
                f"<article class=\"comment\"><p>{self.sentences(int(self.rng.integers(1, 4)))}</p></article>",
            )

        inside = (f"<h2>{self.words(1, 2)}</h2>" if self.chance(0.7) else "") + "".join(one() for _ in range(int(self.rng.integers(1, 8))))
        tag = self.pick("div", "section", "ol", "ul")
        return self.named(tag, "comments", "comment-list", "commentlist", "responses", "discussion", "reader-comments", "comments-area", "disqus_thread").replace(f"<{tag}>", f'<{tag} id="comments">') + inside + (self.form() if self.chance(0.3) else "") + f"</{tag}>"

    def form(self) -> str:
        inside = "".join(self.pick(f"<label>{self.words(1, 3)}</label><input>", f"<p>{self.sentences(1)}</p>", "<textarea>x</textarea>", f"<button>{self.words(1, 1)}</button>", f"<select><option>{self.words(1, 1)}</select>") for _ in range(int(self.rng.integers(1, 5))))
        return f"<form>{inside}</form>" if self.chance(0.8) else self.named("div", "search", "login", "contact-form", "search-box").replace("<div>", '<div class="form">') + f"<form>{inside}</form></div>"

    def paragraph(self) -> str:
        text = MARK + self.sentences(int(self.rng.integers(1, 9) if self.chance(0.8) else self.rng.integers(8, 40)))
        if self.chance(0.15):
            text = MARK + self.words(1, 5) + self.pick(".", "", "!")
        if self.chance(0.2):
            text = text.replace(". ", f'. <a href="/y">{self.words(1, 3)}</a> ', 1)
        if self.chance(0.2):
            text = "<b>" + text + self.pick("</b>", "")
        return text

    def article(self) -> str:
        out = []
        if self.chance(0.85):
            title = f"<h1>{MARK}{self.words(2, 10)}</h1>"
            out.append(f"<header>{title}</header>" if self.chance(0.12) else title)
        kind = self.pick("p", "p", "p", "p", "p", "p", "div", "br")
        for _ in range(int(self.rng.integers(1, 4) if self.chance(0.35) else self.rng.integers(2, 16))):
            extra = self.rng.random()
            if extra < 0.04:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.words(2, 12)}</li>" for _ in range(4)) + "</ul>")
            elif extra < 0.08:
                out.append(f"<blockquote><p>{MARK}{self.sentences(2)}</p></blockquote>")
            elif extra < 0.11:
                out.append(f"<h2>{MARK}{self.words(1, 6)}</h2>")
            elif extra < 0.13:
                out.append(f"<table><tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 3)}</td></tr></table>")
            elif extra < 0.16:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.words(3, 9)}</figcaption></figure>")
            elif extra < 0.24:
                out.append(self.pick(self.advert, self.advert, self.notice, self.sidebar, self.form)())
            if kind == "br":
                out.append(f"{self.paragraph()}<br>")
            else:
                out.append(f"<{kind}>{self.paragraph()}" + ("" if kind == "p" and self.chance(0.3) else f"</{kind}>"))
        if self.chance(0.06):
            out.append(self.comments())
        body = "".join(out)
        wrap = self.rng.random()
        if wrap < 0.45:
            return f"<article>{body}</article>"
        if wrap < 0.55:
            return f"<main><article>{body}</article></main>"
        if wrap < 0.63:
            return f"<main>{body}</main>"
        if wrap < 0.95:
            return self.named("div", "content", "post", "entry-content", "article-body", "main-content", "post-content", "story", "page-content") + body + "</div>"
        return f"<div>{body}</div>"

    def page(self) -> str:
        before = [self.menu] * self.chance(0.8) + [self.header] * self.chance(0.5) + [self.advert] * self.chance(0.5) + [self.notice] * self.chance(0.3) + [self.form] * self.chance(0.2) + [self.sidebar] * self.chance(0.2)
        after = [self.footer] * self.chance(0.85) + [self.comments] * self.chance(0.4) + [self.sidebar] * self.chance(0.35) + [self.advert] * self.chance(0.3) + [self.notice] * self.chance(0.25) + [self.form] * self.chance(0.2) + [self.menu] * self.chance(0.15)
        before = [before[k] for k in self.rng.permutation(len(before))]
        after = [after[k] for k in self.rng.permutation(len(after))]
        inner = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        if self.chance(0.25):
            inner = self.named("div", "wrapper", "container", "page", "site") + inner + "</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{inner}</body></html>"


def holds_main(page: Page, marked: list[bool]) -> np.ndarray:
    """Whether each node's subtree has a run that is marked."""
    out = np.zeros(len(page.tag), bool)
    for (node, _), yes in zip(page.runs, marked):
        while yes and node >= 0 and not out[node]:
            out[node] = True
            node = page.parent[node]
    return out


@functools.lru_cache(maxsize=2)
def trained(n_pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    """The trees, fitted on invented pages: the same in every run, whatever the corpus."""
    writer = Writer(np.random.Generator(np.random.PCG64(seed)))
    pages, wanted = [], []
    for _ in range(n_pages):
        page = Page(writer.page())
        marked = [MARK in text for _, text in page.runs]
        page.runs = [(node, text.replace(MARK, "")) for node, text in page.runs]
        pages.append(page)
        wanted.append(holds_main(page, marked))
    x, parent, _ = features(pages)
    y = np.concatenate(wanted).astype(float)
    # A node matters where its parent is in: what lies under an excluded node is out anyhow.
    inside = (parent >= 0) & (y[np.maximum(parent, 0)] > 0)
    weight = np.where(inside, 1.0, 0.15) * (1 + np.minimum(x[:, -18], 8.0) / 4)
    return boost(x, y, weight)


def chosen(log_odds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes in which no node is in whose parent is out (roots are in).

    From the leaves up, a node's gain for being in is its log-odds plus the gains of its children that are worth it; a
    node is in if its gain is positive and its parent is in. Parents stand before their children.
    """
    gain = log_odds.copy()
    for k in range(len(gain) - 1, -1, -1):
        if parent[k] >= 0 and gain[k] > 0:
            gain[parent[k]] += gain[k]
    out = np.zeros(len(gain), bool)
    for k, up in enumerate(parent):
        out[k] = up < 0 or (gain[k] > 0 and out[up])
    return out


def main_texts(sources: list[str], model: Boosted) -> list[str]:
    """The main text of each page."""
    out = []
    for a in range(0, len(sources), BATCH_PAGES):
        pages = [Page(s) for s in sources[a : a + BATCH_PAGES]]
        x, parent, page = features(pages)
        keep = chosen(model.log_odds(x), parent).tolist()
        head = 0
        for p in pages:
            out.append("\n\n".join(text for node, text in p.runs if keep[head + node]))
            head += len(p.tag)
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html); one scan, no shuffle.

    Text runs of block elements, character references decoded and white space turned into single spaces, are the blocks;
    those whose node is chosen are joined by two newlines in page order. Null or empty html, or a page without chosen
    text: empty text, 0 characters. Unclosed and broken markup is read as browsers would. Repeated rows are extracted
    alike; null ids and urls stay null; an empty table gives no rows; extra columns are ignored.
    """
    shared = shipped(pages.sparkSession, model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared()
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(a, BATCH_PAGES)
                texts = main_texts([s or "" for s in part.column("html").to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return only(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")
