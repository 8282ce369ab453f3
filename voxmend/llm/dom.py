"""A forgiving HTML reader for extraction: block elements as nodes, their text runs, and numbers about them."""

from __future__ import annotations

import html
import re

import numpy as np

#: Elements whose content is never text of the page: scripts, styles, what stands outside of it, and controls of forms. Of the
#: first an end tag is waited for to the end of the page, as browsers do; the others end without one where a block starts.
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = RAW | frozenset("template select button datalist".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are nodes; all others are inline.
BLOCKS = (
    "html body div section article main nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary dialog menu center head hgroup search legend"
).split()
_BLOCK = frozenset(BLOCKS)
_STARTS = re.compile(rf"<(?:{'|'.join(BLOCKS)})(?=[\s/>])", re.I)
#: An open p ends where one of these starts.
_ENDS_P = _BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
#: A start tag also ends an open element of its group, within the nearest of the fences.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Groups of tags, as features.
GROUPS = ("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "div", "section", "article", "main", "nav", "header hgroup", "footer", "aside", "form fieldset legend search", "table thead tbody tfoot tr td th caption", "blockquote pre", "figure figcaption", "html body", "#text")
_GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags.split()}
#: Kinds of attribute tokens (class, id, role), as features. Common names in page templates.
KINDS = {
    "main": "article content post entry story main body text maincontent articlebody postcontent richtext prose",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager topbar submenu sitenav tabs toc",
    "foot": "footer foot bottom copyright colophon legal contentinfo imprint",
    "head": "header masthead banner branding logo tagline siteheader top hero",
    "side": "sidebar aside side widget widgets related recommended recommendations more popular trending rail complementary teaser teasers",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner-ad adsense adslot dfp",
    "notice": "cookie cookies consent notice notices gdpr alert warning newsletter subscribe subscription signup popup modal overlay paywall dialog toast announcement",
    "comment": "comment comments commentlist disqus respond reply replies discussion feedback thread responses reader",
    "social": "share sharing social follow tags tag meta byline author rating bookmark print",
    "form": "form search login register contact input field poll survey",
}
_KIND = {word: 1 << k for k, words in enumerate(KINDS.values()) for word in words.split()}
_TAG_KIND = {"nav": "nav", "footer": "foot", "header": "head", "aside": "side", "form": "form", "search": "form", "fieldset": "form", "dialog": "notice", "menu": "nav", "article": "main", "main": "main"}
_TAG_KIND = {tag: 1 << list(KINDS).index(kind) for tag, kind in _TAG_KIND.items()}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S,
)
_NAMING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACES = re.compile(r"\s+")


def kinds_of(attributes: str) -> int:
    """The bits of KINDS that the class, id and role tokens in a tag's attributes name."""
    out = 0
    for groups in _NAMING.findall(attributes):
        for name in "".join(groups).split():
            out |= _KIND.get(name.lower(), 0)
            for token in _TOKENS.findall(name):
                out |= _KIND.get(token.lower(), 0)
    return out


class Page:
    """The nodes of a page in order of their start tags (a parent before its children) and its text runs in page order.

    tag, parent, kinds: of each node; node 0 is the root. runs: (node, text). Text directly inside a node that also has
    block children gets nodes of its own, tagged #text.
    """

    __slots__ = ("kinds", "link", "parent", "runs", "tag")

    def __init__(self, source: str):
        self.tag, self.parent, self.kinds = ["html"], [-1], [0]
        self.runs: list[tuple[int, str]] = []
        self.link: list[int] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, names = [0], ["html"]
        open_at: dict[str, list[int]] = {}  # where in names each name is, innermost last
        without_end: set[str] = set()  # names that have no end tag from here on
        pieces: list[str] = []
        in_link, linked = 0, 0
        at, size = 0, len(source)

        def close(k: int) -> None:
            """Ends the open elements from the k-th on."""
            while len(names) > k:
                open_at[names.pop()].pop()
                stack.pop()

        def innermost(tags) -> int:
            """Where the innermost open element of these tags is; 0: none is open."""
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = _SPACES.sub(" ", "".join(pieces)).strip()
                if text:
                    self.runs.append((stack[-1], text))
                    self.link.append(min(linked, len(text)))
                pieces.clear()
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if in_link:
                linked += len(text)

        while at < size:
            m = _MARKUP.search(source, at)
            if m is None:
                add(source[at:])
                break
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in VOID:
                if name in ("br", "hr"):
                    pieces.append(" ")
                continue
            if name in SKIPPED:
                if not closing:
                    end = None if name in without_end else re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    if end:
                        at = end.end()
                    elif name in RAW:
                        at = size
                    else:
                        without_end.add(name)
                        start = _STARTS.search(source, at)
                        at = start.start() if start else size
                    pieces.append(" ")
                continue
            if name not in _BLOCK:
                if name == "a":
                    in_link = 0 if closing else 1
                continue
            flush()
            if closing:
                if innermost((name,)):
                    close(innermost((name,)))
                    in_link = 0
                continue
            if name in ("html", "head"):
                continue
            if name in _ENDS_P and innermost(("p",)):
                close(innermost(("p",)))
                in_link = 0
            if name in _SIBLINGS:
                group, fence = _SIBLINGS[name]
                if innermost(group) > innermost(fence):
                    close(innermost(group))
            if name[0] == "h" and name[1:].isdigit() and names[-1][0] == "h" and names[-1][1:].isdigit():
                close(len(names) - 1)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.kinds.append((kinds_of(attributes) if attributes else 0) | _TAG_KIND.get(name, 0))
            open_at.setdefault(name, []).append(len(names))
            stack.append(len(self.tag) - 1)
            names.append(name)
        flush()
        with_children = set(self.parent)
        for k, (node, text) in enumerate(self.runs):
            if node in with_children:
                self.tag.append("#text")
                self.parent.append(node)
                self.kinds.append(0)
                self.runs[k] = (len(self.tag) - 1, text)


FEATURES = [
    *(f"tag {x.split()[0]}" for x in GROUPS),
    *(f"own {x}" for x in KINDS),
    *(f"above {x}" for x in KINDS),
    *(f"below {x}" for x in KINDS),
    *"length share links punctuation words_per_run nodes runs paragraphs depth place siblings like_siblings before after of_parent longest headings items".split(),
]


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, page number) of the nodes of some pages, one page after the other."""
    sizes = np.array([len(p.tag) for p in pages])
    head = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.array([x for p in pages for x in p.parent], np.int64)
    root = parent < 0
    parent = np.where(root, np.arange(len(parent)), parent + head[page])
    group = np.array([_GROUP.get(t, len(GROUPS)) for p in pages for t in p.tag])
    kinds = np.array([x for p in pages for x in p.kinds], np.int64)
    n = len(parent)
    where = np.array([node + a for p, a in zip(pages, head) for node, _ in p.runs], np.int64)
    texts = [t for p in pages for _, t in p.runs]
    length = np.array([len(t) for t in texts], np.float64)
    per_run = {
        "length": length,
        "words": np.array([t.count(" ") + 1 for t in texts], np.float64),
        "punctuation": np.array([t.count(".") + t.count(",") + t.count(";") + t.count("!") + t.count("?") for t in texts], np.float64),
        "links": np.array([x for p in pages for x in p.link], np.float64),
        "runs": np.ones(len(texts)),
    }
    total = {k: np.bincount(where, v, n) for k, v in per_run.items()}
    total |= {"nodes": np.ones(n), "paragraphs": (group == 0) * 1.0, "headings": (group == 1) * 1.0, "items": (group == 2) * 1.0}
    longest = np.zeros(n)
    np.maximum.at(longest, where, length)
    below = np.stack([(kinds >> k & 1) for k in range(len(KINDS))], axis=1).astype(np.float64)
    above = np.zeros_like(below)
    depth = np.zeros(n, np.int64)
    level, levels = root, []
    while level.any():  # nodes by depth
        levels.append(np.flatnonzero(level))
        level = level[parent] & ~root
        level[levels[-1]] = False
        depth[level] = len(levels)
    own = below.copy()
    for nodes in levels[1:]:
        above[nodes] = np.maximum(above[parent[nodes]], own[parent[nodes]])
    below = below * total["length"][:, None] * 0
    for nodes in reversed(levels[1:]):
        up = parent[nodes]
        for v in total.values():
            np.add.at(v, up, v[nodes])
        np.maximum.at(longest, up, longest[nodes])
        np.add.at(below, up, np.maximum(below[nodes], own[nodes] * total["length"][nodes, None]))
    whole = total["length"][head[page]]
    children = np.bincount(parent[~root], minlength=n)
    siblings = children[parent] * ~root
    order = np.lexsort((np.arange(n), parent))
    order = order[~root[order]]
    first = np.ones(len(order), bool)
    first[1:] = parent[order[1:]] != parent[order[:-1]]
    starts = np.flatnonzero(first)
    place = np.zeros(n)
    place[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    before, after = np.zeros(n), np.zeros(n)
    inner = ~first[1:] if len(order) else np.zeros(0, bool)
    before[order[1:][inner]] = total["length"][order[:-1][inner]]
    after[order[:-1][inner]] = total["length"][order[1:][inner]]
    _, inverse, same = np.unique(parent * 64 + group, return_inverse=True, return_counts=True)
    length = total["length"]
    numbers = [
        np.log1p(length),
        length / np.maximum(whole, 1),
        total["links"] / np.maximum(length, 1),
        total["punctuation"] / np.maximum(total["words"], 1),
        total["words"] / np.maximum(total["runs"], 1),
        np.log1p(total["nodes"]),
        np.log1p(total["runs"]),
        total["paragraphs"] / total["nodes"],
        depth,
        place / np.maximum(siblings, 1),
        siblings,
        same[inverse] / np.maximum(siblings, 1),
        np.log1p(before),
        np.log1p(after),
        length / np.maximum(length[parent], 1),
        np.log1p(longest),
        total["headings"] / total["nodes"],
        total["items"] / total["nodes"],
    ]
    tags = group[:, None] == np.arange(len(GROUPS))[None, :]
    return np.concatenate([tags, own, above, below / np.maximum(length, 1)[:, None], np.stack(numbers, axis=1)], axis=1).astype(np.float32), np.where(root, -1, parent), page
