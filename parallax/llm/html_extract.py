"""HTML extraction: flat text blocks, classified by a decision tree.

1. A page is read as a flat stream of tags and text. Block tags (paragraphs,
   headings, list items, table cells, divisions, sections ...) end a text block;
   inline tags do not. Scripts, styles, templates, comments, the head and
   markup inside them give no text; character references are decoded; white
   space inside a block becomes one space.
2. Each block gets its word count and link density, those of the blocks before
   and after it, and marks of where it stands (inside an article or main
   element, inside an element that names itself a menu, header, footer, sidebar,
   notice, advert, form or comment, a heading, a list item). An element that is
   so named by its class, id or role but holds most of the page's words and its
   running text is a layout wrapper (``<div class='layout with-sidebar'>``), inside
   an article too if the names are ones that a layout may carry: its
   blocks have a mark of their own, and the tree weighs their words and links.
3. A decision tree, grown by Gini impurity on a small labelled table (the blocks
   of a few dozen model pages that ``labelled_table`` writes by a rule), tells
   article blocks from the rest. The article's blocks are joined in page order by
   one space.

Defined cases: null or empty html gives an empty text; a page without any block
that the tree accepts gives an empty text; markup that is cut off or badly
nested is read as far as it goes (an unclosed tag of a kind that cannot hold its
own kind is closed by the next), in time linear in its length; very long pages are read whole; repeated rows
and null ids are kept as they are; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that end a text block where they open or close.
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
              "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
              "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p",
              "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
# Elements whose content is no text of the page.
SILENT_TAGS = ["script", "style", "template", "noscript", "head", "title", "svg", "math", "iframe", "object", "canvas",
               "audio", "video", "map", "datalist"]
# Elements whose content is raw text up to their own end tag.
RAW_TAGS = ["script", "style", "title", "textarea", "iframe", "noscript"]
# Elements without content.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
# Elements that a page's frame is made of.
FRAME_TAGS = ["nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "textarea", "fieldset", "label"]
# Words in class, id or role that name a part of a page's frame.
FRAME_WORDS = ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer",
               "sidebar", "aside", "complementary", "contentinfo", "widget", "related", "recommended", "ad", "ads", "adv",
               "advert", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie",
               "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
               "signup", "login", "share", "sharing", "social", "comment", "comments", "reply", "replies", "respond", "disqus",
               "discussion", "pagination", "pager", "tags", "toolbar", "search", "copyright", "legal", "disclaimer", "hidden",
               "skip", "toc", "feedback", "reviews", "dialog", "form"]
# Those of them that an article's own layout carries too.
LAYOUT_WORDS = ["nav", "navbar", "menu", "header", "masthead", "banner", "footer", "sidebar", "aside", "widget", "notice", "legal", "form",
                "discussion", "search", "tags", "toc", "feedback", "reviews", "dialog"]
# Those that a paragraph or heading of an article carries too.
PARAGRAPH_WORDS = ["header", "legal", "form", "discussion"]
# Words in class, id or role that name the article.
ARTICLE_WORDS = ["article", "main", "content", "post", "entry", "story", "body", "text"]

HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

_BLOCK, _SILENT, _RAW, _VOID, _FRAME = map(frozenset, (BLOCK_TAGS, SILENT_TAGS, RAW_TAGS, VOID_TAGS, FRAME_TAGS))
_FRAME_WORDS, _ARTICLE_WORDS = frozenset(FRAME_WORDS), frozenset(ARTICLE_WORDS)
_LAYOUT_WORDS, _PARAGRAPH_WORDS = frozenset(LAYOUT_WORDS), frozenset(PARAGRAPH_WORDS)
_PARAGRAPHS = HEADINGS | {"p", "blockquote", "pre"}

_TAG = re.compile(r"</?[a-zA-Z]")
_OUTSIDE = re.compile(r"[^>\"']*")
_CUT = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# What each element's start tag closes if it is open above the nearest barrier.
CLOSES = {"p": ["p"], "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"],
          "th": ["td", "th"], "option": ["option"], "thead": ["tr", "td", "th"], "tbody": ["tr", "td", "th", "thead", "tbody"]}
# The barriers, which such an end does not pass.
BARRIERS = ["ul", "ol", "table", "div", "article", "section", "body", "td", "blockquote", "dl", "select"]


@dataclass
class Block:
    """A run of text between block tags."""

    text: str
    words: int
    linked: int        # words inside links
    frame: int         # how many open elements name a part of the page's frame
    article: int       # how many open elements name the article
    heading: int
    item: int
    wrapped: int = 0   # whether an open element that names the frame is a layout wrapper

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


# Fixed value: words of a block that counts as running text.
RUNNING_WORDS = 15


def _settle_wrappers(page: list[Block], inner: list[int], h1: list[int], parent: list[int], in_article: list[int]) -> None:
    """Tells layout wrappers among the elements that class, id or role name as frame.

    ``inner`` has each block's innermost such element, ``parent`` each element's own (0: none; later ones have larger numbers).
    A wrapper holds more than half of the words outside the frame's own elements, and the page's h1 or,
    on a page without, all of its running text (some, at least); inside an article and without an h1, four fifths of the words too. The others are frame."""
    words = [0] * len(parent)
    depth = [0] * len(parent)
    for k in range(1, len(parent)):
        depth[k] = depth[parent[k]] + 1
    for b, k in zip(page, inner, strict=True):
        if not b.frame:
            words[k] += b.words
    for k in range(len(parent) - 1, 0, -1):
        words[parent[k]] += words[k]
    total = words[0]
    large = [2 * n > total for n in words]  # one chain of elements inside each other
    # blocks that no smaller named element holds
    free = [j for j, b in enumerate(page) if not b.frame and (not inner[j] or large[inner[j]])]
    marks = [j for j in free if h1[j]]
    running = [j for j in free if page[j].words >= RUNNING_WORDS and page[j].density < 0.5]
    chain = sorted(k for k in range(1, len(parent)) if large[k])  # outermost first

    def hold(j: int) -> int:
        """How many elements of the chain hold a free block: all up to its innermost one."""
        return depth[inner[j]]

    most = max((hold(j) for j in marks), default=0) if marks else min((hold(j) for j in running), default=0)
    wrappers = {k for k in chain if depth[k] <= most and (marks or not in_article[k] or 5 * words[k] >= 4 * total)}
    held = [0] * len(parent)  # wrappers among an element and those around it
    for k in range(1, len(parent)):
        held[k] = held[parent[k]] + (k in wrappers)
    for b, k in zip(page, inner, strict=True):
        b.wrapped = int(held[k] > 0)
        b.frame += depth[k] - held[k]


def _marks(name: str, tag: str) -> tuple[int, int, int, int]:
    """(frame, named, article, unseen) of a start tag: frame by its element; named as frame by its attributes, 1, or 2 if
    an article's layout, or 3 if an article's paragraph may be named so."""
    frame, named, article, unseen = int(name in _FRAME), set(), int(name in ("article", "main")), 0
    if len(tag) > len(name) + 2:
        for key, value in _ATTR.findall(tag, len(name) + 1):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                unseen = 1
            elif key == "style":
                unseen |= bool(_UNSEEN.search(value))
            elif key in ("class", "id", "role") and name not in ("html", "body"):
                words = set(_SPLIT.split(_CAMEL.sub(" ", value).lower()))
                named |= words & _FRAME_WORDS
                article |= bool(words & _ARTICLE_WORDS)
    kind = 0 if not named else 3 if named <= _PARAGRAPH_WORDS else 2 if named <= _LAYOUT_WORDS else 1
    return frame, kind, article, unseen


class _Tags:
    """The tags, comments and declarations of a page, in order, in time linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[int, int] = {}     # where a tag ends that is outside quotes here; -1: nowhere
        self.last: dict[str, int] = {}     # where a quote that is known to occur no more does so last

    def _end(self, at: int) -> int:
        """Past the ``>`` that ends a tag, from a place outside quotes; -1 if the page ends before."""
        page, ends, passed = self.page, self.ends, []
        while at not in ends:
            passed.append(at)
            stop = _OUTSIDE.match(page, at).end()
            if stop == len(page):
                out = -1
                break
            quote = page[stop]
            if quote == ">":
                out = stop + 1
                break
            close = -1 if stop >= self.last.get(quote, len(page)) else page.find(quote, stop + 1)
            if close < 0:
                self.last[quote] = min(stop, self.last.get(quote, stop))
                out = -1
                break
            at = close + 1
        else:
            out = ends[at]
        ends.update(dict.fromkeys(passed, out))
        return out

    def after(self, at: int) -> tuple[int, int] | None:
        """(start, end) of the next one from ``at`` on."""
        page, n = self.page, len(self.page)
        start = page.find("<", at)
        while start >= 0:
            if page.startswith(("<!", "<?"), start):
                for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                    if page.startswith(opening, start):
                        end = page.find(closing, start + (len(opening) if len(opening) > 1 else 2))
                        return start, n if end < 0 else end + len(closing)
            m = _TAG.match(page, start)
            following = page.find("<", start + 1)
            if m:
                end = self._end(m.end())
                if end < 0:  # a quote that never closes: up to the next >, if no tag starts before
                    end = page.find(">", start, n if following < 0 else following) + 1
                if end > 0:
                    return start, end
            start = following
        return None


def blocks(html: str | None) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    page = html or ""
    # open elements: (name, frame, article, silent, number if it may be a wrapper); None where one was closed out of turn
    stack: list[tuple[str, int, int, int, int] | None] = []
    open_at: dict[str, list[int]] = {}   # name -> places in the stack
    blocks_at: list[int] = []            # places of block elements
    parent, in_article = [0], [0]        # of elements that may be wrappers
    inner, h1 = [], []
    parts: list[str] = []
    link_parts: list[str] = []
    frame = article = silent = links = within = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                linked = len(" ".join(link_parts).split())
                out.append(Block(text, len(text.split()), linked, frame, article, int(any(open_at.get(h) for h in HEADINGS)), int(bool(open_at.get("li")))))
                inner.append(within)
                h1.append(int(bool(open_at.get("h1"))))
        parts.clear()
        link_parts.clear()

    def leave(k: int) -> None:
        """Closes the element at ``k``, the last of its name."""
        nonlocal frame, article, silent, links, within
        name, f, a, s, number = stack[k]
        open_at[name].pop()
        if blocks_at and blocks_at[-1] == k:
            blocks_at.pop()
        frame -= f
        article -= a
        silent -= s
        links -= name == "a"
        if number:
            within = parent[number]
        if k == len(stack) - 1:
            stack.pop()
        else:
            stack[k] = None

    def close(k: int) -> None:
        """Closes all elements from the top down to ``k``."""
        while len(stack) > k:
            if stack[-1] is None:
                stack.pop()
            else:
                leave(len(stack) - 1)

    def last(name: str) -> int:
        at = open_at.get(name)
        return at[-1] if at else -1

    def say(raw: str) -> None:
        if raw and not silent:
            t = unescape(raw)
            parts.append(t)
            if links:
                link_parts.append(t)

    at, n, tags = 0, len(page), _Tags(page)
    while at < n:
        found = tags.after(at)
        if found is None:
            # a tag that the page's end cuts off is no text
            cut = _CUT.search(page, at)
            say(page[at:cut.start()] if cut else page[at:])
            break
        say(page[at:found[0]])
        tag, at = page[found[0]:found[1]], found[1]
        m = _NAME.match(tag)
        if not m:
            if tag.startswith("<![CDATA["):
                parts.append("" if silent else tag[9:].removesuffix("]]>"))
            continue
        name = m[1].lower()
        if tag[1] == "/":
            if name in _BLOCK:
                flush()
            k = last(name)
            if k >= 0:
                # an inline end tag does not reach past an open block
                if name in _BLOCK or name in _SILENT or not (blocks_at and blocks_at[-1] > k):
                    close(k)
                else:
                    leave(k)
            continue
        if name in _BLOCK:
            flush()
        elif name in ("br", "img", "input", "wbr"):
            if not silent:
                parts.append(" " if name != "wbr" else "")
        for closed in CLOSES.get(name, ()):
            # up to the nearest element that such an end cannot pass
            k = last(closed)
            if k >= 0 and k > max(last(x) for x in BARRIERS if x != closed):
                close(k)
        if name == "body" and last("head") >= 0:
            # a head that was never closed ends here
            close(open_at["head"][0])
        if name in _VOID or tag.endswith("/>"):
            continue
        f, kind, a, unseen = _marks(name, tag)
        if name == "header":
            # a page's header; an article's own header belongs to the article
            f = int(f or article == 0)
        quiet = int(name in _SILENT or unseen)
        if name in _RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            if name in ("textarea",):
                flush()
            at = end.start() if end else n
            shut = page.find(">", at)
            at = shut + 1 if end and shut >= 0 else n
            continue
        if name == "a":
            while last("a") >= 0:
                leave(last("a"))
            links += 1
        if kind == 3 and article and name in _PARAGRAPHS:
            kind = 0
        # outside the frame a named element may be a layout wrapper
        may_wrap = kind and not f and not frame and (not article or kind > 1) and name in _BLOCK
        f = int(f or kind and not may_wrap)
        if may_wrap:
            parent.append(within)
            in_article.append(article)
            within = len(parent) - 1
        open_at.setdefault(name, []).append(len(stack))
        if name in _BLOCK:
            blocks_at.append(len(stack))
        stack.append((name, f, a, quiet, within if may_wrap else 0))
        frame += f
        article += a
        silent += quiet
    flush()
    if len(parent) > 1:
        _settle_wrappers(out, inner, h1, parent, in_article)
    return out


# Statistics of a block that the tree may ask for, in order.
FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "frame", "in_article",
            "article_on_page", "heading", "item", "wrapped"]


def features(page: list[Block]) -> np.ndarray:
    """One row per block, in the order of FEATURES; the page's ends count as blocks without words."""
    # a small box with an article's name does not make the rest of the page frame
    plain = [b for b in page if not b.frame and b.density < 0.5]
    any_article = float(0 < sum(b.words for b in plain) <= 4 * sum(b.words for b in plain if b.article))
    w = [0, *(b.words for b in page), 0]
    d = [0.0, *(b.density for b in page), 0.0]
    return np.array([[w[k + 1], d[k + 1], w[k], d[k], w[k + 2], d[k + 2], min(b.frame, 1), min(b.article, 1), any_article,
                      b.heading, b.item, b.wrapped] for k, b in enumerate(page)], float).reshape(-1, len(FEATURES))


def labelled_table(n_pages: int = 90, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: statistics and labels of the blocks of ``n_pages`` model pages.

    A model page has a frame (menu, header, notice, advert, sidebar, footer) around an
    article of headings, paragraphs of 1 to 300 words, lists and quotations, with
    adverts, sharing bars, forms and comments inside. A third of the pages name the
    article by element, a third by class, a third not at all; there, menus without a
    name are told by their links. Some pages stand in a layout wrapper with a frame's
    name, some have one inside the article; some small ones are a named part of a frame and no more, or an article and no more. The words are ``art`` and ``frm``, which is the label."""
    rng = np.random.default_rng(seed)
    sizes = [1, 2, 3, 4, 6, 9, 14, 22, 35, 60, 120, 300]

    def say(k: int, mark: str) -> str:
        return " ".join([mark] * k)

    def links(k: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='#'>{say(int(rng.integers(1, 4)), 'frm')}</a></{tag}>" for _ in range(k))

    def paragraph() -> str:
        k = int(rng.choice(sizes))
        linked = int(k * rng.choice([0, 0, 0, 0.1, 0.3])) if k > 8 else 0
        return f"<p>{say(k - linked, 'art')}" + (f" <a href='#'>{say(linked, 'art')}</a>" if linked else "") + "</p>"

    x, y = [], []
    for page in range(n_pages):
        style = page % 3
        inside = [f"<h1>{say(int(rng.integers(1, 14)), 'art')}</h1>"]
        for _ in range(int(rng.integers(1, 10))):
            kind = rng.integers(0, 14)
            if kind == 0:
                inside.append("<ul>" + "".join(f"<li>{say(int(rng.integers(2, 15)), 'art')}</li>" for _ in range(3)) + "</ul>")
            elif kind == 1:
                inside.append(f"<h2>{say(int(rng.integers(1, 9)), 'art')}</h2>")
            elif kind == 2:
                inside.append(f"<div class='ad'>{say(int(rng.choice(sizes[:9])), 'frm')}</div>")
            elif kind == 3:
                inside.append(f"<div class='share'>{links(3, 'span')}</div>")
            elif kind == 4:
                inside.append(f"<form><p>{say(int(rng.choice(sizes[:8])), 'frm')}</p></form>")
            elif kind == 5:
                inside.append(f"<blockquote>{say(int(rng.choice(sizes[3:])), 'art')}</blockquote>")
            else:
                inside.append(paragraph())
        inside.append(paragraph())
        if rng.random() < 0.4:
            inside.append("<section class='comments'>" + "".join(f"<p>{say(int(rng.choice(sizes[:10])), 'frm')}</p>" for _ in range(3)) + "</section>")
        top = [f"<nav><ul>{links(int(rng.integers(2, 9)))}</ul></nav>"] if rng.random() < 0.7 else [f"<div>{links(int(rng.integers(3, 9)), 'div')}</div>"]
        for cls in ("cookie-notice", "ad", "banner"):
            if rng.random() < 0.5:
                top.append(f"<div class='{cls}'>{say(int(rng.choice(sizes[:10])), 'frm')}</div>")
        if rng.random() < 0.5:
            top.insert(0, f"<header><p>{say(int(rng.integers(1, 12)), 'frm')}</p></header>")
        side = f"<aside><h3>{say(2, 'frm')}</h3><p>{say(int(rng.choice(sizes[:10])), 'frm')}</p><ul>{links(4)}</ul></aside>" if rng.random() < 0.5 else ""
        loose = f"<p>{say(int(rng.choice(sizes[:10])), 'frm')}</p>" if style < 2 and rng.random() < 0.4 else ""
        foot = f"<footer>{say(int(rng.choice(sizes[:9])), 'frm')}</footer>"
        holder = (("<article>", "</article>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>"))[style]
        if page % 5 == 4 and style < 2:  # a layout wrapper inside the article
            holder = (f"{holder[0]}<div class='{('content long-form', 'with-sidebar', 'legal-news')[page % 7 % 3]}'>", "</div>" + holder[1])
        whole = "".join(top) + loose + holder[0] + "".join(inside) + holder[1] + side + foot
        if page % 4 == 3:
            whole = f"<div class='{('layout with-sidebar', 'nav-open', 'discussion')[page % 5 % 3]}'>{whole}</div>"
        elif page % 8 == 2:
            whole = "".join(top) + loose + "<section id='discussion'>" + holder[0] + "".join(inside) + holder[1] + "</section>" + side + foot
        found = blocks("<body>" + whole + "</body>")
        x.append(features(found))
        y.extend(b.text.startswith("art") for b in found)
    for page in range(n_pages // 3):
        inner = say(int(rng.choice(sizes[:6])), "frm") if page % 2 else f"<ul>{links(int(rng.integers(1, 9)))}</ul>"
        found = blocks(f"<body><div class='{('menu', 'cookie-notice', 'sidebar')[page % 3]}'>{inner}</div></body>")
        x.append(features(found))
        y.extend([False] * len(found))
        # an article and nothing else, with and without a wrapper
        body = "".join(paragraph() for _ in range(int(rng.integers(1, 5))))
        brief = f"<p>{say(int(rng.choice(sizes[:6])), 'art')}</p>"
        for whole in (body, brief, f"<p>{say(int(rng.choice(sizes[7:])), 'art')}</p>", f"<h1>{say(int(rng.integers(1, 14)), 'art')}</h1><p>{say(int(rng.choice(sizes[7:])), 'art')}</p>{body}"):
            found = blocks(f"<body>{whole}</body>" if whole in (body, brief) else f"<body><div class='has-sidebar'>{whole}</div></body>")
            x.append(features(found))
            y.extend([True] * len(found))
    return np.concatenate(x), np.array(y, float)


@dataclass
class Node:
    """A split (``feature`` <= ``cut`` goes left) or, with no feature, a leaf."""

    share: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 5) -> Node:
    """A tree by Gini impurity; ties go to the first statistic and the lowest cut."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Node(share)
    best, gain = None, 1e-12
    base = len(y) * share * (1 - share)
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        for cut in (u[1:] + u[:-1]) / 2:
            left = x[:, j] <= cut
            a, b = y[left], y[~left]
            if min(len(a), len(b)) < least:
                continue
            g = base - len(a) * a.mean() * (1 - a.mean()) - len(b) * b.mean() * (1 - b.mean())
            if g > gain + 1e-12:
                best, gain = (j, float(cut), left), g
    if best is None:
        return Node(share)
    j, cut, left = best
    return Node(share, j, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


@lru_cache(1)
def default_tree() -> Node:
    return grow(*labelled_table())


def accept(tree: Node, rows: np.ndarray) -> np.ndarray:
    """Whether the tree calls each row article text."""
    out = np.zeros(len(rows), bool)

    def walk(node: Node, at: np.ndarray) -> None:
        if node.feature < 0 or not len(at):
            out[at] = node.share > 0.5
            return
        left = rows[at, node.feature] <= node.cut
        walk(node.left, at[left])
        walk(node.right, at[~left])

    walk(tree, np.arange(len(rows)))
    return out


def main_text(html: str | None, tree: Node | None = None) -> str:
    """The article's blocks, joined by one space."""
    page = blocks(html)
    if not page:
        return ""
    ok = accept(tree or default_tree(), features(page))
    return " ".join(b.text for b, keep in zip(page, ok, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Node | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [src.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    tree = tree or default_tree()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
