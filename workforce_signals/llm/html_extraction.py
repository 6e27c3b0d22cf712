"""Main text of web pages by tree scoring.

A page becomes a light tree of its elements. Every paragraph earns points for its length and its commas and passes
them to its ancestors, less with every level; a container's points are discounted by the share of its text that
stands in links. The article around the best container is kept, or the container with its siblings, without furniture
and menus, and the blocks are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.arrays import text_chunks
from workforce_signals.llm.workers import map_batches

# Points: one per so many characters up to a limit, one per comma, one for a paragraph that is not tiny.
CHARS_A_POINT, MOST_FOR_LENGTH, TINY = 100, 3.0, 25
# Inside the kept text, a list or box is a menu if so much of its text is links, and so many of them; any sibling of the
# best container likewise.
MENU_LINKS, MENU_COUNT = 0.6, 3

# A marked element stays if it holds more than this share of the points; the best container gives way to an ancestor that has
# this much more beside it. Points from which a marked section counts as text, and its greatest share of links.
MOST, BESIDE, TEXTUAL, TEXT_LINKS = 0.5, 0.3, 3.0, 0.25

# Names of HTML elements by their role, attribute words, and commas of some scripts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title|xmp|noembed|noframes|select"
DROPPED = frozenset("nav header footer aside button dialog menu head audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "html body main article section div p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "h1 h2 h3 h4 h5 h6 address figure figcaption fieldset legend xmp hgroup center details summary hr".split()
) | DROPPED | {"form"}
BOXES = frozenset("div section ul ol dl table center details figure".split())
KEPT = frozenset("html body main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside related recommended share sharing social notice cookie "
    "cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments "
    "disqus discussion respond replies pagination pager widget toolbar skip hidden".split()
)
# With one of these beside it, a header is an article's own.
ARTICLE_WORDS = frozenset("article content entry page post section story title".split())
HEADER_WORDS = frozenset("header masthead banner".split())
COMMAS = ",،、，"
# What a start tag closes if it is open, and the elements that limit the search for it.
CLOSES = {
    "li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("tr td th thead tbody", ("table",)),
    "option": ("option", ("select",)),
}

# Quotes count after an equals sign only. A tag, comment or script that never ends takes the rest of the page.
_ATTRS = r"""(?:[^>=]|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<says>{_ATTRS})(?:>(?P<inside>.*?)(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


# How sure it is that an element is page furniture.
PLAIN, ANCHOR, WEAK, STRONG, CERTAIN = range(5)


def _standing(name: str, attributes: str) -> int:
    """CERTAIN by its name, role or being hidden; STRONG if a whole class or id is made of furniture words, WEAK if a part of one is;
    ANCHOR if only a part of the id of a section or heading is."""
    if name in DROPPED:
        return CERTAIN
    if name in KEPT:
        return PLAIN
    found = WEAK if name == "form" else PLAIN
    for attribute in _ATTRIBUTE.finditer(attributes):
        what, value = attribute[1].lower(), (attribute[2] or "").strip("\"'")
        if what in ("class", "id"):
            for token in value.split():
                parts = [w.lower() for w in _PARTS.split(token) if w]
                marks = [w for w in parts if w in WORDS]
                if not marks or name in HEADINGS or not HEADER_WORDS.isdisjoint(marks) and not ARTICLE_WORDS.isdisjoint(parts):
                    continue
                whole = all(w in WORDS or w.isdigit() for w in parts)
                found = max(found, STRONG if whole else ANCHOR if what == "id" and name == "section" else WEAK)
        elif what == "role" and value.lower() in ROLES or what == "hidden" and value.lower() != "until-found":
            return CERTAIN
        elif what == "aria-hidden" and value.lower() == "true" or what == "style" and _HIDDEN.search(value):
            return CERTAIN
    return found


class Page:
    """Elements in page order with their parents, and the text between the tags."""

    def __init__(self, html: str):
        self.names, self.parents, self.dropped, self.standing = ["#page"], [-1], [False], [PLAIN]
        self.pieces: list[tuple[int, str]] = []  # (element, text); "" begins a new block
        stack, opened, place = [0], {"#page": 1}, 0
        for token in _TOKEN.finditer(html):
            if token.start() > place:
                self.pieces.append((stack[-1], unescape(html[place : token.start()])))
            place = token.end()
            name = token["name"]
            if name is None:
                if token["raw"] and token["raw"].lower() == "xmp":
                    self._listing(stack, opened, token["says"], token["inside"] or "")
                continue
            name = name.lower()
            if token["end"]:
                if name == "br":
                    self.pieces.append((stack[-1], " "))
                elif opened.get(name):
                    self._close(stack, opened, name)
                    if name in BLOCKS:
                        self.pieces.append((stack[-1], ""))
                continue
            if name in BLOCKS and opened.get("p"):
                self._close(stack, opened, "p")
            if name in CLOSES:
                ends, limits = CLOSES[name]
                for end in ends.split():
                    if opened.get(end) and self._within(stack, end, limits):
                        self._close(stack, opened, end)
            if name in ("br", "hr"):
                self.pieces.append((stack[-1], " " if name == "br" else ""))
            if name in VOID:
                continue
            node = len(self.names)
            self.names.append(name)
            self.parents.append(stack[-1])
            self._judge(stack[-1], name, token["attrs"])
            if not token["attrs"].endswith("/") or name not in ("path", "use"):
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1
            if name in BLOCKS:
                self.pieces.append((node, ""))
        if place < len(html):
            self.pieces.append((stack[-1], unescape(html[place:])))

    def _judge(self, parent: int, name: str, attributes: str) -> None:
        standing = _standing(name, attributes) if attributes or name in DROPPED or name == "form" else PLAIN
        self.standing.append(standing)
        self.dropped.append(self.dropped[parent] or standing == CERTAIN)

    def _listing(self, stack: list[int], opened: dict[str, int], attributes: str, text: str) -> None:
        """An element whose text is shown letter by letter, tags and all."""
        if opened.get("p"):
            self._close(stack, opened, "p")
        node = len(self.names)
        self.names.append("xmp")
        self.parents.append(stack[-1])
        self._judge(stack[-1], "xmp", attributes)
        self.pieces += [(node, ""), (node, text), (stack[-1], "")]

    def _within(self, stack: list[int], name: str, limits: tuple[str, ...]) -> bool:
        for node in reversed(stack):
            if self.names[node] == name:
                return True
            if self.names[node] in limits:
                return False
        return False

    def _close(self, stack: list[int], opened: dict[str, int], name: str) -> None:
        while len(stack) > 1:
            last = self.names[stack.pop()]
            opened[last] -= 1
            if last == name:
                return

    def _shares(self) -> list[float]:
        """The points that every paragraph has to pass on."""
        found = [0.0] * len(self.names)
        for i, size in enumerate(self.length):
            if size and not self.dropped[i]:
                share = self.commas[i] + min(size / CHARS_A_POINT, MOST_FOR_LENGTH) + (size >= TINY)
                found[i] = share * (1 - self.linked[i] / size)
        return found

    def _sums(self, values: list) -> list:
        """Of every element with all that is in it."""
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def _drop_marked(self) -> bool:
        """Drops what words mark as furniture; tells whether there was any."""
        if not any(PLAIN < s < CERTAIN and not d for s, d in zip(self.standing, self.dropped, strict=True)):
            return False
        mass, length, linked = self._sums(self._shares()), self._sums(self.length), self._sums(self.linked)
        titles = self._sums([int(name in ("article", "main", "h1") and not d) for name, d in zip(self.names, self.dropped, strict=True)])
        for i in range(1, len(self.names)):
            if self.dropped[self.parents[i]]:
                self.dropped[i] = True
            elif PLAIN < self.standing[i] < CERTAIN and not self.dropped[i]:
                most = mass[i] > MOST * mass[0] and (self.standing[i] < STRONG or titles[i] > 0)
                text = self.standing[i] == ANCHOR and mass[i] >= TEXTUAL and linked[i] <= TEXT_LINKS * length[i]
                self.dropped[i] = not most and not text
        return True

    def _measure(self) -> None:
        """Drops marked elements and measures the length, link length, link count and points of every other one."""
        self._paragraphs()
        if self._drop_marked():
            self._paragraphs()
        self._score()

    def _paragraphs(self) -> None:
        n = len(self.names)
        self.block, self.link, inner = list(range(n)), [name == "a" for name in self.names], [False] * n
        for i in range(1, n):
            p = self.parents[i]
            self.link[i] = self.link[i] or self.link[p]
            if self.names[i] in BLOCKS:
                if not self.dropped[i]:
                    inner[self.block[p]] = True
            else:
                self.block[i] = self.block[p]
        self.length, self.linked, self.commas = [0] * n, [0] * n, [0] * n
        for node, text in self.pieces:
            if text and not self.dropped[node]:
                b, size = self.block[node], len(" ".join(text.split()))
                self.length[b] += size
                self.commas[b] += sum(text.count(c) for c in COMMAS)
                if self.link[node]:
                    self.linked[b] += size
        self.inner = inner

    def _score(self) -> None:
        n, shares = len(self.names), self._shares()
        self.links = [name == "a" and not d for name, d in zip(self.names, self.dropped, strict=True)]
        self.points = [25.0 if name in ("article", "main") and not d else 0.0 for name, d in zip(self.names, self.dropped, strict=True)]
        self.takes = [p > 0 for p in self.points]
        for i in range(n):
            if self.length[i] and not self.dropped[i]:
                to, level = (i if self.inner[i] or i == 0 else self.parents[i]), 0
                while to >= 0 and level < 6:
                    if self.block[to] == to:
                        self.points[to] += shares[i] / (1, 2, 6, 9, 12, 15)[level]
                        self.takes[to] = True
                        level += 1
                    to = self.parents[to]
        self.mass = self._sums(shares)
        self.length, self.linked, self.links = self._sums(self.length), self._sums(self.linked), self._sums(self.links)

    def _density(self, i: int) -> float:
        return self.linked[i] / self.length[i] if self.length[i] else 0.0

    def _widened(self, best: int) -> int:
        """The outermost article or main around the best container, else the farthest ancestor that holds much more text."""
        above, node = best, best
        while node > 0:
            node = self.parents[node]
            if self.names[node] in ("article", "main"):
                above = node
        if above != best or self.names[best] in ("article", "main"):
            return above
        node = best
        while (node := self.parents[node]) > 0 and self.names[node] not in KEPT:
            if self.mass[node] - self.mass[best] >= BESIDE * self.mass[best]:
                best = node
        return best

    def main_text(self) -> str:
        self._measure()
        n = len(self.names)
        score = [self.points[i] * (1 - self._density(i)) if self.takes[i] else 0.0 for i in range(n)]
        best = max((i for i in range(n) if self.takes[i] and not self.dropped[i] and self.length[i]), key=lambda i: (score[i], -i), default=0)
        best = self._widened(best)
        kept = [False] * n
        kept[best] = True
        up = self.parents[best] if self.names[best] not in ("article", "main") else -1
        if up >= 0:
            kept[up] = True
        for i in range(1, n):
            p = self.parents[i]
            if kept[p] and i != best:
                menu = (self.names[i] in BOXES or p == up) and self.links[i] >= MENU_COUNT and self._density(i) > MENU_LINKS
                kept[i] = not self.dropped[i] and not menu
        blocks, now, last = [], [], None
        for node, text in self.pieces:
            if text == "" or self.block[node] != last:
                blocks.append("".join(now))
                now, last = [], self.block[node]
            if text and kept[node] and not self.dropped[node]:
                now.append(text)
        blocks.append("".join(now))
        return " ".join(w for b in blocks for w in b.split())


def main_text(html: str) -> str:
    """The article of a page as blocks in page order, one space between words and between blocks."""
    return Page(html).main_text() if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "_html"]
        for a, b, pages in text_chunks(batch.column("_html")):
            texts = pa.array([main_text(h) for h in pages], pa.string())
            yield pa.record_batch([*(batch.column(n).slice(a, b - a) for n in names), texts], names=[*names, "text"])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (code points) of every page.

    Without markup the whole text is the main text. NULL and empty pages have an empty text. Unclosed and
    misplaced tags are read as browsers do in the common cases; an open comment or script hides the rest of
    the page. Rows are neither merged nor dropped; other columns are left out, also one named ``text``.
    """
    narrow = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html).alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_html")
    found = map_batches(narrow, _extract, f"{kinds}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
