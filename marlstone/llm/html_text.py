"""Main text of web pages by composite text density.

A page is parsed into its block elements; inline markup counts as tags of the
block it is in. The density of a node is its characters per tag, adjusted for the
share of link text; the density sum of a node adds up its children's densities.
The node with the greatest sum holds the article, or the outermost article or
main element around it. Without such an element, the article may be in several
containers: the least density on the path to the body is the threshold for all
nodes from the body down, and the node with the greatest sum in each that reaches
it is part of the article.

Elements that are menus, forms and the like by their tag, role or hidden state are
set apart. Class and id names are evidence only: what holds an article element is
never set apart by them, doubtful names count only where the density is below the
article's, and where names would leave next to no text, those around the densest
text are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that start and end a block (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page (fixed values).
HIDDEN = frozenset("head script style title noscript template iframe object svg math canvas audio video noframes".split())
#: Elements read as raw text up to their end tag (fixed values).
RAW = frozenset("script style title textarea noscript iframe noframes xmp".split())
#: Elements that are never part of an article (fixed values).
APART = frozenset("nav footer aside form button select textarea menu dialog search".split())
#: Parts of class and id names that mark menus, notices, adverts, comments and the like (fixed values).
APART_NAMES = frozenset(
    "ad ads adbox adsbox adsbygoogle adslot advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus discussion "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Of these, those that also name parts of articles (fixed values).
DOUBTFUL_NAMES = frozenset("discussion related reply replies respond search".split())
#: Parts that say of an element what is beside it or not there, so the other parts name something else (fixed values).
LAYOUT_NAMES = frozenset("has no with without hide show layout".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Start tags that end an open element of the second set, unless one of the third is open within (HTML's optional end tags; fixed values).
CLOSES = (
    (frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()), frozenset(["p"]), frozenset("button table td th caption object".split())),
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu".split())),
    (frozenset("dd dt".split()), frozenset("dd dt".split()), frozenset(["dl"])),
    (frozenset("td th".split()), frozenset("td th".split()), frozenset(["tr", "table"])),
    (frozenset("tr tbody tfoot thead".split()), frozenset("tr".split()), frozenset(["table"])),
    (frozenset("option optgroup".split()), frozenset(["option"]), frozenset(["select"])),
)
_ENDED_BY: dict[str, list[tuple[frozenset, frozenset]]] = {}
for _starts, _ends, _within in CLOSES:
    for _tag in _starts:
        _ENDED_BY.setdefault(_tag, []).append((_ends, _within))

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/](?:[^>]*>|[^>]*\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WHITE = re.compile(r"[\x20\x09-\x0D]+")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: The least share of the page's text outside links that names may leave.
LEAST_LEFT = 0.1
SURE, DOUBTFUL = 2, 1


def _evidence(tag: str, attributes: str) -> tuple[bool, int]:
    """(set apart by tag, role or hidden state; SURE, DOUBTFUL or 0 by class and id names)."""
    apart, named = tag in APART, 0
    if not attributes:
        return apart, named
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if tag not in ("body", "html", "article", "main"):
                for word in value.split():
                    parts = {x.lower() for x in NAME_PARTS.findall(word)}
                    if LAYOUT_NAMES.isdisjoint(parts):
                        named = max(named, SURE if parts & APART_NAMES - DOUBTFUL_NAMES else DOUBTFUL if parts & DOUBTFUL_NAMES else 0)
        elif name == "role":
            apart |= value.lower() in APART_ROLES
        elif name == "style":
            apart |= UNSEEN_STYLE.search(value) is not None
        else:
            apart |= name == "hidden" or value.lower() == "true"
    return apart, named


class Page:
    """The blocks of a page in page order, and inline elements that may be set apart; node 0 is the document."""

    def __init__(self, source: str):
        self.tag, self.parent, self.apart, self.named, self.last = ["#document"], [-1], [False], [0], [0]
        self.chars, self.tags, self.link_chars, self.link_tags, self.direct = [0], [0], [0], [0], [0]
        #: (node, number of the block run, text)
        self.pieces: list[tuple[int, int, str]] = []
        self._parse(source)
        self._judge_names()

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, int]] = []  # tag, node it belongs to, node of its parent
        node, run, links, hidden, at = 0, 0, 0, 0, 0
        opened: dict[str, int] = {}
        size = len(source)

        def close(count: int) -> None:
            nonlocal node, run, links, hidden
            for _ in range(count):
                tag, own, before = stack.pop()
                opened[tag] -= 1
                if tag == "a":
                    links -= 1
                if tag in HIDDEN:
                    hidden -= 1
                if own != before:
                    self.last[own] = len(self.tag)
                    node = before
                    run += tag in BLOCKS

        while at < size:
            found = TOKEN.search(source, at)
            upto = found.start() if found else size
            if upto > at and not hidden:
                self._text(node, run, links, source[at:upto])
            if not found:
                break
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                if not opened.get(tag):
                    continue
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        close(len(stack) - depth)
                        break
                    if stack[depth][0] in ("td", "th", "table", "article", "main", "body") and tag not in BLOCKS:
                        break
                continue
            if not found[0].endswith(">"):
                break
            for ends, within in _ENDED_BY.get(tag, ()):
                if not any(opened.get(t) for t in ends):
                    continue
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in ends:
                        close(len(stack) - depth)
                        break
                    if stack[depth][0] in within:
                        break
            if tag == "br":
                if not hidden:
                    self._text(node, run, 0, " ")
            if tag in BLOCKS:
                run += 1
            if tag == "body" and hidden and any(t == "head" for t, *_ in stack):
                close(len(stack) - next(k for k, (t, *_) in enumerate(stack) if t == "head"))
            self.tags[node] += 1
            self.link_tags[node] += tag == "a"
            if tag in VOID:
                continue
            closed = found[3].endswith("/") and tag in ("svg", "math", "path")
            if closed:
                continue
            before = node
            apart, named = _evidence(tag, found[3])
            if tag in BLOCKS or apart or named:
                node = len(self.tag)
                self.tag.append(tag)
                self.parent.append(before)
                self.apart.append(self.apart[before] or apart or tag == "header")
                self.named.append(named)
                self.last.append(node + 1)
                for numbers in (self.chars, self.tags, self.link_chars, self.link_tags, self.direct):
                    numbers.append(0)
            links += tag == "a"
            hidden += tag in HIDDEN
            stack.append((tag, node, before))
            opened[tag] = opened.get(tag, 0) + 1
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else size
                if not hidden:
                    self._text(node, run, links, source[at:stop])
                at = stop
        close(len(stack))
        self.last[0] = len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            up = self.parent[k]
            for numbers in (self.chars, self.tags, self.link_chars, self.link_tags):
                numbers[up] += numbers[k]

    def _judge_names(self) -> None:
        """Sets apart what names say, as far as the text agrees."""
        if not any(self.named):
            return
        holds = [t in ("article", "main") for t in self.tag]
        for k in range(len(self.tag) - 1, 0, -1):
            holds[self.parent[k]] |= holds[k]
        density = self.densities()
        best = self.article()
        bar = density[best]
        sure = [k for k, n in enumerate(self.named) if n and not holds[k] and (n == SURE or density[k] < bar)]
        before = list(self.apart)
        whole = self._left([], before)
        if self._left(sure, before) < LEAST_LEFT * whole:
            around = set(self._path(best))
            self._left([k for k in sure if k not in around], before)

    def _left(self, more: list[int], before: list[bool]) -> int:
        """Sets apart what was so before, and the nodes in more; returns the characters outside links that are left."""
        apart, left = list(before), 0
        for k in more:
            apart[k] = True
        plain = [c - lc for c, lc in zip(self.chars, self.link_chars)]
        for k in range(1, len(apart)):
            up = self.parent[k]
            if apart[k] and not apart[up]:
                left -= plain[k]
            apart[k] |= apart[up]
        self.apart = apart
        return plain[0] + left

    def _text(self, node: int, run: int, links: int, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((node, run, text))
        solid = len(text) - sum(map(len, WHITE.findall(text))) if not text.isspace() else 0
        self.chars[node] += solid
        self.direct[node] += solid
        if links:
            self.link_chars[node] += solid

    def densities(self) -> list[float]:
        """Composite text density of every node."""
        body_share = self.link_chars[0] / (self.chars[0] + 1)
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags):
            if not c:
                out.append(0.0)
                continue
            t = max(t, 1)
            linked = c / (c - lc + 1) * lc + body_share * c
            ratio = c / (lc + 1) * t / (lt + 1)
            out.append(c / t * max(0.0, math.log(ratio)) / math.log(math.log(linked + math.e) + math.e - 1) if ratio > 0 else 0.0)
        return out

    def _sums(self, density: list[float]) -> list[float]:
        """Density sum of every node."""
        total = [0.0] * len(self.tag)
        leaf = [True] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            if leaf[k]:
                total[k] = density[k]
            else:
                total[k] += self.direct[k]
            if not self.apart[k]:
                total[self.parent[k]] += density[k]
            leaf[self.parent[k]] = False
        total[0] = total[0] + self.direct[0] if not leaf[0] else density[0]
        return total

    def _path(self, k: int) -> list[int]:
        """k and the nodes around it, the document last."""
        path = []
        while k >= 0:
            path.append(k)
            k = self.parent[k]
        return path

    def article(self) -> int:
        """The node whose subtree holds the article's densest part."""
        total = self._sums(self.densities())
        best = 0
        for k in range(1, len(total)):
            if not self.apart[k] and total[k] > total[best]:
                best = k
        return next((k for k in reversed(self._path(best)) if self.tag[k] in ("article", "main")), best)

    def _reaches(self, k: int, least: int, density: list[float]) -> bool:
        """Whether k is as dense as the node least. As densities grow with size, it is enough to have as many characters a tag and no larger share of link text."""
        if density[k] >= density[least] > 0:
            return True
        longer = self.chars[k] * max(1, self.tags[least]) >= self.chars[least] * max(1, self.tags[k])
        return density[k] > 0 and longer and self.link_chars[k] * self.chars[least] <= self.link_chars[least] * self.chars[k]

    def contents(self) -> list[bool]:
        """Whether each node is in the article."""
        top = self.article()
        kept = [False] * len(self.tag)
        kept[top] = True
        if self.tag[top] not in ("article", "main"):
            density = self.densities()
            total = self._sums(density)
            path = self._path(top)
            if "body" in (names := [self.tag[k] for k in path]):
                path = path[: names.index("body") + 1]
            least = min((k for k in path if density[k] > 0), key=density.__getitem__, default=path[0])
            peak = list(range(len(self.tag)))
            for k in range(len(self.tag) - 1, 0, -1):
                up = self.parent[k]
                if not self.apart[k] and total[peak[k]] >= total[peak[up]]:
                    peak[up] = peak[k]
            reached = [False] * len(self.tag)
            for k in range(path[-1], self.last[path[-1]]):
                reached[k] = (k == path[-1] or reached[self.parent[k]]) and not self.apart[k] and self._reaches(k, least, density)
                if reached[k]:
                    kept[peak[k]] = True
        for k in range(1, len(kept)):
            kept[k] = (kept[k] or kept[self.parent[k]]) and not self.apart[k]
        return kept

    def text(self) -> str:
        """The article's blocks, one a line."""
        kept = self.contents()
        blocks: list[str] = []
        current, parts = -1, []
        for node, run, text in self.pieces:
            if kept[node]:
                if run != current:
                    blocks.append("".join(parts))
                    current, parts = run, []
                parts.append(text)
        blocks.append("".join(parts))
        clean = (WHITE.sub(" ", b).strip(" ") for b in blocks)
        return "\n".join(b for b in clean if b)


def extract(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, and pages without text, give an empty text. Any markup is
    parsed, however broken, cut off or long. Repeated rows each get a row; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
