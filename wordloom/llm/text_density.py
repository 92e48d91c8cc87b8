"""Main text of web pages by composite text density.

Each page becomes a small tree. For every node the characters per tag are weighed by the share of
linked characters and linked tags; a node's density sum is the sum over its children. The subtree
with the largest sum is the article, and the smallest density on its path to ``body`` is the
threshold that other subtrees must reach to be taken as well.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import id_type, map_batches, pick

# Element names of the HTML standard, and names that page authors give to what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED_TAGS = frozenset(
    "script style noscript template svg iframe object embed canvas audio video button select textarea input option title "
    "map xmp noembed noframes".split()
)
FRAME_TAGS = frozenset("nav aside footer form dialog menu head".split())
FRAME_SHARE = 0.8  # of the text in a frame and outside all frames: a frame that holds more is the page's wrapper
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()
)
DROPPED_NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising adv sponsor sponsored sponsors promo promos "
    "promotion banner banners sidebar sidebars menu menus nav navbar navi navigation breadcrumb breadcrumbs crumbs footer foot "
    "masthead topbar toolbar cookie cookies consent gdpr privacy notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login search share sharing social related recommended recommendations comment comments commentlist "
    "disqus respond reply replies discussion pagination pager skip copyright disclaimer form widget widgets outbrain taboola".split()
)
HEADER_OF = frozenset(("", "site", "page", "top", "main", "global", "web", "blog"))
NEGATIONS = frozenset(("has", "no", "with", "without", "is", "show", "hide"))
CLOSED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
}
SCOPES = frozenset("ul ol dl table select body article section div td th main".split())
FENCES = frozenset(("article", "main", "table"))

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
OPENED = re.compile(r"<!--|<!\[CDATA\[")
UNFINISHED = re.compile(r"<[/!a-zA-Z][^>]*\Z")


def unwanted_name(value: str, exact: bool) -> bool:
    """Whether a class or id says that the element is no part of an article."""
    for name in value.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if not parts or parts[0] in NEGATIONS:
            continue
        if exact:
            if name in DROPPED_NAMES:
                return True
        elif parts[0] in DROPPED_NAMES or parts[-1] in DROPPED_NAMES:
            return True
        elif parts[-1] == "header" and (parts[0] if len(parts) > 1 else "") in HEADER_OF:
            return True
    return False


def unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is never seen as text, and whether its tag, name or role says that it is a frame around the article."""
    if tag in DROPPED_TAGS:
        return True, False
    frame = tag in FRAME_TAGS or tag == "header" and not in_article
    if tag in ("html", "body", "main") or "=" not in attributes and "hidden" not in attributes:
        return False, frame
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(values[0] or values[1] or values[2])
        if name in ("class", "id") and unwanted_name(value, exact=tag == "article"):
            frame = True
        if name == "role" and value.strip().lower() in DROPPED_ROLES:
            frame = True
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return False, frame


class Page:
    """Nodes in page order, so that a node's subtree is a range of numbers, and the texts between them."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.dropped, self.frame, self.ends = ["body"], [-1], [False], [False], [0]
        self.texts: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        self.void_tags: dict[int, int] = {}
        self.stack = [0]
        # Depths in the stack: of each tag, of blocks, of fences, and of what can end or shield an implied end.
        self.open_tags: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.fences: list[int] = []
        self.implied: list[int] = []
        at, size = 0, len(source)
        last = source.rfind(">")  # no tag ends beyond it
        while at < size:
            found = TAG.search(source, at) if at <= last else None
            if found is None:
                rest = max(at, last + 1)
                opened = OPENED.search(source, rest)
                self.text(source[at : opened.start()] if opened else source[at:rest] + UNFINISHED.sub("", source[rest:]))
                break
            if found.start() > at:
                self.text(source[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self.close(tag)
            else:
                self.open(tag, found[3])
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at, last + 1)
                    at = close.end() if close else size
                    self.close(tag)
        while self.stack:
            self.ends[self.stack.pop()] = len(self.tags)
        if any(self.frame):
            self.open_wrappers()
            for node in range(1, len(self.tags)):
                self.dropped[node] = self.dropped[node] or self.frame[node] or self.dropped[self.parents[node]]
            self.texts = [x for x in self.texts if not self.dropped[x[0]]]

    def open_wrappers(self) -> None:
        """Let the densities choose in frames that hold the page's article, or nearly all of its text without links.

        A frame holds the page's article where no ``article`` or ``main`` with text stands outside all frames.
        """
        n = len(self.tags)
        plain, bare = [0] * n, [0] * n  # characters outside links, of the subtree; and those in no further frame
        linked, framed = [False] * n, [False] * n
        for node in range(1, n):
            up = self.parents[node]
            linked[node] = linked[up] or self.tags[node] == "a"
            framed[node] = framed[up] or self.frame[node]
        for node, text in self.texts:
            if text is not None and not linked[node]:
                plain[node] += len(text) - text.count(" ") - text.count("\n")
        bare = list(plain)
        for node in range(n - 1, 0, -1):
            plain[self.parents[node]] += plain[node]
            bare[self.parents[node]] += 0 if self.frame[node] else bare[node]
        articles = [i for i in range(1, n) if self.tags[i] in ("article", "main") and not self.frame[i] and bare[i]]
        inner: dict[int, list[int]] = {}  # of each frame, the frames in it; 0 for the page
        around = [0] * n
        for node in range(1, n):
            up = self.parents[node]
            around[node] = up if self.frame[up] else around[up]
            if self.frame[node]:
                inner.setdefault(around[node], []).append(node)
        holds = set()
        if articles and all(framed[i] for i in articles):
            node = around[max(articles, key=lambda i: (plain[i], -i))]
            while node:
                holds.add(node)
                node = around[node]
        outside = bare[0]
        heap = [(i not in holds, -plain[i], i) for i in inner.get(0, ())]
        heapq.heapify(heap)
        while heap:
            needed, _, node = heapq.heappop(heap)
            if needed and (not plain[node] or plain[node] <= FRAME_SHARE * (plain[node] + outside)):
                break  # the others hold less
            self.frame[node] = False
            outside += bare[node]
            for i in inner.get(node, ()):
                heapq.heappush(heap, (i not in holds, -plain[i], i))

    def text(self, raw: str) -> None:
        node = self.stack[-1]
        if not self.dropped[node]:
            self.texts.append((node, html.unescape(raw) if "&" in raw else raw))

    def marks(self, tag: str) -> list[list[int]]:
        """The lists of depths that an element of this tag stands in."""
        held = [self.open_tags.setdefault(tag, [])]
        if tag in BLOCK:
            held.append(self.blocks)
        if tag in FENCES:
            held.append(self.fences)
        if tag == "p" or tag in CLOSED_BY or tag in SCOPES:
            held.append(self.implied)
        return held

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()
            for depths in self.marks(self.tags[node]):
                depths.pop()
            self.ends[node] = len(self.tags)
            if self.tags[node] in BLOCK and not self.dropped[node]:
                self.texts.append((self.parents[node], None))

    def open(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCK:
            self.end_implied(tag)
        parent = self.stack[-1]
        if tag in VOID:
            self.void_tags[parent] = self.void_tags.get(parent, 0) + 1
            if tag in BLOCK and not self.dropped[parent]:
                self.texts.append((parent, None))
            return
        in_article = bool(self.open_tags.get("article") or self.open_tags.get("main"))
        gone, frame = unwanted(tag, attributes, in_article)
        drop = self.dropped[parent] or gone
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(drop)
        self.frame.append(frame and not drop)
        self.ends.append(0)
        if tag in BLOCK and not self.dropped[parent]:
            self.texts.append((parent, None))
        for depths in self.marks(tag):
            depths.append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def end_implied(self, tag: str) -> None:
        """A block ends an open paragraph; a list item or a cell ends the one before it."""
        closing = CLOSED_BY.get(tag, frozenset())
        at = len(self.implied) - 1
        while at >= 0:
            depth = self.implied[at]
            name = self.tags[self.stack[depth]]
            if name == "p" and tag != "br" or name in closing:
                self.pop_to(depth)
                if not closing:
                    return
            elif name in SCOPES:
                return
            at -= 1

    def close(self, tag: str) -> None:
        depth = (self.open_tags.get(tag) or [0])[-1]
        if not depth:
            return
        if tag not in BLOCK and self.blocks and self.blocks[-1] > depth:
            return  # an inline end tag does not end the block around it
        if self.fences and self.fences[-1] > depth and tag not in ("article", "main", "table", "div", "section"):
            return
        self.pop_to(depth)


def density(chars: int, linked: int, tags: int, linked_tags: int, body_link_share: float) -> float:
    """Characters per tag, adjusted by links: C/T * log_b(C/LC * T/LT), b = ln(C/(C-LC) * LC + LCb/Cb * C + e)."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    inner = math.log(chars / max(linked, 1) * tags / max(linked_tags, 1) + 1)
    base = math.log(chars / max(chars - linked, 1) * linked + body_link_share * chars + math.e)
    return chars / tags * inner / max(math.log(base), 0.1)


def chosen_nodes(page: Page) -> tuple[list[int], float]:
    """Roots of the subtrees taken, in page order, and the density threshold."""
    n = len(page.tags)
    own, chars, linked, tags, linked_tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for node in range(1, n):
        in_link[node] = page.tags[node] == "a" or in_link[page.parents[node]]
    for node, text in page.texts:
        if text is not None:
            own[node] += len(text) - text.count(" ") - text.count("\n")
    for node, count in page.void_tags.items():
        tags[node] += count
    for node in range(n - 1, -1, -1):
        chars[node] += own[node]
        linked[node] += own[node] if in_link[node] else 0
        if node and not page.dropped[node]:
            up = page.parents[node]
            chars[up] += chars[node]
            linked[up] += linked[node]
            tags[up] += tags[node] + 1
            linked_tags[up] += linked_tags[node] + (page.tags[node] == "a")
    share = linked[0] / chars[0] if chars[0] else 0.0
    dense = [density(chars[i], linked[i], tags[i], linked_tags[i], share) for i in range(n)]
    sums = [density(own[i], own[i] if in_link[i] else 0, 1, int(in_link[i]), share) for i in range(n)]
    for node in range(1, n):
        if not page.dropped[node]:
            sums[page.parents[node]] += dense[node]
    best = list(range(n))  # of each subtree, the first node with the largest sum
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        if not page.dropped[node] and sums[best[node]] >= sums[best[up]] and (sums[best[node]] > sums[best[up]] or best[up] != up):
            best[up] = best[node]
    top = best[0]
    threshold, node, article = dense[top], top, -1
    while node > 0:
        threshold = min(threshold, dense[node])
        if page.tags[node] in ("article", "main") and (article < 0 or page.tags[article] == "main"):
            article = node
        node = page.parents[node]
    if article > 0:
        return [article], threshold
    taken, node = [], 1
    if top == 0:
        return [0], threshold
    roots = []
    while node < n:
        if page.dropped[node]:
            node = page.ends[node]
            continue
        if chars[node] and dense[node] >= threshold:
            roots.append(best[node])
        node += 1
    end = -1
    for node in sorted(set(roots)):
        if node >= end:
            taken.append(node)
            end = page.ends[node]
    return taken, threshold


def main_text(source: str | None) -> tuple[str, float]:
    """The article's blocks joined by newlines, and the threshold of the page."""
    if not source or not source.strip():
        return "", 0.0
    page = Page(source)
    roots, threshold = chosen_nodes(page)
    inside = bytearray(len(page.tags))
    for node in roots:
        for i in range(node, page.ends[node]):
            inside[i] = 1
    blocks, parts = [], []
    for node, text in page.texts:
        if text is None:
            if parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        elif inside[node] and not page.dropped[node]:
            parts.append(text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b), threshold


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, threshold``: one row per page row, ids and urls as they are.

    Null, empty and markup-free pages: null and empty give an empty text, plain text is one block.
    Repeated rows are extracted each for itself; an empty table gives no rows; other columns are not read. Narrow: no
    shuffle; a task holds the nodes of one page at a time, and no text is cut.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.col("html").cast("string"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["page_id", "url", "text", "threshold"],
            )

    return map_batches(rows, work, f"page_id {id_type(rows, 'page_id')}, url {id_type(rows, 'url')}, text string, threshold double")
