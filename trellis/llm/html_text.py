"""HTML extraction: minimum-cut labelling of text blocks.

A page is cut into blocks (runs of text between block-level tags).  A linear classifier scores each block; a positive
score is the capacity from the source (the cost of calling the block boilerplate), a negative one the capacity to the
sink (the cost of calling it content).  Smoothness edges join blocks that follow each other, stronger the nearer they
are in the DOM, and a block to the one before it under the same parent.  Maximum flow separates content from
boilerplate: a short line between two paragraphs of the article stays, a link list beside it goes.

Every sign has a finite weight: an article or main speaks for a block about as much as a few lines of prose do, so a short
or link-laden block of an article is decided by its neighbours through the cut.  Elements that are no content by their
name (nav, footer, ...) cost more than text and neighbours can make up for, except that an article or main inside starts
anew; hidden text is out.  What a form holds, or an element whose class or id has a word of boilerplate, has a finite cost; it
is waived as far as such an element holds nearly all the text, as a wrapper does and a sidebar does not.

Defined cases: a null or empty page, and one without content, give an empty text; unclosed and stray tags, cut pages and
broken references are read as browsers mostly do; rows that repeat an id are read each by itself; extra columns are not
read.  Scripts, styles, templates, the head, comments and markup are never text.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Element and class names of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FOREIGN_TAGS = frozenset("svg math".split())
ASIDE_TAGS = frozenset("nav header footer aside menu dialog button select textarea option".split())
FORM_TAGS = frozenset("form fieldset".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead "
    "topbar toolbar footer foot copyright legal disclaimer share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search form pagination pager hidden skip outbrain taboola".split()
)
READER_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion reviews".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())
# What follows these in a name says what stands beside the element, or what a post is about, not what the element is.
BESIDE_WORDS = frozenset("has with no without".split())
TOPIC_WORDS = frozenset("category tag".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/=>"']++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?""")
_NAMED = frozenset("class id role hidden aria-hidden".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HEAD_END = re.compile(r"</head\b[^>]*>?|<body\b", re.I)
#: What a block-level start tag closes: a paragraph, or the item before in a list or table.
_PARAGRAPH = frozenset(["p"])
_IMPLIED = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"p", "option"}}
_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in (*UNSEEN, "title", "textarea")}
_SENTENCE = re.compile(r"[.!?。！？;:,](?:\s|$)")

MAIN, ASIDE, ASIDE_TAG, READER, LIKELY, LINK, HIDDEN = 1, 2, 4, 8, 16, 32, 64
LEVEL = 128  # the number of elements with ASIDE or READER that a block stands in, in units of this


@dataclass(frozen=True)
class Costs:
    """Weights of the classifier and of the smoothness edges."""

    bias: float = -1.0
    main: float = 1.5
    likely: float = 1.5
    aside: float = -14.0
    hidden: float = -60.0
    aside_word: float = -9.0
    reader_word: float = -12.0
    #: The share of the text from which on, and the one where wholly, the cost of a word is waived.
    waive_from: float = 0.6
    waive_at: float = 0.9
    link: float = -4.0
    link_inside: float = -1.5
    length: float = 0.9
    sentence: float = 1.2
    heading: float = 0.6
    adjacent: float = 1.2
    fade: float = 3.0
    sibling: float = 0.6


@dataclass
class Block:
    text: str
    flags: int
    link_chars: int
    depth: int
    up: int  # steps through the DOM from the block before
    parent: int
    tag: str


def _words(tag: str, value: str) -> set[str]:
    """The words of a class or id that say what an element is."""
    names = [[w.lower() for w in _WORD.findall(name)] for name in value.split()]
    skip = BESIDE_WORDS | TOPIC_WORDS if tag in MAIN_TAGS or any(len(n) == 1 and n[0] in MAIN_WORDS for n in names) else BESIDE_WORDS
    return {w for n in names for w in n[: next((k for k, x in enumerate(n) if x in skip), None)]}


def _flags(tag: str, attributes: str, flags: int) -> int:
    """What an element adds to the flags of what it stands in."""
    named: dict[str, str] = {}
    if attributes and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            if name.lower() in _NAMED:
                named.setdefault(name.lower(), "".join(values))
    role = named.get("role", "").strip().lower()
    if tag in MAIN_TAGS or role in ("main", "article"):
        flags = MAIN | flags & (LIKELY | LINK | HIDDEN)
    elif tag in ASIDE_TAGS:
        flags |= ASIDE_TAG
    elif tag == "a":
        flags |= LINK
    if role in ASIDE_ROLES or named.get("aria-hidden", "").strip().lower() == "true":
        flags |= ASIDE_TAG
    if "hidden" in named:
        flags |= HIDDEN
    found = ASIDE if tag in FORM_TAGS or role == "form" else 0
    for name in ("class", "id"):
        if name in named:
            words = _words(tag, named[name])
            if words & READER_WORDS:
                found |= READER
            elif words & ASIDE_WORDS:
                found |= ASIDE
            elif words & MAIN_WORDS:
                flags |= LIKELY
    return (flags | found) + (LEVEL if found else 0)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    # tag, flags, number of the element, where in the stack the nearest block-level element is
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    open_at: dict[str, list[int]] = defaultdict(list)  # of each tag the places in the stack
    parts: list[tuple[str, bool]] = []
    begun = False  # whether the parts hold more than white space
    place = (0, 0, "", 1)  # flags, parent, tag, depth where the block began
    number, lowest, last_depth, at, n = 0, 1, 1, 0, len(page)

    def flush() -> None:
        nonlocal lowest, last_depth, begun
        if begun:
            raw = "".join(p for p, _ in parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                flags, parent, tag, depth = place
                lowest_here = min(lowest, depth)
                linked = sum(len(p) for p, in_link in parts if in_link)
                found.append(Block(text, flags, linked * len(text) // max(1, len(raw)), depth, last_depth + depth - 2 * lowest_here, parent, tag))
                lowest = last_depth = depth
        parts.clear()
        begun = False

    def add(text: str) -> None:
        nonlocal place, begun
        if not begun:
            holder = stack[stack[-1][3]]
            place = (stack[-1][1] & ~LINK, holder[2], holder[0], len(stack))
            begun = not text.isspace()
        parts.append((text, bool(stack[-1][1] & LINK)))

    def cut(k: int) -> None:
        """Close the elements from place k of the stack on."""
        for tag, *_ in stack[k:]:
            open_at[tag].pop()
        del stack[k:]

    while at < n:
        hit = _TOKEN.search(page, at)
        if hit is None:
            add(page[at:])
            break
        if hit.start() > at:
            add(page[at : hit.start()])
        at = hit.end()
        closing, tag, attributes = (hit[1], hit[2], hit[3]) if hit[2] else (hit[4], hit[5], hit[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            k = open_at[tag][-1] if open_at.get(tag) else 0
            if tag not in INLINE:
                flush()
            if k and (tag not in INLINE or k > stack[-1][3]):  # an inline end tag reaches no farther than its block
                cut(k)
        elif tag in VOID:
            if tag == "br":
                add(" ") if parts else None
            elif tag not in INLINE:
                flush()
        else:
            if tag not in INLINE:
                flush()
                k = stack[-1][3]
                if k and stack[k][0] in _IMPLIED.get(tag, _PARAGRAPH):
                    cut(k)
            lowest = min(lowest, len(stack))
            if tag in _END:
                if not (attributes.endswith("/") and tag in FOREIGN_TAGS):  # HTML itself has no self-closing form
                    end = _END[tag].search(page, at)
                    at = end.end() if end else n
                continue
            if tag == "head":
                end = _HEAD_END.search(page, at)
                at = end.start() if end else n
                continue
            number += 1
            open_at[tag].append(len(stack))
            stack.append((tag, _flags(tag, attributes, stack[-1][1]), number, stack[-1][3] if tag in INLINE else len(stack)))
        lowest = min(lowest, len(stack))
    flush()
    return found


def waived(found: list[Block], costs: Costs) -> list[float]:
    """The share of the cost of words that is waived for each block.

    It depends on how much of the text, that of articles if there is any, stands in as many elements with such words.
    """
    rated = [b for b in found if not b.flags & (ASIDE_TAG | HIDDEN)]
    articles = any(b.flags & MAIN for b in rated)
    rated = [b for b in rated if b.flags & MAIN] if articles else rated
    at_least: dict[int, int] = {}
    total = 0
    for b in sorted(rated, key=lambda b: -(b.flags // LEVEL)):
        total += len(b.text) - b.link_chars
        at_least[b.flags // LEVEL] = total
    out = []
    for b in found:
        share = at_least.get(b.flags // LEVEL, 0) / max(1, total) if b.flags & MAIN or not articles else 0.0
        out.append(min(1.0, max(0.0, (share - costs.waive_from) / (costs.waive_at - costs.waive_from))))
    return out


def score(block: Block, costs: Costs, waive: float = 0.0) -> float:
    """Log-odds that a block is content."""
    if block.flags & HIDDEN:
        return costs.hidden
    n = len(block.text)
    out = costs.bias + costs.length * math.log1p(n / 20) + (costs.link_inside if block.flags & MAIN else costs.link) * block.link_chars / n
    out += costs.sentence * min(3, len(_SENTENCE.findall(block.text))) / 3
    if block.flags & MAIN:
        out += costs.main
    elif block.flags & LIKELY:
        out += costs.likely
    if block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        out += costs.heading
    if block.flags & ASIDE_TAG:
        out += costs.aside
    elif block.flags & READER:
        out += costs.reader_word * (1 - waive)
    elif block.flags & ASIDE:
        out += costs.aside_word * (1 - waive)
    return out


def min_cut(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut (Dinic's maximum flow)."""
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(there)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        if source[i] > 0:
            link(s, i, source[i], 0.0)
        if sink[i] > 0:
            link(i, t, sink[i], 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(head[a]):
                path.append(head[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def smooth_edges(found: list[Block], costs: Costs) -> list[tuple[int, int, float]]:
    edges, before = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, costs.adjacent * math.exp(-b.up / costs.fade)))
        if before.get(b.parent, i - 1) < i - 1:
            edges.append((before[b.parent], i, costs.sibling))
        before[b.parent] = i
    return edges


def cut_by_parts(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut.

    A node whose score outweighs all its edges has its side in any minimum cut; its edges then are terminal capacities of
    its neighbours.  What remains open falls into parts, and maximum flow decides each.
    """
    n, scores = len(scores), list(scores)
    beside: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        beside[a].append((b, w))
        beside[b].append((a, w))
    weight = [sum(w for _, w in x) for x in beside]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is not None or -weight[i] < scores[i] <= weight[i]:
            continue
        side[i] = scores[i] > weight[i]
        for j, w in beside[i]:
            if side[j] is None:
                scores[j] += w if side[i] else -w
                weight[j] = max(0.0, weight[j] - w)
                todo.append(j)
    for first in range(n):
        if side[first] is not None:
            continue
        part, at = [first], {first: 0}
        for i in part:
            for j, _ in beside[i]:
                if side[j] is None and j not in at:
                    at[j] = len(part)
                    part.append(j)
        inner = [(at[i], at[j], w) for i in part for j, w in beside[i] if j in at and i < j]
        kept = min_cut(len(part), [max(0.0, scores[i]) for i in part], [max(0.0, -scores[i]) for i in part], inner)
        for i, good in zip(part, kept, strict=True):
            side[i] = good
    return [bool(x) for x in side]


def label(found: list[Block], costs: Costs) -> list[bool]:
    """Which blocks are content."""
    scores = [score(b, costs, w) for b, w in zip(found, waived(found, costs), strict=True)]
    return cut_by_parts(scores, smooth_edges(found, costs))


def main_text(page: str | None, costs: Costs = Costs()) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, good in zip(found, label(found, costs), strict=True) if good)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", costs: Costs = Costs()) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    source = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].cast("string").alias("html"))
    kinds = source.schema
    schema = f"`{id_col}` {kinds['id'].dataType.simpleString()}, `{url_col}` {kinds['url'].dataType.simpleString()}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [main_text(page, costs) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return source.mapInArrow(run, schema)
