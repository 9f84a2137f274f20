"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

# Element names by role, and words of class, id and role attributes.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg audio video canvas noembed noframes annotation annotation-xml".split())
SKIPPED = frozenset("head title select option datalist".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset search dir".split())
CLOSES_P = BLOCK - frozenset("body html head title option optgroup".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SIBLING_STOPS = frozenset("ul ol dl table select menu".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising alert banner bottombar breadcrumb breadcrumbs byline captcha comment comments commentlist consent contentinfo cookie cookies copyright complementary discussion disqus donate footer footnav form gdpr header login logo masthead menu menubar meta modal nav navbar navigation navigation-menu newsletter notice notification pager pagination paywall popup promo promoted promotion recommended register related replies reply respond search share sharing sidebar signup site-info skip skiplink social sponsor sponsored subscribe subscription tags toc toolbar topbar trending warning widget".split())
#: Words that only say where a part is or what shape it has: a name of several words is a bad one if one is bad and all others are bad or of these.
PLACE_WORDS = frozenset("area article bar block body bottom box btn button buttons col column container content desktop entry floating form global group holder horizontal icon icons inline inner item items left line link links list lists main menu mobile outer page panel post primary right row secondary section site slot small sticky story sub text title top vertical wrap wrapper".split())
GOOD_WORDS = frozenset("article articlebody body content entry main maintext post postbody story text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z!?][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")


def bad_names(text: str) -> int:
    """How many different bad words the names of an attribute have. A name of one word must be a bad one; of several words (joined by hyphens, underscores or digits) one must be
    bad and the others too, or say a place: `comment-list` and `site-footer` are parts of a page, `comments-open` and `category-social` say something about an article."""
    found = set()
    for name in text.split():
        words = WORD.findall(name)
        if name in BAD_WORDS:
            found.add(name)
        elif words and all(w in BAD_WORDS or w in PLACE_WORDS for w in words):
            found.update(w for w in words if w in BAD_WORDS)
    return len(found)


#: Strength of the edges between neighbouring blocks and between blocks of one parent.
SMOOTH, PROXIMITY, SCALE = 0.6, 0.4, 1000


@dataclass
class Element:
    tag: str
    depth: int
    parent: Element | None
    content: float = 0.0
    boilerplate: float = 0.0
    in_article: bool = False


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _element(tag: str, attributes: str, parent: Element | None) -> Element:
    """Evidence that an element gives for all blocks inside it adds to that of its ancestors."""
    e = Element(tag, parent.depth + 1 if parent else 0, parent)
    if parent:
        e.content, e.boilerplate, e.in_article = parent.content, parent.boilerplate, parent.in_article
    if tag in ("article", "main"):
        e.content, e.in_article = max(e.content, 4.0), e.in_article or tag == "article"
    elif tag in BOILERPLATE_TAGS or tag == "header":
        e.boilerplate += 8.0
    elif tag in ("h1", "h2", "h3") and e.in_article and parent and parent.tag in ("header", "hgroup") and parent.boilerplate == 8.0:
        e.boilerplate = 0.0
    if attributes and not attributes.isspace():
        for name, *value in ATTRIBUTE.findall(attributes):
            name, text = name.lower(), "".join(value).lower()
            if name in ("class", "id", "role", "itemprop") and tag not in ("body", "html"):
                e.boilerplate += 7.0 * bad_names(text)
                if tag not in ("p", "span", "a") and GOOD_WORDS.intersection(WORD.findall(text)):
                    e.content = max(e.content, 2.5)
            elif name == "hidden" or name == "aria-hidden" and text == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", text):
                e.boilerplate += 9.0
    return e


def parse(page: str) -> list[Block]:
    """Blocks of visible text in page order, with white space collapsed and character references decoded; unclosed elements end where their parents do."""
    root = Element("#root", 0, None)
    stack, out, links = [root], [], 0
    block: Block | None = None
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and stack[-1].tag not in SKIPPED and not any(e.tag in SKIPPED for e in stack[-2:]):
            if block is None:
                block = Block(stack[-1])
                out.append(block)
            block.parts.append(text)
            block.linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if tag in BLOCK or tag == "br":
            if tag == "br":
                if block is not None:
                    block.parts.append(" ")
            else:
                block = None
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:  # an inline end tag closes nothing beyond its block
                    break
            continue
        if tag == "xmp" and not closing:  # its text is literal
            end = re.compile(r"</xmp\s*>", re.I).search(page, at)
            out.append(Block(stack[-1], [html.escape(page[at : end.start() if end else n])]))
            at, block = end.end() if end else n, None
            continue
        if tag in RAW:
            if not (attributes or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    links = 0
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SIBLING_STOPS:
                    break
        if tag == "a":
            links += 1
        if not (attributes or "").rstrip().endswith("/") or tag in BLOCK:
            parent = stack[-1]
            stack.append(_element(tag, attributes or "", parent) if tag in BLOCK or attributes else Element(tag, parent.depth, parent, parent.content, parent.boilerplate, parent.in_article))
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def costs(b: Block) -> tuple[float, float]:
    """Terminal capacities: what it costs to call the block boilerplate, and to call it content."""
    e, size = b.element, len(b.text)
    content, boilerplate = e.content, e.boilerplate
    content += 1.0  # what nothing speaks against is content
    density = min(1.0, b.linked / max(1, sum(map(len, b.parts))))
    tag = e.tag
    if density > 0.5:
        boilerplate += 2.5 * density
    if tag in ("p", "blockquote", "pre", "dd") or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        content += 1.0
    content += min(2.0, size / 150) * (1 - density)
    if size < 40:
        boilerplate += 0.8
    if not e.in_article and size < 25 and b.text[-1] not in ".!?:":
        boilerplate += 0.7
    if not e.in_article and re.match(r"(©|\(c\)|copyright\b|all rights reserved)", b.text, re.I):
        boilerplate += 4.0
    return content, boilerplate


def _near(a: Element, b: Element) -> bool:
    """Whether two blocks have one parent."""
    pa_, pb = a.parent if a.tag in BLOCK else a, b.parent if b.tag in BLOCK else b
    return pa_ is pb


def min_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the content side of a minimum cut, by blocking flows in rounds of rising distance (Dinic).

    What flows through one node from source to sink is sent first; only the rest needs paths over edges. A round sends all shortest paths at
    once, so long pages of many short paths take few rounds.
    """
    n = len(content)
    left = [round((c - b) * SCALE) for c, b in zip(content, boilerplate, strict=True)]
    give, take = [max(0, x) for x in left], [max(0, -x) for x in left]
    arcs: list[list[int]] = [[] for _ in range(n)]  # arcs 2k and 2k + 1 are the two ways of an edge
    to, cap = [], []
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            arcs[x].append(len(to))
            to.append(y)
            cap.append(round(w * SCALE))
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if give[i])
        for i in queue:
            level[i] = 0
        last = -1
        while queue:
            i = queue.popleft()
            if last >= 0 and level[i] >= last:
                break
            if take[i]:
                last = level[i]
                continue
            for e in arcs[i]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if last < 0:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            if level[start] != 0:
                continue
            path: list[int] = []
            i = start
            while give[start]:
                if take[i] and level[i] == last:
                    flow = min([give[start], take[i], *(cap[e] for e in path)])
                    give[start] -= flow
                    take[i] -= flow
                    for k, e in enumerate(path):
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    full = next((k for k, e in enumerate(path) if not cap[e]), None)
                    if full is not None:
                        i = to[path[full] ^ 1]
                        del path[full:]
                    continue
                while at[i] < len(arcs[i]) and not (cap[arcs[i][at[i]]] and level[to[arcs[i][at[i]]]] == level[i] + 1 <= last):
                    at[i] += 1
                if at[i] < len(arcs[i]):
                    path.append(arcs[i][at[i]])
                    i = to[path[-1]]
                elif path:
                    e = path.pop()
                    i = to[e ^ 1]
                    at[i] += 1
                else:
                    break


def extract(page: str | None) -> tuple[str, int]:
    """(main text, blocks seen) of one page. Every two neighbouring blocks and every two blocks of one parent that follow each other there are joined by an edge, whatever speaks for or against them."""
    found = parse(page or "")
    if not found:
        return "", 0
    own = [costs(b) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, SMOOTH * (1.0 if _near(found[i - 1].element, b.element) else 0.5)))
        parent = id(b.element.parent if b.element.tag in BLOCK else b.element)
        if parent in last:
            edges.append((last[parent], i, PROXIMITY))
        last[parent] = i
    keep = min_cut([c for c, _ in own], [b for _, b in own], edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k), len(found)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [extract(x) for x in batch.column(2).to_pylist()]
        text = [x for x, _ in got]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64()), pa.array([n for _, n in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks. Pages are independent: nothing is shuffled.

    Null and empty pages, and pages without content, have empty text. Repeated pages give equal rows; null ids and urls stay null; an empty
    table gives no rows; other columns are ignored. Whole pages are parsed, however long.
    """
    return pick(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(_run, "page_id long, url string, text string, n_chars long, n_blocks long")
