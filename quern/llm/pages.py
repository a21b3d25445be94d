"""Main text of HTML pages by tree scoring.

Paragraph-like blocks earn points for length and commas and pass them to their ancestors,
the parent in full, the grandparent half, others less. A container's points are discounted
by the share of its text inside links. The best container is kept, with those siblings that
score near it or read like prose.

Elements that look like menus, forms, adverts, notices or comments are suspects: the rest of
the page is scored without them. A suspect that holds far more prose than all the rest (a form
around the page, an advert that is never closed) is a suspect no more, so that scoring, not a
name, decides where the text is.
"""

from __future__ import annotations

from html import unescape
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold text to read; if closed, they are skipped whole.
SKIPPED = {"button", "select", "object", "embed", "template", "svg", "math"}
SUSPECT_TAGS = {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu"}
SUSPECT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
CUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertorial adsense banner banners breadcrumb breadcrumbs comment comments commentary respond reply replies disqus consent cookie cookies gdpr notice notices notification notifications alert popup modal overlay promo promos promotion sponsor sponsored sponsors newsletter subscribe subscription signup login share sharing social sidebar sidebars rail menu menus nav navbar navigation footer foot header masthead topbar toolbar pagination pager related recommended recommendations widget widgets hidden outbrain taboola skip".split()
)
#: Words that say nothing beside one of those above ("site-footer", "related-posts").
NEUTRAL_WORDS = set("site page global main top bottom left right primary secondary wrapper wrap container box area block section inner outer list item items group row col column bar links link posts buttons button icons form policy message widget thread count title heading text id js the a my new".split())
#: Words for the text itself: beside them the last word decides ("post-comments", "article-footer").
TEXT_WORDS = {"article", "story", "post", "entry", "content", "main", "body", "blog", "news"}
COMMENT_WORDS = {"comment", "comments", "commentary", "respond", "reply", "replies", "disqus"}
#: What a suspect is: a header may belong to the text, comments never do.
ORDINARY, HEADER, COMMENTS = 1, 2, 3
SCORED = {"p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article", "main"}
CONTAINERS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "table", "dl"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}


class Node:
    """A block element: in ``parts``, texts of its own and child nodes in page order."""

    __slots__ = ("attrs", "closed", "linked", "parent", "parts", "score", "suspect", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None, suspect: int = 0):
        self.tag, self.attrs, self.parent, self.suspect = tag, attrs, parent, suspect
        self.parts: list = []
        self.linked: list[int] = []
        self.score, self.closed = 0.0, False


def _named(token: str) -> int:
    """What a class or id says: a word for boilerplate alone, or among words that say nothing."""
    words = [w.lower() for w in _WORDS.findall(token)]
    found = [w for w in words if w in CUT_WORDS]
    if not found or any(w not in CUT_WORDS and w not in NEUTRAL_WORDS and w not in TEXT_WORDS and not w.isdigit() for w in words):
        return 0
    if any(w in TEXT_WORDS for w in words) and words[-1] not in CUT_WORDS:
        return 0
    return COMMENTS if COMMENT_WORDS & set(found) else HEADER if words[-1] == "header" else ORDINARY


@lru_cache(maxsize=4096)
def _suspect(tag: str, attrs: str) -> int:
    """Whether, by its name or marks, an element isn't part of the text."""
    if tag in ("body", "html"):
        return 0
    kind = (HEADER if tag == "header" else ORDINARY) if tag in SUSPECT_TAGS else 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            named = {_named(t) for t in value.split()}
            kind = next((k for k in (COMMENTS, ORDINARY, HEADER) if k in named or k == kind), 0)
        elif name == "role" and value.strip().lower() in SUSPECT_ROLES or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            kind = kind if kind == COMMENTS else ORDINARY
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            kind = kind if kind == COMMENTS else ORDINARY
    return kind


@lru_cache(maxsize=256)
def _tags(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


def _behind(page: str, tag: str, at: int) -> int | None:
    """Where an element that begins before ``at`` ends; None if it is never closed."""
    depth = 1
    for m in _tags(tag).finditer(page, at):
        depth += -1 if m[1] else 1
        if depth == 0:
            return m.end()
    return None


def parse(page: str) -> Node:
    """The tree of block elements; a part of ``parts`` is a text, kept with the number of its
    characters inside links in ``linked``, or a node."""
    root = node = Node("html", "", None)
    text: list[str] = []
    in_link = linked = 0
    at, size = 0, len(page)
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                node.parts.append(line)
                node.linked.append(min(linked, len(line)))
            text.clear()
        linked = 0

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == size:
            break
        m = _TAG.match(page, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in VOID or closing and tag not in BLOCKS and tag != "a":
            if tag == "br" or tag == "img":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        if not closing and tag in RAW - SKIPPED:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            if end or tag != "title":
                at = page.find(">", end.start()) + 1 or size if end else size
            continue
        block = tag in BLOCKS
        known = _suspect if len(attrs) < 2000 else _suspect.__wrapped__  # long ones aren't remembered
        suspect = 0 if closing else known(tag, attrs) if attrs or tag in SUSPECT_TAGS else 0
        if not closing and not block and (suspect or tag in SKIPPED):
            if tag not in unclosed:  # an element that never ends says nothing of what follows
                end = _behind(page, tag, at)
                if end is None:
                    unclosed.add(tag)
                else:
                    at = end
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if not block:
            continue
        flush()
        in_link = 0 if closing else in_link
        if closing:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up.tag == tag and up is not root:
                up.closed = True
                node = up.parent
            continue
        if tag in ("html", "body"):
            continue
        if node.tag == "p" or (node.tag in HEADINGS and tag in HEADINGS):
            node = node.parent
        closed, scope, up = _CLOSED_BY.get(tag, ()), _SCOPES.get(tag, ()), node
        while closed and up is not root and up.tag not in scope:
            if up.tag in closed:
                node = up.parent
                break
            up = up.parent
        child = Node(tag, attrs, node, suspect)
        node.parts.append(child)
        node.linked.append(0)
        node = child
    flush()
    return root


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [p for p in reversed(n.parts) if isinstance(p, Node)]


def _lengths(root: Node) -> dict[int, tuple[int, int]]:
    """Characters, and those inside links, below each node (by id)."""
    out: dict[int, tuple[int, int]] = {}
    for node in reversed(list(_walk(root))):
        n = linked = 0
        for part, link in zip(node.parts, node.linked):
            a, b = out[id(part)] if isinstance(part, Node) else (len(part), link)
            n, linked = n + a, linked + b
        out[id(node)] = n, linked
    return out


def points(text: str, linked: int) -> float:
    return 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3) if len(text) - linked >= 25 else 0


def _prose(root: Node) -> dict[int, tuple[float, int]]:
    """Points and unlinked characters below each node (by id), without what is under comments."""
    out: dict[int, tuple[float, int]] = {}
    for node in reversed(list(_walk(root))):
        gain, chars = 0.0, 0
        for part, link in zip(node.parts, node.linked):
            if isinstance(part, Node):
                a, b = out[id(part)] if part.suspect != COMMENTS else (0.0, 0)
            else:
                a, b = points(part, link), len(part) - link
            gain, chars = gain + a, chars + b
        out[id(node)] = gain, chars
    return out


def _settle(root: Node) -> None:
    """Clears suspects that hold the page's prose, from the outermost in.

    The rest of the page is what is under no suspect. A suspect that is never closed has to
    hold one and a half times the rest's points and characters; a closed one three times, and
    prose of some length unless it is a form; one that is a menu, header, footer or side note
    by its tag also an article or main element. Comments are never cleared, and nothing is
    beside an article or main element that is no suspect."""
    if not any(n.suspect for n in _walk(root)):
        return
    prose = _prose(root)
    holds: dict[int, bool] = {}  # an article or main element with prose
    for node in reversed(list(_walk(root))):
        holds[id(node)] = bool(node.tag in CONTAINERS and prose[id(node)][0]) or any(holds[id(p)] for p in node.parts if isinstance(p, Node))
    gain, chars, marked, tops = 0.0, 0, False, []
    shown = [(root, False)]
    while True:
        # What has been shown is the rest; a cleared suspect adds what is in it, so every node is seen once.
        while shown:
            node, cleared = shown.pop()
            for part, link in zip(node.parts, node.linked):
                if not isinstance(part, Node):
                    if cleared and not points(part, link):
                        continue  # an advert's own few words
                    gain, chars = gain + points(part, link), chars + len(part) - link
                elif part.suspect:
                    if part.suspect != COMMENTS:
                        g, c = prose[id(part)]
                        heapq.heappush(tops, (-g, -c, len(holds) - len(tops), id(part), part))
                else:
                    marked = marked or part.tag in CONTAINERS
                    shown.append((part, False))
        if not tops or marked:
            return
        top = heapq.heappop(tops)[-1]
        g, c = prose[id(top)]
        open_ = not top.closed and top.tag not in _CLOSED_BY and top.tag != "p"
        often = 1.5 if open_ else 3.0
        most = g >= often * max(gain, 1.0) and c >= often * chars
        if open_:
            clear = most
        elif top.tag in ("form", "fieldset"):
            clear = most or (c > 0 and not chars)
        else:
            clear = most and g >= 10 and (top.tag not in SUSPECT_TAGS or holds[id(top)])
        if not clear:
            return
        top.suspect = 0
        marked = marked or top.tag in CONTAINERS
        shown.append((top, True))
        top.parts, top.linked = _without_asides(top)


def _without_asides(node: Node) -> tuple[list, list[int]]:
    """A cleared suspect's parts without words of its own that earn nothing, if others do."""
    pairs = list(zip(node.parts, node.linked))
    kept = [(p, k) for p, k in pairs if isinstance(p, Node) or points(p, k)]
    kept = kept if any(isinstance(p, Node) or points(p, k) for p, k in kept) else pairs
    return [p for p, _ in kept], [k for _, k in kept]


def _own_header(node: Node, lengths: dict[int, tuple[int, int]]) -> bool:
    """Whether a header inside the text belongs to it: a heading, few links and no menu."""
    n, linked = lengths[id(node)]
    inside = list(_walk(node))
    return n > 0 and linked <= 0.3 * n and any(x.tag in HEADINGS for x in inside) and not any(x.tag == "nav" for x in inside)


def _texts(node: Node, lengths: dict[int, tuple[int, int]], headers: bool = True) -> list[str]:
    """Blocks in page order without suspects, and without lists of links that are menus: those
    before the first prose and, outside articles, those of short items."""
    out: list[str] = []
    begun = False
    strict = node.tag not in CONTAINERS
    stack: list = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
            begun = begun or len(part) >= 25
            continue
        if part is not node:
            if part.suspect and not (part.suspect == HEADER and headers and _own_header(part, lengths)):
                continue
            n, linked = lengths[id(part)]
            if part.tag in LISTS and linked > 0.8 * n:
                items = sum(isinstance(p, Node) for p in part.parts) or 1
                if not begun or (strict and n / items < 25):
                    continue
        stack += reversed(part.parts)
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main container joined by an empty line; '' for null, empty or textless pages.

    An article or main element around the best container is kept whole, with other articles
    that score at least half as much. Where no block earns points, the longest article or
    main element counts, else all that is no suspect."""
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    lengths = _lengths(root)
    candidates: dict[int, Node] = {}
    visible: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.suspect:
            continue
        visible.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    for node in visible:
        if node.tag not in SCORED and not (node is root):
            continue
        for part, linked in zip(node.parts, node.linked):
            if not isinstance(part, str) or not (gain := points(part, linked)):
                continue
            # A p or li passes its points on; text straight in a container stays there.
            up = node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "dd") and node.parent else node
            level = 0
            while up:
                up.score += gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
                candidates[id(up)] = up
                up, level = up.parent, level + 1

    def final(node: Node) -> float:
        n, linked = lengths[id(node)]
        return node.score * (1 - linked / n) if n else 0.0

    def written(*nodes: Node) -> str:
        return "\n\n".join(t for n in nodes for t in _texts(n, lengths))

    marked = [n for n in visible if n.tag in CONTAINERS and lengths[id(n)][0]]
    if not candidates:
        best = max(marked, key=lambda n: lengths[id(n)][0] - lengths[id(n)][1], default=root)
        return "\n\n".join(_texts(best, lengths, best is not root))
    best = max(candidates.values(), key=final)
    inside = best
    while inside and inside.tag not in CONTAINERS:
        inside = inside.parent
    if not inside and marked:
        top = max(marked, key=final)
        if final(top) >= 0.5 * final(best) and lengths[id(top)][0] >= 0.5 * lengths[id(best)][0]:
            inside = top
    if inside:
        if inside.tag != "article":
            below = {id(n) for n in _walk(inside)}
            own = [n for n in marked if n.tag == "article" and id(n) in below]
            outer = _outermost(inside, own)
            prose = _prose(inside)
            if not own or sum(prose[id(n)][0] for n in outer) < 0.8 * prose[id(inside)][0]:
                return written(inside)
            inside = max(own, key=final)
        # Articles beside it, none inside another that is kept.
        kept: list[Node] = []
        below, above, taken = {id(n) for n in _walk(inside)}, {id(n) for n in _ancestors(inside)}, set()
        for n in marked:
            beside = n.tag == "article" and id(n) not in below and id(n) not in above and final(n) >= 0.5 * final(inside)
            if n is inside or (beside and not any(id(up) in taken for up in _ancestors(n))):
                kept.append(n)
                taken.add(id(n))
        return written(*kept)
    if best is root or not best.parent:
        return "\n\n".join(_texts(best, lengths, False))
    out: list[str] = []
    least = max(10.0, 0.2 * final(best))
    for part, linked in zip(best.parent.parts, best.parent.linked):
        if part is best:
            out += _texts(best, lengths)
        elif isinstance(part, Node):
            n, link = lengths[id(part)]
            share = link / n if n else 1
            if not part.suspect and (final(part) >= least or part.tag in HEADINGS or (part.tag in ("p", "pre", "blockquote") and share < 0.25 and n)):
                out += _texts(part, lengths)
        elif len(part) - linked >= 25:
            out.append(part)
    return "\n\n".join(out)


def _ancestors(node: Node) -> Iterator[Node]:
    up = node.parent
    while up:
        yield up
        up = up.parent


def _outermost(root: Node, nodes: list[Node]) -> list[Node]:
    """Those of the nodes below ``root`` that are in no other of them."""
    wanted, out, stack = {id(n) for n in nodes}, [], [p for p in root.parts if isinstance(p, Node)]
    while stack:
        node = stack.pop()
        if id(node) in wanted:
            out.append(node)
        else:
            stack += [p for p in node.parts if isinstance(p, Node)]
    return out


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each row; other columns stay, a column of that name is replaced.

    Null and empty pages give ''. Rows are independent: repeated rows and null ids pass."""
    kept = [c for c in pages.columns if c != text_col]
    schema = pages.select(*kept).withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column("__html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [texts], names=[*kept, text_col])

    return pages.select(*kept, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)
