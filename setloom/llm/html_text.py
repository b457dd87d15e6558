"""Main text of web pages by tree scoring.

A page becomes a tree of block elements; inline markup only counts towards link density. Each block
of text passes points for its length and its commas to its ancestors, the farther the fewer. A
container's points are discounted by its link density; the best one is kept, together with siblings
along its path that score well. Navigation, headers, footers, sidebars, notices, adverts, forms and
reader comments are known by element, role and the words of class and id, and do not count.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form fieldset menu dialog button select datalist label".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title noembed noframes xmp head applet map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that mark what is no part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs "
    "comment comments commentlist disqus reply replies respond footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login social related recommended recommendations widget widgets pagination pager toolbar search skip hidden disclaimer".split()
)
#: A class with one of these words, such as has-sidebar, tells what stands beside the block, not what it is.
BESIDE = frozenset("has with no without".split())
#: Share of a block's points that its container gets, and then each ancestor of what the one below has got from its descendants.
FIRST_SHARE, NEXT_SHARE = 0.5, 0.6
#: Elements that a start tag of these closes when they are open.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_token = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_words = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_hiding = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("children", "dropped", "handed", "holds", "items", "linked", "parent", "points", "score", "tag", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node] = []
        self.items: list = []  # child nodes and (text, linked characters) blocks, in page order
        self.score = self.points = self.handed = 0.0
        self.total = self.linked = 0
        self.holds = tag in ("article", "main")


def _marked(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _attribute.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for token in value.split():
                said = {w.lower() for w in _words.findall(token)}
                if not MARKS.isdisjoint(said) and BESIDE.isdisjoint(said):
                    return True
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _hiding.search(value):
            return True
    return False


def tree(page: str) -> Node:
    """The page's block elements with their texts; tags may be missing or misplaced."""
    root = Node("html", None, False)
    at, node, links, text, linked = 0, root, 0, [], 0
    open_tags: Counter[str] = Counter()
    closed_for_good: set[str] = set()  # raw elements without an end tag from here on

    def settle() -> None:
        nonlocal linked
        if text:
            block = " ".join("".join(text).split())
            if block:
                node.items.append((block, min(linked, len(block))))
            text.clear()
        linked = 0

    def words(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw)
            text.append(plain)
            if links:
                linked += len("".join(plain.split()))

    def opened(tags, fences) -> Node | None:
        if not any(open_tags[t] for t in tags):
            return None
        x = node
        while x is not None and x.tag not in fences:
            if x.tag in tags:
                return x
            x = x.parent
        return None

    def leave(x: Node) -> None:
        """Close the open elements down to x and x itself."""
        nonlocal node
        while node is not x.parent:
            open_tags[node.tag] -= 1
            node = node.parent

    def end_of(tag: str, pattern: str):
        """The tag's next end tag from here on; pages where it is missing are searched for it once."""
        if tag in closed_for_good:
            return None
        end = re.compile(pattern, re.I).search(page, at)
        if end is None:
            closed_for_good.add(tag)
        return end

    while True:
        found = _token.search(page, at)
        if not found:
            words(page[at:])
            break
        words(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if not (attributes or "").endswith("/"):
                if tag == "head":  # its own elements are raw or void; it ends where it or the body says
                    end = end_of(tag, r"</head\s*>|(?=<body[\s>])")
                    at = end.end() if end else at
                else:
                    end = end_of(tag, rf"</{re.escape(tag)}\s*[^>]*>")
                    at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title") else at
            text.append(" ")
        elif tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag in DROPPED and tag not in BLOCKS:  # inline controls
            if not closing:
                end = end_of(tag, rf"</{tag}\s*>")
                at = end.end() if end else at
        elif tag in BLOCKS:
            if closing:
                match = opened({tag}, ())
                if tag == "p" and match is None:
                    settle()
                elif match is not None and match.parent is not None:
                    settle()
                    leave(match)
                    links = 0
            else:
                settle()
                links = 0
                if tag in ("html", "body"):
                    continue
                if (p := opened({"p", *HEADINGS} if tag in HEADINGS else {"p"}, {"td", "th", "li", "div", "section", "article", "blockquote", "body", "html"})) is not None:
                    leave(p)
                if tag in SAME and (same := opened(SAME[tag], FENCE[tag])) is not None:
                    leave(same)
                if tag == "hr":
                    continue
                child = Node(tag, node, _marked(tag, attributes or ""))
                node.items.append(child)
                node.children.append(child)
                open_tags[tag] += 1
                node = child
    settle()
    return root


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children))


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by two line ends; empty if there is none."""
    root = tree(page or "")
    nodes = list(_walk(root))
    for x in reversed(nodes):
        if x.parent is not None and x.holds:
            x.parent.holds = True
    inside: set[int] = set()
    for x in nodes:  # a header outside an article is the site's; inside, only its headings are the article's
        if x.parent is not None and (x.parent.tag == "article" or id(x.parent) in inside):
            inside.add(id(x))
        if x.dropped and x.holds or x is root:
            x.dropped = False
        if x.tag == "header" and not x.holds:
            x.dropped = True
    alive = [x for x in nodes if not x.dropped]
    gone: set[int] = set()
    for x in nodes:
        if x.dropped or x.parent is not None and id(x.parent) in gone:
            gone.add(id(x))

    titled: set[int] = set()  # headers, and blocks in them, whose headings are the article's
    for x in nodes:
        if x.tag == "header":
            above = x.parent is None or id(x.parent) not in gone
        else:
            above = x.tag in ("hgroup", "div") and not x.dropped and x.parent is not None and id(x.parent) in titled
        if above:
            titled.add(id(x))

    def kept(x: Node) -> bool:
        return id(x) not in gone or x.tag in HEADINGS and id(x) in inside and x.parent is not None and id(x.parent) in titled

    for x in nodes:
        if id(x) in gone:
            continue
        for item in x.items:
            if isinstance(item, tuple):
                size, linked = len(item[0]), item[1]
                points = (0.1 + item[0].count(",") + min(size / 100, 3) + (size >= 25)) * (1 - linked / size)
                p = x.parent if x.tag in ("p", "pre", "td", "th", "li", "blockquote", "dd", "dt", *HEADINGS) and x.parent is not None else x
                p.score += points
                x.points += points
                x.total += size
                x.linked += linked
    for x in reversed(nodes):  # from the leaves up, so that a page takes time in proportion to its size
        if x.parent is not None:
            x.parent.handed += FIRST_SHARE * x.score + NEXT_SHARE * x.handed
            x.parent.points += x.points
            x.parent.total += x.total
            x.parent.linked += x.linked
    for x in nodes:
        x.score += x.handed
    best, most = None, 0.0
    for x in alive:
        if id(x) not in gone and x.total:
            value = x.score * (1 - x.linked / x.total) * (1.5 if x.tag in ("article", "main") else 1)
            if value > most:
                best, most = x, value
    if best is None:
        return ""
    while best.tag not in ("article", "main") and best.parent is not None and best.parent.parent is not None and not best.parent.dropped and best.parent.points >= 1.05 * best.points and best.parent.linked <= 0.3 * best.parent.total:
        best = best.parent  # the rest of the parent is text of the same kind
    chosen: set[int] = {id(best)}
    x = best
    while x.parent is not None and x.tag not in ("article", "main"):
        for other in x.parent.children:
            if other is x or id(other) in gone or not other.total:
                continue
            density = other.linked / other.total
            long_text = other.tag == "p" and other.total > 80 and density < 0.25
            well = other.points >= max(10, 0.2 * best.points) and density < 0.25
            if long_text or well or other.tag == "h1" and not density:
                chosen.add(id(other))
        x = x.parent
    if best.tag == "article":  # a text told in several articles side by side
        for other in best.parent.children if best.parent is not None else ():
            if other.tag == "article" and id(other) not in gone and other.total and other.linked < 0.25 * other.total and other.points >= max(10, 0.2 * best.points):
                chosen.add(id(other))
    out: list[str] = []
    stack: list = [(root, False)]
    while stack:
        item, within = stack.pop()
        if isinstance(item, tuple):
            if within:
                out.append(item[0])
            continue
        within = within or id(item) in chosen
        own = within and kept(item)
        stack.extend((i, own if isinstance(i, tuple) else within) for i in reversed(item.items))
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every whole page.

    A null or empty page, and one without an article, has the empty text. Character references are
    decoded, white space inside a block is one space, blocks are joined by two line ends. Repeated
    rows come out each, nulls in page_id or url stay, an empty table gives no row, other columns are
    not read. Pages are read where they lie, without a shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p.as_py()) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
