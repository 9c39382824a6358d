"""Main text of web pages by site style trees.

The element trees of a host's pages are merged into one style tree: a node per
path of elements (tag, class and id), with the number of pages that have it.
A node is important in two ways. Presentation: the entropy of the layouts, the
sequences of child elements, that pages show below it. Content: the entropy of
the texts that pages show in it. A node whose text is the same from page to page
(menus, footers, notices) tells nothing and is removed from every page; the
more pages a host has, the more its own tree says. What a page marks as its main
part (article, main) weighs more, but is judged like the rest. What the tree does
not decide is decided by what elements are called, which is all there is for a
host of one page.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.llm.common import cut, rows_batch

# Fixed values of HTML: elements without content, of raw text, and those that
# start a block of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select button object noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
# An open <p> ends where one of these starts.
ENDS_P = BLOCK - frozenset("br caption dd dt html body head legend option optgroup tbody td tfoot th thead tr".split())
# Elements that end an open one of the same kind, up to the given containers.
SAME = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
# Elements that name what comes after them.
LABELS = frozenset("h1 h2 h3 h4 h5 h6 hgroup dt th caption summary".split())
# Elements whose content is never main text, and words of classes, ids and roles
# that name such parts.
NOT_MAIN = frozenset("nav footer aside form dialog menu search".split()) | RAW
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|ted|s)?|nav|navbar|"
    r"navigation|menus?|breadcrumbs?|sidebar|side|widgets?|footer|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|"
    r"disqus|replies|reply|respond|discussion|pagination|pager|skip|search|copyright|legal|hidden)(?:$|[-_\s\d])", re.I)
HEADERS = re.compile(r"(?:^|[-_\s])(?:header|site-?header|page-?header|head)(?:$|[-_\s\d])", re.I)
MAIN_ROLES = frozenset(("main", "article"))
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

#: From how many pages of a host its own tree decides about a node.
ENOUGH_PAGES = 8
#: Importance, 0 to 1, under which a node goes.
LOW = 0.35
#: How many times the importance of a node counts that lies in an article or main part.
MARKED = 2.0

_STYLE = "host string, path long, layout long, content long, n long"
_TEXT = "page_id long, url string, text string, n_chars long"


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "children", "path", "parent", "marked")

    def __init__(self, tag, parent=None, names="", role="", hidden=False):
        self.tag, self.parent, self.names, self.role, self.hidden = tag, parent, names, role, hidden
        self.children: list = []
        own = f"{tag}.{_DIGITS.sub('0', names).strip().lower()}"
        # In an article or main part, or one itself; the lowest bit of a path says so.
        self.marked = parent is not None and parent.marked or (
            (tag in ("article", "main") or role in MAIN_ROLES) and not named_aside(self, False))
        self.path = hash_of(f"{parent.path if parent else 0}/{own}") & ~1 | self.marked


def hash_of(text: str) -> int:
    """A signed 64-bit hash that is the same in every process."""
    data = text.encode("utf-8", "replace")
    value = zlib.crc32(data) << 32 | zlib.crc32(data[::-1] + b"\x01", 0x5BD1E995)
    return value - (1 << 64) if value >> 63 else value


def _attributes(text: str) -> tuple[str, str, bool]:
    if not text or text.isspace():
        return "", "", False
    names, role, hidden = [], "", re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", text)) is not None
    for key, a, b, c in _ATTRIBUTE.findall(text):
        value, key = a or b or c, key.lower()
        if key in ("class", "id"):
            names.append(value)
        elif key == "role":
            role = value.strip().lower()
        elif key == "style":
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif key == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
    return " ".join(names), role, hidden


def tree_of(page: str) -> Node:
    """The element tree of a page, end tags put right as far as blocks need it;
    character references are still as written."""
    root = node = Node("#root")
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= end:
            node.children.append(page[at:])
            break
        if lt > at:
            node.children.append(page[at:lt])
        after = page[lt + 1]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if after in "!?":
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt) or _BROKEN_TAG.match(page, lt)
        if not m:
            if after == "/" or after.isalpha():  # a tag that the page's end cuts off
                if page.find(">", lt) < 0:
                    break
                at = page.find(">", lt) + 1
            else:
                node.children.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            up = node
            while up.parent and up.tag != tag:
                if up.tag in ("article", "main", "table", "body") and tag not in ("body", "html", "article", "main", "table", "section", "div"):
                    up = root
                    break
                up = up.parent
            if up.parent:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", node))
            elif tag == "br":
                node.children.append(Node("br", node))
            continue
        if tag in SAME:
            ends, within = SAME[tag]
            up = node
            while up.parent and up.tag not in within and up.tag not in ends:
                up = up.parent
            while up.parent and up.tag in ends:
                node, up = up.parent, up.parent
        if tag in ENDS_P:
            up = node
            while up.parent and up.tag not in BLOCK and up.tag not in ("td", "th"):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        new = Node(tag, node, *_attributes(m[3]))
        node.children.append(new)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW and tag not in ("span", "a", "b", "i", "em", "strong"):
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"):
            stop = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        node = new
    return root


def named_aside(node: Node, inside: bool) -> bool:
    """Whether an element by its name is no main text."""
    if node.tag in NOT_MAIN or node.hidden or node.role in SIDE_ROLES:
        return True
    if node.tag in ("main", "body", "html", "#root"):
        return False
    if node.tag == "header":
        return not inside
    return bool(node.names) and (NAMES.search(node.names) is not None or not inside and HEADERS.search(node.names) is not None)


_PRIME = (1 << 127) - 1


def text_hashes(root: Node) -> dict[Node, tuple[int, int]]:
    """Per element the hash and length of the text below it, white space left out; one
    pass from the leaves up, as the hash of a whole follows from those of its parts."""
    found: dict[Node, tuple[int, int]] = {}
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if node.tag in RAW:
            found[node] = (0, 0)
        elif not done:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if not isinstance(c, str))
        else:
            value = size = 0
            for child in node.children:
                if isinstance(child, str):
                    data = "".join(child.split()).encode("utf-8", "replace")
                    part, length = int.from_bytes(data, "big") % _PRIME, len(data)
                else:
                    part, length = found[child]
                value, size = (value * pow(256, length, _PRIME) + part) % _PRIME, size + length
            found[node] = (value, size)
    return found


def host_of(url):
    """The lower-case host of a URL column, empty where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


#: Elements that a style tree has nodes for; what is inline belongs to its block.
_STYLED = frozenset("article aside blockquote dd details div dl dt fieldset figure footer form header h1 h2 h3 h4 h5 h6 "
                    "hgroup li main menu nav ol p pre search section table td th tr ul".split())


def styles(page: str) -> dict[int, tuple[int, int]]:
    """Per style node of a page: hashes of its layout (child elements) and of its text."""
    found: dict[int, list] = {}
    root = tree_of(page)
    texts, stack = text_hashes(root), [root]
    while stack:
        node = stack.pop()
        kids = [c for c in node.children if not isinstance(c, str)]
        if node.tag in _STYLED:
            layout = ">".join(dict.fromkeys(c.tag for c in kids))
            found.setdefault(node.path, []).append((layout, "%x:%d" % texts[node]))
        if node.tag not in RAW:
            stack.extend(kids)
    return {path: (hash_of("|".join(dict.fromkeys(a for a, _ in seen))), hash_of("\n".join(b for _, b in seen)))
            for path, seen in found.items()}


def style_tree(pages: DataFrame) -> DataFrame:
    """Per host and style node: pages with it, and its presentation and content
    importance, each an entropy over pages as a share of the largest it could be.

    Counting is by (host, node, layout, text) first, so a host that holds most
    pages is spread by its texts and met only as counts.
    """

    def run(batches):
        for batch in batches:
            counts: dict[tuple, int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, (layout, content) in styles(page or "").items():
                    key = (host, path, layout, content)
                    counts[key] = counts.get(key, 0) + 1
            if counts:
                yield rows_batch(_STYLE, [*zip(*counts), list(counts.values())])

    seen = (pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, _STYLE)
            .groupBy("host", "path", "layout", "content").agg(F.sum("n").alias("n")))

    def entropy(of: str):
        counts = seen.groupBy("host", "path", of).agg(F.sum("n").alias("c"))
        found = counts.groupBy("host", "path").agg(
            F.sum("c").alias("pages"), F.sum(F.col("c") * F.log2("c")).alias("weighted"))
        bits = F.log2("pages") - F.col("weighted") / F.col("pages")
        return found.select("host", "path", "pages", F.when(F.col("pages") > 1, bits / F.log2("pages")).otherwise(1.0).alias(of))

    return entropy("content").join(entropy("layout").drop("pages"), ["host", "path"])


def unimportant(tree: DataFrame, enough: int = ENOUGH_PAGES, low: float = LOW, marked: float = MARKED) -> DataFrame:
    """``host, paths``: the nodes of each host that go. A node is important by the
    larger of its two importances, which counts ``marked`` times in an article or
    main part; one on fewer than ``enough`` pages stays."""
    weight = F.when(F.col("path").bitwiseAND(1) == 1, marked).otherwise(1.0)
    return (tree.where((F.col("pages") >= enough) & (F.greatest("content", "layout") * weight < low))
            .groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths")))


def main_text(page: str, removed: frozenset[int] | set[int]) -> str:
    """Blocks of a page's main text in order, one per line.

    The style nodes ``removed`` go, but for headings of what stays (``labels``), and
    what is named as something else, inside an article or main part and outside. Where nothing would stay (the host
    repeats whole pages), such a part is judged by names alone.
    """
    root = tree_of(page)
    blocks = _blocks([root], removed)
    if not blocks and removed:
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.marked:
                found.append(node)
            elif not named_aside(node, False):
                stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
        blocks = _blocks(found, frozenset())
    return "\n".join(blocks)


def labels(top: Node, removed: frozenset[int] | set[int]) -> set[Node]:
    """Headings among the nodes ``removed`` that stay: what they name stays.

    A heading with the same words on every page ("Ingredients") tells pages apart as
    little as a menu does, but belongs to the text that follows it up to the next heading
    of its rank. Outside an article or main part some text must stay before a heading of
    the ranks h1 to h6 too, so that a site's own title above the text goes.
    """
    kept, label, stack, found = set(), set(), [(top, False)], set()
    while stack:
        node, done = stack.pop()
        inner = [c for c in node.children if not isinstance(c, str)]
        if not done:
            if node is top or not named_aside(node, node.parent.marked):
                stack.append((node, True))
                stack.extend((c, False) for c in inner)
            continue
        words = any(isinstance(c, str) and not c.isspace() for c in node.children)
        if node.tag in LABELS or inner and not words and all(c in label for c in inner):
            label.add(node)
        if (node is top or node.path not in removed) and (words or any(c in kept for c in inner)):
            kept.add(node)
        wanting = [c for c in inner if c in label and (c.path in removed or c.tag not in LABELS)]
        if not wanting:
            continue
        first = next((i for i, c in enumerate(inner) if c in kept), len(inner))
        named = [False] * 8  # per rank: does kept text follow before the next heading of that rank or above?
        for i in range(len(inner) - 1, -1, -1):
            child = inner[i]
            rank = _rank(child) if child in label else 7
            if child in wanting and named[rank] and (node.marked or first < i or rank == 7):
                found.add(child)
            if child in label:
                # A run of headings of the same kind (cells of a table's head) names one thing.
                named[rank:] = [named[rank] and rank == 7] * (8 - rank)
            if child in kept and child not in label:
                named = [True] * 8
    return found


def _rank(label: Node) -> int:
    """1 to 6 for headings, the first one's in a wrapper; 7 for other labels."""
    while label.tag not in LABELS:
        label = next(c for c in label.children if not isinstance(c, str))
    return int(label.tag[1]) if label.tag[1:].isdigit() else 7


def _blocks(tops: list[Node], removed: frozenset[int] | set[int]) -> list[str]:
    blocks, now = [], []

    def close():
        text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    for top in tops:
        stack, stays = [top], labels(top, removed) if removed else ()
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                now.append(x)
            elif x is top or not named_aside(x, x.parent.marked) and (x.path not in removed or x in stays or x.parent in stays):
                if x.parent in stays:  # a heading stays with all that it holds
                    stays.add(x)
                if x.tag == "br":
                    now.append(" ")
                elif x.tag in BLOCK:
                    close()
                    stack.append(None)
                stack.extend(reversed(x.children))
            elif x.tag in BLOCK:
                close()
        close()
    return blocks


def extract(pages: DataFrame, enough: int = ENOUGH_PAGES, low: float = LOW) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, from the whole html.

    Null or empty html gives an empty text. Pages without a readable host share
    one tree. Rows that repeat a page count as pages of the host and give a row
    each. Extra columns are ignored.
    """
    gone = cut(unimportant(style_tree(pages), enough, low), "styles")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(page or "", frozenset(gone or ()))
                     for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield rows_batch(_TEXT, [batch.column(0), batch.column(1), texts, list(map(len, texts))])

    return (rows.withColumn("_host", host_of("url")).join(gone.withColumnRenamed("host", "_host"), "_host", "left")
            .select("page_id", "url", "html", "paths").mapInArrow(run, _TEXT))
