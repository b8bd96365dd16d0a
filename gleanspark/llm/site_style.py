"""Main text of web pages: trees of one host merged into a site style tree, branches of low importance removed."""

from __future__ import annotations

import html
import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.shared import stored, utf8

DAMPING = 0.9  # weight of a node's own importance falls as its number of styles as a power of this
THRESHOLD = 0.3  # branches below are removed
MIN_PAGES = 4  # pages of a host that hold a node before its importance can condemn it
HELD = 200_000  # nodes and counted values a task holds before it hands them on

_TOKEN = re.compile(
    r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>?)",
    re.S | re.A,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.A)
_WORD = re.compile(r"[a-z]+")

# Element names of HTML by what they do to a tree.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# an element of the first kind ends an open one of the others, up to an element that holds both
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
    "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
_SCOPE = frozenset("ul ol dl menu table article section div main body html td th".split())
# Elements, roles and words in class or id that say a branch is no main text.
_ASIDE = frozenset(
    "head script style noscript template svg math iframe object embed canvas audio video nav aside footer form button "
    "select input textarea label option fieldset dialog menu noembed noframes title".split()
)
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended comment comments disqus respond reply "
    "replies toolbar pagination pager skip".split()
)
_DENIED = frozenset("has no with without".split())  # before such a word in one name: has-sidebar
_MAIN = frozenset({"article", "main"})
_TAG_CHARS, _TAGS = 512, 1 << 14  # tags that are short, and how many of them a worker remembers


class Node:
    """An element, or with an empty tag a stretch of text."""

    __slots__ = ("aside", "children", "key", "link", "sign", "style", "tag", "text")

    def __init__(self, tag: str, sign: str = "", aside: bool = False, text: str = "", link: str = ""):
        self.tag, self.sign, self.aside, self.text, self.link = tag, sign, aside, text, link
        self.children: list[Node] | tuple[()] = [] if tag or sign else ()
        self.key = self.style = 0


def _says_aside(names: str) -> bool:
    for name in names.split():
        words = _WORD.findall(name)
        if not _ASIDE_WORDS.isdisjoint(words) and words[0] not in _DENIED:
            return True
    return False


@lru_cache(_TAGS)
def _said(tag: str, raw: str, inside_main: bool) -> tuple[str, bool, str]:
    """What a start tag says: the element's name among its siblings, whether it is an aside, its link."""
    held: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        held.setdefault(name.lower(), next((v for v in values if v), ""))
    said = f"{held.get('class', '')} {held.get('id', '')}".lower()
    hidden = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "")
    aside = (
        tag in _ASIDE
        or held.get("role", "").lower() in _ASIDE_ROLES
        or (tag not in ("html", "body", "main") and (tag != "article" or inside_main) and _says_aside(said))
        or (tag == "header" and not inside_main)
        or hidden
    )
    # a name that only carries a number differs from page to page
    sign = f"{tag}|{re.sub('[0-9]+', '0', said).strip()}|{held.get('role', '')}"
    return sign, aside, held.get("href") or held.get("src") or ""


@lru_cache(_TAGS)
def _ended_by(tag: str) -> tuple[str, ...]:
    """The open elements that a start tag of this name ends."""
    return (*_ENDS.get(tag, ()), *(("p",) if tag in _CLOSES_P else ()))


def parsed(page: bytes) -> Node:
    """The tree of a page. Tags that were left out or stand in the wrong place are made good: a block
    ends an open paragraph, an item the one before it, an end tag all that is open inside."""
    text = page.decode("utf-8", "replace")
    root = Node("", "root")
    open_: list[Node] = [root]
    mains, at, size = 0, 0, len(text)

    def close(depth: int) -> None:
        nonlocal mains
        for node in open_[depth:]:
            mains -= node.tag in _MAIN
        del open_[depth:]

    tokens = _TOKEN.finditer(text)
    while found := next(tokens, None):
        begin = found.start()
        if at < begin:
            open_[-1].children.append(Node("", text=html.unescape(text[at:begin])))
        at = found.end()
        ends, name, raw, ends_odd, name_odd, raw_odd = found.groups()
        if name is None:
            if name_odd is None:
                continue
            ends, name, raw = ends_odd, name_odd, raw_odd
        tag = name.lower()
        if ends:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag == tag:
                    close(depth)
                    break
                if tag in _INLINE and open_[depth].tag not in _INLINE:
                    break  # the block goes on
            continue
        if ended := _ended_by(tag) if len(tag) <= _TAG_CHARS else ():
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag in ended:
                    close(depth)
                    break
                if open_[depth].tag in _SCOPE and open_[depth].tag not in ended:
                    break
        said = _said if len(raw) <= _TAG_CHARS and len(tag) <= _TAG_CHARS else _said.__wrapped__
        sign, aside, link = said(tag, raw, mains > 0)
        node = Node(tag, sign, aside, link=link)
        open_[-1].children.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(r"</" + re.escape(name) + r"(?=[\s/>]|\Z)[^>]*>?", re.I | re.A).search(text, at)
            at = end.end() if end else size
            tokens = _TOKEN.finditer(text, at)
            continue
        open_.append(node)
        mains += tag in _MAIN
    if at < size:
        open_[-1].children.append(Node("", text=html.unescape(text[at:])))
    return root


def _walk(root: Node) -> Iterator[tuple[Node, Node | None]]:
    """Nodes with their parents, parents first; no recursion, so depth has no bound."""
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        node, parent = stack.pop()
        yield node, parent
        stack += [(child, node) for child in reversed(node.children)]


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "replace"), 7) - (1 << 63)


def _keyed(root: Node, host: str) -> tuple[list[Node], list[int]]:
    """Elements outside known asides, each with its key in the host's tree and its style; and the
    numbers of their parents, which come first.

    An element is named by its parent's key and style and its place there; its style is the
    sequence of its element children. Equal trees have equal keys, on any machine."""
    root.key = _hash("host", host)
    out, parents, stack = [], [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        shown = [c for c in node.children if c.tag and not c.aside and c.tag not in _INLINE]
        node.style = _hash(node.key, *(c.sign for c in shown))
        for place, child in enumerate(shown):
            child.key = _hash(node.style, place, child.sign)
        number = len(out)
        out.append(node)
        parents.append(parent)
        stack += [(child, number) for child in reversed(shown)]
    return out, parents


def _content(node: Node) -> list[str]:
    """What a leaf of the style tree shows: its text, its links and images."""
    text, links = [], []
    stack = list(node.children)
    while stack:
        child = stack.pop()
        if not child.tag:
            text.append(child.text)
        elif not child.aside and child.tag in _INLINE:
            if child.link:
                links.append(child.link)
            stack += child.children
    shown = " ".join(" ".join(reversed(text)).split())
    return ([f"t{shown}"] if shown else []) + [f"l{x}" for x in links]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TREES = (
    "k1 long, k2 long, s1 long, s2 long, values array<struct<key: long, item: long, n: int>>, digest long, "
    "seen array<long>, n long, nodes array<struct<node: int, parent: int, key: long, style: long, may: boolean>>"
)


def _lists(lists: list[list[tuple] | None], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """A column of lists of structs; None gives null."""
    flat = [row for rows in lists for row in rows or ()]
    columns = zip(*flat, strict=True) if flat else [()] * len(kinds)
    fields = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
    ends = pa.array([0, *accumulate(len(rows or ()) for rows in lists)], pa.int32())
    mask = pa.array([rows is None for rows in lists], pa.bool_())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, list(kinds)), mask=mask)


def _trees(pages: DataFrame, most: int = HELD) -> DataFrame:
    """Pages ``host, body, k1, k2`` parsed once: a row per page, and one per shape that a task has met.

    A page has its shape ``s1, s2``, how often each value of a node's content occurs (``values``) and
    its ``digest`` with the nodes it is a different page for (``seen``: all of them, or ``MIN_PAGES``
    at least). A shape is the sequence of nodes of a tree, the host among their keys: pages that share
    it differ in content alone. Its row has the ``nodes`` and the number ``n`` of the task's pages.
    A task hands its rows on whenever it holds more than ``most`` nodes and values.
    """
    value = {"key": pa.int64(), "item": pa.int64(), "n": pa.int32()}
    place = {"node": pa.int32(), "parent": pa.int32(), "key": pa.int64(), "style": pa.int64(), "may": pa.bool_()}

    def laid(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, s1, s2, values, digest, seen, n, nodes = zip(*rows, strict=True)
        longs = [pa.array(c, pa.int64()) for c in (k1, k2, s1, s2, digest, n)]
        columns = [*longs[:4], _lists(values, value), longs[4], pa.array(seen, pa.list_(pa.int64())), longs[5], _lists(nodes, place)]
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "s1", "s2", "values", "digest", "seen", "n", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[tuple[int, int], list] = {}
        seen: dict[int, set[int]] = {}
        held = 0

        def handed(rows: list[tuple]) -> pa.RecordBatch:
            return laid(rows + [(None, None, *s, None, None, None, n, nodes) for s, (n, nodes) in shapes.items()])

        rows: list[tuple] = []
        for batch in batches:
            for host, page, k1, k2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = xxhash.xxh3_64_intdigest(page, 7) - (1 << 63)
                found, parents = _keyed(parsed(page), host)
                may = _removable(found, parents)
                keys = [node.key for node in found]
                mark = array("q", keys).tobytes() + array("q", parents).tobytes() + bytes(may)
                shape = struct.unpack("<qq", xxhash.xxh3_128_digest(mark))
                if shape not in shapes:
                    shapes[shape] = [0, list(zip(range(len(found)), parents, keys, [x.style for x in found], may, strict=True))]
                    held += len(found)
                shapes[shape][0] += 1
                new = []
                for key in keys:
                    copies = seen.setdefault(key, set())
                    if len(copies) < MIN_PAGES and digest not in copies:
                        copies.add(digest)
                        new.append(key)
                values = [(node.key, _hash(v), n) for node in found for v, n in Counter(_content(node)).items()]
                rows.append((k1, k2, *shape, values, digest, new, None, None))
                held += 1 + len(values) + len(new)
                if held > most:
                    yield handed(rows)
                    shapes, seen, rows, held = {}, {}, [], 0
        if rows:
            yield handed(rows)

    return pages.select("host", "body", "k1", "k2").mapInArrow(run, TREES)


def _counted(trees: DataFrame) -> DataFrame:
    """``key, kind, item, n, nlogn``: by kind 0 the pages with each style of a node, by 1 how often each
    value of its content occurs over all pages of a host, by 2 some different pages that hold it: all
    of them, or ``MIN_PAGES`` at least."""
    none = F.lit(0.0).alias("nlogn")
    styles = trees.where("nodes is not null").select("n", F.inline("nodes")).select(
        "key", F.lit(0).alias("kind"), F.col("style").alias("item"), "n", none
    )
    values = trees.select(F.inline("values")).select(
        "key", F.lit(1).alias("kind"), "item", F.col("n").cast("long"), (F.col("n") * F.log("n")).alias("nlogn")
    )
    copies = trees.select("digest", F.explode("seen").alias("key")).select(
        "key", F.lit(2).alias("kind"), F.col("digest").alias("item"), F.lit(1).cast("long").alias("n"), none
    )
    made = styles.union(values).union(copies)
    return made.groupBy("key", "kind", "item").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn"))


def importance(counted: DataFrame) -> DataFrame:
    """``key, pages, styles, imp``: a node's own importance from the merged tree of its host, and how
    many different pages hold it (any number from ``MIN_PAGES`` on may stand for more).

    With m pages, an inner node has the entropy of its styles to the base m; a leaf has 1 less the
    mean entropy of its content over the pages, so content that is the same everywhere counts for
    nothing. One page alone gives 1.
    """
    kind, n = F.col("kind"), F.col("n")
    spread = F.log(n) - F.col("nlogn") / n  # entropy of a value over pages, natural logarithm
    sums = counted.groupBy("key").agg(
        F.sum(F.when(kind == 0, n)).alias("m"),
        F.count(F.when(kind == 0, True)).alias("styles"),
        F.sum(F.when(kind == 0, n * F.log(n))).alias("style_nlogn"),
        F.count(F.when(kind == 1, True)).alias("values"),
        F.coalesce(F.sum(F.when(kind == 1, spread)), F.lit(0.0)).alias("spread"),
        F.count(F.when(kind == 2, True)).alias("pages"),
    )
    base = F.log(F.greatest(F.col("m"), F.lit(2)))
    inner = (base - F.col("style_nlogn") / F.col("m")) / base
    leaf = 1 - F.col("spread") / F.greatest(F.col("values"), F.lit(1)) / base
    own = F.when(F.col("m") == 1, 1.0).when(F.col("values") > 0, F.greatest(inner, leaf)).otherwise(inner)
    return sums.select("key", "pages", "styles", own.alias("imp"))


def _judged(parents: list[int], pages: list[int], styles: list[int], imps: list[float]) -> list[int]:
    """Numbers of the topmost nodes of a page that are, with all below them, of low importance.

    A branch counts for its own node and the mean of its children, the latter the more the fewer
    styles the node has; nodes are given parents first. A page that is low as a whole stays."""
    n = len(parents)
    below, many, best = [0.0] * n, [0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        kept = DAMPING ** styles[i] if many[i] else 0.0
        whole = (1 - kept) * imps[i] + (kept * below[i] / many[i] if many[i] else 0.0)
        best[i] = max(best[i], whole)
        if (above := parents[i]) >= 0:
            below[above] += whole
            many[above] += 1
            best[above] = max(best[above], best[i])
    if not n or best[0] < THRESHOLD:
        return []
    out, gone = [], [False] * n
    for i in range(1, n):
        low = pages[i] >= MIN_PAGES and best[i] < THRESHOLD
        gone[i] = gone[parents[i]] or low
        if low and not gone[parents[i]]:
            out.append(i)
    return out


def _removable(nodes: list[Node], parents: list[int]) -> list[bool]:
    """Which nodes the merged tree may remove: all but what is inside an article or main part. An article
    or main part may go as a whole."""
    below: list[str] = []
    out = []
    for node, parent in zip(nodes, parents, strict=True):  # parents come first
        within = below[parent] if parent >= 0 else ""
        out.append(not within or (within == "main" and node.tag == "article"))
        below.append("article" if "article" in (within, node.tag) else "main" if node.tag == "main" else within)
    return out


def _outermost(root: Node, tag: str, through: bool, removed: set[int]) -> list[Node]:
    """Elements of a tag that are in no other one, in page order; ``through`` looks into asides too.

    Those that the merged tree removes are left out, unless the page has no other."""
    out, gone, stack = [], [], [(root, False)]
    while stack:
        node, low = stack.pop()
        low = low or id(node) in removed
        if node.tag == tag and not node.aside:
            (gone if low else out).append(node)
        elif through or not node.aside:
            stack += [(child, low) for child in reversed(node.children)]
    return out or gone


def _text(root: Node, removed: set[int]) -> str:
    """Blocks of what is left in page order; of the articles alone where the page has some, and of
    these only those that the merged tree leaves."""
    starts = [root]
    for tag, through in (("article", False), ("main", False), ("article", True), ("main", True)):
        if found := _outermost(root, tag, through, removed):
            starts = found
            removed = removed - {id(n) for n in found}
            break
    blocks: list[list[str]] = [[]]
    stack: list[Node | None] = list(reversed(starts))
    while stack:
        node = stack.pop()
        if node is None:
            blocks.append([])
        elif not node.tag and not node.children:
            blocks[-1].append(node.text)
        elif node.aside or id(node) in removed:
            blocks.append([])
        elif node.tag == "br":
            blocks[-1].append(" ")
        elif node.tag in _INLINE:
            stack += reversed(node.children)
        else:
            stack += [None, *reversed(node.children), None]
    shown = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in shown if b)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page.

    The pages of a host are merged into a site style tree: a node is an element in a place of its
    parent's style, a style the sequence of an element's children. Nodes whose styles vary over
    pages, and leaves whose content varies, are important; a branch weighs its own node and the mean
    of its children as the page has them. Branches that with all below them are under the threshold,
    and that at least ``MIN_PAGES`` different pages hold, are removed; copies of one page count once,
    and a page that is under it as a whole stays.
    What HTML itself calls no content (navigation, header, footer, aside, forms, scripts; classes,
    ids and roles of adverts, notices, sidebars, comments) is removed everywhere. Where a page has an
    article, its text is the article's, and a paragraph of it stays however often the host repeats it;
    of several articles, those that the tree removes as a whole (the same teaser or offer on many pages)
    are no part of it. A page's only article stays.

    The tree is never in one place: nodes are hashed paths, counted over all pages by key, so a hot
    host is spread over all tasks. A page is parsed twice: for its nodes, which are stored as numbers,
    and for its text. Sequences of nodes that pages share meet the importance of their nodes once a task,
    and pages come back to their html by its hash only with the numbers of the nodes to be removed.

    Character references are decoded, white space in a block and line breaks become one space, blocks
    are joined by an empty line. Null and empty pages give an empty text; pages without a url are one
    host; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    names = ["page_id", "url"]
    rows = pages.select(*names, host_of(F.col("url")).alias("host"), utf8(F.col("html")).alias("body")).withColumns(
        {"k1": F.xxhash64("host", "body"), "k2": F.xxhash64(F.lit("second"), "host", "body")}
    )
    trees = stored(_trees(rows), "trees")
    judged = importance(_counted(trees))
    nodes = trees.where("nodes is not null").select("s1", "s2", F.inline("nodes"))
    met = nodes.join(judged, "key").groupBy("s1", "s2").agg(
        F.sort_array(F.collect_set(F.struct("node", "parent", "may", "pages", "styles", "imp"))).alias("nodes")
    )

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(2):
                parents, may, *known = (found.values.field(i).to_pylist() for i in range(1, 6))
                out.append([i for i in _judged(parents, *known) if may[i]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["s1", "s2", "removed"]
            )

    cut = met.mapInArrow(low, "s1 long, s2 long, removed array<int>").where("size(removed) > 0")
    cut_pages = trees.where("nodes is null").select("k1", "k2", "s1", "s2").join(cut, ["s1", "s2"])
    removed = stored(cut_pages.select("k1", "k2", "removed").dropDuplicates(["k1", "k2"]), "removed")
    slots = rows.withColumnsRenamed({"page_id": "c0", "url": "c1"})
    both = slots.join(removed, ["k1", "k2"], "left").select("c0", "c1", "host", "body", "removed")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, page, gone in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                root = parsed(page)
                nodes = _keyed(root, host)[0] if gone else []
                out.append(_text(root, {id(nodes[i]) for i in gone or ()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["c0", "c1", "text"])

    kinds = dict(slots.select("c0", "c1").dtypes)
    made = both.mapInArrow(texts, f"c0 {kinds['c0']}, c1 {kinds['c1']}, text string")
    return made.select(F.col("c0").alias("page_id"), F.col("c1").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
