"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: elements with the same path of tags and classes are one node.
For every node, the diversity of the child sequences it has on the host's pages (its presentation) and of
the texts below it (its content) are measured as entropies. What looks and reads the same on page after
page is of low importance, and such branches are cut from each page first; then go the branches whose elements
say themselves that they are menus, notices, adverts, forms or comments. Hosts of few pages
are compared as one coarse site, in which only what reads alike across hosts is of low importance; there, names decide most.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import ascii_lower, col, materialise, others, salted_join, scratch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of their own.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Start tags that end an open paragraph, and what ends an open element of its own kind.
_ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend title li dd dt".split()) | frozenset(("li", "dd", "dt"))
_ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select", "datalist")), "tbody": ("tbody thead tr td th", ("table",)), "tfoot": ("tbody thead tr td th", ("table",))}
#: Elements that hold no text of an article, whatever they hold.
NEVER = frozenset("script style noscript template svg math canvas iframe object embed audio video map head title nav aside footer form button input select textarea label dialog menu datalist".split())
#: Words of class, id and role that say the same of any element.
_SAYS = re.compile(
    r"(?:^|[\s_-])(?:(?:top|sub|main|site|left|right|side)?nav(?:bar|igation|links?)?|(?:sub)?menu|breadcrumbs?|foot(?:er)?|masthead|banner|side-?bar|aside|widgets?|ad-?(?:s|box|slot|unit|banner|container|wrapper|block)?\d*|advert(?:s|isements?|ising)?|"
    r"sponsor(?:ed|s)?|promo(?:tion)?s?|teasers?|trending|popular|most-?read|cookies?|consent|gdpr|notices?|notifications?|announcements?|disclaimer|popup|modal|overlay|dialog|newsletter|subscribe|sign-?up|login|form|search|share|sharing|social|"
    r"related|recommended|comments?|commentlist|discussion|disqus|replies|respond|pagination|pager|toolbar|skip(?:-?link)?|copyright|legal|site-?header|page-?header|top-?bar|complementary|contentinfo|alert)(?:$|[\s_-])",
    re.I,
)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|post(?:-?(?:body|content))?|entry(?:-?content)?|story(?:-?body)?|main(?:-?content)?|content)(?:$|[\s_-])", re.I)


#: A comment, a tag with whole quotes, a tag with a quote that never ends, or another declaration.
_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+>)""", re.S)
#: Elements whose content has no tags, with what ends them.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_P_STOPS = frozenset(("article", "section", "div", "td", "th", "li", "blockquote", "body", "main", "table", "button", "aside", "nav", "header", "footer", "form"))
_STRAY_STOPS = frozenset(("article", "main", "body", "table", "td"))


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []


@lru_cache(10_000)
def _said(attrs: str) -> str:
    """Words of class, id and role, and "hidden" if it is."""
    found = [(k.lower(), unescape(x or y or z)) for k, x, y, z in _ATTRIBUTE.findall(attrs)]
    words = [v for k, v in found if k in ("class", "id", "role") and v]
    if any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v, re.I)) for k, v in found):
        words.append("hidden")
    return " ".join(words)


def _end_open(at: Node, tags, stop) -> Node:
    """Where one is after open elements of these tags have ended, as far as they are open inside of stop."""
    node = at
    while node.parent is not None and node.tag not in stop:
        if node.tag in tags:
            at = node.parent
        node = node.parent
    return at


def parse_nodes(html: str | None) -> list[Node]:
    """The tree of any html as its nodes in page order, root first; open elements end where browsers end them, as far as text is concerned."""
    root = at = Node("")
    nodes, pos = [root], 0
    html = html or ""
    while True:
        m = _TOKEN.search(html, pos)
        data = html[pos : m.start()] if m else html[pos:]
        if data:
            at.children.append(unescape(data) if "&" in data else data)
        if m is None:
            return nodes
        pos = m.end()
        end, tag, attrs = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            node = at
            while node is not None and node.tag != tag:
                if node.tag in _STRAY_STOPS and tag not in BLOCKS:
                    node = None  # a stray end of an inline element ends no block
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if tag in _ENDS_P:
            at = _end_open(at, ("p",), _P_STOPS)
        if tag in _ENDS:
            own, stop = _ENDS[tag]
            at = _end_open(at, own.split(), stop)
        node = Node(tag, _said(attrs) if attrs and not attrs.isspace() else "", at)
        at.children.append(node)
        nodes.append(node)
        if tag in _RAW:
            close = _RAW[tag].search(html, pos)
            content = html[pos : close.start()] if close else html[pos:]
            node.children.append(unescape(content) if tag in ("textarea", "title") else content)
            pos = html.find(">", close.end()) + 1 if close else len(html)
            if close and not pos:
                pos = len(html)
        elif tag not in VOID:
            at = node


def parse(html: str | None) -> Node:
    return parse_nodes(html)[0]


def kind(node: Node) -> str:
    """What makes elements of different pages one node: tag and class words without digits."""
    return _kind(node.tag, node.attrs) if node.attrs else node.tag


@lru_cache(10_000)
def _kind(tag: str, attrs: str) -> str:
    return ".".join([tag, *sorted({w for w in attrs.lower().split() if not any(c.isdigit() for c in w)})])


@lru_cache(100_000)
def _digest(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def style_nodes(html: str | None) -> list[tuple[int, int, int]]:
    """(path, presentation, content) of the page's part in its host's tree: one entry a path, presentations and contents of its elements joined."""
    return _styles(parse_nodes(html))


def _styles(nodes: list[Node]) -> list[tuple[int, int, int]]:
    content: dict[int, bytes] = {}
    for node in reversed(nodes):  # children come after their parents, so theirs are known
        h = hashlib.blake2b(digest_size=8)
        for c in node.children:
            h.update(" ".join(c.split()).encode("utf-8", "replace") + b" " if isinstance(c, str) else content[id(c)])
        content[id(node)] = h.digest()
    found: dict[str, tuple[list[str], list[bytes]]] = {}
    paths = {id(nodes[0]): ""}
    for node in nodes[1:]:
        above = paths[id(node.parent)]
        if node.tag not in BLOCKS:
            paths[id(node)] = above
            continue
        path = paths[id(node)] = f"{above}/{kind(node)}"
        shapes, texts = found.setdefault(path, ([], []))
        shapes.append(" ".join([kind(c) for c in node.children if not isinstance(c, str)]))
        texts.append(content[id(node)])
    short = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
    return [(_digest(p), short("\n".join(s).encode()), short(b"".join(t))) for p, (s, t) in found.items()]


class _Blocks:
    """Text in page order, cut into blocks."""

    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []

    def cut(self) -> None:
        text = " ".join("".join(self.open).split())
        self.open.clear()
        if text:
            self.done.append(text)


def main_text(html: str | None, dull: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, joined by line feeds. dull: digests of paths of low importance on the page's host.

    Branches of low importance go first, then those whose elements say what they are. Of what is left, the article is the page's
    article or main elements (the outermost ones), else elements whose class says so, else all of it. Headings in an article's
    own header stay.
    """
    return _main_text(parse_nodes(html), dull)[0]


def _main_text(nodes: list[Node], dull: frozenset[int] | set[int] = frozenset()) -> tuple[str, int, int]:
    """The text, and how many branches the style tree and names have cut."""
    root = nodes[0]
    tops, cut = _tops(nodes, dull)
    blocks = _Blocks()
    for path, top, chosen in tops or [("", root, False)]:
        # an article that is itself alike on many pages is a repeated page, not a repeated branch
        _walk(top, path, chosen, frozenset() if _digest(path) in dull else dull, blocks, cut if tops else [0, 0])
        blocks.cut()
    return "\n".join(blocks.done), *cut


def _never(node: Node, inside: bool) -> bool:
    if node.tag in NEVER or (not inside and (node.tag == "header" or (node.tag == "div" and "header" in node.attrs.lower().split()))):
        return True
    return bool(node.attrs) and node.tag not in ("body", "html") and ("hidden" in node.attrs.split() or (_SAYS.search(node.attrs) is not None and not (_MAIN.search(node.attrs) and node.tag in ("article", "main"))))


def _tops(nodes: list[Node], dull) -> tuple[list[tuple[str, Node, bool]], list[int]]:
    """The outermost elements that hold the article, and how many branches outside of them the style tree and names have cut.

    An article of low importance is a repeated page and stays; so do the elements around any article.
    """
    found: dict[str, list] = {"article": [], "main": [], "class": []}
    cut = [0, 0]
    around: set[int] = set()  # elements that are or hold such a one
    for node in reversed(nodes):  # children come after their parents
        if (id(node) in around or _is_top(node)) and node.parent is not None:
            around |= {id(node), id(node.parent)}
    stack = [("", nodes[0], frozenset())]
    while stack:
        path, node, inside = stack.pop()
        said = _is_top(node)
        if said and said not in inside:
            found[said].append((path, node, True))
            inside = inside | {said}
        for child in reversed(node.children):
            if isinstance(child, Node):
                below = f"{path}/{kind(child)}" if child.tag in BLOCKS else path
                if child.tag in BLOCKS and child.tag not in ("html", "body") and not said and _digest(below) in dull and id(child) not in around:
                    cut[0] += not inside
                elif _never(child, False):
                    cut[1] += not inside
                else:
                    stack.append((below, child, inside))
    return next((group for group in found.values() if group), []), cut


def _is_top(node: Node) -> str | None:
    if node.tag == "article":
        return "article"
    if node.tag == "main" or "main" in node.attrs.split():
        return "main"
    return "class" if node.tag in ("div", "section", "td") and _MAIN.search(node.attrs) else None


def _walk(top: Node, path: str, chosen: bool, dull, blocks: _Blocks, cut: list[int]) -> None:
    # depth is the page's, so no recursion; a None ends a block
    stack: list[tuple[str, Node | str | None]] = [(path, c) for c in reversed(top.children)]
    while stack:
        path, x = stack.pop()
        if x is None:
            blocks.cut()
        elif isinstance(x, str):
            blocks.open.append(x)
        else:
            below = f"{path}/{kind(x)}" if x.tag in BLOCKS else path
            if x.tag in BLOCKS and x.tag not in ("html", "body") and _digest(below) in dull:
                cut[0] += 1
                blocks.cut()
            elif _never(x, chosen):
                cut[1] += 1
            elif x.tag == "br":
                blocks.open.append(" ")
            else:
                if x.tag in BLOCKS:
                    blocks.cut()
                    stack.append((path, None))
                stack.extend((below, c) for c in reversed(x.children))


def _host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def site_style_tree(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = 8, importance: float = 0.2) -> DataFrame:
    """(host, dull): digests of the paths that are of low importance, for each host of at least min_pages different pages that has any, and
    with host null for all other hosts together.

    A path's importance is the greater of two entropies over the host's pages that have it, each divided by the
    logarithm of their number: of its child sequences and of its texts. Paths on fewer than min_pages pages,
    and all paths above an important one, are left alone. Pages of a host with one main text are copies and count as one
    page (the one whose tree has the least digest), as what is alike on copies of a page needn't be the site's.
    """
    return _trees(pages, url, html, min_pages, importance).where(F.size("dull") > 0)


def _trees(pages: DataFrame, url: str, html: str, min_pages: int = 8, importance: float = 0.2) -> DataFrame:
    """site_style_tree() with a row for every host of at least min_pages different pages."""
    with scratch(pages.sparkSession) as tables:
        parsed = F.arrow_udf(_style_batches, "struct<main: binary, page: binary, nodes: array<struct<path: bigint, shape: bigint, text: bigint>>>")
        read = pages.select(_host(col(url)).alias("host"), parsed(col(html)).alias("p")).select("host", "p.*")
        read = materialise(read.withColumn("uid", F.monotonically_increasing_id()), "pages")
        # a hot page's copies are summed where they are read, and found again by numbers of their own
        once = materialise(read.groupBy("host", "main").agg(F.min(F.struct("page", "uid")).alias("first")).select("host", F.col("first.uid").alias("id")), "once")
        large = once.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select(F.col("host").alias("site"))
        large = materialise(large, "sites")
        sites = salted_join(once, large, F.col("host") == F.col("site"), "id", how="left").select("site", "id")
        nodes = read.join(sites, F.col("uid") == F.col("id")).select("site", F.explode("nodes").alias("n")).select("site", "n.*")
        nodes = materialise(nodes, "nodes")  # three measures from one reading of the pages
        # one shuffle a measure, each a sum of counts, so hot hosts and paths are summed where they are read
        measured = nodes.groupBy("site", "path").agg(F.count("*").alias("m")).where(F.col("m") >= min_pages)

        def entropy(of: str) -> DataFrame:
            counts = nodes.groupBy("site", "path", of).agg(F.count("*").alias("c"))
            return counts.groupBy(F.col("site").alias("s"), F.col("path").alias("p")).agg(F.sum(F.col("c") * F.log("c")).alias(f"s_{of}"))

        for of in ("shape", "text"):
            measured = measured.join(entropy(of), F.col("site").eqNullSafe(F.col("s")) & (F.col("path") == F.col("p"))).drop("s", "p")
        bits = lambda s: 1 - F.col(s) / (F.col("m") * F.log("m"))
        low = measured.where(F.greatest(bits("s_shape"), bits("s_text")) < importance)
        # every large host has a row, so that pages of others can be told
        rows = large.select("site", F.lit(None).cast("bigint").alias("path")).unionByName(low.select("site", "path"))
        tree = materialise(rows.groupBy(F.col("site").alias("host")).agg(F.collect_set("path").alias("dull")), "styles")
        tables.keep(tree)
    return tree


def _style_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind_ = pa.struct([("main", pa.binary()), ("page", pa.binary()), ("nodes", pa.list_(pa.struct([("path", pa.int64()), ("shape", pa.int64()), ("text", pa.int64())])))])
    for htmls in batches:
        out = []
        for h in htmls.to_pylist():
            nodes = parse_nodes(h)
            styles = _styles(nodes)
            main = hashlib.blake2b(" ".join(_main_text(nodes)[0].split()).encode("utf-8", "replace"), digest_size=16).digest()
            page = hashlib.blake2b(repr(styles).encode(), digest_size=16).digest()
            out.append({"main": main, "page": page, "nodes": [{"path": p, "shape": s, "text": t} for p, s, t in styles]})
        yield pa.array(out, kind_)


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", coarse_paths: int = 1_000_000, **options) -> DataFrame:
    """pages without html, with text (the main text's blocks, joined by line feeds), n_chars (its code points), and cut_by_tree
    and cut_by_name: how many branches went by low importance, and by what they say of themselves.

    Null or empty html gives an empty text; html is read whole, however long or deep. A url that is null or without "://" has the
    empty host, whose pages are compared with each other. Repeated rows are extracted each for itself. Where most pages of a host are
    copies of one, its article is alike on them, too; such an article stays whole. Columns with an output's name give way; any other
    names do. More than coarse_paths paths of low importance over the hosts of few pages are refused, as they go to all tasks.
    """
    tree = _trees(pages, url, html, **options)
    pool = tree.where("host IS NULL").select(F.size("dull").alias("n"), "dull")
    if (n := (pool.select("n").first() or [0])[0]) > coarse_paths:
        raise ValueError(f"{n} paths of low importance over hosts of few pages; raise coarse_paths if tasks can hold them")
    coarse = (pool.select("dull").first() or [[]])[0]
    held = pages.sparkSession.sparkContext.broadcast(frozenset(coarse))
    produced = ["text", "n_chars", "cut_by_tree", "cut_by_name"]
    kept = [c for c in others(pages, produced) if c != html]
    rows = pages.select(F.struct(*map(col, kept)).alias("row"), col(html).alias("html"), _host(col(url)).alias("page_host"))
    joined = salted_join(rows, tree.where("host IS NOT NULL"), F.col("page_host") == F.col("host"), F.octet_length("html"), how="left")

    @F.arrow_udf("struct<text: string, cut_by_tree: int, cut_by_name: int>")
    def extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, dull in batches:
            found = [_main_text(parse_nodes(h), held.value if d is None else set(d)) for h, d in zip(htmls.to_pylist(), dull.to_pylist(), strict=True)]
            text, tree_cuts, name_cuts = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(tree_cuts, pa.int32()), pa.array(name_cuts, pa.int32())], ["text", "cut_by_tree", "cut_by_name"])

    done = joined.select("row", extract("html", "dull").alias("x"))
    return done.select("row.*", F.col("x.text"), F.length("x.text").cast("long").alias("n_chars"), "x.cut_by_tree", "x.cut_by_name")
