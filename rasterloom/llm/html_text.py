"""Main text of web pages by site style trees.

Each page is parsed tolerantly into a tree. Nodes of the distinct pages of one host are merged by their path of tags,
classes and ids. Two entropies over the m pages that have a merged node, each divided by log m, tell how much it varies:
a content's is that of its spread over pages, so that what each page has weighs nothing and what one page has weighs
1; a node's presentation is that of the sequences of its children's styles. A branch's importance on a page is gamma
times the mean importance of its texts, by length, plus (1 - gamma) times its node's presentation. A branch of an importance
under `threshold` goes, unless it holds more than half of what is the page's own (the sum of length times importance): then
it is a frame around the main text, and its parts are judged. Nodes on fewer than `least_pages` pages and contents on
fewer than `repeated` of a node's pages count as unknown, importance 1. The tree takes nothing from inside of an
article or main element, but decides which articles are the page's.

What the tree can't tell, as menus, adverts and comments differ from page to page and hosts may be small, is read by structure:
scripts, forms, navigation and elements whose role, class or id names page furniture go. Text is taken from outermost
articles if there are any, else from main elements, else from the body; articles and mains in low or named branches are
taken only where there are no others, those in asides, footers or comments not at all, wherever they stand.

A name alone removes no branch with more than half of the text of the page, article or main that it is in (comments may
have more, if they hold no main or first heading), and no text where nothing else is left. Words like "no" and "has"
before it undo a name; in a heading only a whole name counts. Words that articles use of themselves count outside of articles
only, and only for nodes that the tree doesn't know.

Statistics are partial aggregates by (host, node, value), so that a host with a third of all pages is spread over its
values; a host gets back 1 / `repeated` contents a text of a page at most, joined to its pages like any skewed join.
Parsing and reading take time in proportion to a page's length, whatever its nesting.

Nulls, ties, empties: a null or empty html has an empty text. A null or odd url has the host "". Repeated rows count once
in the statistics and come back each. If a host's low branches hold all of a page's text, the page keeps it. An empty
table gives an empty table. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

# Elements by how they are read, fixed values
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
GONE = RAW | {"head", "noscript", "template", "object", "svg", "canvas", "audio", "video", "map", "button", "select", "datalist", "dialog", "menu", "nav", "aside", "footer", "form", "input", "option"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "li", "dd", "dt"} | {"li", "dd", "dt"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
# Words in a class, id or role that name page furniture, fixed values
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "billboard",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "skip", "toc",
    "header", "masthead", "topbar", "footer", "colophon", "contentinfo", "copyright", "sidebar", "aside", "complementary", "widget", "widgets", "rail",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "subscription", "signup", "login",
    "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "discussion", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "tags",
    "search", "searchbox", "form", "hidden", "noprint",
}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}  # often longer than the page's own text
OWN_WORDS = {"header", "discussion", "form", "notice", "notices", "notification", "alert", "search", "rail", "consent", "copyright", "promotion", "subscription"}  # in an article, its own parts too
UNDONE = {"no", "not", "has", "with", "without"}  # "has-banner" is said of what is around a banner
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KEEP = {"html", "body", "article", "main"}
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
WORDS = re.compile(r"[a-z]+")


class Node:
    """An element: children are nodes and texts in page order. Sizes are set by Page."""

    __slots__ = ("tag", "attrs", "children", "path", "size", "own", "weight", "holds", "titled", "low")

    def __init__(self, tag: str, attrs: dict[str, str], above: int):
        self.tag, self.attrs, self.children = tag, attrs, []
        style = f"{tag}.{' '.join(sorted(attrs.get('class', '').split()))}#{attrs.get('id', '')}"
        style = re.sub(r"\d+", "0", style) if len(style) > len(tag) + 2 else style
        self.path = xxhash.xxh3_64_intdigest(style.encode("utf-8", "surrogatepass"), above)
        self.size, self.own, self.weight, self.holds, self.titled, self.low = 0, 0.0, 0, False, False, False


class Open:
    """The open elements, and where in their list those of each tag are, so that no end tag has to search."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK or node.tag == "button":
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()
            if self.blocks and self.blocks[-1] == len(self.nodes):
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost one, 0 if there is none."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def first(self, tags: set[str], after: int) -> int:
        """The place of the outermost one of some tags behind a place, 0 if there is none."""
        found = [own[i] for own in (self.places.get(t, []) for t in tags) if (i := bisect_right(own, after)) < len(own)]
        return min(found, default=0)


def parse(page: str) -> Node:
    """The tree of a page. Unclosed elements close where HTML closes them; stray end tags and broken tags are passed over."""
    root = Node("#root", {}, 0)
    pos, n, opened = 0, len(page), Open(root)
    while pos < n:
        node = opened.nodes[-1]
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            node.children.append(entities.unescape(page[pos:at]))
        if at >= n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) if not page.startswith(("<!-->", "<!--->"), at) else at + 2
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find("]]>", at) + 2 if page.startswith("<![CDATA[", at) else page.find(">", at)
            pos = n if end < 2 else end + 1
            continue
        found = TAG.match(page, at) or LOOSE_TAG.match(page, at)
        if not found:
            if re.match(r"</?[a-zA-Z]", page[at : at + 3]):  # a tag that never ends
                break
            node.children.append("<")
            pos = at + 1
            continue
        pos, tag = found.end(), found[2].lower()
        if found[1]:
            place = opened.last(tag)
            if place:
                opened.cut(place)
            continue
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in reversed(ATTRIBUTE.findall(found[3]))} if found[3].strip(" /") else {}
        if tag in CLOSES_P and opened.blocks and opened.nodes[opened.blocks[-1]].tag == "p":  # only a p that is open right here
            opened.cut(opened.blocks[-1])
        if tag in SAME_CLOSES:
            place = opened.first(SAME_CLOSES[tag], max(map(opened.last, SCOPE[tag])))
            if place:
                opened.cut(place)
        node = opened.nodes[-1]
        own = Node(tag, attrs, node.path)
        node.children.append(own)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            own.children.append(page[pos : end.start() if end else n])
            close = page.find(">", end.start()) if end else -1
            pos = close + 1 if close >= 0 else n
        elif tag not in VOID:
            opened.push(own)
    return root


def removed(node: Node) -> bool:
    """Whether an element is page furniture by its tag or hidden."""
    if node.tag in GONE or node.tag == "header":
        return True
    attrs = node.attrs
    if not attrs or node.tag in KEEP:
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def names(node: Node, inside: bool) -> set[str]:
    """The words of an element's role, class and id that name page furniture. inside: in an article or main."""
    found: set[str] = set()
    if not node.attrs:
        return found
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')} {node.attrs.get('role', '')}".split():
        words = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if len(words) > 1 and (words[0] in UNDONE or node.tag in HEADINGS):
            continue
        found.update(FURNITURE.intersection(words))
    return found - OWN_WORDS if inside else found


Site = dict[int, float]  # what a host's pages tell: importance by content (content_key) and by node (path), where it is known


def content_key(path: int, text: str) -> int:
    """A text, white space aside, of the node it stands in."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path)


class Page:
    """A page's tree with what is in each branch, without what is removed by tag: characters that aren't white space,
    their part that is the page's own, main elements and articles, first headings."""

    def __init__(self, root: Node, site: Site, by_name: bool = True, gamma: float = 0.9, threshold: float = 0.3):
        self.root, self.site, self.by_name = root, site, by_name
        order, stack = [], [root]
        while stack:
            x = stack.pop()
            x.size, x.own, x.weight, x.holds, x.titled, x.low = 0, 0.0, 0, False, False, False
            order.append(x)
            if x.tag not in GONE or x.tag == "form":
                stack += [c for c in x.children if isinstance(c, Node)]
        known = site
        for x in reversed(order):
            if x.tag in GONE and x.tag != "form":
                continue
            for c in x.children:
                if isinstance(c, str):
                    words = c.split()
                    n = sum(map(len, words))
                    if n:
                        x.size += n
                        x.weight += n
                        x.own += n * known.get(content_key(x.path, " ".join(words)), 1.0) if known else n
                else:
                    c_main = is_main(c)
                    x.holds |= c.holds or c_main or c.tag == "article"
                    x.titled |= c.titled or c_main or c.tag == "h1"
                    if not removed(c):
                        x.size, x.own, x.weight = x.size + c.size, x.own + c.own, x.weight + c.weight
        if known:
            for x in order:
                if x.weight and 2 * x.own <= root.own:
                    x.low = gamma * x.own / x.weight + (1 - gamma) * known.get(x.path, 1.0) < threshold

    def gone(self, node: Node, top: Node) -> bool:
        """Whether an element of top, which is the page or an article or main, is page furniture."""
        if removed(node):
            return not (node.tag in ("form", "header") and (node.holds or node.tag == "form" and node.titled))
        if not self.by_name or node.tag in ("html", "body") or is_main(node):
            return False
        found = names(node, top is not self.root or node.path in self.site)
        return bool(found) and (not found.isdisjoint(COMMENTS) and not (node.titled and top is self.root) or 2 * node.size <= top.size)


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.attrs.get("role") == "main"


def roots_of(page: Page) -> list[Node]:
    """Where the text is: outermost articles, else main elements, that are in no low or named branch; else those that are;
    else the whole page."""
    articles: tuple[list[Node], list[Node]] = ([], [])
    mains: tuple[list[Node], list[Node]] = ([], [])
    stack = [(page.root, False, False)]
    while stack:
        x, in_main, doubted = stack.pop()
        if x is not page.root and page.gone(x, page.root):
            comment = page.by_name and not names(x, False).isdisjoint(COMMENTS)
            if removed(x) or comment or x.tag == "article" or not x.holds:
                continue
            doubted = True
        doubted |= x.low
        if x.tag == "article":
            articles[doubted].append(x)
            continue
        if is_main(x) and not in_main:
            mains[doubted].append(x)
            in_main = True
        stack += [(c, in_main, doubted) for c in reversed(x.children) if isinstance(c, Node)]
    return articles[0] or mains[0] or articles[1] or mains[1] or [page.root]


def main_text(html: str | None, site: Site | None = None, gamma: float = 0.9, threshold: float = 0.3) -> str:
    """The page's main text: blocks in page order, two line ends between them."""
    if not html:
        return ""
    root = parse(html)
    for own, by_name in ((site or {}, True), ({}, True), ({}, False)):
        page = Page(root, own, by_name, gamma, threshold)
        out = _text(page, roots_of(page))
        if out:
            break
    return out


def _text(page: Page, roots: list[Node]) -> str:
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for top in roots:
        whole = top is page.root
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif x is not top and (whole and x.low or page.gone(x, top) and (whole or x.tag != "header")):
                if x.tag in BLOCK:
                    end()
            elif x.tag == "br":
                now.append(" ")
            else:
                if x.tag in BLOCK:
                    end()
                    stack.append(None)
                stack += reversed(x.children)
        end()
    return "\n\n".join(blocks)


CONTENT, STYLE = 0, 1


def features(root: Node) -> set[tuple[int, int, int]]:
    """(node, kind, value) of a page: the texts of merged nodes, and a hash of their children's styles. What is removed by tag
    is left out."""
    out: set[tuple[int, int, int]] = set()
    styles: dict[int, xxhash.xxh3_64] = {}
    stack = [root]
    while stack:
        x = stack.pop()
        last, kinds = None, styles.setdefault(x.path, xxhash.xxh3_64())
        for child in x.children:
            if isinstance(child, Node):
                if child.path != last:
                    last = child.path
                    kinds.update(last.to_bytes(8, "little"))
            elif words := child.split():
                out.add((x.path, CONTENT, content_key(x.path, " ".join(words))))
        kinds.update(b"|")
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and c.tag not in GONE]
    return out | {(path, STYLE, value.intdigest()) for path, value in styles.items()}


MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole = _signed(xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass")))
            for path, kind, value in features(parse(page or "")):
                for col, x in zip(cols, (host, whole, _signed(path), kind, _signed(value)), strict=True):
                    col.append(x)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "page", "node", "kind", "value"])


def _extracted(gamma: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, site = None, {}
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                own = tuple(b"" if (x := batch.column(c)[i].values) is None else x.to_numpy().tobytes() for c in (3, 4))
                if own != last:
                    last, site = own, dict(zip(np.frombuffer(own[0], "<u8").tolist(), np.frombuffer(own[1], "<f4").tolist(), strict=True))
                texts.append(main_text(batch.column(2)[i].as_py(), site, gamma, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def importance(pages: DataFrame, least_pages: int = 8, repeated: float = 0.01, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What the pages of each host tell: host, kind (CONTENT, STYLE), key, n_pages, importance.

    A content's key is its content_key, a node's its path; n_pages counts the distinct pages that have it. Nodes are those
    of `repeated` of the host's pages, and least_pages, at least.
    """
    rows = pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    seen = rows.mapInArrow(_nodes, "host string, page long, node long, kind byte, value long").distinct()
    counts = seen.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    counts = shared.write(counts.where((F.col("kind") == STYLE) | (F.col("c") > 1)), "style-tree")
    nodes = counts.where(F.col("kind") == STYLE).groupBy("host", "node").agg(F.sum("c").alias("m"), (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("h"))
    whole = nodes.where(F.col("node") == _signed(parse("").path)).select("host", F.col("m").alias("all_pages"))
    nodes = nodes.join(whole, "host").where((F.col("m") >= least_pages) & (F.col("m") >= repeated * F.col("all_pages")))
    presentation = nodes.select("host", F.lit(STYLE).alias("kind"), F.col("node").alias("key"), F.col("m").alias("n_pages"), F.when(F.col("m") > 1, F.greatest(F.col("h") / F.log("m"), F.lit(0.0))).otherwise(1.0).alias("importance"))
    others = counts.where((F.col("kind") == CONTENT) & (F.col("c") > 1)).join(nodes.select("host", "node", "m"), ["host", "node"])  # one on a single page is the default
    content = others.where(F.col("c") >= repeated * F.col("m")).select("host", F.lit(CONTENT).alias("kind"), F.col("value").alias("key"), F.col("c").alias("n_pages"), (1 - F.log("c") / F.log("m")).alias("importance"))
    return presentation.unionByName(content)


def extract(
    pages: DataFrame, threshold: float = 0.3, gamma: float = 0.9, least_pages: int = 8, repeated: float = 0.01, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """A row for each row of pages: page_id, url, text."""
    shared.small_batches(pages.sparkSession)
    told = importance(pages, least_pages, repeated, url_col, html_col)
    known = F.sort_array(F.collect_list(F.struct("key", F.col("importance").cast("float").alias("importance"))))
    sites = told.groupBy(F.col("host").alias("site")).agg(known.alias("known"), F.min("kind").alias("least_kind")).where(F.col("least_kind") == CONTENT)
    sites = sites.select("site", F.col("known.key").alias("keys"), F.col("known.importance").alias("importances"))
    # written, so that its size is known when the join is planned: small ones are broadcast, others shuffled
    sites = shared.write(sites, "sites")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    joined = rows.join(sites, host_of(F.col("url")) == F.col("site"), "left").select("page_id", "url", "html", "keys", "importances")
    return joined.mapInArrow(_extracted(gamma, threshold), "page_id long, url string, text string")
