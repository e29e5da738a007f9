"""Main text of web pages, with site templates removed.

Every page is parsed to a light tree. Subtrees of container elements are hashed, and Spark counts for
each host in how many different articles a subtree occurs; those in many are templates of the site and
are cut out, as are elements that name themselves menus, adverts, forms and the like. Paragraphs are
never taken for templates, so a sentence many articles share stays, and copies of one page count once.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import xxhash
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.common import BROADCAST_LIMIT, broadcast_if, cut, mapped

#: Elements without an end tag, elements that start a block, and elements whose text is never shown. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style noscript template iframe object svg canvas head title textarea select button option".split())
#: Elements that aren't part of an article, and words of class, id or role that say the same. Fixed values.
APART = frozenset("nav header footer aside form menu dialog".split())
APART_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header "
    "menu nav navbar navigation newsletter notice popup promo related respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget banner navigation complementary contentinfo search".split()
)
#: Containers that may be templates.
CONTAINER = frozenset("aside dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
#: A start tag on the left ends open elements on the right, up to the nearest one behind the bar. Fixed values.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Headings belong to what follows, whatever they are called.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of other languages, which may close themselves.
FOREIGN = frozenset("svg math".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "words", "children", "apart", "named", "key", "size")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]]):
        self.tag, self.children, self.key, self.size = tag, [], 0, 0
        said = [v.lower() for k, v in attrs if k in ("class", "id", "role") and v]
        self.words = " ".join(said)
        hidden = any(
            k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and UNSEEN.search(v.lower()) for k, v in attrs
        )
        self.apart = tag in APART or tag in HIDDEN or hidden
        self.named = tag not in HEADINGS and any(not APART_WORDS.isdisjoint(WORD.findall(s)) for s in said)


class Reader(HTMLParser):
    """Builds the tree; unclosed elements are closed as browsers do for paragraphs, items and cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", [])
        self.open = [self.root]

    def _close(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                return self._close(tags, until)
            if tag in until:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._close({"p"}, CONTAINER | {"td", "th", "article", "main", "li", "blockquote"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        element = Element(tag, attrs)
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        if tag in HIDDEN or tag in FOREIGN:
            self.open[-1].children.append(Element(tag, attrs))  # holds nothing
        else:
            self.handle_starttag(tag, attrs)

    def parse_marked_section(self, i, report=1):
        """A marked section, of whatever kind, is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break
            if self.open[i].tag in ("article", "main") and tag not in ("article", "main"):
                break  # a stray end tag doesn't close what holds the article

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Element:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    hashed(reader.root)
    measured(reader.root)
    return reader.root


def _walk(root: Element):
    """Elements, children before parents; no recursion, as pages may be nested deeply."""
    todo, found = [root], []
    while todo:
        element = todo.pop()
        found.append(element)
        todo += [c for c in element.children if isinstance(c, Element)]
    return reversed(found)


def hashed(root: Element) -> None:
    """Give every element the hash of its subtree: tag, names, text and the hashes of its children."""
    for element in _walk(root):
        parts = [element.tag, element.words]
        parts += [f"<{c.key}>" if isinstance(c, Element) else SPACE.sub(" ", c).strip() for c in element.children]
        element.key = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def measured(root: Element) -> None:
    """Set aside elements that name themselves something else than the article, but none that holds most of the text."""
    for element in _walk(root):
        own = (c.size if isinstance(c, Element) else len(c.strip()) for c in element.children)
        element.size = 0 if element.apart and element is not root else sum(own)
    for element in _walk(root):
        if element.named and 2 * element.size <= root.size:
            element.apart = True


def article(root: Element) -> list[Element]:
    """The outermost articles, else the outermost main parts, else the whole page."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            element = todo.pop()
            if element.tag == wanted or wanted == "main" and "main" in element.words.split():
                found.append(element)
            elif not element.apart or element is root:
                todo += [c for c in reversed(element.children) if isinstance(c, Element)]
        if found:
            return found
    return [root]


def subtrees(html: str | None) -> tuple[list[int], int]:
    """Hashes of the containers that don't hold the article, and the hash of the article."""
    root = parse(html)
    main = article(root)
    holding = {id(e) for e in main}
    for element in _walk(root):
        if any(id(c) in holding for c in element.children if isinstance(c, Element)):
            holding.add(id(element))
    keys = {e.key for e in _walk(root) if e.tag in CONTAINER and id(e) not in holding}
    return sorted(keys), xxhash.xxh3_64_intdigest(repr([e.key for e in main])) - (1 << 63)


def main_text(html: str | None, templates: set[int]) -> str:
    """Blocks of the article in page order, without templates and what isn't the article's."""
    blocks, held = [], []

    def close():
        if line := SPACE.sub(" ", "".join(held)).strip():
            blocks.append(line)
        held.clear()

    for main in article(parse(html)):
        todo: list = [main]
        while todo:
            item = todo.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                held.append(item)
            elif item is main or not (item.apart or item.tag in CONTAINER and item.key in templates):
                if item.tag in BLOCK:
                    close()
                    todo.append(None)
                if item.tag == "br":
                    held.append(" ")
                todo += reversed(item.children)
        close()
    return "\n".join(blocks)


def site_templates(pages: DataFrame, share: float = 0.05, least: int = 5) -> DataFrame:
    """``(host, templates array<long>)``: containers in at least ``least`` and ``share`` of a host's articles.

    As a template occurs in a share of the articles, a host's list is bounded by the containers of a
    page divided by ``share``.
    """

    def make():
        def step(rows):
            both = [subtrees(h) for h in rows["html"]]
            return {"host": rows["host"], "article": [b[1] for b in both], "keys": [b[0] for b in both]}

        return step

    seen = mapped(pages.select("host", "html"), make, {"host": "string", "article": "long", "keys": "array<long>"})
    seen = cut(seen, "articles")
    sizes = seen.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    each = seen.select("host", "article", F.explode("keys").alias("key")).distinct()
    counts = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") >= least).join(sizes, "host").where(F.col("n") >= share * F.col("articles"))
    return often.groupBy("host").agg(F.collect_list("key").alias("templates"))


def extract(pages: DataFrame, share: float = 0.05, least: int = 5) -> DataFrame:
    """Main text of every page: ``(page_id, url, text, n_chars)``.

    A page without text, or with null html, has an empty text; a null url belongs to the host ``''``.
    Rows are kept one for one, also with null or repeated ``page_id``; other columns are left out; an
    empty table gives an empty table.
    """
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.col("html").cast("string").alias("html"))
    templates = cut(site_templates(own, share, least), "templates")
    size = templates.agg(F.sum(64 + 8 * F.size("templates"))).first()[0] or 0

    def make():
        def step(rows):
            found = [main_text(h, set(t or ())) for h, t in zip(rows["html"], rows["templates"])]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": found, "n_chars": [len(t) for t in found]}

        return step

    joined = own.join(broadcast_if(templates, size, BROADCAST_LIMIT), "host", "left").select("page_id", "url", "html", "templates")
    return mapped(joined, make, {"page_id": "long", "url": "string", "text": "string", "n_chars": "long"})


def op7_page_text(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
