"""Main text of web pages by removal of site templates.

A page becomes a tree of elements.  Elements that never hold article text go by
their tag, or by a name (role, id, one of the classes) that says nothing but what they
are, such as ``cookie-notice``, not ``share-price`` or ``no-comments``.  All subtrees of
the page, those too, are hashed (tag and white-space-free text); Spark counts, host by
host, on how many different pages each occurs inside the article and outside of it.  Pages whose article is the same
count once, so copies of an article do not make it a template.  The text of what is
left inside the article (or main element, or body) is put out block by block.

A subtree inside the article is its host's template if it is outside the article on
at least ``LEAST`` different pages and inside on two, however many pages the host
has, or inside on ``LEAST`` pages and a ``SHARE`` of the host's.  Inside alone a fixed
number would not do: sentences of articles recur.  Pages meet their templates by a
join on host and subtree.  Hosts of fewer than ``LEAST`` pages have no templates: there
tags and names decide alone.

Cases: null and empty html give the empty text; pages without a host form one
host; truncated pages end all open elements; stray end tags are skipped; repeated
rows give repeated results; a page of any length is read whole; an empty table gives an
empty result; an input column named ``text`` is replaced, all others come through,
whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from docloom.llm.names import col, fresh, rest
from docloom.session import Workspace, ship

LEAST, SHARE = 4, 0.25

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|</?[a-zA-Z][^>]*+>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
GONE = frozenset(
    "head nav header footer aside form script style noscript template iframe svg math object embed canvas audio video "
    "button select option textarea input label fieldset dialog menu title".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
STOPS = frozenset("ul ol dl table article section div body nav main aside header footer".split())
# Words in class, id or role that name parts other than the article; those of comments; and words that only place such a part.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidenav aside complementary footer masthead contentinfo cookie cookies consent gdpr notice notices "
    "popup modal overlay dialog alert newsletter subscribe subscription signup login share sharing social related recommended "
    "pagination pager search searchbox toolbar widget widgets skip skiplink copyright legal disclaimer tracking".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
NAMED = NOT_ARTICLE | COMMENTS
PLACES = frozenset(
    "left right top bottom upper lower main site page global primary secondary inner outer box block bar list links link area section wrapper "
    "wrap container group row item items slot unit panel region zone posts articles stories form button buttons icon icons".split()
)


class Node:
    __slots__ = ("tag", "gone", "children", "digest")

    def __init__(self, tag: str, gone: bool):
        self.tag, self.gone, self.children, self.digest = tag, gone, [], 0

    def close(self) -> None:
        parts = [x.digest if isinstance(x, Node) else "".join(x.split()) for x in self.children if not (isinstance(x, Node) and x.gone)]
        parts = [str(p) for p in parts if p]
        self.digest = xxhash.xxh3_64_intdigest(f"{self.tag}\x00{chr(1).join(parts)}") >> 1 if parts else 0


def _named(attributes: str, parts: frozenset[str]) -> bool:
    """Whether a class, id or role names such a part, and nothing besides it."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in (a or b or c).split():
                words = {w.lower() for w in NAME_PART.findall(token)}
                if words & parts and all(w in parts or w in PLACES or w.isdigit() for w in words):
                    return True
    return False


def _hidden(attributes: str) -> bool:
    return any(n.lower() == "hidden" or n.lower() == "aria-hidden" and (a or b or c).lower() == "true" for n, a, b, c in ATTRIBUTE.findall(attributes))


def parse(page: str) -> Node:
    """The tree of a page; elements that never hold article text are marked gone."""
    root = Node("#page", False)
    stack, at, size = [root], 0, len(page)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw))

    def end(count: int) -> None:
        for _ in range(count):
            stack.pop().close()

    def shut(tags: tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return end(len(stack) - depth)
            if stack[depth].tag in STOPS:
                return None
        return None

    while (m := TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    end(len(stack) - depth)
                    break
            continue
        if tag in CLOSES_P:
            shut(("p",))
        if tag in CLOSES:
            shut(CLOSES[tag])
        if tag in ("html", "body", "article", "main"):
            gone = tag == "article" and _named(m[3], COMMENTS)
        else:
            gone = tag in GONE or bool(m[3]) and (_hidden(m[3]) or _named(m[3], NAMED))
        node = Node(tag, gone)
        if tag == "header" and any(x.tag in ("article", "main") for x in stack):
            node.gone = False  # an article's own heading
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW and not m[0].endswith("/>"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        stack.append(node)
    text(page[at:])
    end(len(stack))
    return root


def articles(root: Node) -> list[Node]:
    """The outermost article elements with text, else main elements, else the body, else the page."""
    for tag in ("article", "main", "body"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.gone:
                continue
            if node.tag == tag and node.digest:
                found.append(node)
            else:
                todo += [x for x in reversed(node.children) if isinstance(x, Node)]
        if found:
            return found
    return [root]


def subtrees(root: Node) -> tuple[int, set[int], set[int]]:
    """A hash of the article, and the hashes of all subtrees inside it and of those outside or gone."""
    tops = articles(root)
    inner, found = {id(x) for x in tops}, (set(), set())
    todo = [(root, 1)]
    while todo:
        node, out = todo.pop()
        top = id(node) in inner
        out = 0 if top else 1 if node.gone else out
        if node.digest and node.tag not in INLINE and not top:
            found[out].add(node.digest)
        todo += [(x, out) for x in node.children if isinstance(x, Node)]
    return xxhash.xxh3_64_intdigest(",".join(str(x.digest) for x in tops)) >> 1, *found


def text_of(root: Node, template: frozenset[int] | set[int]) -> str:
    """The article's blocks, white space in a block as one space, joined by an empty line."""
    blocks: list[str] = []
    part: list[str] = []

    def flush() -> None:
        block = " ".join("".join(part).split())
        part.clear()
        if block:
            blocks.append(block)

    for top in articles(root):
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                part.append(x)
            elif x.gone or x is not top and x.digest and x.digest in template:
                continue
            elif x.tag == "br":
                part.append(" ")
            elif x.tag in INLINE:
                todo += reversed(x.children)
            else:
                flush()
                todo.append(None)
                todo += reversed(x.children)
        flush()
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, h, page in zip(batch["_key"], batch["_host"], batch["_html"]):
            article, inside, outside = subtrees(parse(page or ""))
            rows.append((key, h, 0, article, True))
            rows += [(key, h, x, article, True) for x in inside]
            rows += [(key, h, x, article, False) for x in outside]
        yield pd.DataFrame(rows, columns=["key", "host", "subtree", "article", "inside"])


def templates(seen: DataFrame) -> DataFrame:
    """(host, subtree): each host's template inside articles; seen has the rows of _hashes."""
    counts = seen.select("host", "subtree", "article", "inside").distinct().groupBy("host", "subtree")
    counts = counts.agg(F.count_if("inside").alias("n"), F.count_if(~F.col("inside")).alias("outside"))
    whole = counts.where("subtree = 0").select("host", F.col("n").alias("pages"))
    known = (F.col("outside") >= LEAST) & (F.col("n") >= 2)
    often = counts.where((F.col("subtree") != 0) & (known | (F.col("n") >= LEAST))).join(whole, "host")
    return often.where(known | (F.col("n") >= SHARE * F.col("pages"))).select("host", "subtree")


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with text, the main text of each."""
    spark = pages.sparkSession
    ship(spark)
    names = rest(pages, "text")
    page_key = F.xxhash64(col(url).cast("string"), col(html).cast("string"))
    with Workspace(spark, "html") as work:
        read = pages.select(page_key.alias("_key"), host(col(url)).alias("_host"), col(html).alias("_html"))
        seen = work.save(read.mapInPandas(_hashes, "key long, host string, subtree long, article long, inside boolean"), "seen")
        met = seen.where("inside").join(templates(seen), ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("template"))
        known = work.save(met, "met", keep=True)

    @F.pandas_udf("string")
    def told(html: pd.Series, template: pd.Series) -> pd.Series:
        return pd.Series([text_of(parse(h or ""), frozenset(t) if t is not None else frozenset()) for h, t in zip(html, template)], dtype=object)

    key, template = fresh(pages, "_key", "_template")
    if known.isEmpty():
        joined = pages.withColumn(template, F.lit(None).cast("array<long>"))
    else:
        joined = pages.withColumn(key, page_key).join(known.select(F.col("key").alias(key), F.col("template").alias(template)), key, "left")
    return joined.select(*map(col, names), told(col(html), F.col(template)).alias("text"))
