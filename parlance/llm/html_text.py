"""HTML extraction: the main text of pages, without their hosts' templates.

A page is read into a tree of elements. Each element with text has a hash of its subtree, that is of
its tag and the hashes of what it holds; Spark counts on how many different pages of its host a
subtree recurs, and subtrees that recur on many are the host's template and deleted. Pages
count as different by their longest block of text, so copies of a page don't make its article a
template. What no count can show, as on hosts of one page, is decided by the page's own markup:
menus, forms, adverts, comments and the like by tag, role and class.

Counting shuffles three numbers an element, with distinct counts in two steps, so a host with a third
of all pages isn't one group. A host's template is bounded: its subtrees recur on a stated share of the
host's pages, so there are at most 1 / share times as many as a page has elements.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import release, stored

#: A subtree outside of a declared article is template from so many different pages and this share of
#: the host's; a paragraph inside of one from these.
PAGES, SHARE = 3, 0.2
ARTICLE_PAGES, ARTICLE_SHARE = 8, 0.6

#: Rows (host, hash) of templates that are broadcast, 16 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
SALTS = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary".split())
BLOCKS = PROSE | frozenset(
    "address article aside body center details dialog dir div dl fieldset figure footer form header hgroup hr html legend main menu nav ol optgroup option section table tbody tfoot thead tr ul".split()
)
NEVER = frozenset("head script style noscript template nav footer aside form button input select option textarea iframe object embed svg math canvas audio video dialog menu title noembed noframes datalist label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription signup paywall share sharing social comment comments commentlist disqus respond responses replies discussion sidebar widget widgets related recommended recommendations breadcrumb breadcrumbs"
    " menu nav navbar navigation pagination pager footer masthead toolbar skip login hidden".split()
)
CONTENT = frozenset("article post entry story content main".split())
#: Without a declared article: lists and boxes with this share of their text in two or more links are menus.
LINKED = 0.8

#: Start tags that end an open element: an open p before any block, items and cells before their like.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "hash", "size", "linked", "links")

    def __init__(self, tag: str, attributes: str = "", parent: Element | None = None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.hash = self.size = self.linked = self.links = 0  # of the subtree: hash, characters of text, those in links, links

    def names(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)} if self.attributes.strip() else {}

    def words(self) -> set[str]:
        names = self.names()
        return {w.lower() for w in _NAME.findall(names.get("class", "") + " " + names.get("id", ""))}


def parsed(page: str) -> Element:
    """The tree of a page: elements, and texts with their references decoded. Any text is a page."""
    root = at = Element("html")
    place, end = 0, len(page)
    while place < end:
        m = _TOKEN.match(page, place)
        place = m.end()
        if m[2] is None:
            if m[0][:2] not in ("<!", "<?"):
                at.children.append(html.unescape(m[0]))
            continue
        tag = m[2].lower()
        if m[1]:
            up = at
            while up is not None and up.tag != tag and not (tag not in BLOCKS and up.tag in BLOCKS):
                up = up.parent  # an inline end tag doesn't end blocks
            if up is not None and up.tag == tag and up.parent is not None:
                at = up.parent
            elif tag == "p":
                at.children.append(Element("p", "", at))  # an end tag alone divides, too
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            up = at
            while up is not None and up.tag != "p" and up.tag not in BLOCKS:
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                at = up.parent  # a block ends an open paragraph
            elif tag in ENDS:
                up = at
                while up is not None and up.tag not in ENDS[tag] and up.tag not in HOLDS[tag]:
                    up = up.parent
                while up is not None and up.tag in ENDS[tag]:
                    at, up = up.parent, up.parent
        element = Element(tag, m[3], at)
        at.children.append(element)
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, place)
            element.children.append(page[place : close.start() if close else end])
            place = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            at = element
    return root


def elements(root: Element) -> list[Element]:
    """All elements, parents before what they hold; without recursion, as pages nest at will."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        out.append(e)
        stack += [c for c in reversed(e.children) if isinstance(c, Element)]
    return out


def hashed(found: list[Element]) -> None:
    """Hashes and text sizes of all subtrees, from the leaves up."""
    for e in reversed(found):
        h = blake2b(e.tag.encode(), digest_size=8)
        for c in e.children:
            if isinstance(c, Element):
                if c.tag not in NEVER or c.size:
                    h.update(c.hash.to_bytes(8, "little"))
                    e.size, e.linked, e.links = e.size + c.size, e.linked + c.linked, e.links + c.links
            elif words := " ".join(c.split()):
                h.update(b"\0" + words.encode("utf-8", "surrogatepass"))
                e.size += len(words)
        e.hash = int.from_bytes(h.digest(), "little")
        if e.tag in ("script", "style", "template", "noscript", "head", "title"):
            e.size = 0
        if e.tag == "a":
            e.linked, e.links = e.size, 1


def _named_out(e: Element) -> bool:
    names = e.names()
    if names.keys() & {"hidden", "inert"} or names.get("aria-hidden", "").lower() == "true" or names.get("aria-modal", "").lower() == "true":
        return True
    if "display:none" in names.get("style", "").replace(" ", "").lower() or ROLES & set(names.get("role", "").lower().split()):
        return True
    return bool(e.words() & NAMES)


def dropped(e: Element, article: Element | None) -> bool:
    """Is the element none of the main text by its own markup?"""
    if e is article or e.tag in ("html", "body"):
        return False
    if e.tag in NEVER:
        return True
    if article is None:
        if e.tag == "header" or e.attributes and "header" in (words := e.words()) and not words & CONTENT:
            return True
        if e.links > 1 and e.tag in ("ul", "ol", "div", "section", "table") and e.linked >= LINKED * e.size:
            return True
    return bool(e.attributes) and _named_out(e)


def article_of(found: list[Element]) -> Element | None:
    """The page's declared main element: the largest article that is no comment, or else the element whose
    itemprop is articleBody, the largest main, or one that is named so and holds most of the text."""

    def outside(e: Element) -> bool:
        up = e
        while up is not None and up.tag not in ("html", "body"):
            if up.tag in ("aside", "footer", "nav", "form", "template", "noscript") or up.attributes and _named_out(up):
                return up is e or up.size < 2 * e.size or up.tag in ("template", "noscript")
            up = up.parent
        return False

    for fits in (
        lambda e: e.tag == "article" or e.attributes and e.names().get("role", "").lower() == "article",
        lambda e: e.attributes and e.names().get("itemprop", "") == "articleBody",
        lambda e: e.tag == "main" or e.attributes and e.names().get("role", "").lower() == "main",
        lambda e: e.attributes and e.tag in BLOCKS and e.tag != "body" and 2 * e.size >= found[0].size and e.words() & CONTENT,
    ):
        mine = [e for e in found if e.size and fits(e) and not outside(e)]
        if mine:
            return max(mine, key=lambda e: e.size)  # the first of equals
    return None


def is_prose(e: Element, inside: bool) -> bool:
    return inside and (e.tag in PROSE or e.tag not in BLOCKS)


def blocks(root: Element, article: Element | None, template: frozenset[int] = frozenset(), strict: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below ``root`` in page order, without what is dropped or template.

    Without an article an element that is named like a sidebar but holds half of the page's text stays.
    """
    out: list[str] = []
    open_: list[str] = []
    half = root.size / 2

    def close() -> None:
        text = " ".join("".join(open_).split())
        open_.clear()
        if text:
            out.append(text)

    stack: list = [root]
    while stack:
        e = stack.pop()
        if e is None:
            close()
        elif isinstance(e, str):
            open_.append(e)
        elif e.tag in ("br", "wbr", "hr", "img"):
            open_.append("" if e.tag == "wbr" else " ")
            if e.tag == "hr":
                close()
        else:
            gone = e.hash in (strict if is_prose(e, article is not None) else template)
            if e is not root and (gone or dropped(e, article) and not (article is None and e.tag not in NEVER and e.size > half)):
                if e.tag in BLOCKS:
                    close()
                continue
            if e.tag in BLOCKS:
                close()
                stack.append(None)
            stack += reversed(e.children)
    close()
    return out


def signature(found: list[Element]) -> int:
    """What tells pages apart: the hash of the longest prose element, or 0."""
    prose = [e for e in found if e.tag in PROSE and e.size] or [e for e in found if e.size and all(isinstance(c, str) for c in e.children)]
    return max(prose, key=lambda e: e.size).hash if prose else 0


def _long(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page, hash, prose: the subtrees of the pages (host, html) with text; hash 0 is the page itself.

    Of elements with one child and no text beside it only the outer one counts. page: the page's signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                found = elements(parsed(page.as_py() or ""))
                hashed(found)
                article, mark = article_of(found), _long(signature(found))
                inside = {id(e) for e in elements(article)} if article else set()
                seen = {(0, False)}
                for e in found[1:]:
                    alone = e.parent is not None and len(e.parent.children) == 1 and e.parent.tag not in ("html", "body")
                    if e.size and e.tag != "body" and e is not article and not alone:
                        seen.add((_long(e.hash), is_prose(e, id(e) in inside)))
                rows += [(host, mark, h, prose) for h, prose in seen]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["host", "page", "hash", "prose"])

    return pages.where("host is not null").select("host", "html").mapInArrow(run, "host long, page long, hash long, prose boolean")


def templates(pages: DataFrame) -> DataFrame:
    """host, hash, prose: subtrees that recur on enough different pages of their host."""
    counts = stored(subtrees(pages).groupBy("host", "hash", "prose").agg(F.count_distinct("page").alias("n")).where(f"n >= {min(PAGES, ARTICLE_PAGES)} or hash = 0"), "subtrees")
    totals = counts.where("hash = 0").select("host", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = counts.where("hash <> 0").withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    many = lambda pages_, share: (F.col("n") >= pages_) & (F.col("n") >= F.col("total") * share)
    found = salted.join(totals, ["host", "salt"])
    return found.where(F.when(F.col("prose"), many(ARTICLE_PAGES, ARTICLE_SHARE)).otherwise(many(PAGES, SHARE))).select("host", "hash", "prose")


def extracted(pages: DataFrame, template: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` (html, host and others) with ``text`` and without html and host."""
    spark, others = pages.sparkSession, [c for c in pages.columns if c not in ("html", "host")]
    per_host = template.groupBy("host").agg(F.collect_list(F.when(~F.col("prose"), F.col("hash"))).alias("template"), F.collect_list(F.when(F.col("prose"), F.col("hash"))).alias("strict"))
    if template.count() <= broadcast_rows:
        joined = pages.join(F.broadcast(per_host), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        joined = salted.join(per_host.select("*", salts), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = []
            for page, *hashes in zip(batch.column("html"), batch.column("template"), batch.column("strict")):
                found = elements(parsed(page.as_py() or ""))
                hashed(found)
                article = article_of(found)
                texts.append("\n".join(blocks(article or found[0], article, *(frozenset(h % (1 << 64) for h in x.as_py() or ()) for x in hashes))))
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*others, "text"])

    schema = spark.createDataFrame([], pages.select(*others).schema).withColumn("text", F.lit("")).schema
    return joined.select(*others, "html", "template", "strict").mapInArrow(run, schema)


def with_hosts(pages: DataFrame) -> DataFrame:
    """host: a hash of the url's host in lower case; null for a null url, and for one without a host."""
    host = F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.withColumn("host", F.when(host != "", F.xxhash64(host)))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of each page; a null or empty page has an empty text.

    Rows that are repeated have a row each; pages without a host lose no template. No pages: no rows.
    """
    pages = with_hosts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    found = extracted(pages, stored(templates(pages), "templates"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: For pages whose main text is an article element that holds headings and paragraphs alone.
OP13_SQL = r"""WITH cut AS (
    SELECT page_id, url, string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:p|h[1-6])>') AS b FROM pages
), plain AS (
    SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>|<!--.*?-->', '', 'g'))) AS b FROM cut
), decoded AS (
    SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM plain
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url, regexp_replace(array_to_string(b, chr(10)), '&amp', '&', 'g') AS text FROM decoded)"""
