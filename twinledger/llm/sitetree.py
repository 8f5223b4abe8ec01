"""Main text of web pages by a site style tree.

The pages of a host are merged by their branches: a node of the tree is a path of block elements with their style (tag and
first class or id, digits folded). For every node and host the operator counts in how many pages it occurs, how its content differs
between pages, how the styles of its children differ, and how much of its text is links. Its importance is

    (style_weight * H(styles) + (1 - style_weight) * H(contents)) * (1 - share of link text)

with entropies divided by the logarithm of the page count, so between 0 (the same everywhere, or all links) and 1. Branches under `least_importance`
are cut from the pages of that host. The names of branches (nav, aside, class="cookie-notice", ...) are what is believed beforehand: a named branch needs
`named_importance` to stay, and is cut where the host has too few pages to tell.
A listed word counts if a whole class, id or role consists of such words; it doesn't reach into an article or main element, and an element with
blocks of its own that holds most of the page's text isn't cut by its words.
Branches of an article or main element are cut as well, by counts in which articles of the same content are one: a page that was copied stays an article.

Pages are read twice. Where the node names to cut are proven few, in all and for each host, they are sent to the pages, which aren't moved; else pages
are moved once, joined with the node names to cut in each. Hosts are never gathered.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import kept_table

MASK = (1 << 63) - 1
#: Node names to cut, in all and of one host, up to which they may be broadcast.
TOLD_ROWS, HOST_ROWS = 200_000, 200
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|svg|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that make a block of their own; all others are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of a class, id or role, that name a part which isn't the article.
PART_TAGS = frozenset("nav header footer aside form menu dialog button select head search".split())
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related "
    "replies reply respond search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset(("articlebody", "main"))
# A start tag closes these open elements, as far as no other container lies between.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(frozen=True)
class StyleTree:
    least_importance: float = 0.2
    named_importance: float = 0.9
    style_weight: float = 0.3
    least_pages: int = 5


class _Element:
    __slots__ = ("tag", "path", "above", "by_tag", "by_word", "article", "content", "style", "chars", "links")

    def __init__(self, tag: str, path: str, above: _Element | None, by_tag: bool, by_word: bool, article: bool):
        self.tag, self.path, self.above, self.by_tag, self.by_word, self.article = tag, path, above, by_tag, by_word, article
        self.content = self.style = self.chars = self.links = 0

    def root(self) -> _Element | None:
        """The outermost article element around this one, or itself."""
        e = self if self.article else None
        while e and e.above and e.above.article:
            e = e.above
        return e

    def cut(self, paths: frozenset[str]) -> bool:
        """Whether a branch of `paths` holds the element; what lies around an article doesn't decide on it."""
        e = self
        while e:
            if e.path in paths:
                return True
            if e.article and not (e.above and e.above.article):
                return False
            e = e.above
        return False

    def part(self, total: int, kept: frozenset[str] = frozenset()) -> bool:
        """Whether the element is in a named part, not among `kept`, of a page of `total` characters; to be asked when the page has been read."""
        e, words = self, True
        while e:
            # A wrapper of blocks with most of the page's text is no part, whatever its name says.
            if (e.by_tag or (e.by_word and words)) and e.path not in kept and not (e.style and 2 * e.chars > total and (e.by_word or e.tag == "form")):
                return True
            words = words and e.tag not in ARTICLE_TAGS
            e = e.above
        return False


def _element(tag: str, attrs: str, above: _Element | None) -> _Element:
    style, words, named, names = tag, set(), False, _NAMES.findall(attrs) if "=" in attrs else ()
    for name, *values in names:
        value = html.unescape(next((v for v in values if v), "")).lower()
        if name.lower() in ("class", "id") and style == tag and value.split():
            style = f"{tag}.{re.sub('[0-9]+', '#', value.split()[0])}"
        for one in value.split():
            words.update([one, *re.split("[-_:]+", one)])
            named = named or all(w in PART_WORDS for w in re.split("[-_:]+", one))
    article = bool(above and above.article) or tag in ARTICLE_TAGS or bool(words & ARTICLE_WORDS)
    # The heading part of an article belongs to it; a page's header doesn't.
    by_tag = tag in PART_TAGS and not (tag == "header" and above and above.article)
    by_word = named and tag not in ("html", "body", "article", "main")
    style += "!" if by_tag or by_word else ""
    return _Element(tag, f"{above.path}/{style}" if above else style, above, by_tag, by_word, article)


def blocks_of(page: str, closed=None) -> Iterator[tuple[str, _Element]]:
    """(text, innermost block element) in page order, white space folded and references decoded; calls closed(element) when an element ends."""
    stack = [_Element("html", "html", None, False, False, False)]
    pieces: list[str] = []
    link = [0, 0]  # open links; characters of the present block in links

    def flush():
        text = " ".join("".join(pieces).split())
        pieces.clear()
        found = None
        if text:
            mark = _marker(text)
            for e in stack:
                e.content = (e.content * 1000003 + mark) & MASK
                e.chars += len(text)
                e.links += min(link[1], len(text))
            found = text, stack[-1]
        link[0] = link[1] = 0
        return found

    def pop():
        e = stack.pop()
        if stack:
            stack[-1].style = (stack[-1].style * 1000003 + _marker(e.path)) & MASK
        if closed:
            closed(e)

    def said(text: str):
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if link[0]:
                link[1] += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        said(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["raw"]:
                pieces.append(" ")
            continue
        if tag not in BLOCKS:
            if tag == "a":
                link[0] = 0 if (m["end"] or m["end2"]) else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        if found := flush():
            yield found
        if m["end"] or m["end2"]:
            if any(e.tag == tag for e in stack[1:]):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "p" or (stack[-1].tag == "head" and tag == "body"):
            pop()
        while stack[-1].tag in _CLOSES.get(tag, ()):
            pop()
        if tag not in VOID:
            stack.append(_element(tag, m["attrs"] or m["attrs2"] or "", stack[-1]))
    said(page[at:])
    if found := flush():
        yield found
    while stack:
        pop()


def _marker(text: str) -> int:
    import zlib

    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def main_text(page: str, cut: frozenset[str] = frozenset(), kept: frozenset[str] = frozenset()) -> str:
    """The blocks that are left when named parts that aren't in `kept`, and the branches in `cut`, are gone, one a line.

    If `cut` would leave nothing, the branches that merely repeat themselves stay: all pages of the host are alike then.
    """
    blocks = list(blocks_of(page))
    total = sum(len(text) for text, _ in blocks)
    blocks = [(text, e) for text, e in blocks if not e.part(total, kept)]
    left = [(text, e) for text, e in blocks if not e.cut(cut)] if cut else blocks
    return "\n".join(text for text, _ in left or blocks)


def _keyed(pages: DataFrame) -> DataFrame:
    url, page = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    host: Column = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), page.alias("html"),
                        host.alias("host"), F.xxhash64(F.col("page_id").cast("long"), url, page).alias("key"))


def page_nodes(pages: DataFrame) -> DataFrame:
    """One row per page and node: key, host, path, unit (the fingerprint of the article that the node is in, or else key), content and
    styles (fingerprints), chars and links (characters)."""
    kinds = [("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("unit", pa.int64()), ("content", pa.int64()), ("styles", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found: dict[str, list[int]] = {}
                elements: list[_Element] = []
                for _ in blocks_of(page, elements.append):
                    pass
                for e in elements:
                    if e.chars:
                        n = found.setdefault(e.path, [key if not e.article else 0, 0, 0, 0, 0])
                        if e.article:
                            n[0] = (n[0] * 31 + e.root().content) & MASK
                        n[1], n[2] = (n[1] * 31 + e.content) & MASK, (n[2] * 31 + e.style) & MASK
                        n[3] += e.chars
                        n[4] += e.links
                rows += [(key, host, path, *n) for path, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    return pages.select("key", "host", "html").mapInArrow(nodes, "key long, host string, path string, unit long, content long, styles long, chars long, links long")


def node_importance(nodes: DataFrame, tree: StyleTree = StyleTree()) -> DataFrame:
    """(host, path, pages, importance) of nodes that occur in at least least_pages pages; counts meet, not pages. Pages with the
    same article are one page for what is in it."""
    each = nodes.groupBy("host", "path", "unit", "content", "styles").agg(F.max("chars").alias("chars"), F.max("links").alias("links")).selectExpr("host", "path", "stack(2, 'content', content, 'styles', styles) AS (kind, mark)", "chars", "links")
    seen = each.groupBy("host", "path", "kind", "mark").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    w = tree.style_weight
    return (
        seen.groupBy("host", "path", "kind").agg(
            F.sum("n").alias("pages"), F.expr("sum(n * ln(n))").alias("nlogn"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
        .filter(F.col("pages") >= max(2, tree.least_pages))
        .withColumn("entropy", F.expr("(ln(pages) - nlogn / pages) / ln(pages)"))
        .groupBy("host", "path").agg(
            F.max("pages").alias("pages"), F.expr(f"sum(entropy * if(kind = 'styles', {w}, {1 - w})) * (1 - max(links) / max(chars))").alias("importance"))
    )


def _few(told: DataFrame) -> bool:
    """Whether the node names to cut are proven few enough to be sent around by host."""
    total, most = told.groupBy("host").count().agg(F.sum("count"), F.max("count")).first()
    return (total or 0) <= TOLD_ROWS and (most or 0) <= HOST_ROWS


def extract_main_text(pages: DataFrame, tree: StyleTree = StyleTree()) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none).

    Null html counts as empty, a null or odd url as a host without name. Rows that repeat, or repeat a page_id, give a row each.
    Further columns are left out; an empty table gives no rows.
    """
    keyed = _keyed(pages)
    nodes = kept_table(page_nodes(keyed), "nodes")
    low = F.col("importance") < tree.least_importance
    told = node_importance(nodes, tree).filter(low | (F.col("path").endswith("!") & (F.col("importance") >= tree.named_importance)))
    told = kept_table(told.select("host", "path", low.alias("low")), "told")
    by = "host" if _few(told) else "key"
    if by == "key":
        told = nodes.select("key", "host", "path").distinct().join(told, ["host", "path"])
    cuts = told.groupBy(by).agg(
        F.collect_set(F.when(F.col("low"), F.col("path"))).alias("cut"), F.collect_set(F.when(~F.col("low"), F.col("path"))).alias("stay"))
    joined = keyed.join(F.broadcast(cuts) if by == "host" else cuts, by, "left").select("page_id", "url", "html", "cut", "stay")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, frozenset(c or ()), frozenset(s or ())) for p, c, s in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(extract, "page_id long, url string, text string")


def with_lengths(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
