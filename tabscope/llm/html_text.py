"""Main text of web pages by site style trees.

Pages are parsed into blocks of text, each with the path of its elements (tags with their classes).  The pages of a
host are merged into a style tree by path.  Two entropies, to the base of the host's pages, weigh a node: that of its
presentations (the sequences of child elements it is seen with), high where pages differ, and that of each content
over the pages, high where one content stands on many.  A block's importance is

    (1 - DECAY) * presentation entropy of the element around it + DECAY * (1 - entropy of its content)

and a block goes if that is at most ``importance``.  All blocks of all elements but scripts and the like are weighed, so the
tree takes what repeats in menus, footers and notices, whatever they are called.
Pages under one heading count as one, so that copies of an article don't make it a template; hosts of fewer than
``least_pages`` such pages have no tree.

Menus, adverts and footers whose text differs on every page of a site are as important as content to the tree.  What is
left after it in elements that are never content (menus, forms, and what a class, id or role calls an advert, a notice or
a comment, alone or with its holder or place as in ``share-bar`` and ``top-nav``) is removed by name, and where an article
or main element holds at least a quarter of the rest, what stands outside is not its article.  A name or a form does not remove
the article or main element inside of it, unless it is one for comments or other articles; inside of an article, headings
and paragraphs are not removed by name; and where nothing else is left, what stands in the fewest elements removed by name
is kept.  Elements within a line (buttons, labels, hidden spans) that are no content leave the line around them whole.

Defined results: null, empty or textless pages give an empty text; a null url belongs to the host ""; broken markup is
read as far as it goes (unclosed paragraphs end at the next block, end tags without a start are ignored); repeated rows
give repeated results; input columns called as a result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from tabscope.functions.columns import col
from tabscope.llm.common import add_columns, as_bytes, others
from tabscope.llm.url_filter import host_and_path
from tabscope.plans.stored import stored

DECAY = 0.9

#: Elements of HTML by the part they play here.
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
NEVER = frozenset((
    "aside audio button canvas datalist dialog footer form head iframe input label menu nav noframes noscript object "
    "optgroup option script select style svg template textarea title video"
).split())
ARTICLE = frozenset(("article", "main"))
MAIN = frozenset(("main", "main-content", "maincontent"))
#: What a page is called by, the first that it has; a page without one is called by all its text.
HEADINGS = ("h1", "h2", "h3", "title")
#: Elements whose content does not end a paragraph around them.
SCOPES = frozenset("button object table td template th".split())
#: Start tags that end an open element of the same group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Classes, ids or roles that call an element something else than content.
NAMED = frozenset((
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets related recommended "
    "recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs topbar footer copyright comment comments "
    "reply replies respond disqus login search toolbar pagination pager complementary contentinfo dialog alertdialog menubar form"
).split())
#: Names and elements whose articles are not the page's own.
OTHERS = frozenset("comment comments reply replies respond disqus related recommended recommendations sidebar".split())
#: Elements that a name doesn't remove inside of an article.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: The same outside of an article only; inside it is the article's own head.
NAMED_OUTSIDE = frozenset(("header", "masthead", "banner"))
#: Names of two words: one of the above with what it stands in, or where it stands.
HOLDERS = frozenset("area bar block bottom box button buttons container content form group inner item items link links list panel posts section slot thread unit wrap wrapper".split())
PLACES = frozenset("bottom global inner left main page post primary right secondary side site sub top".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


@dataclass
class Element:
    tag: str
    path: str
    dropped: bool
    named: int  # elements around, this one too, that are removed by name or are forms
    others: bool  # one of them is for comments or other articles
    article: bool
    block: bool
    silent: bool  # inside of a block, but not of its text
    children: list[str] = field(default_factory=list)


@lru_cache(maxsize=4096)
def _named(attributes: str) -> tuple[str, frozenset[str], bool]:
    """Classes as written in a path, classes, id and roles, and whether the element is hidden."""
    found = {k.lower(): unescape(v.strip("\"'")).lower() for k, v in ATTRIBUTE.findall(attributes)}
    # names with numbers differ from page to page
    classes = ".".join(sorted(c for c in found.get("class", "").split() if not any(map(str.isdigit, c))))
    words = frozenset(" ".join(found.get(k, "") for k in ("class", "id", "role")).split())
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return classes, words, hidden


def is_named(words: frozenset[str], names: frozenset[str]) -> bool:
    """Whether a class, id or role is one of ``names``, or one of them with its holder or its place."""
    if words & names:
        return True
    for word in words:
        parts = re.split("[-_]+", word)
        if len(parts) == 2 and (parts[0] in names and parts[1] in HOLDERS or parts[1] in names and parts[0] in PLACES):
            return True
    return False


def parsed(html: str) -> tuple[str, list[tuple[str, str, int, bool]], list[tuple[str, str]]]:
    """Heading, blocks (path, text, names around that call for removal, within an article), and styles (path, child elements)."""
    stack = [Element("", "", False, 0, False, False, True, False)]
    blocks: list[tuple[Element, str]] = []
    buffer: list[str] = []
    headings: dict[str, str] = {}
    at = 0

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        around = next(e for e in reversed(stack) if e.block)
        if text and not around.dropped:
            blocks.append((around, text))
            if around.tag in HEADINGS:
                headings.setdefault(around.tag, text)

    def close(depth: int) -> None:
        if any(e.block for e in stack[depth:]):
            flush()
        del stack[depth:]

    while at < len(html):
        token = TOKEN.match(html, at)
        at = token.end()
        end, tag, attributes = token.groups()
        if tag is None:
            if not (stack[-1].silent or token.group().startswith(("<!", "<?"))):
                buffer.append(token.group())
            continue
        tag = tag.lower()
        if end:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), None)
            if depth is not None:
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        classes, words, hidden = _named(attributes) if attributes else ("", frozenset(), False)
        block = tag in BLOCKS
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
            if tag == "title":
                headings.setdefault(tag, " ".join(unescape(html[at:stop.start() if stop else len(html)]).split()))
            at = stop.start() if stop else len(html)
            stop = html.find(">", at)
            at = stop + 1 if stop >= 0 else len(html)
            continue
        if block:
            flush()
            if tag not in ("html", "head") and any(e.tag == "head" for e in stack):
                close(next(i for i, e in enumerate(stack) if e.tag == "head"))
            if stack[-1].tag == "p" or not stack[-1].block:  # a block ends the paragraph that is open in this scope
                nearest = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in SCOPES), 0)
                if stack[nearest].tag == "p":
                    close(nearest)
            while stack[-1].tag in ENDS.get(tag, ()):
                close(len(stack) - 1)
        elif tag == "br":
            buffer.append(" ")
        if tag in VOID or attributes.endswith("/") and not block:
            continue
        above = stack[-1]
        named = is_named(words, NAMED)
        if above.article:
            named &= tag not in PROSE
        else:
            named |= is_named(words, NAMED_OUTSIDE) or tag == "header"
        named = (named and tag not in ("html", "body") and not (tag in ARTICLE and not words & {"comment", "comments", "reply"})) or tag == "form"
        never = tag in NEVER and tag != "form" or hidden and tag not in ("html", "body", *ARTICLE)
        if not block and not never and not named:
            continue  # markup inside a block
        article = tag in ARTICLE or bool(words & MAIN)
        own = article and not above.article and (tag == "main" or not above.others)  # the page's own, whatever it stands in
        if block:
            above.children.append(f"{tag}.{classes}")
        stack.append(Element(tag, f"{above.path}/{tag}.{classes}", above.dropped or never, (0 if own else above.named) + named,
                             above.others or named and is_named(words, OTHERS), above.article or article, block,
                             not block and (above.silent or never or named)))
    flush()
    styles = {e.path: " ".join(e.children) for e, _ in blocks}
    heading = next((headings[h] for h in HEADINGS if headings.get(h)), "") or " ".join(t for _, t in blocks)
    return heading, [(e.path, t, e.named, e.article) for e, t in blocks], list(styles.items())


def _hash(text: str) -> int:
    value = xxh64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


PARSED = "heading bigint, blocks array<struct<path: bigint, content: bigint, text: string, named: int, article: boolean>>, styles array<struct<path: bigint, style: bigint>>"


def with_blocks(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``df`` without its html, with site (the url's host), heading (a hash), blocks and styles."""
    block = pa.list_(pa.struct([("path", pa.int64()), ("content", pa.int64()), ("text", pa.string()), ("named", pa.int32()), ("article", pa.bool_())]))
    style = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64())]))

    def run(pages):
        headings, blocks, styles = [], [], []
        for data in as_bytes(pages):
            heading, own_blocks, own_styles = parsed(data.decode("utf-8", "replace"))
            headings.append(_hash(heading))
            blocks.append([{"path": _hash(p), "content": _hash(t), "text": t, "named": n, "article": a} for p, t, n, a in own_blocks])
            styles.append([{"path": _hash(p), "style": _hash(s)} for p, s in own_styles])
        return [pa.array(headings, pa.int64()), pa.array(blocks, block), pa.array(styles, style)]

    site = df.select(*[col(c) for c in df.columns if c != html], host_and_path(col(url))[0].alias("site"), col(html).alias("__html"))
    return add_columns(site, PARSED, run, F.col("__html")).drop("__html")


def templates(pages: DataFrame, importance: float, least_pages: int) -> DataFrame:
    """Blocks of low importance by site: ``gone`` holds (path, content) of each."""
    sites = pages.groupBy("site").agg(F.count_distinct("heading").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    contents = (pages.select("site", "heading", F.explode("blocks").alias("b")).select("site", "heading", "b.path", "b.content").distinct()
                .groupBy("site", "path", "content").agg(F.count("*").alias("n")))
    presented = (pages.select("site", "heading", F.explode("styles").alias("s")).select("site", "heading", "s.path", "s.style").distinct()
                 .groupBy("site", "path", "style").agg(F.count("*").alias("n")))
    # -sum p log p = log N - (sum n log n) / N, with N the sum of n
    spread = presented.groupBy("site", "path").agg(
        (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("presentations"))
    # a content on one page alone is as important as can be
    weighed = contents.where("n > 1").join(sites, "site").join(spread, ["site", "path"], "left")
    base = F.log("n_pages")
    value = (1 - DECAY) * F.coalesce("presentations", F.lit(0.0)) / base + DECAY * (1 - F.log("n") / base)
    # low importance takes a growing number of pages, so these are few blocks for a site
    return weighed.where(value <= importance).groupBy(F.col("site").alias("of_site")).agg(F.collect_set(F.struct("path", "content")).alias("gone"))


def article_blocks(blocks: Column) -> Column:
    """Of a page's blocks those in the fewest elements removed by name, and of these the article's, if it holds a quarter of their text."""
    least = F.array_min(F.transform(blocks, lambda b: b["named"]))
    named = F.filter(blocks, lambda b: b["named"] == least)
    inside = F.filter(named, lambda b: b["article"])

    def chars(own: Column) -> Column:
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda n, b: n + F.length(b["text"]))

    return F.when((F.size(inside) > 0) & (4 * chars(inside) >= chars(named)), inside).otherwise(named)


def main_text(df: DataFrame, html: str = "html", url: str = "url", text: str = "text", importance: float = 0.25, least_pages: int = 10) -> DataFrame:
    """``df`` without its html, with the main text of its pages: blocks in page order, joined by empty lines."""
    pages = stored(with_blocks(df, html, url), "pages")
    # stored, so that Spark knows the size: small ones are broadcast, others joined by a shuffle
    gone = stored(templates(pages, importance, least_pages), "templates")
    joined = pages.join(gone, F.col("site") == F.col("of_site"), "left")
    left = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(
        F.filter("blocks", lambda b: ~F.array_contains("gone", F.struct(b["path"].alias("path"), b["content"].alias("content")))))
    made = F.array_join(F.transform(article_blocks(F.col("__left")), lambda b: b["text"]), "\n\n")
    return joined.withColumn("__left", left).select(*others(df, (html, text)), made.alias(text))
