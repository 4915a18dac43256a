"""HTML extraction: main text of pages, with site templates found by counting subtrees per host.

A page is read into a tree of elements. The hash of a subtree covers its tags, its attributes and its
text. Spark counts on how many pages of a host each subtree occurs; those on many of them belong to
the site's template and go, except within the article itself, where a repeated paragraph is text.
What is a menu, footer, advert or comment by its tag, role or class goes on every page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variegate.llm.common import checked_broadcast, written
from variegate.llm.url_filter import host_of

# What HTML says about its elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
         "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
         "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
         "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th",
         "thead", "tr", "ul"}
ENDS_PARAGRAPH = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "dd",
                          "dt", "li", "legend", "summary", "figcaption"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
             "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "menu", "div", "article", "section", "body", "main"}
DROPPED = {"script", "style", "noscript", "template", "title", "head", "nav", "header", "footer",
           "aside", "form", "button", "select", "option", "textarea", "input", "label", "iframe",
           "object", "embed", "svg", "canvas", "audio", "video", "menu", "dialog", "noembed",
           "noframes", "search", "datalist", "fieldset"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert",
                 "alertdialog", "form", "menu", "menubar", "toolbar", "tablist"}
# Words of class and id names that mark what is not main text.
MARKS = {"ad", "ads", "advert", "advertisement", "adverts", "adsense", "sponsor", "sponsored", "promo",
         "promotion", "banner", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb",
         "breadcrumbs", "header", "masthead", "topbar", "footer", "foot", "sidebar", "aside", "widget",
         "widgets", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
         "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
         "login", "share", "sharing", "social", "comment", "comments", "disqus", "respond", "replies",
         "related", "recommended", "recommendations", "pagination", "pager", "toc", "copyright",
         "legal", "disclaimer", "skip", "search", "form", "rail", "toolbar"}
MAIN = {"article", "main"}
# Words that say nothing beside a mark: "site-footer" is marked, "article-header" is not.
NEUTRAL = {"site", "main", "page", "top", "bottom", "left", "right", "primary", "secondary", "global",
           "box", "bar", "block", "area", "container", "wrapper", "wrap", "inner", "outer", "slot", "unit",
           "list", "item", "items", "link", "links", "button", "buttons", "section", "panel", "group",
           "posts", "bottom", "sticky", "fixed", "mobile", "desktop", "the", "my"}
# The marks that count for an article, and for what holds one: it may be a comment or a teaser.
ARTICLE_MARKS = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "comment", "comments",
                 "replies", "related", "recommended"}

TAG = re.compile(r"<(?:!--(.*?)(?:-->|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
                 r"|[!?][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
SPACE = re.compile(r"\s+")

# A subtree is a template's if it is on at least so many different pages of a host, and on as many as
# the root of their number.
LEAST_PAGES = 5


class Node:
    __slots__ = ("tag", "given", "children", "hash")

    def __init__(self, tag: str, given: str):
        self.tag, self.given, self.children, self.hash = tag, given, [], 0


def parse(page: str | None) -> Node:
    """The page as a tree; text is strings among children. Never fails: odd markup becomes text."""
    root = Node("#root", "")
    stack, at, page = [root], 0, page or ""
    find = TAG.search
    while True:
        match = find(page, at)
        if match is None:
            break
        if match.start() > at:
            stack[-1].children.append(page[at:match.start()])
        at = match.end()
        tag = match[3]
        if tag is None:
            continue
        tag = tag.lower()
        if match[2]:
            _close(stack, tag)
            continue
        _make_room(stack, tag)
        node = Node(tag, match[4])
        stack[-1].children.append(node)
        if tag in VOID or match[4].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            inner = page[at:end.start() if end else len(page)]
            if inner:
                node.children.append(inner)
            at = end.end() if end else len(page)
            continue
        stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in BLOCK and tag not in BLOCK:
            return  # an inline end tag does not end blocks


def _make_room(stack: list[Node], tag: str) -> None:
    """Ends what a start tag ends by itself: a paragraph before a block, an item before an item."""
    if tag in ENDS_PARAGRAPH:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in BLOCK:
                break
    closed = CLOSED_BY.get(tag)
    if closed:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in closed:
                del stack[i:]
                break
            if stack[i].tag in SCOPE:
                break


def attributes(given: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in ATTRIBUTE.findall(given):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def names_mark(names: str, marks: set[str]) -> bool:
    """Whether one of the names is a mark: all of its words are marks or neutral, and not all neutral."""
    for name in names.split():
        words = [w.lower() for w in NAME_WORD.findall(name)]
        if any(w in marks for w in words) and all(w in marks or w in NEUTRAL for w in words):
            return True
    return False


def is_marked(node: Node, in_article: bool = False, holds: bool = False) -> bool:
    """Whether tag, role or names say that the element is not main text.

    The header of an article holds its title, so there the tag alone does not count. An element that
    holds an article or main element goes by few names only.
    """
    if node.tag in DROPPED and not (in_article and node.tag == "header"):
        return True
    if not node.given or node.tag in ("html", "body"):
        return False
    given = attributes(node.given)
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" \
            or re.search(r"display\s*:\s*none", given.get("style", "")):
        return True
    if given.get("role", "").lower() in DROPPED_ROLES:
        return True
    names = f"{given.get('class', '')} {given.get('id', '')}"
    return names_mark(names, ARTICLE_MARKS if holds or node.tag in MAIN else MARKS)


def holders(root: Node, tags: set[str]) -> set[int]:
    """Ids of the elements that hold one of ``tags``."""
    order, stack = [], [root]
    while stack:
        own = stack.pop()
        order.append(own)
        stack += [c for c in own.children if isinstance(c, Node)]
    found: set[int] = set()
    for own in reversed(order):
        if any(isinstance(c, Node) and (c.tag in tags or id(c) in found) for c in own.children):
            found.add(id(own))
    return found


def hash_subtrees(node: Node) -> list[int]:
    """Sets the hash of each element and returns those that may be a template's.

    Without a loop over one's own calls, so depth is no limit. What is in an article, or in a main
    element that holds none, is not returned, as a paragraph that recurs there is text; nor is what
    holds one of them.
    """
    with_article = holders(node, {"article"})
    order, stack = [], [(node, False)]
    while stack:
        own, inside = stack.pop()
        order.append((own, inside))
        inside = inside or own.tag == "article" or own.tag == "main" and id(own) not in with_article
        stack += [(c, inside) for c in own.children if isinstance(c, Node)]
    holds, found = holders(node, MAIN), set()
    for own, inside in reversed(order):
        digest = xxhash.xxh64(f"<{own.tag} {own.given.strip()}>")
        for child in own.children:
            if isinstance(child, Node):
                digest.update(child.hash.to_bytes(8, "big"))
            else:
                digest.update(SPACE.sub(" ", child))
        own.hash = digest.intdigest()
        if not inside and own.tag not in MAIN and own.tag not in ("#root", "html", "head", "body") \
                and id(own) not in holds and own.tag not in VOID:
            found.add(own.hash - (1 << 63))
    return sorted(found)


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the main text joined by two line feeds; ``template``: hashes that go."""
    holds = holders(root, MAIN)
    within = _main_parts(root, holds)
    in_article = within[0] is not root
    blocks, current = [], []

    def flush():
        text = SPACE.sub(" ", html.unescape("".join(current))).strip()
        current.clear()
        if text:
            blocks.append(text)

    stack = [(part, True) for part in reversed(within)]
    while stack:
        item, opening = stack.pop()
        if isinstance(item, str):
            current.append(item)
            continue
        if not opening:
            flush()
            continue
        if item.tag != "#root" and (is_marked(item, in_article, id(item) in holds)
                                    or template and item.hash - (1 << 63) in template):
            continue
        if item.tag in ("br", "wbr"):
            current.append(" " if item.tag == "br" else "")
            continue
        if item.tag in BLOCK:
            flush()
            stack.append((item, False))
        stack += [(c, True) for c in reversed(item.children)]
    flush()
    return "\n\n".join(blocks)


def _main_parts(root: Node, holds: set[int]) -> list[Node]:
    """The outermost articles and main elements in page order, else the whole page."""
    parts, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag != "#root" and is_marked(node, holds=id(node) in holds):
            continue
        if node.tag in MAIN:
            parts.append(node)
            continue
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return parts or [root]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html",
            url: str = "url", least_pages: int = LEAST_PAGES) -> DataFrame:
    """``keep`` and ``text``, the main text of every row; null and empty pages have empty text.

    Pages of a host (null and hostless urls are one host without a template) are counted by
    their subtrees. A subtree counts once for a page, and copies of a page count as one. It is a
    template's from ``least_pages`` pages on, and from the root of the number of the host's pages.
    Counts are combined before the shuffle, so a hot host is no hot task. What recurs comes back as one
    list for each host, at most a page's subtrees times that root long, and is broadcast if it is
    counted to be small. Rows are kept as they are, repeats too.
    """
    rows = pages.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)],
                        host_of(F.col(url)).alias("__host"), F.col(page).alias("__page"))
    hosted = rows.select("__host", "__page", F.xxhash64("__page").alias("__hash")).where(F.col("__host") != "")
    copied = written(hosted.groupBy(F.col("__host").alias("__of"), F.col("__hash").alias("__as"))
                     .agg(F.count(F.lit(1)).alias("__copies")).where(F.col("__copies") > 1))
    weighed = hosted.join(checked_broadcast(copied), (F.col("__host") == F.col("__of"))
                          & (F.col("__hash") == F.col("__as")), "left") \
        .select("__host", "__page", (F.lit(1.0) / F.coalesce("__copies", F.lit(1))).alias("__share"))
    found = weighed.mapInArrow(_count_subtrees, "host string, hash long, n double")
    # shares of copies add up to one page, but for rounding
    counts = written(found.groupBy("host", "hash").agg(F.round(F.sum("n"), 3).alias("n")))
    sizes = counts.where(F.col("hash").isNull()).select("host", F.col("n").alias("pages"))
    often = counts.where(F.col("hash").isNotNull() & (F.col("n") >= least_pages))
    often = often.join(sizes, "host").where(F.col("n") >= F.sqrt("pages"))
    templates = written(often.groupBy("host").agg(F.collect_list("hash").alias("__template")))
    joined = rows.join(checked_broadcast(templates, 20_000),
                       F.col("__host") == F.col("host"), "left")
    schema = pages.select(*[F.col(c) for c in keep]).withColumn("text", F.lit("")).schema
    names = [f"__keep{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for batch in batches:
            out = []
            for host, own, template in zip(batch["__host"].to_pylist(), batch["__page"],
                                           batch["__template"]):
                if template.is_valid and host not in sets:
                    if len(sets) >= 1000:
                        sets.clear()
                    sets[host] = set(template.as_py())
                root = parse(own.as_py())
                gone = sets[host] if template.is_valid else set()
                if gone:
                    hash_subtrees(root)
                out.append(main_text(root, gone))
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], pa.array(out, pa.string())], names=[*keep, "text"])

    return joined.select(*names, "__host", "__page", "__template").mapInArrow(run, schema)


def _count_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of host, subtree and pages; a null subtree counts the host's pages."""
    for batch in batches:
        counts: dict = {}
        for host, page, share in zip(batch["__host"].to_pylist(), batch["__page"],
                                     batch["__share"].to_pylist()):
            for own in [None, *hash_subtrees(parse(page.as_py()))]:
                counts[host, own] = counts.get((host, own), 0.0) + share
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()),
             pa.array([k[1] for k in counts], pa.int64()),
             pa.array(list(counts.values()), pa.float64())], names=["host", "hash", "n"])
