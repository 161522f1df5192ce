"""HTML extraction with site template removal.

Pages become blocks of text, each with the hashes of the element subtrees that hold it.
Spark counts the different pages of a host on which a subtree recurs; subtrees on many pages of
their host are template and are deleted.  Every block element is counted, whatever its name or class
(but for the text blocks of an article); what the markup itself names as menu, header,
footer, sidebar, notice, advert, form, script, style or reader comment is then dropped where it
doesn't recur, as on hosts of few pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .url_filter import url_host

#: A subtree is template when it is on this many different pages of its host, and on this share of its pages.
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 0.002
#: A paragraph, heading, item or cell alone may be template only outside articles and from this many characters on, so that short ones that many pages say stay.
LONG_TEXT = 25
#: Up to this many (host, subtree) templates are sent to the tasks; more are joined to the pages.
BROADCAST_TEMPLATES = 200_000

#: Elements by their role.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html legend li main menu nav noscript ol option p pre section summary table tbody td template tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head script style noscript template title nav footer aside form button select textarea iframe object svg canvas dialog menu".split())
RAW = set("script style textarea title noscript iframe".split())
#: Elements that an opening tag closes when they are open.
CLOSES_P = BLOCKS - set("body html option caption tbody td tfoot th thead tr title template noscript".split())
#: Content elements: see LONG_TEXT.
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr article main body html".split())
#: Words in class, id or role that name boilerplate.
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|widget\w*|related|recommend\w*|"
    r"cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|comments?|respond|replies|disqus|"
    r"search\w*|pagination|pager|toolbar|alert|complementary|contentinfo|navigation)(?=$|[\s_-])", re.I)

#: Inside an article only a whole class, id or role counts, and only one that names what no article holds.
_BOILER_INSIDE = re.compile(
    r"(?:^|\s)(?:ads?|ad-\w+|advert\w*|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|footer|sidebar|cookies?|cookie-\w+|notices?|newsletter|comments?|comment-\w+|"
    r"respond|replies|disqus\w*)(?=$|\s)", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"[\s ]+")


class Block(NamedTuple):
    text: str
    #: Subtrees that hold the block, outermost first: index into the page's subtrees.
    path: tuple[int, ...]
    #: By its markup.
    dropped: bool
    article: bool


class _Open:
    __slots__ = ("name", "dropped", "article", "index", "start")

    def __init__(self, name: str, dropped: bool, article: bool, index: int, start: int):
        self.name, self.dropped, self.article, self.index, self.start = name, dropped, article, index, start


def parse(page: str) -> tuple[list[Block], list[tuple[int, bool]]]:
    """Blocks in page order, and each element subtree as (64-bit hash of its tags and text, may be template)."""
    stack = [_Open("#root", False, False, -1, 0)]
    blocks: list[Block] = []
    trees: list[list] = []  # hash state, may be template whatever its length, may be if it is long, characters
    text: list[str] = []

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip(" ")
            text.clear()
            if line:
                top = stack[-1]
                path = tuple(o.index for o in stack if o.index >= 0)
                data = line.encode("utf-8", "surrogatepass")
                for i in path:
                    trees[i][0].update(b"\0" + data)
                    trees[i][3] += len(line)
                blocks.append(Block(line, path, top.dropped, top.article))

    def close(to: int) -> None:
        del stack[to:]

    at = 0
    while at <= len(page):
        m = _TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        block = name in BLOCKS or name in DROPPED
        if m.group(1):  # closing tag
            if name not in VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        if block or any(o.name in BLOCKS for o in stack[k:]):
                            flush()
                        close(k)
                        break
                    if not block and stack[k].name in BLOCKS:
                        break
            continue
        attrs = m.group(3)
        if block:
            flush()
            if name in CLOSES_P and any(o.name == "p" for o in stack):
                close(next(k for k, o in enumerate(stack) if o.name == "p"))
            elif name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                own = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, (name,))
                stop = ("ul", "ol", "dl", "table", "select", "menu")
                k = len(stack) - 1
                while k > 0 and stack[k].name not in stop:
                    if stack[k].name in own:
                        close(k)
                    k -= 1
        top = stack[-1]
        # A header inside an article is its title; outside it is the page's.
        drop = top.dropped or name in DROPPED or name == "header" and not top.article
        if attrs and not drop and name not in ("html", "body"):
            said = " ".join(a or b or c for a, b, c in _ATTR.findall(attrs))
            named = _BOILER_INSIDE if top.article else _BOILER
            drop = bool(name not in ("article", "main") and said and named.search(said)) or bool(_HIDDEN.search(attrs))
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        article = top.article or name in ("article", "main")
        index = -1
        if block and name not in ("html", "body", "head") and name not in RAW:
            index = len(trees)
            trees.append([xxhash.xxh64(name), name not in TEXT_BLOCKS, not article, 0])
            for o in stack:
                if o.index >= 0:
                    trees[o.index][0].update(b"<" + name.encode("utf-8", "surrogatepass"))
        stack.append(_Open(name, drop, article, index, 0))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if not drop and name not in ("script", "style"):
                text.append(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page) + 1
    flush()
    return blocks, [(t.intdigest() - 2**63, n > 0 and (any_ or outside and n >= LONG_TEXT)) for t, any_, outside, n in trees]


def main_text(page: str | None, templates: set[int] | None = None) -> str:
    """Text of a page's blocks, one to a line, without the subtrees of the given hashes and what the markup names.

    With article or main elements that hold text only their blocks count.
    """
    blocks, trees = parse(page or "")
    gone = {i for i, (h, may) in enumerate(trees) if may and templates and h in templates}
    kept = [b for b in blocks if gone.isdisjoint(b.path) and not b.dropped]
    if any(b.article for b in kept):
        kept = [b for b in kept if b.article]
    return "\n".join(b.text for b in kept)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, keys, trees = [], [], []
        for host, key, page in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
            own = {h for h, may in parse(page.as_py() or "")[1] if may}
            hosts += [host] * len(own)
            keys += [key] * len(own)
            trees += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(trees, pa.int64())], ["host", "key", "tree"])


def _texts(known: dict[str, set[int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, page = batch.column(2), batch.column(3)
            sets = ((known.get(h) for h in host.to_pylist()) if known is not None else ({*(x or ())} for x in batch.column(4).to_pylist()))
            out = [main_text(p.as_py(), s) for p, s in zip(page, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return run


def site_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_pages: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """(host, tree long): subtrees on at least least_pages pages of their host and at least that share of them.

    Pages of equal html are one page, so that copies of a page don't make its content a template.  A page counts once for
    each of its subtrees; pages of a subtree are told apart by their hash, which deals a hot host's pages over all tasks, and
    counted before the next shuffle.  Pages without a host share the empty one.
    """
    base = pages.select(url_host(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("key"), F.col(html_col).alias("html"))
    of_host = base.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    each = base.mapInArrow(_subtrees, "host string, key long, tree long").distinct()
    trees = each.groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return trees.join(of_host, "host").where(F.col("n") >= share * F.col("pages")).select("host", "tree")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """(page_id, url, text, n_chars long) for every row of pages.

    Null or empty html gives an empty text; whole pages of any length are read; null and repeated ids are rows like any
    other; other columns are not read; an empty table gives an empty result.  Templates go to the tasks when there
    are at most broadcast_templates of them, else to the pages in a join by host.
    """
    templates = cut(site_templates(pages, id_col, url_col, html_col))
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    if templates.count() <= broadcast_templates:
        known: dict[str, set[int]] | None = {}
        for r in templates.collect():
            known.setdefault(r["host"], set()).add(r["tree"])
    else:
        known = None
        base = base.join(templates.groupBy("host").agg(F.collect_set("tree").alias("trees")), "host", "left").select("page_id", "url", "host", "html", "trees")
    out = base.mapInArrow(_texts(known), f"page_id {types[id_col]}, url {types[url_col]}, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
