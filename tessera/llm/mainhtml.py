"""Main text of web pages by site template removal.

Each page is parsed into elements. The subtrees of container elements (lists, boxes, navigation, …) are
hashed by tags and text and counted per host in Spark, over pages with different main text, so that copies of a
page do not make a template of its article. Subtrees that recur on at least ``MIN_PAGES`` such pages of their host are
deleted wherever they stand, in the article as well; the number is the same for hosts of any size. Paragraphs and headings
are no containers, since pages may quote the same passage.

What a single page tells is used beside that: elements that are by their tag, role or names no part of an article go (inside
the article by far fewer names than outside), and of a page with an `article` (else a `main`) element the rest is left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: A subtree is a template if it is on at least this many pages of different text of its host.
MIN_PAGES = 4
#: Up to this many templates travel with the tasks (8 bytes each); more are joined by page.
SHIPPED_TEMPLATES = 500_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption body head html tbody td tfoot th thead tr title option legend".split())
#: tag: (open tags that it ends, tags the search for them stops at)
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_STOPS = frozenset("table td th caption button object".split())
#: Elements whose recurrence marks a template; article text stands in others.
CONTAINERS = frozenset("div section nav ul ol dl menu aside header footer form table figure details dialog".split())
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button input select textarea iframe svg canvas object embed"
    " dialog menu noembed noframes xmp datalist map audio video search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion banner cookie cookies"
    " consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " pagination pager footer masthead topbar toolbar comment comments commentlist disqus reply replies respond related recommended"
    " recommendations share sharing social widget login skip".split()
)
#: The names that count inside an article: adverts, menus, comments, and notices about cookies and letters.
DROPPED_INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors cookie cookies consent gdpr newsletter"
    " subscribe sidebar nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments commentlist disqus".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Page:
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    #: In page order: a node number at its start, its complement at its end, or a piece of text.
    events: list[int | str] = field(default_factory=list)


def parse(html: str) -> Page:
    """Elements in page order. The open ones are kept by tag as well, so that an end tag need not look through them."""
    page, stack = Page(), [-1]
    tags, events = page.tags, page.events
    depths: dict[str, list[int]] = {}

    def open_(tag: str, attr: str) -> None:
        tags.append(tag)
        page.parents.append(stack[-1])
        page.attrs.append(attr)
        events.append(len(tags) - 1)

    def deepest(names: Iterable[str]) -> int:
        return max((depths[t][-1] for t in names if depths.get(t)), default=0)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            depths[tags[node]].pop()
            events.append(~node)

    def end_open(ended: frozenset[str], stops: frozenset[str]) -> None:
        depth = deepest(ended)
        if depth > deepest(stops):
            close_to(depth)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            events.append(html[at:])
            break
        if m.start() > at:
            events.append(html[at : m.start()])
        at = m.end()
        slash, name, attr = m[1], m[2], m[3]
        if name is None:
            slash, name, attr = m[4], m[5], m[6]
            if name is None:
                continue
        tag = name.lower()
        if slash:
            if tag == "br":
                events.append(" ")
                continue
            if depth := deepest([tag]):
                close_to(depth)
            continue
        if tag in CLOSES_P:
            end_open(frozenset(["p"]), P_STOPS)
        if tag in IMPLIED:
            end_open(*IMPLIED[tag])
        open_(tag, attr)
        node = len(tags) - 1
        if tag in VOID:
            events.append(~node)
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(html, at)
            if tag == "title" or tag == "textarea":
                events.append(html[at : end.start()])
            at = end.end()
            events.append(~node)
        elif attr.endswith("/") and tag in ("path", "rect", "use", "circle", "g"):
            events.append(~node)
        else:
            depths.setdefault(tag, []).append(len(stack))
            stack.append(node)
    close_to(1)
    return page


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def _no_article(tag: str, raw: str, inside: bool) -> bool:
    """By its tag, role or names the element is no part of an article; ``inside`` if it stands in one."""
    if tag in DROPPED:
        return True
    if not raw or tag in ("html", "body", "main"):
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if a.get("role", "").lower() in DROPPED_ROLES:
        return True
    names = _WORD.findall(f"{a.get('class', '')} {a.get('id', '')}".lower())
    if tag == "article":
        return any(w in ("comment", "comments", "reply", "ad", "advert", "sponsored", "related") for w in names)
    return any(w in (DROPPED_INSIDE if inside else DROPPED_WORDS) for w in names)


def subtree_hashes(page: Page) -> list[int | None]:
    """For each container element with text: a signed 64-bit hash of its tags and text, blanks and attributes left out."""
    hashes: list[int | None] = [None] * len(page.tags)
    open_: list[tuple[int, xxhash.xxh64, list[bool]]] = []
    for e in page.events:
        if isinstance(e, str):
            if open_ and (words := e.split()):
                open_[-1][1].update(" ".join(words) + "\1")
                open_[-1][2][0] = True
        elif e >= 0:
            h = xxhash.xxh64(page.tags[e] + "\2")
            open_.append((e, h, [False]))
        else:
            node, h, text = open_.pop()
            h.update("\3")
            value = h.intdigest()
            if text[0] and page.tags[node] in CONTAINERS:
                hashes[node] = value - (1 << 64) if value >> 63 else value
            if open_:
                open_[-1][1].update(value.to_bytes(8, "big"))
                open_[-1][2][0] |= text[0]
    return hashes


def main_text(page: Page, templates: set[int] | frozenset[int] = frozenset(), hashes: list[int | None] | None = None) -> str:
    """Blocks of the article, one a line, white space inside a block as one space."""
    n = len(page.tags)
    gone = [False] * n
    inside = [False] * n  # of an article or main element
    in_header = [False] * n
    roots: dict[str, list[int]] = {"article": [], "main": []}
    for i, (tag, parent, raw) in enumerate(zip(page.tags, page.parents, page.attrs)):
        up = parent >= 0
        gone[i] = (up and gone[parent]) or _no_article(tag, raw, up and inside[parent]) or bool(templates and hashes and hashes[i] in templates)
        kind = "main" if tag != "article" and (tag == "main" or _attributes(raw).get("role", "").lower() == "main") else tag
        inside[i] = (up and inside[parent]) or kind in roots
        if kind in roots and not gone[i]:
            roots[kind].append(i)
        in_header[i] = (up and in_header[parent]) or tag == "header"
        if not gone[i] and in_header[i]:
            # of a header, headings inside the article stay
            if not inside[i]:
                gone[i] = True
    chosen = frozenset(roots["article"] or roots["main"])
    blocks: list[str] = []
    line: list[str] = []
    within = [not chosen] * n
    heading = [False] * n

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    current: list[int] = []
    for e in page.events:
        if isinstance(e, str):
            node = current[-1] if current else -1
            if node < 0:
                if not chosen:
                    line.append(e)
            elif within[node] and not gone[node] and (heading[node] or not in_header[node]):
                line.append(e)
            continue
        node = e if e >= 0 else ~e
        if e >= 0:
            parent = page.parents[node]
            within[node] = within[node] or node in chosen or (parent >= 0 and within[parent])
            heading[node] = page.tags[node] in HEADINGS or (parent >= 0 and heading[parent])
        if page.tags[node] in BLOCK:
            flush()
        elif page.tags[node] == "br":
            line.append(" ")
        if e >= 0:
            current.append(node)
        else:
            current.pop()
    flush()
    return "\n".join(blocks)


def page_host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _page_key(url: Column, html: Column) -> Column:
    return F.xxhash64(url, html)


def page_subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, host, main, subtree): the distinct container subtrees of each page and a hash of its main text."""
    rows = pages.select(_page_key(F.col(url_col), F.col(html_col)).alias("page"), page_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = rows.where("html is not null and html != ''")
    schema = pa.schema([("page", pa.int64()), ("host", pa.string()), ("main", pa.int64()), ("subtree", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hosts, mains, subtrees = [], [], [], []
            for key, host, html in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "html"))):
                page = parse(html)
                found = {h for h in subtree_hashes(page) if h is not None}
                main = xxhash.xxh64_intdigest(main_text(page)) >> 1
                keys += [key] * len(found)
                hosts += [host] * len(found)
                mains += [main] * len(found)
                subtrees += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((keys, hosts, mains, subtrees), schema)], schema=schema)

    return rows.mapInArrow(run, "page long, host string, main long, subtree long")


def templates_of(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) of the templates. Counts are combined before the shuffle, so a large host is no hot key."""
    counts = subtrees.select("host", "subtree", "main").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_pages).select("host", "subtree")


def _extract(shipped: np.ndarray | None):
    """``shipped``: sorted hashes of (host, subtree), or None where each row brings its templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            own = batch.column("removed").to_pylist() if shipped is None else None
            for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
                page = parse(html or "")
                hashes = subtree_hashes(page)
                if shipped is None:
                    removed = set(own[i] or ())
                else:
                    known = [h for h in set(hashes) if h is not None]
                    keys = np.array([_template_key(host, h) for h in known], dtype=np.int64)
                    at = np.minimum(np.searchsorted(shipped, keys), max(len(shipped) - 1, 0))
                    removed = {h for h, hit in zip(known, shipped[at] == keys) if hit} if len(shipped) else set()
                texts.append(main_text(page, removed, hashes))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string())], names=["page_id", "url", "text"])

    return run


def _template_key(host: str, subtree: int) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{subtree}") - (1 << 63)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, shipped: int = SHIPPED_TEMPLATES) -> DataFrame:
    """(page_id, url, text) per row.

    A null or empty html gives an empty text; a null url belongs to the host without a name. Repeated rows stay
    repeated and count as one page for templates. Other columns are ignored.
    """
    subtrees = cut(page_subtrees(pages, url_col, html_col))
    templates = cut(templates_of(subtrees, min_pages))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), page_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    if templates.count() <= shipped:
        found = templates.toPandas()
        keys = np.sort(np.array([_template_key(h, s) for h, s in zip(found["host"], found["subtree"])], dtype=np.int64))
        return rows.mapInArrow(_extract(keys), schema)
    removed = subtrees.join(templates, ["host", "subtree"]).groupBy("page").agg(F.collect_set("subtree").alias("removed"))
    return rows.withColumn("page", _page_key(F.col("url"), F.col("html"))).join(removed, "page", "left").mapInArrow(_extract(None), schema)
