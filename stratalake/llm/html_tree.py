"""HTML extraction with site style trees.

The DOMs of a host are merged: elements with the same path of (tag, class, id, role) from
the root are one node, siblings of one kind included. Copies count once: pages of a host whose
``article`` or ``main`` has the same text, or that have the same text in all where they have
none, are one page to its tree. Over the m pages that have a node,

* its presentation importance is the entropy of the sequences of its children's kinds;
* its content importance is one minus the mean entropy of its text pieces, each piece's
  entropy being that of its spread over the pages;

both relative to the logarithm of m, so they lie between 0 and 1. Nodes
with text have the content importance, others that of presentation. Every host has a tree. As
few pages say little, m pages of the host are mixed with ``PRIOR`` pages of the importance that
the path has over all hosts; a path below ``article`` or ``main`` is mixed with as many pages
of importance 1. A branch in which no node reaches ``IMPORTANT`` is boilerplate and is
removed from every page of the host that has it; below ``article`` and ``main``, which are
never removed themselves, the limit is ``REPEATED``: only what nearly all articles share goes.

Besides, elements that are never article text by their kind (``HIDDEN``, ``BOILERPLATE``
tags) are removed, and those whose class, id or role has a word such as ``sidebar``: a tree
cannot see an advert that differs on every page. Below ``article`` and ``main`` such a word is
only further evidence: there it moves the limit to ``IMPORTANT``.

Trees are aggregates by host and node, so a large host is counted before the shuffle. A
page meets its tree by a join on the host, broadcast up to ``BROADCAST_NODES`` nodes.

Defined results: null and empty html give the empty text; null or odd urls form a host of
their own; repeated rows count and are extracted each; unclosed and stray tags are taken
as browsers do in the main, elements deeper than ``MAX_DEPTH`` included; other columns
are passed through.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.llm.common import free_name
from stratalake.scratch import written

IMPORTANT = 0.6
REPEATED = 0.2
PRIOR = 4
BROADCAST_NODES = 500_000
MAX_DEPTH = 512  # deeper elements become siblings there, as in browsers

# Element kinds of HTML.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
    main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
HIDDEN = frozenset(
    """head script style title noscript template iframe svg math canvas object audio video
    textarea select option button input datalist""".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
KEPT = MAIN | VOID | {"html", "body"}  # by the trees
# A start tag ends an open element of these kinds, not looking beyond the second set.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
# Words of class, id and role that name boilerplate.
NOISE = frozenset(
    """ad ads advert adverts advertisement adbox adslot advertising banner breadcrumb breadcrumbs
    byline comment comments commentlist consent contentinfo cookie cookies disclaimer disqus
    footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices
    notification paywall pager pagination popup promo promoted promotion recommended related
    search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
    tagcloud toolbar topbar widget""".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def host_of(url: Column) -> Column:
    """Host name of a url in lower case, "" if there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


@dataclass
class Element:
    tag: str
    kind: str
    path: int
    noise: bool
    children: list[str] = field(default_factory=list)


_kinds: dict[tuple[str, str], tuple[str, bool]] = {}
_paths: dict[tuple[int, str], int] = {}


def _kind(tag: str, attributes: str) -> tuple[str, bool]:
    """Presentation of a start tag, and whether its words name boilerplate."""
    known = _kinds.get((tag, attributes))
    if known is None:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        words = {w.lower() for v in found.values() for w in _WORDS.findall(v)}
        parts = [f"{k}={re.sub('[0-9]{2,}', '0', v)}" for k, v in sorted(found.items())]
        known = (" ".join([tag, *parts]), not NOISE.isdisjoint(words))
        if len(_kinds) > 100_000:
            _kinds.clear()
        _kinds[tag, attributes] = known
    return known


def _path(parent: int, kind: str) -> int:
    known = _paths.get((parent, kind))
    if known is None:
        known = xxhash.xxh3_64_intdigest(f"{parent:x}/{kind}".encode()) - (1 << 63)
        if len(_paths) > 100_000:
            _paths.clear()
        _paths[parent, kind] = known
    return known


def walk(page: str) -> Iterator[tuple[str, object, list[Element]]]:
    """("open", element, stack), ("close", element, stack) and ("text", raw, stack) in page order."""
    root = Element("#page", "", 0, False)
    stack = [root]
    at, end = 0, len(page)

    def close(depth: int) -> Iterator[tuple[str, object, list[Element]]]:
        while len(stack) > depth:
            gone = stack.pop()
            yield "close", gone, stack

    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            yield "text", page[at:], stack
            break
        if token.start() > at:
            yield "text", page[at : token.start()], stack
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                yield from close(depth)
            continue
        if tag in BLOCKS:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if depth:
                yield from close(depth)
        if tag in ENDS:
            ends, stops = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in ends:
                    yield from close(i)
        if len(stack) > MAX_DEPTH:
            yield from close(MAX_DEPTH)
        kind, noise = _kind(tag, token[3])
        element = Element(tag, kind, _path(stack[-1].path, kind), noise)
        parent = stack[-1].children
        if not parent or parent[-1] != kind:
            parent.append(kind)
        stack.append(element)
        yield "open", element, stack
        if tag in VOID or token[3].endswith("/"):
            yield from close(len(stack) - 1)
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            yield "text", page[at : stop.start() if stop else end], stack
            at = stop.end() if stop else end
            yield from close(len(stack) - 1)
    yield from close(1)


def clean(text: str) -> str:
    """Character references decoded, white space as single spaces."""
    return " ".join(entities.unescape(text).split())


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def nodes(page: str) -> tuple[int, dict[int, tuple[list[int], int, set[int], bool]]]:
    """What the page is known by, and path -> (ancestors, hash of the children's kinds, hashes
    of text pieces, whether it lies below article or main)."""
    above: dict[int, list[int]] = {}
    children: dict[int, list[list[str]]] = {}
    pieces: dict[int, set[int]] = {}
    inside: dict[int, bool] = {}
    article: list[str] = []
    visible: list[str] = []
    for event, value, stack in walk(page):
        if event == "open":
            if value.path not in above:
                above[value.path] = [e.path for e in stack[:-1]]
                pieces[value.path], children[value.path] = set(), []
                inside[value.path] = any(e.tag in MAIN for e in stack[:-1])
        elif event == "close":
            children[value.path].append(value.children)
        else:
            text = " ".join(value.split())
            if text and len(stack) > 1:
                pieces[stack[-1].path].add(digest(text))
                if stack[-1].tag not in RAW:
                    visible.append(text)
                    if inside[stack[-1].path] or stack[-1].tag in MAIN:
                        article.append(text)
    return digest("\n".join(article or visible)), {
        path: (ancestors, digest(str(children[path])), pieces[path], inside[path])
        for path, ancestors in above.items()
    }


def main_text(
    page: str | None, low: frozenset[int], repeated: frozenset[int] = frozenset()
) -> tuple[str, int]:
    """(text, number of elements removed for low importance); ``repeated`` are the paths that
    go even below article and main."""
    blocks: list[str] = []
    current: list[str] = []
    removed = 0
    skip_from = 0  # depth of the outermost removed element, 0 if none
    main_depth = 0

    def flush() -> None:
        text = clean("".join(current))
        current.clear()
        if text:
            blocks.append(text)

    for event, value, stack in walk(page or ""):
        if event == "text":
            if not skip_from:
                current.append(value)
            continue
        depth = len(stack) if event == "open" else len(stack) + 1
        if value.tag in BLOCKS and not skip_from:
            flush()
        elif value.tag == "br" and not skip_from:
            current.append(" ")
        if event == "open":
            if skip_from:
                continue
            below_main = bool(main_depth)
            if value.tag in MAIN and not main_depth:
                main_depth = depth
            limit = repeated if below_main and not value.noise else low
            if value.path in limit and value.tag not in KEPT:
                removed += 1
                skip_from = depth
            elif value.tag in HIDDEN or value.tag in BOILERPLATE:
                skip_from = depth
            elif below_main or value.tag in MAIN:
                continue
            elif value.tag == "header" or (value.noise and value.tag not in ("html", "body")):
                skip_from = depth
        else:
            if skip_from == depth:
                skip_from = 0
            if main_depth == depth:
                main_depth = 0
    flush()
    return "\n".join(blocks), removed


_NODE = "struct<path:bigint,style:bigint,piece:bigint,inside:boolean>"
_LINK = "struct<path:bigint,above:bigint>"
PARSED = f"struct<ident:bigint,nodes:array<{_NODE}>,links:array<{_LINK}>>"


def _lists(rows: list[list[tuple]], names: list[str], kinds: list[pa.DataType]) -> pa.ListArray:
    flat = [r for own in rows for r in own]
    columns = [pa.array(c, k) for c, k in zip(zip(*flat), kinds)] or [pa.array([], k) for k in kinds]
    ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names))


def _page_nodes():
    """A style row per node, a row per text piece, and the nodes above a path, which a task
    tells once in a batch."""

    @F.arrow_udf(PARSED)
    def parsed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in parts:
            told: set[int] = set()
            idents, found, links = [], [], []
            for page in pages:
                ident, of = nodes(page.as_py() or "")
                rows, new = [], []
                for path, (above, style, pieces, inside) in of.items():
                    rows.append((path, style, None, inside))
                    rows += [(path, None, p, inside) for p in pieces]
                    if path not in told:
                        told.add(path)
                        new += [(path, a) for a in above]
                idents.append(ident)
                found.append(rows)
                links.append(new)
            number = pa.int64()
            yield pa.StructArray.from_arrays(
                [
                    pa.array(idents, number),
                    _lists(found, ["path", "style", "piece", "inside"], [number] * 3 + [pa.bool_()]),
                    _lists(links, ["path", "above"], [number] * 2),
                ],
                ["ident", "nodes", "links"],
            )

    return parsed


def _tree(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, inside, m, importance) of (keys, path, inside, style, piece, k)."""
    k = F.col("k").cast("double")
    styled, pieced = F.col("style").isNotNull(), F.col("piece").isNotNull()
    tree = counted.groupBy(*keys, "path").agg(
        F.first("inside").alias("inside"),  # the path says so
        F.sum(F.when(styled, k)).alias("m"),
        F.sum(F.when(styled, k * F.log(k))).alias("style_sum"),
        F.count_if(pieced).alias("n_pieces"),
        F.sum(F.when(pieced, F.log(k))).alias("piece_sum"),
    )
    pages = F.log("m")
    presentation = 1 - F.col("style_sum") / F.col("m") / pages
    content = 1 - F.col("piece_sum") / F.col("n_pieces") / pages
    importance = F.when(F.col("m") < 2, 1.0).when(F.col("n_pieces") > 0, content)
    return tree.select(
        *keys, "path", "inside", "m", importance.otherwise(presentation).alias("importance")
    )


def style_trees(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(site, low, repeated): the paths below each limit, by host (``site_of``)."""
    html = F.col(page).cast("string")
    parsed = written(
        pages.select(
            site_of(F.col(url).cast("string")).alias("site"),
            F.xxhash64(html).alias("page"),
            _page_nodes()(html).alias("p"),
        ).select("site", "page", "p.*"),
        "parsed-pages",
    )
    above = written(parsed.select(F.inline("links")).distinct(), "paths")
    # Of copies the one with the least hash of its html stands for all.
    one = parsed.groupBy("site", "ident").agg(F.min_by("nodes", "page").alias("nodes"))
    counted = written(
        one.select("site", F.inline("nodes"))
        .groupBy("site", "path", "inside", "style", "piece")
        .agg(F.count("*").alias("k")),
        "page-nodes",
    )
    over_all = counted.groupBy("path", "inside", "style", "piece").agg(F.sum("k").alias("k"))
    prior = _tree(over_all).select("path", F.col("importance").alias("prior"))
    tree = _tree(counted, "site").join(prior, "path")
    from_prior = F.when(F.col("inside"), 1.0).otherwise(F.col("prior"))
    mixed = (F.col("m") * F.col("importance") + PRIOR * from_prior) / (F.col("m") + PRIOR)
    tree = written(tree.select("site", "path", mixed.alias("importance")), "trees")
    upwards = tree.join(above, "path").select("site", F.col("above").alias("path"), "importance")
    branches = (
        tree.unionByName(upwards).groupBy("site", "path").agg(F.max("importance").alias("importance"))
    )
    under = lambda limit: F.collect_set(F.when(F.col("importance") < limit, F.col("path")))
    sites = branches.where(F.col("importance") < max(IMPORTANT, REPEATED)).groupBy("site")
    return written(
        sites.agg(under(IMPORTANT).alias("low"), under(REPEATED).alias("repeated")), "low-paths"
    )


def site_of(url: Column) -> Column:
    return F.xxhash64(host_of(url))


def _extractor():
    kind = pa.struct([("text", pa.string()), ("removed", pa.int32())])

    @F.arrow_udf("struct<text:string,removed:int>")
    def extracted(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in parts:
            rows = [
                main_text(page.as_py(), *(frozenset(x.as_py() or ()) for x in paths))
                for page, *paths in zip(*columns)
            ]
            yield pa.array([{"text": t, "removed": n} for t, n in rows], kind)

    return extracted


def _small(trees: DataFrame, low: str) -> DataFrame:
    nodes_in = trees.agg(F.sum(F.size(low) + 1)).first()[0] or 0
    return F.broadcast(trees) if nodes_in <= BROADCAST_NODES else trees


def extract(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text",
            removed: str | None = None) -> DataFrame:
    """``pages`` with their main text.

    ``removed`` names an extra column with the number of branches the trees took out.
    """
    site, low, repeated, result = (
        free_name(pages, n) for n in ("site", "low", "repeated", "result")
    )
    trees = style_trees(pages, url, page).toDF(site, low, repeated)
    html = F.col(page).cast("string")
    rows = pages.withColumn(site, site_of(F.col(url).cast("string")))
    rows = rows.join(_small(trees, low), site, "left")
    rows = rows.withColumn(result, _extractor()(html, F.col(low), F.col(repeated)))
    new = {text: F.col(result)["text"]}
    if removed:
        new[removed] = F.col(result)["removed"]
    return rows.withColumns(new).select(*dict.fromkeys([*pages.columns, *new]))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the number of removed branches of every page."""
    rows = extract(pages.select("page_id", "url", "html"), removed="removed_branches")
    return rows.select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"),
        "removed_branches",
    )
