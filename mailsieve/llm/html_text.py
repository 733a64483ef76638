"""Main text of web pages by consensus host paths.

Every page scores its containers by the running text in their blocks and names
the best one by its path of tags and classes, digits left out. Spark counts
these votes per host. Every page is then read again with its host's winning
paths: the first one that it has and that holds text. A page without any, or
without a host, keeps its own best container. From there each page climbs to
what holds the whole article: title, lead and parts beside the chosen container.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from mailsieve.llm.frames import slices, with_small, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select|object)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|[^<]++|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var wbr img picture".split()
)
_CONTAINERS = frozenset("body main article section div td center".split())
_DROPPED = frozenset("nav header footer aside form menu dialog head button fieldset".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_BOILERPLATE = frozenset(
    "alert announcement discussion login overlay pager replies search "
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these, the ones that no article section bears; the others are evidence only.
_CLEAR = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu "
    "modal nav navbar navigation newsletter pager pagination popup share sharing sidebar signup subscribe toolbar".split()
)
#: Characters of running text from which a container with a doubtful name is kept.
_LONG = 250
#: Pages held as Python objects at once, and their texts; an Arrow batch may hold thousands.
_PAGES_AT_ONCE = 100
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ARTICLE_WORDS = frozenset("article post entry story content".split())
#: Of these, the ones that name the whole of an article and not a page's middle.
_TITLES = _ARTICLE_WORDS - {"content"}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())


@dataclass
class _Open:
    tag: str
    dropped: bool
    path: str
    container: int | None
    doubt: int = 0


def _is_dropped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return attributes.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


def _named(tag: str, attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether a block's class and id say that it is boilerplate, and whether they give reason to doubt it.

    Beside a name that says article and nothing else, only a name that is boilerplate and nothing else counts.
    """
    if tag in _INLINE or tag in _HEADINGS or tag in ("p", "body", "html", "main", "article"):
        return False, False
    names = [set(re.findall(r"[a-z]+", n)) for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()]
    words = set().union(*names)
    bad = _BOILERPLATE & words
    if not bad or (bad == {"header"} and _ARTICLE_WORDS & words):
        return False, False
    if any(n & _ARTICLE_WORDS and not n & _BOILERPLATE for n in names):
        return any(n and n <= _CLEAR for n in names), False
    return bool(_CLEAR & words), True


def blocks(page: str) -> tuple[list[tuple[int, str, int]], list[tuple[str, int | None]]]:
    """The kept blocks as (container, text, characters in links), and the containers as (path, parent)."""
    containers: list[tuple[str, int | None]] = [("body", None)]
    around, doubts = [0], []  # the doubt around each doubt, and the innermost doubt of each block
    stack, found, text = [_Open("html", False, "", 0)], [], []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        if line and not stack[-1].dropped:
            found.append((stack[-1].container, line, linked))
            doubts.append(stack[-1].doubt)
        text.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            links -= stack[-1].tag == "a"
            if stack[-1].tag not in _INLINE:
                flush()
            stack.pop()

    def close(tags: tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return pop_to(depth)
            if stack[depth].tag in _CONTAINERS or stack[depth].tag in ("ul", "ol", "dl", "table"):
                return

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                if not stack[-1].dropped:
                    piece = html.unescape(m[0])
                    text.append(piece)
                    linked += len(piece) if links > 0 else 0
            continue
        tag = tag.lower()
        if m[2]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
            continue
        if tag in ("br", "hr", "wbr"):
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in _VOID:
            continue
        if tag in ("html", "body"):
            flush()
            if tag == "body":  # closes a head left open
                pop_to(1)
                stack.append(_Open("body", False, "body", 0))
            continue
        if tag not in _INLINE:
            # A paragraph ends where the next block begins; so do formatting tags left open in it.
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag not in _INLINE:
                    break
            flush()
            if tag in _CLOSES:
                close(_CLOSES[tag])
        above = stack[-1]
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[4])} if m[4] else {}
        clear, doubtful = _named(tag, attributes)
        dropped = above.dropped or clear or _is_dropped(tag, attributes)
        path, container, doubt = above.path, above.container, above.doubt
        if doubtful and not dropped:
            around.append(doubt)
            doubt = len(around) - 1
        if tag in _CONTAINERS and not dropped:
            classes = ".".join(sorted(set(re.sub(r"\d+", "", attributes.get("class", "")).split())))
            path = f"{path or 'body'}>{tag}" + (f".{classes}" if classes else "")
            containers.append((path, container))
            container = len(containers) - 1
        links += tag == "a"
        stack.append(_Open(tag, dropped, path, container, doubt))
        if m[4].endswith("/") and tag not in _INLINE:
            pop_to(len(stack) - 1)
    pop_to(1)
    flush()
    return _without_doubtful(found, doubts, around) if len(around) > 1 else found, containers


def _without_doubtful(found: list[tuple[int, str, int]], doubts: list[int], around: list[int]) -> list[tuple[int, str, int]]:
    """The blocks in no doubtful container whose text is short or made of links."""
    worth, size, links = [0] * len(around), [0] * len(around), [0] * len(around)
    for doubt, (_, line, linked) in zip(doubts, found, strict=True):
        worth[doubt] += max(len(line) - 2 * linked, 0)
        size[doubt] += len(line)
        links[doubt] += linked
    for at in range(len(around) - 1, 0, -1):
        for sums in (worth, size, links):
            sums[around[at]] += sums[at]
    gone = [False]
    for at in range(1, len(around)):
        gone.append(gone[around[at]] or worth[at] < _LONG or 3 * links[at] > size[at])
    return [block for doubt, block in zip(doubts, found, strict=True) if not gone[doubt]]


def scores(page: str) -> dict[str, float]:
    """Characters of running text by container path; half of it also counts for the container around."""
    found, containers = blocks(page)
    total: dict[str, float] = defaultdict(float)
    for container, line, linked in found:
        worth = max(len(line) - 2 * linked, 0)
        total[containers[container][0]] += worth
        parent = containers[container][1]
        if parent is not None:
            total[containers[parent][0]] += worth / 2
    return total


def best_path(page: str) -> str | None:
    total = scores(page)
    return min(total, key=lambda p: (-total[p], p)) if total else None


def _whole(found: list[tuple[int, str, int]], containers: list[tuple[str, int | None]], chosen: list[int]) -> tuple[set[int], bool]:
    """The containers that hold the article of which ``chosen`` hold the core, and whether lines of the body itself belong to it.

    Named for an article, or adding running text and not links, the container around is taken whole.
    The body never is; only lines that stand in it by themselves are.
    """
    size, links = [0] * len(containers), [0] * len(containers)
    for container, line, linked in found:
        size[container] += len(line)
        links[container] += linked
    for at in range(len(containers) - 1, 0, -1):
        size[containers[at][1]] += size[at]
        links[containers[at][1]] += links[at]

    def named(at: int) -> bool:
        own = containers[at][0][len(containers[containers[at][1]][0]) + 1 :]
        return own.startswith("article") or not _TITLES.isdisjoint(re.findall(r"[a-z]+", own.lower()))

    tops, open_body = set(), True
    for top in chosen:
        at, clear = containers[top][1] if top else None, True
        while at:
            more, linked = size[at] - size[top], links[at] - links[top]
            main = containers[at][0].startswith(containers[containers[at][1]][0] + ">main")
            if named(at) or (main and not named(top)) or (clear and 3 * linked <= more):
                top, clear = at, True
            else:
                clear = False
            at = containers[at][1]
        tops.add(top)
        open_body &= clear
    return tops, open_body


def extract_with(page: str, paths: list[str]) -> str:
    """Blocks of the article around the first of the paths that holds text, joined by an empty line."""
    found, containers = blocks(page)
    for path in paths:
        inside: list[bool] = []
        for own, parent in containers:
            inside.append(own == path or (parent is not None and inside[parent]))
        if not any(inside[container] for container, _, _ in found):
            continue
        holding = {container for container, _, _ in found if inside[container]}
        for at in range(len(containers) - 1, 0, -1):
            if at in holding:
                holding.add(containers[at][1])
        chosen = [at for at, (own, parent) in enumerate(containers) if own == path and at in holding and not (parent is not None and inside[parent])]
        tops, open_body = _whole(found, containers, chosen)
        inside = []
        for at, (_, parent) in enumerate(containers):
            inside.append(at in tops or (parent is not None and inside[parent]))
        lines = [line for at, line, linked in found if inside[at] or (at == 0 and open_body and len(line) > 2 * linked)]
        if lines:
            return "\n\n".join(lines)
    own = best_path(page)
    return extract_with(page, [own]) if own is not None and own not in paths else ""


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def winning_paths(pages: DataFrame, url: str = "url", source: str = "html", share: float = 0.05) -> DataFrame:
    """(host, paths): the paths with at least that share of a host's votes, most votes first, ties by path.

    One vote a page. Votes are added up in each task before they move, and a
    host keeps at most 1 / share paths.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _PAGES_AT_ONCE):
            paths = pa.array([best_path(p) for p in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("host"), paths], ["host", "path"])

    with_host = pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html")).where("host is not null and html is not null")
    votes = with_host.mapInArrow(vote, "host string, path string").where("path is not null").groupBy("host", "path").count()
    of_host = W.partitionBy("host")
    ranked = votes.withColumn("share", F.col("count") / F.sum("count").over(of_host)).where(F.col("share") >= share)
    order = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("votes"), "path")))
    return ranked.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text) for every row; null html is the empty page and gives the empty text."""
    paths = written(winning_paths(pages, url, source), "paths").withColumnRenamed("host", "_host")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(F.col(url)).alias("host"))
    joined = with_small(rows, paths, F.col("host") == F.col("_host")).select("key", "url", "html", "paths")
    schema = T.StructType([rows.schema["key"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _PAGES_AT_ONCE):
            pages = zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)
            texts = pa.array([extract_with(p or "", w or []) for p, w in pages], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), texts], ["key", "url", "text"])

    return joined.mapInArrow(run, schema).withColumnRenamed("key", key).withColumnRenamed("url", url)
