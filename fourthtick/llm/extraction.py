"""Main text of web pages by site style trees.

Pages of a host share templates. Their element trees are merged into one tree per
host, whose nodes are styles (tag and classes below the same ancestors). Content that
many pages of the host repeat under one style has high entropy over the pages and
little importance; so has presentation that HTML itself marks as not the article.
A branch whose importance is low is cut from every page of the host, but never all of a
page's article or main element: what many pages syndicate is still their article.

Blocks and features are counted with map-side aggregates; per host only the list of
its low branches, as long as its template is varied, meets the pages again.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourthtick.llm.common import by_bytes
from fourthtick.sources.storage import stage

#: A branch is cut below this importance.
LEAST_IMPORTANCE = 0.5
#: The tree of all hosts counts like so many more pages of a host when its styles are judged.
PRIOR_PAGES = 8
#: A branch marked by words alone is judged without the mark when the unmarked rest of its
#: site has less than this part of its important content.
LEAST_REST = 0.1
#: Weight of styles marked as not the article, and of styles inside article or main.
ASIDE_WEIGHT, ARTICLE_WEIGHT = 0.3, 2.0

# Element names of HTML by their role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object svg math".split())
ASIDE_TAGS = frozenset(
    "nav footer header aside form button select textarea dialog menu fieldset".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share "
    "sharing social related recommended comment comments disqus reply replies widget search pagination "
    "pager complementary contentinfo toolbar".split()
)
#: A compound name tells a state, not what the element is, if one of these is in it.
STATE_WORDS = frozenset("no not non has have with without is hide show hidden visible".split())
#: Inside an article these are its own: the title often stands in a header.
OF_ARTICLES = frozenset("header masthead".split())
#: Elements that hold the page or the article are not marked by any class word.
NEVER_ASIDE = frozenset("html body main article".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_DIGITS = re.compile(r"\d+")


_PARTS = re.compile(r"[-_]+")


def _names_aside(value: str, inside: bool) -> bool:
    """Whether a class, id or role names something beside the article, as a whole or in a compound.

    ``comment-list`` does, ``no-banner`` and ``content-with-comments`` do not.
    """
    for name in value.split():
        parts = set(_PARTS.split(name))
        if len(parts) > 1 and not parts.isdisjoint(STATE_WORDS):
            continue
        found = (parts | {name}) & ASIDE_WORDS
        if found - OF_ARTICLES if inside else found:
            return True
    return False


def style_of(tag: str, attrs: str, inside: bool = False) -> str:
    """Tag and classes; a final ``!`` marks what is not the article by its tag, class, id or role.

    ``inside``: the element is part of an article, whose header is its own.
    """
    classes, aside = "", tag in ASIDE_TAGS and not (inside and tag in OF_ARTICLES)
    if attrs and "=" in attrs:
        for name, value in _MARKS.findall(attrs):
            value = html.unescape(value.strip("\"'")).lower()
            if name.lower() == "class":
                classes = ".".join(sorted(_DIGITS.sub("0", value).replace("/", "_").split()))
            if tag not in NEVER_ASIDE:
                aside = aside or _names_aside(value, inside)
    return f"{tag}.{classes}" * bool(classes) + tag * (not classes) + "!" * aside


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(style path, text) of every block of a page in page order; white space is one space.

    Unfinished markup at the end of a page is markup; end tags of nothing are ignored.
    """
    page = page or ""
    stack: list[tuple[str, str]] = []
    blocks: list[tuple[str, str]] = []
    parts: list[str] = []
    unseen = 0

    def flush() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                blocks.append(("/".join(s for _, s in stack), text))
            parts.clear()

    def pop() -> None:
        nonlocal unseen
        flush()
        unseen -= stack.pop()[0] in UNSEEN

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not unseen:
            parts.append(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        style = style_of(tag, m["attrs"], any(t == "article" for t, _ in stack))
        if tag in INLINE and not style.endswith("!"):
            continue
        flush()
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            pop()
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            pop()
        if tag == "body":
            while stack and stack[-1][0] == "head":
                pop()
        stack.append((tag, style))
        unseen += tag in UNSEEN
    if at < len(page) and not unseen:
        parts.append(page[at:])
    flush()
    return blocks


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page each style path once with a null feature and once per distinct block text.

    ``page`` stands for the blocks of the page: pages with the same are one page of the site.
    """
    for batch in by_bytes(batches, 1):
        hosts, paths, features, pages = [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            blocks = blocks_of(page.as_py())
            found = set(blocks)
            rows = [(path, None) for path in {p for p, _ in found}] + list(found)
            hosts += [host] * len(rows)
            paths += [path for path, _ in rows]
            features += [text for _, text in rows]
            digest = hashlib.blake2b(repr(blocks).encode("utf-8", "surrogatepass"), digest_size=8)
            pages += [int.from_bytes(digest.digest(), "little", signed=True)] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x, pa.string()) for x in (hosts, paths, features)], pa.array(pages, pa.int64())],
            names=["host", "path", "feature", "page"],
        )


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance, bare, held) of every node; host null is the tree of all hosts.

    A text on k of the m different pages that have its style has the entropy log k / log m
    there; the importance of a style is one minus the mean entropy of what it
    holds, times its weight. An inner node is as important as the best of its
    branch, so it is low only if everything below it is. ``bare`` is the importance
    without the first mark of a path, if words made it; ``held`` is the important
    content of the node itself, whatever its weight.
    """
    texts = (
        pages.select(host_of().alias("host"), "html")
        .mapInArrow(_features, "host string, path string, feature string, page long")
        .select(
            "host",
            "path",
            F.xxhash64("feature").alias("feature"),
            F.col("feature").isNull().alias("whole"),
            "page",
        )
        .distinct()
    )
    counted = stage(
        texts.groupBy("host", "path", "feature", "whole").agg(F.count(F.lit(1)).alias("k")),
        "style-features",
    )
    every = counted.groupBy("path", "feature", "whole").agg(F.sum("k").alias("k"))
    counted = counted.unionByName(every.withColumn("host", F.lit(None).cast("string")))

    m = counted.where("whole").select("host", "path", F.col("k").alias("m"))
    entropy = F.when(F.col("m") > 1, F.log("k") / F.log("m")).otherwise(F.lit(0.0))
    leaves = (
        counted.where("NOT whole")
        .alias("c")
        .join(m.alias("m"), F.col("c.host").eqNullSafe(F.col("m.host")) & (F.col("c.path") == F.col("m.path")))
        .select("c.host", "c.path", "k", "m")
        .groupBy("host", "path", "m")
        .agg(F.sum("k").alias("weight"), F.sum(F.col("k") * (1 - entropy)).alias("important"))
    )
    aside = F.col("path").contains("!")
    article = F.concat(F.lit("/"), F.col("path"), F.lit("/")).rlike("/(article|main)[./]")
    by_tag = F.col("path").rlike(f"(^|/)({'|'.join(sorted(ASIDE_TAGS))})(\\.[^/]*)?!")
    bare_aside = by_tag | F.col("path").rlike("!.*!")

    def own(aside):
        weight = F.when(aside, ASIDE_WEIGHT).when(article, ARTICLE_WEIGHT).otherwise(1.0)
        return F.least(F.col("weight") * 1.0, weight * F.col("important"))

    steps = F.split("path", "/")
    return (
        leaves.select(
            "host",
            "m",
            "weight",
            own(aside).alias("important"),
            own(bare_aside).alias("bare"),
            F.when(~by_tag, F.col("important")).alias("held"),
            F.col("path").alias("leaf"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size(steps)),
                    lambda n: F.array_join(F.slice(steps, 1, n), "/"),
                )
            ).alias("path"),
        )
        .groupBy("host", "path")
        .agg(
            F.max("m").alias("pages"),
            F.max(F.col("important") / F.col("weight")).alias("importance"),
            F.max(F.col("bare") / F.col("weight")).alias("bare"),
            F.coalesce(
                F.sum(F.when(F.col("leaf") == F.col("path"), F.col("held"))), F.lit(0.0)
            ).alias("held"),
        )
    )


_IN_ARTICLE = re.compile(r"(^|/)(article|main)[./]|(^|/)(article|main)$")


def _is_cut(path: str, cut: set[str]) -> bool:
    steps = path.split("/")
    return any("/".join(steps[:n]) in cut for n in range(1, len(steps) + 1))


def extract_main_text(
    pages: DataFrame, least: float = LEAST_IMPORTANCE, prior_pages: int = PRIOR_PAGES
) -> DataFrame:
    """page_id, url, text and n_chars of every page, without the low branches of its site.

    Null html is an empty page; a url without a host counts as one site of its own;
    repeated rows are each extracted and count as one page of their site; an empty table
    gives none. A header inside an article is the article's own and stays, other headers
    go. Only page_id, url and html are read.
    """
    pages = pages.select("page_id", "url", "html")
    tree = stage(style_tree(pages), "style-tree")
    nodes = tree.where("host IS NOT NULL")
    # Per host the outermost marked branch (empty: no mark) with the most important content.
    top = F.regexp_extract("path", "^[^!]*!", 0)
    branches = nodes.groupBy("host", top.alias("_top")).agg(
        F.max("pages").alias("_pages"), F.sum("held").alias("_held")
    )
    is_rest = F.col("_top") == ""
    main = (
        branches.groupBy("host")
        .agg(
            F.coalesce(F.max(F.when(is_rest, F.col("_held"))), F.lit(0.0)).alias("_rest"),
            F.max(F.when(~is_rest, F.struct("_held", "_top"))).alias("_most"),
        )
        .select(
            "host",
            F.when(F.col("_rest") < LEAST_REST * F.col("_most._held"), F.col("_most._top")).alias("_main"),
        )
    )
    within = F.col("path").startswith(F.col("_main")) | F.col("_main").startswith(
        F.concat("path", F.lit("/"))
    )
    nodes = nodes.join(main, "host").withColumn(
        "importance", F.when(within, F.col("bare")).otherwise(F.col("importance"))
    )
    # A mark needs no other pages to be judged. Entropy does: what all hosts show of a style
    # weighs the more, the fewer pages a host has beyond the first.
    anywhere = tree.where("host IS NULL").select("path", F.col("importance").alias("_anywhere"))
    seen = F.col("pages") - 1
    judged = (seen * F.col("importance") + prior_pages * F.col("_anywhere")) / (seen + prior_pages)
    marked = F.col("path").contains("!")
    low = nodes.join(anywhere, "path").where(F.when(marked, F.col("importance")).otherwise(judged) < least)
    rules = stage(
        low.groupBy("host").agg(F.collect_set("path").alias("cut")),
        "style-rules",
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, cuts = (batch.column(i).to_pylist() for i in (0, 1, 3))
            texts = []
            for page, cut in zip(batch.column(2), cuts, strict=True):
                cut = set(cut or ())
                kept: dict[str, bool] = {}
                out = []
                blocks = blocks_of(page.as_py())
                articles = {path for path, _ in blocks if "!" not in path and _IN_ARTICLE.search(path)}
                if articles and all(_is_cut(path, cut) for path in articles):
                    kept = dict.fromkeys(articles, True)
                for path, text in blocks:
                    if (keep := kept.get(path)) is None:
                        keep = kept[path] = not _is_cut(path, cut)
                    if keep:
                        out.append(text)
                texts.append(" ".join(out))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(urls, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array(np.array([len(t) for t in texts], dtype=np.int64)),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return (
        pages.withColumn("_host", host_of())
        .join(rules.withColumnRenamed("host", "_host"), "_host", "left")
        .select("page_id", "url", "html", "cut")
        .mapInArrow(extract, "page_id long, url string, text string, n_chars long")
    )
