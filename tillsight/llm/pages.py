"""Main text of web pages by template deduction from equivalence classes of tokens.

The tokens of a page are its tags and its runs of text, each told apart by the path of tags
that leads to it. Over the pages of a host, a token has an occurrence vector: how often it
stands on each page. Tokens with equal vectors form a class; classes that are large and occur
on many pages are valid. Valid classes nest by the paths of their tokens, and together they
are the template of the host. What is left of a page lies in slots: each run of text belongs to
the innermost template element around it.

The slots of the article are its main text. Inside it the template decides what goes: boxes that
hold nothing but text of the template, and elements that are of the template and whose names
have a word for menus, adverts or comments among others. Names decide alone
only where they say nothing else; articles within an article are comments on it. In pages without
an article element, slots outside of menus, adverts and the like that are not mostly links are
the main text.

An occurrence vector is kept as an order-free checksum over pages, so a host may have any
number of pages, and what reaches the shuffle is one row for each token, host and task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import stored

#: A valid class occurs on this share of a host's pages, and has so many tokens.
SUPPORT, CLASS_SIZE = 0.3, 3
#: It occurs on so many different pages, or on all: two pages may be near copies.
LEAST = 3

# Names of elements and of their classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE_TAGS = frozenset("nav footer aside menu dialog button head".split())
#: Elements that hold other blocks; inside an article, only these are told apart by name.
BOXES = frozenset("blockquote center details div dl fieldset figure form ol section table ul".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar footer "
    "masthead comment comments commentlist disqus respond reply replies related recommended "
    "recommendations share sharing social pagination pager widget widgets toolbar search".split()
)
HEADER_NAMES = frozenset("header topbar".split())
#: Words that say nothing of what an element holds.
SHAPE_NAMES = frozenset(
    "area block body bottom box container inner item items left list outer panel right section slot "
    "top unit wrap wrapper zone".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
MAIN_TAGS = frozenset("article main".split())
#: A start of one of these ends an open element of the same group.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

MARK = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _aside(tag: str, attributes: str, in_main: bool) -> tuple[bool, str]:
    """Whether the name or role of an element says that it holds what is not main text.

    Inside an article a name does so that has no other words but for shapes, an id only on a box. Otherwise
    the names with a listed word are returned, which say so if the element is of the template.
    """
    if tag == "form":
        return True, ""
    if "=" not in attributes or tag in ("html", "body") or not in_main and tag in MAIN_TAGS:
        return False, ""
    hints = []
    for name, *values in NAMED.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "role":
            if value.strip().lower() in ASIDE_ROLES:
                return True, ""
            continue
        for part in value.split():
            words = {w.lower() for w in PARTS.findall(part)}
            if not in_main and words & (ASIDE_NAMES | HEADER_NAMES):
                return True, ""
            if words & ASIDE_NAMES and words <= ASIDE_NAMES | SHAPE_NAMES and (name == "class" or tag in BOXES):
                return True, ""
            if words & ASIDE_NAMES:
                hints.append(f"{name}={part}")
    return False, " ".join(sorted(hints))


@dataclass
class Run:
    """A run of text: its path, block number, and the elements around it.

    ``main`` is the innermost main element, ``outside`` and ``inside`` count the elements around
    and within it that are not main text by their names; ``boxes`` numbers the boxes within it,
    and ``hinted`` the elements there whose names are a hint.
    """

    path: str
    block: int
    text: str
    main: str
    aside: bool
    link: bool
    outside: int
    inside: int
    boxes: tuple[int, ...]
    hinted: tuple[int, ...]


def parse(page: str | None) -> tuple[list[str], list[Run], list[int]]:
    """Tag paths in order of opening, and runs of text with character references decoded.

    The numbers of elements in articles whose names are a hint come last.

    Elements may be left open; comments, scripts, styles and other raw elements are passed
    over. A page that breaks off inside a tag ends before it.
    """
    page = page or ""
    paths: list[str] = []
    runs: list[Run] = []
    hints: list[int] = []
    stack: list[tuple[str, str, str, bool, bool, int, int, tuple[int, ...], tuple[int, ...]]] = [
        ("", "", "", False, False, 0, 0, (), ())
    ]
    block = at = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            runs.append(Run(stack[-1][1], block, html.unescape(piece), *stack[-1][2:]))
        elif piece and runs and runs[-1].block == block:
            runs[-1].text += " "

    while True:
        mark = MARK.search(page, at)
        if not mark:
            text(page[at:])
            return paths, runs, hints
        text(page[at : mark.start()])
        start = mark.start()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[start + 1] in "!?":
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            continue
        found = TAG.match(page, start) or OPEN_TAG.match(page, start)
        closing, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        at = found.end()
        if page[at - 1] != ">":
            return paths, runs, hints
        if tag in BLOCKS:
            block += 1
        elif tag == "br" and runs and runs[-1].block == block:
            runs[-1].text += " "
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCKS and stack[-1][0] != "p":
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCKS:
                    break
        elif tag in BLOCKS:
            stack.pop()
        for other in ENDS.get(tag, ()):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == other:
                    del stack[depth:]
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        _, path, main, aside, link, outside, inside, boxes, hinted = stack[-1]
        path = f"{path}/{tag}"
        paths.append(path)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        aside = aside or tag in ASIDE_TAGS or tag == "header" and not main
        named, hint = _aside(tag, attributes, bool(main))
        inside += named
        if hint:
            hints.append(number("hint", path, hint))
            hinted = (*hinted, hints[-1])
        if tag in MAIN_TAGS and not aside and main != "article":
            main, outside, inside, boxes, hinted = tag, outside + inside, 0, (), ()
        elif main and tag in BOXES or tag == "article" and not aside:
            inside += tag == "article"
            boxes = (*boxes, len(paths))
        stack.append((tag, path, main, aside, link or tag == "a", outside, inside, boxes, hinted))


def number(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}") - 2**63


def squeezed(text: str) -> str:
    return " ".join(text.split())


def page_tokens(page: str | None) -> dict[int, int]:
    """How often each token stands on a page."""
    counts: dict[int, int] = {}
    paths, runs, hints = parse(page)
    for key in hints:
        counts[key] = counts.get(key, 0) + 1
    for path in paths:
        key = number("tag", path)
        counts[key] = counts.get(key, 0) + 1
    for run in runs:
        key = number("text", run.path, squeezed(run.text))
        counts[key] = counts.get(key, 0) + 1
    return counts


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def templates(pages: DataFrame, support: float = SUPPORT, size: int = CLASS_SIZE) -> DataFrame:
    """``host, template``: the tokens of the valid classes of each host.

    A host has at most its mean number of tokens per page divided by ``support`` of them.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [page_tokens(page) for page in batch["html"]]
            n = [len(p) for p in parts]
            yield pd.DataFrame(
                {
                    "host": np.repeat(batch["host"].to_numpy(object), n),
                    "page": np.repeat(batch["page"].to_numpy(), n),
                    "token": np.fromiter((t for p in parts for t in p), np.int64, sum(n)),
                    "times": np.fromiter((c for p in parts for c in p.values()), np.int64, sum(n)),
                }
            )

    columns = "host string, page long, token long, times long"
    hosted = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    # Pages are told apart by their content: equal pages are one column of the vectors.
    contents = stored(hosted.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")), "contents")
    total = contents.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    copied = stored(
        contents.where("copies > 1").select(F.col("host").alias("of"), F.col("page").alias("copy")), "copied"
    )
    same = (F.col("host") == F.col("of")) & (F.col("page") == F.col("copy"))
    seen = (
        hosted.join(copied, same, "left_anti").mapInPandas(tokens, columns)
        .unionByName(hosted.join(copied, same, "left_semi").mapInPandas(tokens, columns).distinct())
    )
    vectors = seen.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("support"),
        F.bit_xor(F.xxhash64("page", "times")).alias("odd"),
        F.sum(F.xxhash64("times", "page") % (2**31)).alias("all"),
    )
    frequent = stored(
        vectors.join(total, "host")
        .where(
            (F.col("support") >= F.greatest(F.lit(2), F.least(F.lit(LEAST), F.col("pages"))))
            & (F.col("support") >= support * F.col("pages"))
        )
        .select("host", "token", "support", "odd", "all"),
        "vectors",
    )
    classes = frequent.groupBy("host", "support", "odd", "all").agg(
        F.count(F.lit(1)).alias("tokens"), F.collect_list("token").alias("members")
    )
    return (
        classes.where(F.col("tokens") >= size)
        .groupBy("host")
        .agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("template"))
    )


def slot_of(path: str, template: frozenset[int]) -> str:
    """The innermost element around a run of text that belongs to the template."""
    while path and number("tag", path) not in template:
        path = path.rpartition("/")[0]
    return path


def _main_runs(runs: list[Run]) -> list[Run]:
    """The runs of the main elements, without the elements in them that are aside by name.

    A name counts against an article only if another article is free of it, so an element around
    the article takes nothing away, and a list of further articles is left out.
    """
    articles = [run for run in runs if run.main == "article"]
    least = min((run.outside for run in articles), default=0)
    kept = [run for run in runs if run.main == "main" or run.main and run.outside == least]
    inside = min((run.inside for run in kept), default=0)
    return [run for run in kept if run.inside == inside]


def main_text(page: str | None, template: frozenset[int]) -> str:
    """The slots of a page that are main text, a line for each block.

    Text of the template is dropped outside of the article. Inside, a box goes if all its text
    is of the template, as with fixed adverts and notices, and an element if its name hints at it
    and it is of the template. Text of the template that stands beside what varies is kept, and so
    is an article that would lose all its text.
    """
    _, runs, _ = parse(page)
    runs = [run for run in runs if not run.aside]
    if any(run.main for run in runs):
        kept = _main_runs(runs)
        token = {id(r): number("text", r.path, squeezed(r.text)) for r in kept}
        varied = {box for r in kept if r.boxes and token[id(r)] not in template for box in r.boxes}
        kept = [r for r in kept if varied.issuperset(r.boxes)] or kept
        kept = [r for r in kept if template.isdisjoint(r.hinted)] or kept
    else:
        inside = min((run.inside for run in runs), default=0)
        runs = [run for run in runs if run.inside == inside]
        free = [r for r in runs if number("text", r.path, squeezed(r.text)) not in template]
        # Elements of one path are told apart by their blocks.
        slots = [(slot_of(run.path, template), run.block) for run in free]
        links: dict[tuple[str, int], int] = {}
        for run, slot in zip(free, slots):
            links[slot] = links.get(slot, 0) + (len(run.text) if run.link else -len(run.text))
        kept = [run for run, slot in zip(free, slots) if links[slot] <= 0]
    blocks: dict[int, list[str]] = {}
    for run in kept:
        blocks.setdefault(run.block, []).append(run.text)
    lines = [squeezed("".join(pieces)) for pieces in blocks.values()]
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null and empty pages give an empty text; pages without a host share one template. Pages
    are extracted one by one, so repeated rows and null ids do not matter; an empty table
    gives no rows; further columns are ignored.
    """
    learned = templates(pages).withColumnRenamed("host", "of")

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[bytes, frozenset[int]] = {}
        for markup, template in batches:
            out = []
            for page, tokens in zip(markup, template):
                key = b"" if tokens is None else np.asarray(tokens, np.int64).tobytes()
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = frozenset(np.frombuffer(key, np.int64).tolist())
                out.append(main_text(page, known[key]))
            yield pd.Series(out, dtype=object)

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    return (
        rows.join(learned, F.col("host") == F.col("of"), "left")
        .select("page_id", "url", extracted("html", "template").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
