"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: elements, told apart by their path of containers, and runs of text with their path.
Over the pages of one host a token has an occurrence vector, how often each page holds it.  Tokens with equal vectors
form an equivalence class.  Classes that most pages of the host share are kept if their tokens come in the same order
(ordered), and if the class is in the same place of the one around it (nested), on most of the pages that have it: they make
the host's template.  What lies between the tokens of its outermost class, which has most tokens once each on most pages, are the
slots, and the text in slots that is not template text is the page's data.

Vectors are never built.  Each page adds a hash of itself and the count to two sums per token, equal sums mean equal
vectors, and sums are added up within a task before they are shuffled, so a host with a third of all pages costs a row
per token and task.  A template holds tokens that at least half of the pages have, so it is no larger than two pages.

Template text, and slots of which most text over all pages is linked, go first.  Which of the remaining text is the article is
read from its containers (article, main, names of menus, adverts, comments and the like); hosts without a template are read by those
alone.

Defined cases: NULL and empty pages have empty text; urls without host share one empty host; hosts of fewer than three
pages have no template, and are read by marks alone; a text that template evidence alone would empty is kept whole;
repeated rows get equal results; an unclosed element ends with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.tables import stored
from tidecrew.plans.combine import broadcast_up_to

# A template token is on this share of a host's pages, and on so many at least.
SUPPORT = 0.5
LEAST_PAGES = 3
# Hosts whose templates are broadcast at most; with more of them, pages and templates are joined by a shuffle.
BROADCAST_HOSTS = 10_000
# A slot with a larger share of linked text, over all pages of the host, is a list of links.
LINKED = 0.5
# Token sums a task holds before it passes them on.
HELD = 200_000

CONTAINERS = frozenset(
    "html body div section article main nav aside header footer form ul ol dl menu table tbody thead tfoot blockquote "
    "figure details fieldset dialog center search".split()
)
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre hr address figcaption summary legend option head title".split()
)
# Elements that never hold article text.
ASIDE_ELEMENTS = frozenset("nav aside footer form menu dialog search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
# Words of class and id values that name other parts of a page.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion sidebar "
    "sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer foot copyright "
    "legal comment comments respond replies reply disqus discussion cookie cookies consent gdpr notice notices notification "
    "notifications alert alerts popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended teaser teasers widget widgets tags tagcloud skip".split()
)
HEAD_WORDS = frozenset("header head masthead topbar".split())
MAIN_WORDS = frozenset("article content main post entry story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|button|canvas|head)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    """A run of text: its token, the template position it follows, and what its containers say about it."""

    text: str
    token: int
    order: int
    linked: int
    aside: bool
    level: int
    named: bool = False  # aside by a class or id word only


class Page(NamedTuple):
    tokens: list[int]  # of elements and texts in page order; texts are odd
    blocks: list[Block]


def _token(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) >> 1 & ~1


def _marks(name: str, attributes: str, level: int) -> tuple[bool, bool, int, str]:
    """(not article text, the same by a class or id word, how surely it is the article, signature) of an element inside one
    of ``level``.  Words do not mark the article itself."""
    named, aside, own, signature = False, name in ASIDE_ELEMENTS, {"article": 3, "main": 2}.get(name, 0), name
    if name == "header" and level < 2:
        aside = True
    if attributes.strip():
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "")
            if key in ("class", "id"):
                words = {word.lower() for word in _NAME_WORDS.findall(value)}
                signature += f".{value}" if key == "class" else f"#{value}" if not any(c.isdigit() for c in value) else ""
                if name not in ("html", "body"):
                    named = named or bool(words & ASIDE_WORDS) or (level < 2 and bool(words & HEAD_WORDS))
                    own = own or (1 if words & MAIN_WORDS else 0)
            elif key == "role":
                aside = aside or value.lower() in ASIDE_ROLES
                own = own or (2 if value.lower() == "main" else 0)
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                aside = True
            elif key == "style":
                aside = aside or bool(_HIDDEN_STYLE.search(value))
    return aside, named and own < 2, max(level, own), signature


def parsed(html: str) -> Page:
    """The tokens and text blocks of a page, in page order."""
    tokens: list[int] = []
    blocks: list[Block] = []
    # name, path, aside, level, the innermost element around that a word marks
    stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
    around = [0]  # of every marked element, the marked one around it; 0 stands for none
    marked_by: list[int] = []  # of every block
    held: list[str] = []
    linked, in_link = 0, 0
    block_name, block_aside, block_named = "", False, 0

    def flush() -> None:
        nonlocal linked, block_name, block_aside, block_named
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            _, path, aside, level, mark = stack[-1]
            token = _token(path, block_name, text) | 1
            marked_by.append(block_named or mark)
            blocks.append(Block(text, token, len(tokens), min(linked, len(text)), aside or block_aside, level))
            tokens.append(token)
        linked, block_name, block_aside, block_named = 0, "", False, 0

    at = 0
    for found in _TOKEN.finditer(html):
        if found.start() > at:
            held.append(html[at : found.start()])
            if in_link:
                linked += found.start() - at
        at = found.end()
        if found[1] and found[1].lower() == "head":
            flush()
            continue
        if not found[3]:
            continue
        name = found[3].lower()
        if name not in BLOCKS:
            if name == "br":
                held.append(" ")
            elif name == "a":
                in_link = 0 if found[2] else 1
            continue
        flush()
        in_link = 0
        if found[2]:
            if name in CONTAINERS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
            continue
        _, path, aside, level, mark = stack[-1]
        own_aside, own_named, level, signature = _marks(name, found[4] or "", level)
        token = _token(path, signature)
        tokens.append(token)
        if own_named:
            around.append(mark)
            mark = len(around) - 1
        if name in CONTAINERS:
            if not (found[4] or "").endswith("/"):
                stack.append((name, token, aside or own_aside, level, mark))
        else:
            block_name, block_aside, block_named = name, own_aside, mark if own_named else 0
    if at < len(html):
        held.append(html[at:])
    flush()
    # An element that holds the article, or without one most of the page's text, is no part beside it, whatever its words.
    sizes, articles, whole, sure = [0] * len(around), [0] * len(around), 0, 0
    for block, mark in zip(blocks, marked_by, strict=True):
        if not block.aside:
            sizes[mark] += len(block.text)
            whole += len(block.text)
            if block.level >= 2:
                articles[mark] += 1
                sure += 1
    for mark in range(len(around) - 1, 0, -1):
        sizes[around[mark]] += sizes[mark]
        articles[around[mark]] += articles[mark]
    hidden = [False] * len(around)
    for mark in range(1, len(around)):
        holds = articles[mark] == sure if sure else 2 * sizes[mark] > whole
        hidden[mark] = hidden[around[mark]] or not holds
    return Page(
        tokens,
        [b._replace(aside=b.aside or hidden[m], named=hidden[m] and not b.aside) for b, m in zip(blocks, marked_by, strict=True)],
    )


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Page]]:
    """(batch, row, page) for batches whose first column is the html."""
    for batch in batches:
        column = batch.column(0)
        for row in range(batch.num_rows):
            yield batch, row, parsed(column[row].as_py() or "")


def _rows(sums: dict[tuple, list[int]], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*[(*key, *values) for key, values in sums.items()], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, total, d1, d2), added up within the task.  Token 0 stands for the page itself."""
    names, kinds = ["host", "token", "pages", "total", "d1", "d2"], [pa.string(), *[pa.int64()] * 5]
    sums: dict[tuple, list[int]] = {}
    for batch, row, page in _pages(batches):
        host, own = batch.column(1)[row].as_py(), xxhash.xxh64_intdigest(str(batch.column(2)[row].as_py()))
        # NULL and empty pages are no evidence against a template.
        counts: dict[int, int] = {0: 1} if page.tokens else {}
        for token in page.tokens:
            counts[token] = counts.get(token, 0) + 1
        for token, n in counts.items():
            digest = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), own & 0xFFFFFFFFFFFFFFFF)
            held = sums.setdefault((host, token), [0, 0, 0, 0])
            held[0] += 1
            held[1] += n
            held[2] += digest & 0xFFFFFFFF
            held[3] += digest >> 32
        if len(sums) >= HELD:
            yield _rows(sums, names, kinds)
            sums = {}
    if sums:
        yield _rows(sums, names, kinds)


def _class_of(batch: pa.RecordBatch, row: int, column: int) -> dict[int, int]:
    template = batch.column(column)[row].as_py()
    return {entry["token"]: entry["class"] for entry in template or ()}


def _order(page: Page, classes: dict[int, int], outer: int | None) -> Iterator[tuple[int, int, int]]:
    """(class, order, place) of every class on a page: hashes of the sequence of its tokens, and of the tokens of the
    outermost class that come before each of them."""
    sequences: dict[int, list[int]] = {}
    places: dict[int, set[int]] = {}
    last = 0
    for token in page.tokens:
        own = classes.get(token)
        if own is None:
            continue
        if own == outer:
            last = token
        else:
            places.setdefault(own, set()).add(last)
        sequences.setdefault(own, []).append(token)
    for own, sequence in sequences.items():
        yield own, _token(*sequence), _token(*sorted(places.get(own, ())))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and task: on how many pages every class has an order and place (kind 0), and size and linked size of the
    text in every slot (kind 1)."""
    names = ["host", "kind", "key", "order", "place", "n", "linked"]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5]
    sums: dict[tuple, list[int]] = {}
    for batch, row, page in _pages(batches):
        host, classes, outer = batch.column(1)[row].as_py(), _class_of(batch, row, 3), batch.column(4)[row].as_py()
        for own, order, place in _order(page, classes, outer):
            sums.setdefault((host, 0, own, order, place), [0, 0])[0] += 1
        for block, slot in _slots(page, classes, outer):
            held = sums.setdefault((host, 1, slot, 0, 0), [0, 0])
            held[0] += len(block.text)
            held[1] += block.linked
        if len(sums) >= HELD:
            yield _rows(sums, names, kinds)
            sums = {}
    if sums:
        yield _rows(sums, names, kinds)


def _slots(page: Page, classes: dict[int, int], outer: int | None) -> Iterator[tuple[Block, int]]:
    """Every block with its slot: the last element token of the outermost class before it."""
    last, at = 0, 0
    for block in page.blocks:
        for token in page.tokens[at : block.order]:
            if not token & 1 and outer is not None and classes.get(token) == outer:
                last = token
        at = block.order
        yield block, last


def main_text(page: Page, classes: dict[int, int], outer: int | None, linked_slots: frozenset[int]) -> str:
    """The article of a page, given its host's template.

    Template text and slots of links go first, wherever they are; marks choose among what remains.  On a host without a
    template they choose among all blocks.
    """
    every = list(_slots(page, classes, outer))
    left = [(block, slot) for block, slot in every if block.token not in classes and slot not in linked_slots]
    # Where the template takes everything that marks leave, marks alone decide.
    for blocks in (left, every):
        seen = [block for block, _ in blocks if not block.aside] or [block for block, _ in blocks if block.named]
        if seen:
            top = max(block.level for block in seen)
            return "\n\n".join(block.text for block in seen if block.level == top)
    return ""


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, outer, linked): valid classes of every host, its outermost class, and its slots of links."""
    sums = (
        pages.select("html", "host", "page")
        .mapInArrow(_occurrences, "host string, token long, pages long, total long, d1 long, d2 long")
        .groupBy("host", "token")
        .agg(*[F.sum(c).alias(c) for c in ("pages", "total", "d1", "d2")])
        .filter(F.col("pages") >= LEAST_PAGES)
    )
    counted = stored(sums, "token-vectors")
    sizes = counted.filter("token = 0").select(F.col("host").alias("of_host"), F.col("pages").alias("n"))
    frequent = counted.filter("token <> 0").join(sizes, F.col("host") == F.col("of_host")).filter(F.col("pages") >= SUPPORT * F.col("n"))
    # Equal sums: an equivalence class.  The outermost one has each of its tokens once on the pages it is on, and the most tokens
    # on the most pages.
    classed = stored(frequent.select("host", "token", "pages", "total", F.xxhash64("pages", "total", "d1", "d2").alias("class")), "classes")
    weighed = classed.filter("pages = total").groupBy("host", "class").agg((F.count(F.lit(1)) * F.max("pages")).alias("weight"))
    outermost = weighed.groupBy(F.col("host").alias("o_host")).agg(F.max(F.struct("weight", "class"))["class"].alias("outer"))
    lists = classed.groupBy(F.col("host").alias("of_host")).agg(F.collect_list(F.struct("token", "class")).alias("template"))
    return stored(lists.join(outermost, F.col("of_host") == F.col("o_host"), "left").select("of_host", "template", "outer"), "templates")


def _with_template(pages: DataFrame, found: DataFrame) -> DataFrame:
    return pages.join(broadcast_up_to(found, BROADCAST_HOSTS), F.col("host") == F.col("of_host"), "left")


def valid_templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The templates without classes that are out of order or out of place on more than 1 - ``SUPPORT`` of their pages, and with
    their slots of links."""
    raw = (
        _with_template(pages, found)
        .select("html", "host", "page", "template", "outer")
        .mapInArrow(_checked, "host string, kind int, key long, order long, place long, n long, linked long")
    )
    checks = stored(
        raw.groupBy("host", "kind", "key", "order", "place").agg(F.sum("n").alias("n"), F.sum("linked").alias("linked")), "template-checks"
    )
    # The share of the pages with a class on which it has its most common order and place.
    usual = checks.filter("kind = 0").groupBy("host", "key").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    broken = usual.filter(F.col("most") < SUPPORT * F.col("n")).groupBy("host").agg(F.collect_list("key").alias("broken"))
    links = checks.filter((F.col("kind") == 1) & (F.col("linked") > LINKED * F.col("n"))).groupBy("host").agg(F.collect_list("key").alias("linked"))
    sides = broken.withColumnRenamed("host", "b_host"), links.withColumnRenamed("host", "l_host")
    joined = found.join(sides[0], F.col("of_host") == F.col("b_host"), "left").join(sides[1], F.col("of_host") == F.col("l_host"), "left")
    wrong = F.coalesce("broken", F.array().cast("array<bigint>"))
    return stored(
        joined.select(
            "of_host",
            F.filter("template", lambda e: ~F.array_contains(wrong, e["class"])).alias("template"),
            F.when(~F.array_contains(wrong, F.col("outer")), F.col("outer")).alias("outer"),
            "linked",
        ),
        "valid-templates",
    )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for row in range(batch.num_rows):
            page = parsed(batch.column(0)[row].as_py() or "")
            outer, linked = batch.column(4)[row].as_py(), batch.column(5)[row].as_py()
            texts.append(main_text(page, _class_of(batch, row, 3), outer, frozenset(linked or ())))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string())], ["id", "url", "text"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    named = pages.select(
        F.col(html_col).alias("html"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(id_col).cast("string").alias("page")
    )
    found = valid_templates(named, templates(named))
    kind = pages.schema[id_col].dataType.simpleString()
    joined = _with_template(named, found).select("html", "id", "url", "template", "outer", "linked")
    return joined.mapInArrow(_extracted, f"id {kind}, url string, text string").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )
