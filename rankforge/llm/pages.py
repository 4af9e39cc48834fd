"""Main text of web pages by wrapper induction.

Every page of a host is aligned with one of them, its pivot, by simple tree matching. Blocks with the same text in at
least ``SHARED`` of a host's different pages are the host's template; what varies are slots, and the content element is
the one that holds most of the slots' text over all pages, an ``article`` or ``main`` where several do. A page's text is
what stands in the content element (where the page or the host has none, in its ``article`` or ``main`` elements, else in
the page), without template blocks and without elements whose tag, role or class says that they are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or comments. A class or id that only contains such a word
(``post-header``, ``related-work``) says little: inside the content the slots decide, and such an element goes only if its
text repeats over pages or stands mostly in links; outside it goes.

Pages are matched where they are read; what is shuffled are paths, hashes and sizes of their blocks, counted per task
first. Copies, and near copies whose longest blocks agree, count as one page. Texts of one page are slots whatever their
host, so they are summed before they meet by host; only texts of several pages are compared with the number of pages.
Pivots and wrappers are a few kilobytes for each host; they are broadcast while their counted size stays below
``BROADCAST_BYTES``, beyond that they are joined, and a host of very many pages or texts is dealt over several tasks.

Defined results: null or empty html gives the empty text; a null url shares the empty host; a host with fewer than
``MIN_ALIGNED`` different pages, or whose pages share more text than varies, has no wrapper; broken markup is closed as
browsers do; repeated rows get equal results; a very long page is read whole, alone in its slice; an empty table gives no
rows; further columns are ignored, and carried ones may have any name but ``text``, ``_host``, ``_html`` and ``_wrapper``.
"""

from __future__ import annotations

import html as entities
import itertools
import json
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common
from rankforge.llm.urls import host_of
from rankforge.operators.joins import beside as salted
from rankforge.session import written

#: Different pages that a wrapper needs, and the share of them that has a template block.
MIN_ALIGNED, SHARED = 2, 0.8
#: Share of the slots' text that the content element holds at least.
CONTENT_SHARE = 0.7
#: Longest blocks that tell different pages from near copies.
LONGEST = 3
BROADCAST_BYTES = 8 << 20
#: Pages of a host that one task of a join should get.
PAGES_PER_TASK = 5_000
#: Characters of pivots whose trees a worker keeps, and shapes of trees and their sizes.
KEPT_CHARS, KEPT_SHAPES = 4 << 20, 100_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
                 re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag closes, up to the nearest of the tags behind the bar.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
          "tbody": ("thead tbody tr td th", "table")}
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())

#: Elements that never hold the article's text, by tag, role and word of class or id.
DROPPED_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg button select option "
                         "textarea input head title dialog object canvas audio video menu datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                          "toolbar".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo "
                          "promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header "
                          "masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe share "
                          "sharing social related comment comments respond disqus widget widgets pagination pager "
                          "login signup search skip toolbar".split())
#: Words that say so as a part of a longer name too.
FIRM_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored comment comments "
                       "respond disqus cookie cookies consent gdpr newsletter subscribe login signup breadcrumb breadcrumbs "
                       "pagination pager".split())
#: Share of an element's text that stands in links from which on it is no part of an article.
LINK_SHARE = 0.5
ARTICLE_TAGS = ("article", "main")
ITEMS = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.int64()), ("size", pa.int64())]))


class Element:
    __slots__ = ("tag", "key", "items", "dropped", "doubtful", "main")

    def __init__(self, tag: str, attributes: str = "") -> None:
        names = {n.lower(): (a or b or c or "").lower() for n, a, b, c in ATTRIBUTE.findall(attributes)} \
            if attributes.strip(" /") else {}
        self.tag = tag
        self.key = tag + "".join("." + w for w in sorted(names.get("class", "").split()))
        self.items: list[Element | str] = []
        tokens = (names.get("class", "") + " " + names.get("id", "")).split()
        words = {w for token in tokens for w in re.split("[_-]+", token)}
        self.main = tag in ARTICLE_TAGS or names.get("role") in ARTICLE_TAGS
        told = tag not in ("main", "body") and names.get("role") != "main" and not DROPPED_WORDS.isdisjoint(words)
        firm = told and not (DROPPED_WORDS.isdisjoint(tokens) and FIRM_WORDS.isdisjoint(words))
        self.dropped = tag in DROPPED_TAGS or names.get("role") in DROPPED_ROLES or firm
        self.doubtful = told and not firm


def mostly_links(element: Element) -> bool:
    """Whether at least ``LINK_SHARE`` of an element's characters, white space aside, stand in links."""
    linked = total = 0
    todo: list[tuple[Element | str, bool]] = [(element, False)]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            size = len("".join(x.split()))
            total += size
            linked += size * link
        else:
            todo += ((y, link or x.tag == "a") for y in x.items)
    return total > 0 and linked >= LINK_SHARE * total


def parse(html: str) -> Element:
    """The tree of a page; what is left open is closed where browsers would."""
    root = Element("")
    stack, at, size = [root], 0, len(html)
    while at < size:
        found = TAG.search(html, at)
        if found is None:
            stack[-1].items.append(html[at:])
            break
        if found.start() > at:
            stack[-1].items.append(html[at:found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            close(stack, {"p"}, {"button", "td", "th", "table", "article", "aside", "body"})
        if tag in CLOSES:
            close(stack, set(CLOSES[tag][0].split()), set(CLOSES[tag][1].split()))
        element = Element(tag, found[3])
        stack[-1].items.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            element.items.append(html[at:end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(element)
    return root


def close(stack: list[Element], tags: set[str], stop: set[str]) -> None:
    """Close the outermost open element of ``tags`` above the nearest of ``stop``."""
    cut = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in stop:
            break
        if stack[i].tag in tags:
            cut = i
    if cut is not None:
        del stack[cut:]


def path_below(path: int, key: str) -> int:
    """A number for the path of elements from the root, however deep; 0 is the root."""
    return xxhash.xxh64_intdigest(f"{path}/{key}") >> 1 if key else path


class Block(NamedTuple):
    """A block element's own text, and what holds it."""

    path: int
    dropped: bool
    main: bool
    inside: bool
    text: str


def blocks(root: Element, content: int | None = None) -> list[Block]:
    """The page's blocks in order; text inside a block is joined and its white space made single spaces.

    ``inside`` tells whether an element of path ``content`` holds the block.
    """
    out: list[Block] = []
    run: list[str] = []

    def flush(state: tuple[int, bool, bool, bool]) -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append(Block(*state, text))

    state = (0, False, False, False)
    todo: list[tuple] = [("in", root, state)]
    while todo:
        what, element, held = todo.pop()
        if what == "text":
            run.append(element)
            continue
        if what == "out":
            flush(state)
            state = held
            continue
        if element.tag == "br" or element.tag == "hr":
            flush(state)
            continue
        inside = state
        if not through(element):
            flush(state)
            todo.append(("out", None, state))
            path = path_below(state[0], element.key)
            main, within = state[2] or element.main, state[3] or path == content
            gone = element.dropped or element.doubtful and (not (main or within) or mostly_links(element))
            inside = (path, state[1] or gone, main, within)
            state = inside
        todo += [("text" if isinstance(x, str) else "in", x, inside) for x in reversed(element.items)]
    flush(state)
    return out


def through(element: Element) -> bool:
    """Whether an element is part of the block around it."""
    return element.tag in INLINE and not element.dropped and not element.doubtful and not element.main


def own_texts(element: Element) -> list[str]:
    """Texts of an element between its block children, as :func:`blocks` gives them."""
    out, run, todo = [], [], list(reversed(element.items))
    while todo or run:
        x = todo.pop() if todo else None
        if isinstance(x, str):
            run.append(x)
        elif x is not None and through(x):
            todo += reversed(x.items)
        elif run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append(text)
    return out


def children(element: Element) -> list[Element]:
    """Block children; inline elements are looked through."""
    out, todo = [], list(reversed(element.items))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if through(x):
            todo += reversed(x.items)
        else:
            out.append(x)
    return out


_SHAPES: dict[tuple, int] = {}
_SIZES: dict[tuple[int, int], int] = {}
_NUMBERS = itertools.count()


class Tree:
    """An element with its block children and path, ready for matching; trees of equal ``shape`` have equal keys."""

    __slots__ = ("key", "path", "above", "depth", "texts", "kids", "dropped", "doubtful", "main", "shape", "size")

    def __init__(self, element: Element, above: Tree | None = None) -> None:
        self.key, self.above, self.main = element.key, above, element.main
        self.path = path_below(above.path if above else 0, element.key)
        self.depth = above.depth + 1 if above else 0
        self.texts = own_texts(element)
        self.dropped = element.dropped or above is not None and above.dropped
        self.doubtful = element.doubtful or above is not None and above.doubtful
        self.kids = [] if element.tag in RAW else [Tree(x, self) for x in children(element)]
        self.size = 1 + sum(k.size for k in self.kids)
        if len(_SHAPES) > KEPT_SHAPES:  # numbers are never used again, so trees of before stay right
            _SHAPES.clear()
        shape = (self.key, *(k.shape for k in self.kids))
        self.shape = _SHAPES.get(shape)
        if self.shape is None:
            self.shape = _SHAPES[shape] = next(_NUMBERS)

    def walk(self) -> Iterator[Tree]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.kids)


def match_size(a: Tree, b: Tree) -> int:
    """Size of the largest order-keeping match of two trees."""
    if a.key != b.key:
        return 0
    if a.shape == b.shape:
        return a.size
    if not a.kids or not b.kids:
        return 1
    pair = (a.shape, b.shape)
    found = _SIZES.get(pair)
    if found is None:
        found = 1
        for row in match_rows(a, b):
            found = 1 + int(row[-1])
        if len(_SIZES) > KEPT_SHAPES:
            _SIZES.clear()
        _SIZES[pair] = found
    return found


def match_rows(a: Tree, b: Tree) -> Iterator[np.ndarray]:
    """For each child of ``a`` the best sizes of matches of the children up to it with those of ``b`` up to each."""
    first: dict[int, int] = {}
    which = np.array([first.setdefault(y.shape, len(first)) for y in b.kids])
    some = [b.kids[i] for i in np.unique(which, return_index=True)[1]]
    row = np.zeros(len(b.kids) + 1, np.int64)
    for x in a.kids:
        gain = np.array([match_size(x, y) for y in some])[which]
        # A child that cannot match adds nothing, so its diagonal is never the only best.
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain))])
        yield row


def matching(a: Tree, b: Tree) -> tuple[int, list[tuple[Tree, Tree]]]:
    """Simple tree matching: size of the largest order-keeping match of two trees with equal roots, and its pairs."""
    size, pairs = match_size(a, b), []
    todo = [(a, b)] if size else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            todo += zip(x.kids, y.kids)
            continue
        if not x.kids or not y.kids:
            continue
        # Of each row only where it equals the one above and its own last entry is kept, as bits.
        before, steps = np.zeros(len(y.kids) + 1, np.int64), []
        for row in match_rows(x, y):
            steps.append((np.packbits(row == before), np.packbits(np.concatenate([[False], row[1:] == row[:-1]]))))
            before = row
        i, j = len(x.kids), len(y.kids)
        while i and j:
            up, left = (bits[j >> 3] >> (7 - (j & 7)) & 1 for bits in steps[i - 1])
            if up:
                i -= 1
            elif left:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x.kids[i], y.kids[j]))
    return size, pairs


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1 or 1


def tree_of(html: str) -> Tree:
    # Trees are walked by plain recursion, and pages may be nested very deeply.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    return Tree(parse(html))


def observed(pivot: Tree, page: Tree) -> tuple[int, list[tuple[int, int, int]]]:
    """What a page tells about its host: what it is known by, and ``(path, text hash, length)`` of its blocks.

    Blocks that match none of the pivot count for the nearest element that does, with hash 0. Blocks of doubtful elements
    have length 0: they may be template, but do not tell where the content is.
    """
    matched = {id(y): x for x, y in matching(pivot, page)[1]}
    out: dict[tuple[int, int], int] = {}
    texts: set[str] = set()
    todo = [(page, pivot.path)]
    while todo:
        node, path = todo.pop()
        if node.dropped:
            continue
        own = id(node) in matched
        path = node.path if own else path
        for text in node.texts:
            texts.add(text)
            if own or not node.doubtful:
                key = (path, hashed(text) if own else 0)
                out[key] = out.get(key, 0) + len(text) * (not node.doubtful)
        todo += ((k, path) for k in node.kids)
    longest = sorted(texts, key=lambda t: (-len(t), t))[:LONGEST]
    return hashed("\0".join(longest)), [(*key, size) for key, size in out.items()]


def induce(pivot: Tree, shared: list[tuple[int, int, int]], varying: dict[int, int]) -> dict:
    """The wrapper of a host: constant ``(path, text hash)`` blocks and the path of the content element (or null).

    ``shared`` has path, hash and total length of the template's blocks, ``varying`` the length of the slots by path.
    """
    held: dict[int, list] = {}
    constant: dict[int, int] = {}
    done = set()
    same: dict[int, int] = {}
    for path, _, size in shared:
        same[path] = same.get(path, 0) + size
    for node in pivot.walk():
        if node.path in done or node.dropped:
            continue
        done.add(node.path)
        size, template = varying.get(node.path, 0), same.get(node.path, 0)
        if not size and not template:
            continue
        # A block of text is held by the elements above it, a page's whole by itself.
        above = node if node.kids or not node.above else node.above
        while above is not None:
            each = held.setdefault(above.path, [0, above.depth, False])
            each[0] += size
            each[2] |= above.main
            constant[above.path] = constant.get(above.path, 0) + template
            above = above.above
    total = sum(varying.values())
    found = [(main, depth, path) for path, (size, depth, main) in held.items()
             if depth and size and size >= CONTENT_SHARE * total]
    content = max(found, default=(False, 0, None))[2]
    if content is None or constant[content] > held[content][0]:
        return {"template": [], "content": None}  # near copies, or nothing that varies
    return {"template": [[path, text] for path, text, _ in shared], "content": content}


def main_text(html: str, wrapper: dict | None) -> str:
    """The page's main text under its host's wrapper."""
    found = blocks(parse(html), wrapper and wrapper["content"])
    template = wrapper["template"] if wrapper else ()
    found = ([b for b in found if b.inside and not b.dropped] or [b for b in found if b.main and not b.dropped]
             or [b for b in found if not b.dropped])
    return " ".join(b.text for b in found if not template or (b.path, hashed(b.text)) not in template)


def beside(pages: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Pages with their host's ``column`` of ``known`` (``_host``, ``column``, ``_pages``), null where it has none."""
    size = known.agg(F.coalesce(F.sum(F.octet_length(column) + F.octet_length("_host")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(known.drop("_pages")), "_host", "left")
    parts = F.floor(F.col("_pages") / PAGES_PER_TASK) + 1
    dealt = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_pages")
    # At most one host for each PAGES_PER_TASK pages.
    hot = known.where(F.col("_pages") >= PAGES_PER_TASK).select("_host", parts.alias("_parts"))
    salted = pages.join(F.broadcast(hot), "_host", "left").withColumn("_salt", F.pmod(
        F.xxhash64("_html", F.spark_partition_id()), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    return salted.join(dealt, ["_host", "_salt"], "left").drop("_salt")


class Pivots:
    """Trees of the pivots that a worker met last."""

    def __init__(self) -> None:
        self.trees: dict[str, Tree] = {}
        self.chars = 0

    def of(self, html: str) -> Tree:
        if html not in self.trees:
            if self.chars > KEPT_CHARS:
                self.trees.clear()
                self.chars = 0
            self.trees[html] = tree_of(html)
            self.chars += len(html)
        return self.trees[html]


def pivots(pages: DataFrame) -> DataFrame:
    """``_host``, ``_pivot`` (the html with the smallest hash) and ``_pages`` of hosts with several different pages."""
    keyed = pages.where("_html <> ''").withColumn("_digest", F.xxhash64("_html"))
    hosts = written(keyed.groupBy("_host").agg(
        F.min("_digest").alias("_digest"), F.max("_digest").alias("_last"), F.count("*").alias("_pages")).where(
        "_digest <> _last").drop("_last"), "hosts")
    return written(keyed.join(hosts, ["_host", "_digest"]).groupBy("_host").agg(
        F.min("_html").alias("_pivot"), F.first("_pages").alias("_pages")), "pivots")


def wrappers(pages: DataFrame) -> DataFrame:
    """``_host``, ``_wrapper`` (JSON) and ``_pages`` of each host, from ``_host`` and ``_html`` of all its pages."""
    known = pivots(pages)
    both = beside(pages.where("_html <> ''"), known, "_pivot").where("_pivot is not null").select(
        "_host", "_html", "_pivot")

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Pivots()
        for part in common.slices(batches, "_html"):
            names, items = [], []
            for page, pivot in zip(part.column("_html").to_pylist(), part.column("_pivot").to_pylist()):
                name, each = observed(trees.of(pivot), tree_of(page))
                names.append(name)
                items.append([{"path": p, "text": t, "size": n} for p, t, n in each])
            yield pa.RecordBatch.from_arrays(
                [part.column("_host"), pa.array(names, pa.int64()), pa.array(items, ITEMS)],
                names=["_host", "page", "items"])

    seen = both.mapInArrow(observe, "_host string, page bigint, items array<struct<path:bigint,text:bigint,size:bigint>>")
    blocks_of = written(seen.select("_host", "page", F.explode_outer("items").alias("x")).select(
        "_host", "page", "x.*").groupBy("_host", "path", "text", "page").agg(F.max("size").alias("size")), "blocks")
    texts = blocks_of.where("path is not null").groupBy("_host", "path", "text").agg(
        F.count("*").alias("pages"), F.sum("size").alias("size"))
    different = blocks_of.select("_host", "page").distinct().groupBy("_host").agg(F.count("*").alias("n")).where(
        F.col("n") >= MIN_ALIGNED)
    # A text of one page is no template of a host of several: no host is needed to know.
    single = texts.where("pages < 2").groupBy("_host", "path").agg(F.sum("size").alias("size")).withColumn(
        "text", F.lit(None).cast("bigint"))
    shared = texts.where("pages >= 2")
    asked = different.join(shared.groupBy("_host").agg(F.count("*").alias("_rows")), "_host")
    constant = (F.col("text") != 0) & (F.col("pages") >= SHARED * F.col("n"))
    told = salted(shared, written(asked, "counts"), ["_host"], F.col("text")).where("n is not null").groupBy(
        "_host", "path", F.when(constant, F.col("text")).alias("text")).agg(F.sum("size").alias("size"))
    # Of each path: at most 1 / SHARED as many texts as a page has there, and the length of all others.
    slots = told.unionByName(single.join(different.select("_host"), "_host", "left_semi")).groupBy(
        "_host", "path", "text").agg(F.sum("size").alias("size"))
    facts = slots.groupBy("_host").agg(F.collect_list(F.struct("path", "text", "size")).alias("_facts"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pivot, each in zip(batch.column("_pivot").to_pylist(), batch.column("_facts").to_pylist()):
                shared = sorted((x["path"], x["text"], x["size"]) for x in each if x["text"] is not None)
                out.append(json.dumps(induce(tree_of(pivot), shared, {
                    x["path"]: x["size"] for x in each if x["text"] is None})))
            yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(out, pa.string()), batch.column("_pages")],
                                             names=["_host", "_wrapper", "_pages"])

    return known.join(facts, "_host").select("_host", "_pivot", "_pages", "_facts").mapInArrow(
        learn, "_host string, _wrapper string, _pages bigint")


def extract(pages: DataFrame, carry: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """``carry`` and ``text``: the main text of every page."""
    rows = pages.select(*carry, host_of(F.col(url)).alias("_host"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    joined = beside(rows, written(wrappers(rows.select("_host", "_html")), "wrappers"), "_wrapper")
    given = joined.select(*carry, "_html", "_wrapper")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for part in common.slices(batches, "_html"):
            texts = []
            for page, wrapper in zip(part.column("_html").to_pylist(), part.column("_wrapper").to_pylist()):
                if wrapper is not None and wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                    known[wrapper]["template"] = {tuple(x) for x in known[wrapper]["template"]}
                texts.append(main_text(page, known.get(wrapper)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(texts, pa.string())],
                                             names=[*carry, "text"])

    return given.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(common.table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
