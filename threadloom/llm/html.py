"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: a node is an element reached by a path of tags
with their classes; per node it holds how many pages show which children below it (presentation)
and which text (content). A node's importance is the entropy of its presentations and contents,
1 if every page differs and 0 if all are the same. A branch of low importance below an important
parent is what the site repeats, and is removed from each page. Elements that say what they are
(navigation, footers, forms, advertisement, comments and so on, by tag, class, id or role) are removed
on any page, also where a host has too few pages to tell; an element that holds most of the page's text,
or whose name says what it is without (no-comments, with-sidebar), is not one of them. Where an article or
main element holds most of the text, the text is what stands there. Each piece of text is judged by the
elements it stands in itself; repeats of the site are removed by whole blocks.

Defined results: null or empty html gives an empty text; a page without a host in its url is read by
its elements alone; an empty table gives an empty result. Pages of a host with the same text are one page of
its style tree, however often they stand there, and what stands in an article or main element is never
removed for being the same elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import fits_broadcast, stored

GAMMA = 0.9
LOW = 0.3
MIN_PAGES = 4
SALTS = 64
PRIME, FACTOR = (1 << 61) - 1, 0x9E3779B97F4A7C15

# A tag whose attributes hold no angle bracket: nearly all. Others are read by ``tags`` step by step.
TAG = re.compile(r"<(/?)([a-z][^\s/<>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>", re.I)
START = re.compile(r"</?[a-z][^\s/<>]*", re.I)
QUOTED = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NAMES = frozenset(("class", "id", "role"))

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split())
NOT_TEXT = frozenset("head nav header footer aside form button dialog menu fieldset object audio video canvas".split())
ARTICLE = frozenset(("article", "main"))
WRAPPERS = frozenset(("form", "fieldset", "object"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
# Elements without text of the page: some end where the page does if they have no end tag, others are then passed by.
UNREAD = frozenset("script style textarea title noscript iframe svg template select".split())
TO_END = frozenset("script style textarea title".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
NOISE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe ad ads advert adverts advertisement "
    "promo promotion sponsor sponsored social share sharing related recommended comment comments disqus reply replies "
    "login signup search pagination pager widget toolbar contentinfo complementary skip".split())
# Words that say where or what kind of noise it is, not what else.
BESIDE = frozenset(
    "site main page top bottom left right global primary secondary list item items box bar block section container "
    "wrapper wrap area inner outer link links button buttons btn icon icons label badge marker tag title heading form "
    "field input slot unit post posts article articles story stories news count thread panel dialog to".split())
ON_A_LINE = frozenset("label badge icon icons button buttons btn link links count tag marker".split())
SENTENCES = 8  # words
MODIFIER = re.compile(r"(?<!\S)(?:no|not|non|has|have|with|without|hide)[_-]\S*", re.I)


def noise_of(hints: str, inline: bool) -> int:
    """2 if a class, id or role names noise and nothing else, 1 if it names something else as well, else 0.
    On a line only a whole name counts, or one of a label, button or the like."""
    level = 0
    for name in hints.lower().split():
        words = [w for w in re.split("[_-]+", name) if w]
        if not NOISE.intersection(words):
            continue
        if inline:
            level = max(level, 2 * (words[0] in NOISE and ON_A_LINE.issuperset(words[1:])))
        else:
            level = max(level, 2 if all(w in NOISE or w in BESIDE for w in words) else 1)
    return level


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start and end of each tag or passage that is no text, with ``/`` of an end tag, name and attributes; names
    are empty where nothing but the text around matters. Each character is looked at a bounded number of times,
    whatever is left open: what is not found once is not looked for again."""
    at, lower, missing, quotes = 0, None, set(), True
    while (at := html.find("<", at)) >= 0:
        start, sign = at, html[at + 1 : at + 2]
        if m := TAG.match(html, at):
            at, closing, name, rest = m.end(), m[1], m[2].lower(), m[3]
        elif sign == "!" or sign == "?":
            mark = "-->" if html.startswith("<!--", at) else ">"
            found = html.find(mark, at + 2) if mark not in missing else -1
            if found < 0 and mark == ">":
                missing.add(mark)
                at += 1
                continue
            at = found + len(mark) if found >= 0 else len(html)
            yield start, at, "", "", ""
            continue
        elif m := START.match(html, at):
            end, place = -1, m.end()
            while quotes:  # the end that stands in no quotes
                q = QUOTED.search(html, place)
                if q and q[0] == ">":
                    end = q.start()
                    break
                place = html.find(q[0], q.end()) + 1 if q else 0
                quotes = place > 0  # else quotes do not close any more, here or later
            if end < 0 and ">" not in missing:
                end = html.find(">", m.end())
            if end < 0:
                missing.add(">")
                at += 1
                continue
            closing, name, rest, at = "/" * m[0].startswith("</"), m[0].lstrip("</").lower(), html[m.end() : end], end + 1
        else:
            at += 1
            continue
        if name in UNREAD:
            if not closing and not rest.endswith("/") and name not in missing:
                lower = html.lower() if lower is None else lower
                if len(lower) != len(html):  # letters that lower to several: only where none changes places
                    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), html)
                m = re.compile(rf"</{name}(?=[\s/>])[^>]*>?").search(lower, at)
                if m:
                    at = m.end()
                elif name in TO_END:
                    at = len(html)
                else:
                    missing.add(name)
            yield start, at, "", "" if name not in IN_HEAD else name, ""
            continue
        yield start, at, closing, name, rest


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """Elements of one page in order, and its blocks of text: pieces with the element each stands in."""

    def __init__(self, html: str):
        self.parent, self.path, self.tag, self.noise, self.children = [-1], [hash64("")], [""], [False], [[]]
        self.unsure: set[int] = set()
        self.blocks: list[list[tuple[int, str]]] = []
        stack, at, open_block = [0], 0, False
        self.places: dict[str, list[int]] = {}  # of open elements, by tag
        blocks = [0]

        def shut(place: int) -> None:
            while len(stack) > place:
                tag = self.tag[stack.pop()]
                self.places[tag].pop()
                if tag not in INLINE:
                    blocks.pop()

        def text(raw: str) -> None:
            nonlocal open_block
            if not raw or (not open_block and raw.isspace()):
                return
            if self.tag[stack[-1]] == "head" and not raw.isspace():
                shut(len(stack) - 1)  # the end tag may be left out; text is not in a head
            if not open_block:
                self.blocks.append([])
                open_block = True
            self.blocks[-1].append((stack[-1], unescape(raw) if "&" in raw else raw))

        for start, end, closing, name, rest in tags(html):
            if start > at:
                text(html[at:start])
            at = end
            if not name or name in UNREAD:
                continue
            if name == "br":
                text(" ")
                continue
            if self.tag[stack[-1]] == "head" and not closing and name not in IN_HEAD:
                shut(len(stack) - 1)
            block = name not in INLINE
            if block:
                open_block = False
            if closing:
                places = self.places.get(name)
                if places and (block or places[-1] > blocks[-1]):
                    shut(places[-1])
                continue
            if block and (self.tag[stack[blocks[-1]]] == "p" or self.tag[stack[blocks[-1]]] in CLOSES.get(name, ())):
                shut(blocks[-1])
            if name in VOID:
                continue
            self._open(stack, name, rest)
            if rest.endswith("/") and name not in INLINE and name not in ("p", "div"):
                stack.pop()
                continue
            self.places.setdefault(name, []).append(len(stack) - 1)
            if block:
                blocks.append(len(stack) - 1)
        text(html[at:])
        self._settle()

    def _open(self, stack: list[int], name: str, rest: str) -> None:
        up, hints = stack[-1], ""
        if rest and "=" in rest:
            hints = " ".join(m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest) if m[1].lower() in NAMES)
        said = MODIFIER.sub(" ", hints) if hints and name not in ("html", "body", "article", "main") else ""
        if name == "header" and any(self.tag[k] in ARTICLE for k in stack):
            said, name_is_noise = said.replace("header", ""), False
        else:
            name_is_noise = name in NOT_TEXT
        level = noise_of(said, name in INLINE) if said else 0
        noise = name_is_noise or level > 0
        if level == 1 and not name_is_noise and any(self.tag[k] in ARTICLE for k in stack):
            self.unsure.add(len(self.parent))
        key = f"{name}.{hints}" if hints else name
        self.parent.append(up)
        self.path.append(hash64(f"{self.path[up]}>{key}"))
        self.tag.append(name)
        self.noise.append(noise)
        self.children.append([])
        seen = self.children[up]
        if not seen or seen[-1] != key:  # repeats in a row count once
            seen.append(key)
        stack.append(len(self.parent) - 1)

    def _settle(self) -> None:
        """Noise goes down the tree, but from an element that holds most of the page's text: if an article,
        main or h1 stands in it, or hardly any other text is left beside it."""
        n = len(self.parent)
        size, clean, whole = [0] * n, [0] * n, [False] * n
        if self.unsure:  # in an article: sentences are no noise for a name that also names something else
            says = [False] * n
            for pieces in self.blocks:
                said = "".join(piece for _, piece in pieces)
                if len(said.split()) >= SENTENCES and re.search(r"[.!?。！？]", said):
                    for node, piece in pieces:
                        says[node] |= not piece.isspace()
            for k in range(n - 1, 0, -1):
                says[self.parent[k]] |= says[k]
                if says[k] and k in self.unsure:
                    self.noise[k] = False
        if any(self.noise):
            inherited = [False] * n
            for k in range(1, n):
                inherited[k] = self.noise[k] or inherited[self.parent[k]]
            for pieces in self.blocks:
                for node, piece in pieces:
                    length = len(piece) - sum(map(str.isspace, piece))
                    size[node] += length
                    clean[0] += 0 if inherited[node] else length
            for k in range(n - 1, 0, -1):
                size[self.parent[k]] += size[k]
                whole[self.parent[k]] |= whole[k] or self.tag[k] in ARTICLE or self.tag[k] == "h1"
        for k in range(1, n):
            if self.noise[k] and self.tag[k] != "head" and 2 * size[k] > size[0]:
                self.noise[k] = not (whole[k] or (self.tag[k] not in NOT_TEXT or self.tag[k] in WRAPPERS)
                                     and 4 * clean[0] < size[k])
            self.noise[k] = self.noise[k] or self.noise[self.parent[k]]

    def nodes(self) -> Iterator[tuple[int, int, int, int]]:
        """Per path: the parent's path, the presentation and the content below it, as hashes."""
        # the pieces below an element stand together, so a hash of any such run follows from those of all starts
        n = len(self.parent)
        first, last, upto, powers = [1 << 60] * n, [0] * n, [0], [1]
        for pieces in self.blocks:
            for node, piece in pieces:
                first[node], last[node] = min(first[node], len(upto) - 1), len(upto)
                upto.append((upto[-1] * FACTOR + hash64(piece)) % PRIME)
                powers.append(powers[-1] * FACTOR % PRIME)
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            first[up], last[up] = min(first[up], first[k]), max(last[up], last[k])
        by_path: dict[int, list] = {}
        for k in range(1, n):
            up, style, content = by_path.setdefault(self.path[k], [self.path[self.parent[k]], [], []])
            style.append(",".join(self.children[k]))
            if last[k]:
                content.append(f"{(upto[last[k]] - upto[first[k]] * powers[last[k] - first[k]]) % PRIME}")
        for path, (up, style, content) in by_path.items():
            yield path, up, hash64(";".join(dict.fromkeys(style))), hash64("\n".join(content))

    def text(self, low: frozenset = frozenset()) -> str:
        """Blocks without noise; none of the branches in ``low`` unless nothing else is left."""
        marked = [False] * len(self.parent)
        main = [False] * len(self.parent)
        for k in range(1, len(self.parent)):
            up = self.parent[k]
            main[k] = main[up] or (self.tag[k] in ARTICLE and not self.noise[k])
            marked[k] = not main[k] and (marked[up] or self.path[k] in low)
        clean = []
        for pieces in self.blocks:
            kept = [(node, piece) for node, piece in pieces if not self.noise[node]]
            block = " ".join("".join([piece for _, piece in kept]).split())
            if block:
                said = [node for node, piece in kept if not piece.isspace()]
                clean.append((block, all(marked[node] for node in said), any(main[node] for node in said)))
        kept = [(block, inside) for block, repeat, inside in clean if not repeat]
        kept = kept or [(block, inside) for block, _, inside in clean]
        if 2 * sum(len(block) for block, inside in kept if inside) > sum(len(block) for block, _ in kept):
            kept = [(block, inside) for block, inside in kept if inside]
        return "\n".join([block for block, _ in kept])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, low): paths of the branches to remove, per host, from ``pages(host, html)``."""
    def page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per page: its text as a hash, and its nodes as four numbers each."""
        for batch in batches:
            texts, packed = [], []
            for html in batch.column(1).to_pylist():
                page = Page(html or "")
                texts.append(hash64(page.text()))
                packed.append(np.array(list(page.nodes()), np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.int64()), pa.array(packed, pa.binary())], names=["host", "page", "nodes"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in batch.column(1).to_pylist()]
            host = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows])))
            numbers = np.concatenate([np.zeros((0, 4), np.int64), *rows])
            yield pa.RecordBatch.from_arrays([host, *[pa.array(numbers[:, k]) for k in range(4)]],
                                             names=["host", "path", "up", "style", "content"])

    # copies of a page count once
    distinct = (pages.mapInArrow(page_nodes, "host string, page long, nodes binary")
                .groupBy("host", "page").agg(F.min("nodes").alias("nodes")))
    seen = (distinct.select("host", "nodes")
            .mapInArrow(unpacked, "host string, path long, up long, style long, content long")
            .groupBy("host", "path", "up", "style", "content").agg(F.count(F.lit(1)).alias("n")))

    def entropy(column: str, name: str) -> DataFrame:
        """Of how the pages with a node are spread over the values, as a share of the largest possible."""
        counts = seen.groupBy("host", "path", "up", column).agg(F.sum("n").alias("n"))
        sums = counts.groupBy("host", "path", "up").agg(
            F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
        return sums.select("host", "path", "up", "pages", F.when(
            F.col("pages") > 1, 1 - F.col("nlogn") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias(name))

    importance = entropy("style", "shown").join(entropy("content", "said"), ["host", "path", "up", "pages"]).select(
        "host", "path", "up", "pages", ((1 - GAMMA) * F.col("shown") + GAMMA * F.col("said")).alias("importance"))
    parents = importance.select("host", F.col("path").alias("up"), F.col("importance").alias("above"))
    return (importance.filter((F.col("importance") < LOW) & (F.col("pages") >= MIN_PAGES))
            .join(parents, ["host", "up"]).filter(F.col("above") >= LOW)
            .groupBy("host").agg(F.collect_set("path").alias("low")))


def with_lists(pages: DataFrame, low: DataFrame) -> DataFrame:
    """``pages`` with the list ``low`` of their host. Lists that fit go to all tasks, and no page moves. Otherwise
    pages and lists meet by host; of hosts that hold a two-hundredth of the pages or more (two hundred at most), the
    pages are dealt to SALTS keys and the lists stand at each of them."""
    if fits_broadcast(low):
        return pages.join(F.broadcast(low), "host", "left")
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    often = F.broadcast(counts.filter(F.col("n") * 200 >= total).select("host", F.lit(True).alias("often")))
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = low.join(often, "host", "left").withColumn("salt", F.explode(salts)).drop("often")
    return pages.join(often, "host", "left").withColumn("salt", salt).drop("often").join(dealt, ["host", "salt"], "left")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page ``(page_id, url, html)``."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    low = stored(style_tree(pages.filter("host <> ''").select("host", "html")), "html-low")

    @F.arrow_udf("string")
    def page_text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, paths in batches:
            yield pa.array((Page(h or "").text(frozenset(p or ())) for h, p in zip(html.to_pylist(), paths.to_pylist())),
                           pa.string())

    return (with_lists(pages, low).select("page_id", "url", page_text("html", "low").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
