"""Main text of web pages by consensus paths per host.

First pass: each page is parsed into containers; a container is named by its path of tags
with generalized classes. The text without links of all its descendants counts for a
container. A page votes for the containers that hold its article whole: from the one
with the most text of its own, upwards as long as a parent is an article or main, or adds
more text than links and boilerplate. Spark sums the votes per host and path, and each
host's best path wins. Second pass: pages are extracted again from the containers on the
winning path; a page where they hold less than ``COVERED`` of the text of its own
best container, or where there is none, uses its own.

Whether an element with a telling tag or class is boilerplate is judged after the whole
page is read, by what it holds: one around the article or around nearly all text of the
page is a wrapper and stays; only comments, adverts, menus and the like need an article
with more than half of the text inside them to stay. Time and memory of a page grow with
its length, whatever the nesting.

Defined results: a null or empty page gives an empty text; a page without an URL votes
in the group of the empty host; ties between paths go to the longer, then the
alphabetically first; repeated rows are extracted alike; an empty table gives an
empty result; other columns are ignored. Votes are summed before they are shuffled,
and pages of a large host are spread by a salt, so a hot host fills no single task.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm import flat
from creditspark.llm.registry import query, table
from creditspark.llm.url_vocabulary import host_and_path

SALTS = 64
COVERED = 0.5  # of the text of a page's own best container
WRAPPER_BLOCKS, WRAPPER_TEXT, WRAPPER_SHARE = 3, 200, 4  # a marked element with so much, and so many times the text outside, is a wrapper
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>|<[!?][^<>]*>", re.S)
CLASS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style noscript template textarea title svg iframe object canvas annotation annotation-xml".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
SELF_CLOSED = frozenset("svg math annotation annotation-xml".split())  # foreign elements, where "/>" closes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
INLINE = MATH | frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
CONTAINERS = frozenset("article main section div td body".split())
BARRIERS = CONTAINERS | frozenset("table ul ol dl".split())
ARTICLE = frozenset(("article", "main"))
CONTROLS = frozenset("button select option datalist".split())  # never text
FIRM_TAGS = frozenset("nav footer aside menu dialog".split())
SOFT_TAGS = frozenset("form fieldset".split())
PLAIN, HEADER, SOFT, COMMENT, FIRM = range(5)
#: A class, id or role with one of these parts marks matter that is not the article.
MARKS = {
    COMMENT: frozenset("comment comments reply replies disqus respond".split()),
    FIRM: frozenset("ad ads adv advert advertisement adverts sponsor sponsored cookie cookies consent popup".split()),
    SOFT: frozenset("banner promo promotion sidebar side menu nav navbar navigation footer masthead breadcrumb breadcrumbs notice notices alert modal overlay newsletter "
                    "subscribe signup login search share sharing social related recommended widget toolbar pagination pager copyright legal contentinfo complementary".split()),
    HEADER: frozenset(("header",)),
}
NEGATED = frozenset("with without no not has".split())  # "with-sidebar" tells of the page, not of the element
OWN_HEADER = frozenset("post entry article story content title".split())  # "post-header" holds the article's heading
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[-_]+")


def _judged(names: str) -> tuple[str, int]:
    """Generalized classes for the path, and the strongest mark among them."""
    classes = sorted(set(names.split()))
    mark = PLAIN
    for c in classes:
        parts = [p.rstrip("0123456789") for p in PARTS.split(c.lower())]
        if parts[0] in NEGATED:
            continue
        for kind, words in MARKS.items():
            if kind > mark and not words.isdisjoint(parts) and not (kind == HEADER and not OWN_HEADER.isdisjoint(parts)):
                mark = kind
    return ".".join(DIGITS.sub("#", c).replace(">", "_") for c in classes), mark


_judged_short = lru_cache(maxsize=4096)(_judged)


class Page:
    """Blocks of a page in a tree of containers and marked elements; paths are numbered, a parent before its children."""

    def __init__(self, source: str):
        self.parents, self.marks, self.articles, self.path = [-1], [PLAIN], [False], [0]  # by container
        self.path_names, self.path_parents = ["body"], [-1]
        self._path_ids: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        # tag, container, inside a control, inside a link, inside article or main, places of the innermost barrier and container
        self._stack: list[tuple[str, int, bool, bool, bool, int, int]] = [("body", 0, False, False, False, 0, 0)]
        self._open: dict[str, list[int]] = defaultdict(list)  # tag, its places on the stack
        self._text: list[tuple[str, bool]] = []
        self._parse(source)
        self._judge()

    def _flush(self) -> None:
        if self._text:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in self._text))).strip()
            if text:
                links = len(SPACE.sub(" ", html.unescape("".join(t for t, linked in self._text if linked))))
                self.blocks.append((self._stack[-1][1], text, links))
            self._text = []

    def _add(self, text: str) -> None:
        if text and not self._stack[-1][2]:
            self._text.append((text, self._stack[-1][3]))

    def _close(self, at: int) -> None:
        for i in range(len(self._stack) - 1, at - 1, -1):
            self._open[self._stack[i][0]].pop()
        del self._stack[at:]

    def _push(self, tag: str, container: int, control: bool, linked: bool, inside: bool) -> None:
        at, (barrier, fence) = len(self._stack), self._stack[-1][5:]
        self._open[tag].append(at)
        self._stack.append((tag, container, control, linked, inside, at if tag in BARRIERS else barrier, at if tag in CONTAINERS else fence))

    def _open_place(self, tag: str) -> int:
        """Place of the open element that a start tag closes; 0 if none."""
        if tag in ("tr", "td", "th"):
            closes, least = ("tr",) if tag == "tr" else ("td", "th"), (self._open["table"] or [0])[-1]
        else:
            closes, least = ("li",) if tag == "li" else ("dt", "dd") if tag in ("dt", "dd") else ("p",), self._stack[-1][5]
        place = max((self._open[t][-1] for t in closes if self._open[t]), default=0)
        return place if place >= least else 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in INLINE or tag in VOID:
            if tag in ("br", "hr", "img"):
                self._add(" ")
            if tag == "hr":
                self._flush()
            if tag not in VOID:
                _, container, control, linked, inside, _, _ = self._stack[-1]
                self._push(tag, container, control, linked or tag == "a", inside)
            return
        self._flush()
        if at := self._open_place(tag):
            self._close(at)
        _, container, control, linked, inside, _, _ = self._stack[-1]
        names = " ".join(m[2] or m[3] or m[4] or "" for m in CLASS.finditer(attributes)) if attributes else ""
        general, mark = (_judged_short if len(names) < 200 else _judged)(names) if names else ("", PLAIN)
        if tag in ARTICLE:
            mark = COMMENT if mark == COMMENT and tag == "article" else PLAIN
        elif tag in FIRM_TAGS:
            mark = FIRM
        elif tag in SOFT_TAGS:
            mark = max(mark, SOFT)
        elif tag == "header":
            mark = max(mark, HEADER)
        if mark == HEADER and inside:
            mark = PLAIN
        if tag in CONTAINERS or mark:
            name = f"{tag}.{general}" if general else tag
            key = self.path[container], name
            if key not in self._path_ids:
                self._path_ids[key] = len(self.path_names)
                self.path_names.append(name)
                self.path_parents.append(key[0])
            self.path.append(self._path_ids[key])
            self.parents.append(container)
            self.marks.append(mark)
            self.articles.append(tag in ARTICLE and not mark)
            container = len(self.parents) - 1
        self._push(tag, container, control or tag in CONTROLS, linked, inside or tag in ARTICLE)

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self._open[tag]:
            place = self._open[tag][-1]
            if tag not in INLINE or place > self._stack[-1][6]:
                self._close(place)

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        endless: set[str] = set()
        while at < n:
            m = MARKUP.search(source, at)
            if not m:
                break
            self._add(source[at:m.start()])
            at = m.end()
            tag, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
            elif tag in SELF_CLOSED and attributes.endswith("/"):
                continue
            elif tag in RAW:
                if tag not in endless and (end := RAW_END[tag].search(source, at)):
                    at = end.end()
                elif tag in ("svg", "object", "canvas"):  # without an end tag they swallow nothing
                    endless.add(tag)
                else:
                    at = n
            else:
                self._start(tag, attributes)
        self._add(source[at:])
        self._flush()

    def _judge(self) -> None:
        """``anchor``: the container that keeps a container's text, itself unless dropped.

        Text in dropped elements counts as boilerplate of the container around them.
        """
        n = len(self.parents)
        good, count = [0] * n, [0] * n
        for container, text, linked in self.blocks:
            good[container] += max(0, len(text) - 2 * linked)
            count[container] += 1
        region = [0] * n  # the innermost marked element at or above
        for v in range(1, n):
            region[v] = v if self.marks[v] else region[self.parents[v]]
        total, blocks, core, own = good[:], count, [0] * n, [0] * n
        inner: dict[int, list[int]] = defaultdict(list)
        for v in range(n - 1, -1, -1):
            own[region[v]] += good[v]
            if self.articles[v]:
                core[v] = max(core[v], total[v])
            if v:
                up = self.parents[v]
                core[up] = max(core[up], core[v])
                if self.marks[v] < COMMENT:
                    total[up] += total[v]
                    blocks[up] += blocks[v]
                if self.marks[v]:
                    inner[region[up]].append(v)
        kept, plain = {0}, own[0]
        waiting = [(-total[v], v) for v in inner[0]]
        heapq.heapify(waiting)
        while waiting:
            _, v = heapq.heappop(waiting)
            if self.marks[v] >= COMMENT:
                wraps = 2 * core[v] > total[0] + total[v]
            else:
                wraps = core[v] > 0 and 4 * core[v] >= total[0] or (
                    blocks[v] >= WRAPPER_BLOCKS and total[v] >= WRAPPER_TEXT and total[v] > WRAPPER_SHARE * plain and 2 * total[v] > total[0])
            if wraps:
                kept.add(v)
                plain += own[v]
                for w in inner[v]:
                    heapq.heappush(waiting, (-total[w], w))
        self.anchor = [0] * n
        for v in range(1, n):
            self.anchor[v] = v if region[v] in kept else self.anchor[self.parents[v]]

    def path_text(self, path: int) -> str:
        names = []
        while path >= 0:
            names.append(self.path_names[path])
            path = self.path_parents[path]
        return ">".join(reversed(names))

    def find(self, text: str) -> int | None:
        """Number of a path given as text; none if the page has none such."""
        path: int | None = 0
        for name in text.split(">")[1:]:
            path = self._path_ids.get((path, name))
            if path is None:
                return None
        return path

    def measures(self) -> tuple[list[int], list[int], list[int]]:
        """Per path, of all its containers with their descendants: text without links, text in links, dropped text."""
        good, links, dropped = ([0] * len(self.path_names) for _ in range(3))
        for container, text, linked in self.blocks:
            kept = self.anchor[container]
            if kept == container:
                good[self.path[container]] += max(0, len(text) - 2 * linked)
                links[self.path[container]] += linked
            else:
                dropped[self.path[kept]] += len(text)
        for path in range(len(self.path_names) - 1, 0, -1):
            for of in (good, links, dropped):
                of[self.path_parents[path]] += of[path]
        return good, links, dropped

    def best(self) -> int | None:
        """Path of the outermost container that still holds the article; none in a page without text.

        From the innermost path with more than half of the page's text without links, go up
        while that gains more text than links, and outside of article and main also more than
        dropped matter; never up from the outermost article or main.
        """
        good, links, dropped = self.measures()
        if not good[0]:
            return 0 if any(self.anchor[c] == c for c, _, _ in self.blocks) else None
        core = max(p for p in range(len(good)) if 2 * good[p] > good[0])  # these lie inside one another
        semantic = [False] * len(good)
        for p in range(1, len(good)):
            semantic[p] = self.path_names[p].partition(".")[0] in ARTICLE or semantic[self.path_parents[p]]
        at = out = core
        while (up := self.path_parents[at]) >= 0 and not (semantic[at] and not semantic[up]):
            gain = good[up] - good[at]
            loss = links[up] - links[at] + (0 if semantic[up] else dropped[up] - dropped[at])
            if loss > gain:
                break
            at = up
            if gain or semantic[up]:
                out = up
        return out

    def vote(self) -> str | None:
        own = self.best()
        return None if own is None else self.path_text(own)

    def _blocks_of(self, path: int) -> list[tuple[str, int]]:
        inside = [False] * len(self.parents)
        for v, parent in enumerate(self.parents):
            inside[v] = self.path[v] == path or (parent >= 0 and inside[parent])
        return [(text, links) for v, text, links in self.blocks if inside[v] and self.anchor[v] == v]

    def article(self, path: str | None) -> list[str]:
        """Blocks of the host's path, or of the page's own if the host's holds too little of it."""
        own = self.best()
        if own is None:
            return []
        chosen = self._blocks_of(own)
        if path and (at := self.find(path)) is not None and at != own:
            found = self._blocks_of(at)
            if found and _plain(found) >= COVERED * _plain(chosen):
                chosen = found
        return [text for text, _ in chosen]


def _plain(blocks: list[tuple[str, int]]) -> int:
    """Text without links."""
    return sum(max(0, len(text) - 2 * links) for text, links in blocks)


def page_votes(pages: DataFrame, host: str = "host", source: str = "html") -> DataFrame:
    """(host, path, votes): each page votes for the outermost container that holds its article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], int] = defaultdict(int)
            for h, s in zip(flat.pylist(batch, host), flat.pylist(batch, source)):
                if s and (path := Page(s).vote()):
                    votes[h, path] += 1
            keys = list(votes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(votes.values()), pa.int64())],
                names=["host", "path", "votes"])

    return pages.select(host, source).mapInArrow(run, "host string, path string, votes long")


def host_paths(pages: DataFrame) -> DataFrame:
    """Winning path per host."""
    sums = page_votes(pages).groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("votes", F.length("path"), _reversed("path"))).alias("path"))


def _reversed(column: str):
    """Orders the alphabetically first text last, so that it wins a maximum."""
    return F.translate(column, "".join(map(chr, range(32, 127))), "".join(map(chr, range(126, 31, -1))))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Page, URL, main text and its length in code points."""
    host, _ = host_and_path(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), host.alias("host"))
    winners = host_paths(own).select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for s, path in zip(flat.pylist(batch, "html"), flat.pylist(batch, "path")):
                texts.append("\n\n".join(Page(s).article(path) if s else []))
            yield pa.RecordBatch.from_arrays(
                [flat.column(batch, "page_id"), flat.column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = own.schema["page_id"].dataType.simpleString()
    return salted.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "path").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")


@query("op10_host_consensus")
def op10_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
