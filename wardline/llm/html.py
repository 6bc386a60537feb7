"""Main-text extraction by a consensus of each host's pages.

Every page's containers are scored, and the page votes for the generalised path (tags, classes with digits folded) of
its best one. Votes are counted per host with partial sums; each page is then extracted anew from the containers on
its host's winning path, and from its own best container where it has none there.

Defined results: a null html is an empty page with empty text; a null url or one without a host votes with all of its
kind; votes that tie go to the path first in order; repeated rows vote and come out each; a page cut anywhere is read as
far as it goes; nesting of any depth is read in linear time; an element that is never closed keeps its text unless it holds
none by its kind; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stored, table

#: The most that winning paths may take, by their own sizes, to be sent to every executor.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article main section div body td blockquote html".split())
#: Elements whose content is no text of the page; those of the second kind only where they are closed.
_RAW = frozenset("script style noscript textarea iframe".split())
_CLOSED_RAW = frozenset("template select svg object canvas".split())
#: Start tags that end an open element of the first kind, up to the second.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Elements of what surrounds an article, and words of classes, ids and roles that name it outside an article: such as
#: speak for themselves, and such as an article's own parts may have too.
_ASIDE_TAGS = frozenset("nav aside footer form head button dialog menu script style noscript template iframe select".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar "
    "comment comments reply replies disqus cookie cookies consent gdpr popup modal overlay subscribe newsletter signup login share sharing recommended recommendations widget pagination pager".split()
)
_DOUBTFUL_WORDS = frozenset("banner promotion side foot header discussion notice notification alert social related form search skip copyright legal".split())
#: Inside an article only names made of these words alone speak for themselves, with plain words of layout.
_FOREIGN_WORDS = frozenset("ad ads adv advert advertisement adverts advertising sponsor sponsored promo comment comments disqus replies cookie cookies consent gdpr popup modal overlay subscribe newsletter signup login".split())
_LAYOUT_WORDS = frozenset("area bar block body box card container content form group holder inner item items list outer panel row section slot stack thread top bottom unit wrap wrapper zone user reader".split())
#: Of parts named by these, a few words make a notice; of other doubtful parts, words that form no sentence a label.
_NOTICE_WORDS = frozenset("notice notification banner alert promotion social form search skip copyright legal".split())
#: What a container begins or ends with under one of these names is not of it.
_EDGE_WORDS = frozenset("nav navbar navigation breadcrumb breadcrumbs sidebar aside footer foot masthead topbar toolbar side header banner".split())
_FEW = 12
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f:;]")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


class Element:
    """``doubt``: what its name says inside an article, nothing, a doubt or a notice; ``around``: the block that a button
    inside an article stands in; ``link``: in an anchor; ``article`` and ``main``: in an article, in one or in main. ``skip``
    is for the whole part, by its parent's, its ``own`` or its names' word, ``named``, which holds where no article is;
    ``edge``: named as a container's first or last part may be."""

    __slots__ = ("around", "article", "doubt", "edge", "link", "linked", "main", "named", "number", "own", "parent", "path", "signs", "size", "skip", "tag", "words")

    def __init__(self, tag: str, parent: Element | None, number: int, path: int):
        self.tag, self.parent, self.number, self.path = tag, parent, number, path
        self.size = self.linked = self.words = self.signs = self.doubt = 0
        self.own = self.named = self.edge = False
        self.skip = parent is not None and parent.skip
        self.around: Element | None = None
        self.link = tag == "a" or parent is not None and parent.link
        self.main = parent is not None and (parent.main or parent.tag in ("article", "main"))
        self.article = parent is not None and (parent.article or parent.tag == "article")


class Page:
    """Elements in order and text runs with the element each stands in; a run of None marks a block's bound. Time and memory
    are linear in the source: open elements are kept by tag, paths as (path of the parent, step)."""

    def __init__(self, source: str):
        self.steps: dict[tuple[int, str], int] = {}
        self.by_path: list[tuple[int, str]] = [(0, "")]
        self.elements: list[Element] = [Element("", None, 0, 0)]
        self.runs: list[tuple[Element, str | None]] = []
        self.stack = [self.elements[0]]
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        unclosed: set[str] = set()
        at = 0
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag in _RAW or tag in _CLOSED_RAW and not attributes.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif tag in _RAW:
                    at = len(source)
                else:
                    unclosed.add(tag)
                    self._start(tag, attributes)
            else:
                self._start(tag, attributes)
        if at < len(source):
            self._text(source[at:])
        self._weigh()

    def _text(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.runs.append((self.stack[-1], text))

    def _last(self, tags) -> int:
        """Depth of the innermost open element of some tags; 0 where none is open."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _pop(self, depth: int) -> None:
        broken, parent = False, self.stack[depth].parent
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.open[e.tag].pop()
            if e.tag in _BLOCK:
                self.blocks.pop()
                broken = True
        if broken:
            self.runs.append((parent, None))

    def _close(self, tag: str) -> None:
        depth = self._last((tag,))
        # an inline end tag does not reach out of its block
        if depth and (tag in _BLOCK or not self.blocks or depth > self.blocks[-1]):
            self._pop(depth)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.runs.append((self.stack[-1], "\n"))
            return
        if tag in _BLOCK and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self._pop(self.blocks[-1])
        if tag in _ENDS:
            ended, bound = _ENDS[tag]
            while (depth := self._last(ended)) > self._last(bound):
                self._pop(depth)
                if tag != "tr":
                    break
        if tag in _BLOCK:
            self.runs.append((self.stack[-1], None))
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            return
        parent = self.stack[-1]
        e = Element(tag, parent, len(self.elements), 0)
        classes = ids = ""
        if "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values)
                if name.lower() == "class":
                    classes = value
                ids += f" {value}" if name.lower() == "role" or name.lower() == "id" and not e.main else ""
        step = tag + "".join(f".{c}" for c in sorted({re.sub(r"\d+", "#", c) for c in classes.split()}))
        path = self.steps.get((parent.path, step))
        if path is None:
            path = self.steps[parent.path, step] = len(self.by_path)
            self.by_path.append((parent.path, step))
        e.path = path
        self._judge(e, f"{classes} {ids}".lower().split())
        self.elements.append(e)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def _judge(self, e: Element, names: list[str]) -> None:
        """What an element's tag and names say of it. In an article a name that says more than one of the foreign words is a
        doubt, which its text settles."""
        tag = e.tag
        if tag == "button" and e.article and self.blocks and (block := self.stack[self.blocks[-1]]).article:
            e.around = block
        else:
            e.own = tag in _ASIDE_TAGS or tag == "header" and not e.main
        if names and tag not in ("html", "body", "article", "main") and not (tag in _HEADING and e.main):
            words = [set(_SPLIT.split(n)) - {""} for n in names]
            every = set().union(*words)
            foreign = any(not _FOREIGN_WORDS.isdisjoint(w) and w <= _FOREIGN_WORDS | _LAYOUT_WORDS | _ASIDE_WORDS | _DOUBTFUL_WORDS for w in words)
            if not every.isdisjoint(_ASIDE_WORDS | _DOUBTFUL_WORDS):
                e.doubt = 2 if any(not _NOTICE_WORDS.isdisjoint(w) and w <= _NOTICE_WORDS | _LAYOUT_WORDS for w in words) else 1
            if e.article or e.main and every.isdisjoint(_ASIDE_WORDS):
                e.own |= foreign
            elif e.doubt:
                e.named, e.edge = True, not every.isdisjoint(_EDGE_WORDS)
                e.own |= foreign
        e.skip |= e.own or e.named

    def _weigh(self) -> None:
        """Signs of each element's text, inside links and out of them, summed from the leaves up. A doubtful part of an article
        is surroundings if most of it is links, or if its few words form no sentence or are a notice's; a button in a block
        of few other words is a control. Then sizes are summed again without them."""
        for e in self.elements:
            e.size = e.linked = e.words = e.signs = 0
        for where, text in self.runs:
            if text is not None and not where.skip:
                parts = text.split()
                where.words += len(parts)
                n = sum(map(len, parts))
                where.linked += n if where.link else 0
                where.size += 0 if where.link else n
                where.signs += _SENTENCE.search(text) is not None
        own = [(e.size, e.linked, e.words, e.signs) for e in self.elements]
        self._sum(own)
        pressed: dict[int, int] = {}
        for e in self.elements:
            if e.around is not None and not e.skip:
                pressed[e.around.number] = pressed.get(e.around.number, 0) + e.words
        doubted = False
        for e in self.elements[1:]:
            e.skip |= e.parent.skip
            labels = e.words < _FEW and (e.doubt == 2 or not e.signs)
            if not e.skip and (e.doubt and (e.linked > e.size or labels) or e.around is not None and e.around.words - pressed[e.around.number] < 4):
                e.own = e.skip = doubted = True
        if doubted:
            self._sum([(0, 0, 0, 0) if e.skip else x for e, x in zip(self.elements, own, strict=True)])

    def _sum(self, own: list[tuple[int, int, int, int]]) -> None:
        for e, (size, linked, words, signs) in zip(self.elements, own, strict=True):
            e.size, e.linked, e.words, e.signs = size, linked, words, signs
        for e in reversed(self.elements[1:]):
            e.parent.size += e.size
            e.parent.linked += e.linked
            e.parent.words += e.words
            e.parent.signs += e.signs

    def best(self) -> Element:
        """The deepest container that holds most of the page's text outside of surroundings and links."""
        children: dict[int, list[Element]] = {}
        for e in self.elements[1:]:
            children.setdefault(e.parent.number, []).append(e)
        root = self.elements[0]
        marked = [e for e in self.elements if e.tag in ("article", "main") and not e.skip and e.size * 5 >= root.size * 2 and e.size]
        e = max(marked, key=lambda x: (x.size, x.tag == "article", x.number)) if marked else root
        while True:
            inner = [c for c in children.get(e.number, ()) if c.tag in _BLOCK and c.tag != "p" and c.size * 5 >= e.size * 4 and c.size and not c.skip]
            if not inner or marked and e.tag == "article":
                return e
            e = inner[0]
            if e.tag not in _CONTAINER:
                return e.parent

    def settle(self, chosen: list[Element]) -> None:
        """Inside chosen containers that are neither the whole page nor an article, names are doubts as in an article, but for
        what a container begins or ends with."""
        inside, ends = {e.number for e in chosen if e.tag in _CONTAINER and e.tag not in ("html", "body")}, {}
        for e in self.elements[1:]:
            if e.parent.number in inside:
                first, _ = ends.get(e.parent.number, (e.number, 0))
                ends[e.parent.number] = first, e.number
                inside.add(e.number)
        roots = {e.number for e in chosen}
        again = [e for e in self.elements[1:] if e.named and e.number in inside and not (e.edge and e.parent.number in roots and e.number in ends[e.parent.number])]
        if again:
            for e in again:
                e.named = False
            for e in self.elements[1:]:
                e.skip = e.parent.skip or e.own or e.named
            self._weigh()

    def path_of(self, e: Element) -> str:
        steps, at = [], e.path
        while at:
            at, step = self.by_path[at]
            steps.append(step)
        return "/".join(["", *reversed(steps)])

    def text(self, chosen: list[Element]) -> str:
        """Blocks of the chosen elements in page order."""
        inside = [False] * len(self.elements)
        for e in chosen:
            inside[e.number] = True
        for e in self.elements[1:]:
            inside[e.number] |= inside[e.parent.number]
        blocks: list[str] = []
        held: list[str] = []

        def flush() -> None:
            if held and (block := " ".join("".join(held).split())):
                blocks.append(block)
            held.clear()

        for where, text in self.runs:
            if text is None:
                flush()
            elif not where.skip and inside[where.number]:
                held.append(text)
        flush()
        return "\n\n".join(blocks)

    def at(self, path: str) -> list[Element]:
        number = 0
        for step in path.split("/")[1:]:
            number = self.steps.get((number, step), -1)
            if number < 0:
                return []
        return [e for e in self.elements if not e.skip and e.path == number]


def vote(source: str) -> str:
    if not source:
        return ""
    page = Page(source)
    return page.path_of(page.best())


def extract(source: str, path: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    for chosen in (page.at(path) if path else [], [page.best()]):
        if chosen:
            page.settle(chosen)
            if text := page.text(chosen):
                return text
    return ""


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path most of a host's pages vote for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([vote(h or "") for h in b.column(1).to_pylist()], pa.string())], ["host", "path"])

    votes = pages.select(host(url_col).alias("host"), pages[html_col].cast("string").alias("html")).mapInArrow(run, "host string, path string")
    counts = votes.where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    return counts.groupBy("host").agg(F.min_by("path", F.struct((-F.col("n")).alias("n"), "path")).alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): every page's main text by its host's winning path."""
    winners = stored(consensus(pages, url_col, html_col), "winners")
    src = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), host(url_col).alias("host"), pages[html_col].cast("string").alias("html"))
    if winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        joined = src.join(F.broadcast(winners), "host", "left")
    else:  # a host's pages are dealt over all parts
        n = parts(pages.sparkSession)
        each = winners.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"))
        joined = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(n)).cast("int")).join(each, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h or "", p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string")


def op4_query(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
