"""Main text of web pages by removal of site templates.

A first pass over the pages hashes each element subtree (tag names and words, no attributes) and
names its slot: the tags, classes and places on its path. Both are counted per host with partial aggregation,
over the different texts around them, so that copies of a page count once. Template is

- a slot that recurs with contents that recur: at most ``SINGLE`` of its occurrences, of
  ``MIN_PAGES`` at least, have a content of their own (a menu or an advert that alternates; its rare
  contents go too, but never most of a page). Hosts of under ``MIN_HOST`` pages are judged as one
  host too;
- a subtree of one content among ``MIN_PAGES`` different texts or more; inside the article, among
  half of the host's texts too, for a line that some articles share is their text.

The text around is told by its least hash of three words: the article's, if there is one. A subtree
with more than half of a page's words counts as one occurrence, whatever its copies. Inside the article containers count, lists, and
paragraphs and items of ``MIN_BLOCK_WORDS`` words; headings and table cells recur by chance.

A second pass parses again and deletes the template subtrees, wherever they are. What a page says of
itself goes last: navigation, asides, footers, forms and elements named as adverts, notices, menus or
comments (``rules``). On a host of under ``MIN_PAGES`` pages, where nothing can recur, only the article
(or main) is text if the page marks it.

Parsing is linear in the page, whatever its nesting or broken quotes, in Arrow batches; no group of
pages is gathered, and no text is written or shuffled between the passes while all templates together
are at most ``MAX_BROADCAST`` (of 8 bytes, beside a host's name): then each host's list is broadcast.
Else the subtrees of the pages meet the templates by (host, hash), and each page gets only those it
has.

Defined cases: null or empty html gives empty text; pages without a host share one; unclosed and
misnested tags are closed by their parents' ends; a quote that never closes is an ordinary character;
equal rows get equal texts; columns other than page_id, url and html are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import guarded, table, written

MIN_PAGES = 5
#: Share of a slot's occurrences whose content came up once, at most, for a template slot.
SINGLE = 0.25
#: Pages of a host from which its slots are judged by it alone.
MIN_HOST = 50
#: Words of a paragraph or list item inside the article that may be template.
MIN_BLOCK_WORDS = 4
MAX_BROADCAST_HOSTS = 10_000
#: Templates of a host, and of all, that may go to each page as a list.
MAX_LIST = 1_000
MAX_BROADCAST = 500_000
#: Hash of no text.
NOTHING = 2**64 - 1

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What may end a tag, or begin a quoted value in it.
STOP = re.compile(r"[>\"']")
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Element names by their role in HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
GONE = frozenset("head nav footer aside form button select menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BLOCKS = frozenset("p li blockquote".split())
PEERS = {"li": ("li",), "option": ("option",), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr figcaption article main html body".split())
CLOSES_P = frozenset("p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 blockquote pre hr address figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
NAMED = frozenset(
    "nav navbar navigation menu header masthead footer sidebar cookie cookies consent gdpr banner notice notification alert advert adverts advertisement"
    " ad ads adbox adsense sponsor sponsored promo promotion share sharing social comment comments disqus respond reply replies subscribe newsletter"
    " signup login related recommended breadcrumb breadcrumbs popup modal overlay toolbar widget pagination".split()
)


def _named(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and not NAMED.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


class Element:
    __slots__ = ("tag", "state", "slot", "gone", "inside", "first", "words", "blocks", "kids")

    def __init__(self, tag, state, slot, gone, inside, first, words, blocks):
        self.tag, self.state, self.slot, self.gone, self.inside = tag, state, slot, gone, inside
        self.first, self.words, self.blocks, self.kids = first, words, blocks, {}


class Tags:
    """The tags of a page in order, each found in time linear in what it spans."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.unclosed: set[str] = set()

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag or "" for a comment, whether it is an end tag, attributes) of the next tag, or None."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(source), "", False, ""
            if start > self.last:
                return None
            if source[start + 1 : start + 2] in ("!", "?"):
                return start, source.index(">", start) + 1, "", False, ""
            if m := OPEN.match(source, start):
                end = self._end(m.end())
                return start, end + 1, m[2].lower(), bool(m[1]), source[m.end() : end]
            at = start + 1
        return None

    def _end(self, begin: int) -> int:
        """Where a tag's ``>`` is; one inside quotes only counts if no other follows."""
        at = begin
        while m := STOP.search(self.source, at):
            if m[0] == ">":
                return m.start()
            close = -1 if m[0] in self.unclosed else self.source.find(m[0], m.end())
            if close < 0:
                self.unclosed.add(m[0])
            at = close + 1 if close >= 0 else m.end()
        return self.source.index(">", begin)

    def after_raw(self, tag: str, at: int) -> int:
        """The place after an element of raw text, whose end tag may be missing."""
        m = None if tag in self.unclosed else re.compile(f"</{tag}[^>]*>?", re.I).search(self.source, at)
        if m:
            return m.end()
        self.unclosed.add(tag)
        return len(self.source) if tag in ("script", "style") else at


def _least(text: str) -> int:
    """The least hash of three words in a row; NOTHING of a blank text."""
    words = text.split()
    if len(words) < 3:
        return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) if words else NOTHING
    return min(
        xxhash.xxh64_intdigest(f"{a} {b} {c}".encode("utf-8", "surrogatepass")) for a, b, c in zip(words, words[1:], words[2:], strict=False)
    )


class Page:
    """A parsed page: texts in order as [text, inside the article, gone by its own names], and the subtrees around them."""

    def __init__(self, source: str | None):
        self.texts: list[tuple[str, bool, bool]] = []
        #: (slot, content, first text, end, words) of each subtree that may be template; slots inside the article are odd.
        self.subtrees: list[tuple[int, int, int, int, int]] = []
        self.articles = 0
        self.words = 0
        self._parse(source or "")

    def _say(self, s: str) -> None:
        top = self.stack[-1]
        if s and top.tag != "head":
            self.texts.append((s, top.inside, top.gone))
            if words := s.split():
                self.words += len(words)
                top.state.update(" ".join(words).encode("utf-8", "surrogatepass"))

    def _open(self, tag: str, attributes: str) -> None:
        up = self.stack[-1]
        article = tag in ("article", "main")
        gone = up.gone or tag in GONE or (tag == "header" and not up.inside) or (tag not in ("html", "body") and not article and _named(attributes))
        inside = (up.inside or article) and not gone
        self.articles += article and not gone
        inline = tag in INLINE
        state, slot = up.state, up.slot
        if not inline:
            m = CLASS.search(attributes)
            names = sorted((m[1] or m[2] or m[3] or "").lower().split()) if m else []
            if tag not in PARAGRAPHS:
                up.kids[tag] = up.kids.get(tag, 0) + 1
            state, slot = xxhash.xxh64(tag.encode("utf-8", "surrogatepass")), f"{up.slot:x} {tag} {up.kids.get(tag, 0)} {' '.join(names)}"
            slot = xxhash.xxh64_intdigest(slot.encode("utf-8", "surrogatepass"))
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, state, slot, gone, inside, len(self.texts), self.words, up.blocks + (not inline)))

    def _close(self) -> None:
        e = self.stack.pop()
        self.depths[e.tag].pop()
        if e.tag in INLINE:
            return
        words = self.words - e.words
        digest = e.state.digest()
        self.stack[-1].state.update(digest)
        if words and e.tag not in ("html", "body", "article", "main") and (
            not e.inside or e.tag not in PARAGRAPHS or e.tag in BLOCKS and words >= MIN_BLOCK_WORDS
        ):
            h = xxhash.xxh64_intdigest(digest, seed=e.slot)
            self.subtrees.append((e.slot >> 2 << 1 | e.inside, h >> 2 << 1 | e.inside, e.first, len(self.texts), words))
        self._say(" ")

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._close()

    def _deepest(self, *tags: str) -> int:
        """The depth of the innermost open element of some tags, 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def _parse(self, source: str) -> None:
        self.stack = [Element("", xxhash.xxh64(), 0, False, False, 0, 0, 0)]
        self.depths: dict[str, list[int]] = {}
        tags, at = Tags(source), 0
        while found := tags.next(at):
            start, end, tag, ends, attributes = found
            self._say(source[at:start])
            at = end
            if not tag:
                continue
            depth = self._deepest(tag)
            if ends:
                if depth and not (tag in INLINE and self.stack[-1].blocks > self.stack[depth].blocks):
                    self._close_to(depth)
                elif not depth and tag in ("br", "p"):
                    self._say(" ")
                continue
            if tag in RAW:
                at = tags.after_raw(tag, at)
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    self._say(" ")
                continue
            if tag in CLOSES_P:
                depth = self._deepest("p")
                if depth and self.stack[-1].blocks == self.stack[depth].blocks:
                    self._close_to(depth)
            elif tag in PEERS:
                depth = self._deepest(*PEERS[tag], "ul", "ol", "dl", "table")
                if depth and self.stack[depth].tag in PEERS[tag]:
                    self._close_to(depth)
            if tag not in INLINE:
                self._say(" ")
            if not attributes.endswith("/") or tag not in INLINE:
                self._open(tag, attributes)
        self._say(source[at:])
        self._close_to(1)
        del self.stack, self.depths

    def counted(self) -> list[tuple[int, int, int]]:
        """(slot, content, least hash of the text around) of the subtrees that count."""
        own = [_least(t) if inside or not self.articles else NOTHING for t, inside, _ in self.texts]
        before = [NOTHING, *accumulate(own, min)]
        after = [NOTHING, *accumulate(reversed(own), min)][::-1]
        # What is most of its page, or all, comes up once as far as can be told.
        return [(g, h, 0 if 2 * words > self.words or (s := min(before[i], after[j])) == NOTHING else s) for g, h, i, j, words in self.subtrees]

    def text(self, template: set[int] | frozenset[int] = frozenset(), counted: bool = False, rules: bool = True) -> str:
        """Text without template subtrees, character references decoded and white space collapsed."""
        off = [0] * (len(self.texts) + 1)
        for g, h, first, end, words in self.subtrees if template else ():
            if h in template or g in template and 2 * words <= self.words:
                off[first] += 1
                off[end] -= 1
        only = rules and self.articles and not counted
        kept = (t for (t, inside, gone), n in zip(self.texts, accumulate(off)) if not n and not (rules and gone) and (inside or not only))
        return " ".join(entities.unescape("".join(kept)).split())


def text_without(source: str | None, template: set[int] | frozenset[int] = frozenset(), counted: bool = False, rules: bool = True) -> str:
    """The page's text without template subtrees; ``rules`` off: by them alone."""
    return Page(source).text(template, counted, rules)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counted subtrees of each page."""
    kind = pa.list_(pa.struct([("g", pa.int64()), ("h", pa.int64()), ("s", pa.int64())]))
    for b in batches:
        found = [[{"g": g, "h": h, "s": s >> 1} for g, h, s in Page(x).counted()] for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["host", "found"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots and contents of each page."""
    for b in batches:
        own = [sorted({x for t in Page(p).subtrees for x in t[:2]}) for p in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64())), *b.columns[2:]], names=["host", "own", "k1", "k2"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
        out = pa.array([text_without(h, set(gone or ()), gone is not None) for h, gone in pages], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], names=["page_id", "url", "text"])


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, h): template slots and contents of each host of ``MIN_PAGES`` pages or more; null h is the host's own row."""
    each = pages.select(host_of().alias("host"), "html").mapInArrow(_hashed, "host string, found array<struct<g:bigint,h:bigint,s:bigint>>")
    # A row without hashes counts the page itself.
    none = F.lit(None).cast("struct<g:bigint,h:bigint,s:bigint>")
    rows = each.select("host", F.inline(F.array_append("found", none)))
    texts = rows.groupBy("host", "g", "h", "s").agg(F.count("*").alias("pages"))
    counts = texts.groupBy("host", "g", "h").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"))
    counts = written(counts, "counts")
    hosts = counts.where("g is null").where(F.col("pages") >= MIN_PAGES).select("host", "pages")
    hosts = written(hosts, "hosts")
    known = guarded(hosts, hosts.count(), MAX_BROADCAST_HOSTS)
    contents = counts.where("g is not null").drop("pages")
    often = contents.where(F.col("n") >= MIN_PAGES).join(known.withColumnRenamed("pages", "all"), "host")
    often = often.where((F.col("h") % 2 == 0) | (2 * F.col("n") >= F.col("all"))).select("host", "h")
    sums = F.sum("n").alias("p"), F.count_if(F.col("n") == 1).alias("once")
    few = lambda df: df.where((F.col("p") >= MIN_PAGES) & (F.col("once") <= SINGLE * F.col("p")))
    slots = contents.groupBy("host", "g").agg(*sums).join(known, "host")
    own = few(slots).select("host", F.col("g").alias("h"))
    small = contents.join(known, "host").where(F.col("pages") < MIN_HOST)
    pooled = small.groupBy("g", "h").agg(F.sum("n").alias("n")).groupBy("g").agg(*sums)
    pooled = slots.where(F.col("pages") < MIN_HOST).select("host", "g").join(few(pooled).select("g"), "g").select("host", F.col("g").alias("h"))
    return own.unionByName(pooled).unionByName(often).unionByName(hosts.select("host", F.lit(None).cast("long").alias("h"))).distinct()


def _with_lists(rows: DataFrame, found: DataFrame, hosts: int) -> DataFrame:
    """Each page with the list of its host."""
    gone = found.groupBy("host").agg(F.collect_set("h").alias("gone")).withColumnRenamed("host", "_host")
    return rows.join(guarded(gone, hosts, MAX_BROADCAST_HOSTS), F.col("_own") == F.col("_host"), "left")


def _with_own(rows: DataFrame, found: DataFrame, hosts: int) -> DataFrame:
    """Each page with the templates that it has, by a join of subtrees; a page is named by 128 bits of its row."""
    name = [F.xxhash64("page_id", "url", "html").alias("k1"), F.xxhash64(F.lit(1), "html", "url", "page_id").alias("k2")]
    each = rows.select("_own", "html", *name).mapInArrow(_owned, "host string, own array<bigint>, k1 bigint, k2 bigint")
    blocks = written(each.select("host", "k1", "k2", F.explode("own").alias("h")), "blocks")
    own = blocks.join(found.where("h is not null"), ["host", "h"]).groupBy("k1", "k2").agg(F.collect_set("h").alias("_gone"))
    counted = guarded(found.where("h is null").select(F.col("host").alias("_host")), hosts, MAX_BROADCAST_HOSTS)
    rows = rows.select("*", *name).join(own, ["k1", "k2"], "left").join(counted, F.col("_own") == F.col("_host"), "left")
    return rows.withColumn("gone", F.when(F.col("_host").isNotNull(), F.coalesce("_gone", F.array().cast("array<bigint>"))))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each page row."""
    kind = pages.schema["page_id"].dataType.simpleString()
    found = written(templates(pages), "templates")
    lists = found.groupBy("host").agg(F.count("h").alias("n"))
    hosts, longest, total = lists.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    rows = pages.select("page_id", "url", "html", host_of().alias("_own"))
    short = hosts <= MAX_BROADCAST_HOSTS and (longest or 0) <= MAX_LIST and (total or 0) <= MAX_BROADCAST
    rows = _with_lists(rows, found, hosts) if short else _with_own(rows, found, hosts)
    out = rows.select("page_id", "url", "html", "gone").mapInArrow(_texts, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
