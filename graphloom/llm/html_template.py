"""Main text of pages by the template that pages of one host share.

A page is a sequence of tokens: start and end tags, and the words that stand
outside an article or main element, each with the path of open elements. Tokens
of a host that occur equally often in each of its pages (one occurrence vector)
form an equivalence class. The vectors are compared by their hash, which
is put together over pages before the shuffle. A class is valid if its tokens keep one
order in every page and its spans don't cross those of a greater class. The
valid classes nest into the host's template, and what stands between two
neighbouring tokens of a class is a slot.

Slots are judged over all pages of the host. A slot holds an article's text if
text of an article or main element in it isn't all links on some page. Where a
page has such slots, its article elements without any are teasers or menus and
go; links elsewhere in the article stay, such as a linked title. Where it has
none, its article elements stay as they are. For pages without such an element,
every slot whose text isn't all links is extracted. A last check looks at each
block of an extracted slot on its own: blocks inside menus, headers, footers,
asides, forms, scripts, styles, or elements whose class, id or role says advert,
notice, comments and the like, aren't main text, nor are blocks outside the
article on pages that have one. On pages without one, blocks made of template
words alone go too. Pages whose host has fewer than MIN_PAGES pages keep links
and template words, since nothing can be told apart.

Null pages are empty; an empty page, or one with no text left, gives an empty
text. Pages whose URL is null or has no host form a host of their own. Repeated
rows are pages of their own. Broken markup is read with implied ends of
elements; unclosed comments and scripts reach to the end. Very long pages are
one row and are read whole. Other columns are kept, whatever their names,
except for those named ``text`` and ``n_chars``, which are replaced.
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

from graphloom.llm.skew import hot_keys, salted_join
from graphloom.llm.store import Scratch, written
from graphloom.llm.textvec import arrow_limits, rounds
from graphloom.llm.url_filter import host_of

#: Hosts and their template tokens up to which they are broadcast (about 10 bytes each).
MOST_BROADCAST = 1_000_000
#: Pages of a host from which its constant words count as template, and the share of them that a template token is on.
MIN_PAGES, SHARE = 5, 0.5
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre script search section select style summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
MAIN = frozenset(["article", "main"])
#: Elements that hold no main text; ``header`` only outside an article.
FURNITURE = frozenset("head nav menu aside footer form dialog script style noscript template iframe svg canvas object audio video button select textarea xmp noembed noframes search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids: of adverts, notices, comments and teasers, and of a page's layout, which an article inside them overrides.
ALIEN = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox sponsor sponsored promo promos promotion notice notices cookie cookies consent gdpr "
    "comment comments commentlist disqus replies reply popup modal newsletter subscribe signup related recommended share sharing social widget".split()
)
LAYOUT = frozenset("sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer topbar toolbar pager pagination".split())
#: Layout outside an article, where these name its title; and words that make a name of layout one of what is beside it.
HEADS, BESIDE = frozenset(["header", "masthead", "banner"]), frozenset(["has", "no", "with", "without"])
#: An open element of these kinds ends where one of those begins.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "body": frozenset(["head"]),
}
#: Where the search for an element to end stops.
BARS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tbody": frozenset(["table"])}
CLOSES_P = BLOCK - frozenset("body head html script style title td th tr tbody thead tfoot caption option optgroup legend summary textarea select".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class _Open:
    """An open element: its path's hash, whether text in it is an article's, whether it is furniture (1 by layout, 2 for good), and its article's number."""

    __slots__ = ("article", "furniture", "main", "path", "tag")

    def __init__(self, tag: str, path: int, main: bool, furniture: int, article: int):
        self.tag, self.path, self.main, self.furniture, self.article = tag, path, main, furniture, article


class Page:
    """Tokens and blocks of one page. Blocks are (text, number of tokens before, in an article, furniture, all links, own tokens).

    ``articles`` has for each article element the number of the one around it, ``within`` for each block that of its innermost one; 0 is none.
    """

    def __init__(self, html: str):
        self.tokens: list[int] = []
        self.blocks: list[tuple[str, int, bool, bool, bool, int]] = []
        self.articles, self.within = [0], []
        self.open = [_Open("", 0, False, 0, 0)]
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.plain = False
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            to = html.find("<", at)
            if to < 0:
                to = size
            if to > at:
                self._say(html[at:to])
            if to == size:
                break
            at = self._markup(html, to)
        self._flush()

    def _say(self, piece: str) -> None:
        self.text.append(unescape(piece) if "&" in piece else piece)
        if not self.plain and not self.count.get("a") and not piece.isspace():
            self.plain = True

    def _markup(self, html: str, at: int) -> int:
        """Reads what starts with ``<`` at a place; the place after it."""
        following = html[at + 1 : at + 2]
        if following in ("!", "?") or (following == "/" and not html[at + 2 : at + 3].isalpha() and at + 2 < len(html)):
            if html.startswith("<!--", at):
                if html.startswith(("<!-->", "<!--->"), at):
                    return html.index(">", at) + 1
                end = html.find("-->", at + 4)
                return len(html) if end < 0 else end + 3
            end = html.find(">", at)
            return len(html) if end < 0 else end + 1
        if following != "/" and not (following.isascii() and following.isalpha()):
            self._say("<")
            return at + 1
        found = TAG.match(html, at) or LOOSE_TAG.match(html, at)
        if not found:
            return len(html)  # A tag that the page's end cuts off.
        tag = found[2].lower()
        if found[1]:
            self._end(tag)
            return found.end()
        self._start(tag, found[3])
        if tag not in RAW:
            return found.end()
        # Content that is no markup: to the element's own end tag.
        end = re.compile(rf"(?i)</{tag}(?=[\s/>])").search(html, found.end())
        if tag in ("title", "textarea"):
            self._say(html[found.end() : end.start() if end else len(html)])
        return end.start() if end else len(html)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            if tag in CLOSES_P:
                self._close("p", frozenset(["button", "table", "td", "th"]))
            for kind in ENDS.get(tag, ()):
                self._close(kind, BARS.get(tag, frozenset()))
        top = self.open[-1]
        named, role = "", ""
        if "=" in attributes:
            for kind, *values in ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                role = value.strip().lower() if kind.lower() == "role" else role
                named += " " + value if kind.lower() != "role" else ""
        path = _hash(f"{top.path}/{tag}{named}")
        self.tokens.append(path)
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK and tag not in RAW):
            return
        words = {w.lower() for w in NAME.findall(named)} if named else frozenset()
        furniture, main, article = top.furniture, top.main, top.article
        if tag in MAIN or role in ("main", "article"):
            main, furniture = True, 0 if furniture == 1 and not main else furniture
            if tag == "article" or role == "article":
                self.articles.append(article)
                article = len(self.articles) - 1
        elif tag in FURNITURE or role in ROLES or (tag == "header" and not main):
            furniture = 2
        if words and tag not in ("html", "body"):
            if words & ALIEN and (tag not in MAIN or words & {"comment", "comments", "ad", "ads", "advert", "sponsored"}):
                furniture = 2
            elif (words & LAYOUT or (words & HEADS and not main)) and not words & BESIDE and tag not in MAIN:
                furniture = max(furniture, 1)
        self.open.append(_Open(tag, path, main, furniture, article))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        self._close(tag, frozenset())

    def _close(self, tag: str, bars: frozenset) -> None:
        """Ends the last open element of a kind, and those inside it; nothing if there is none before an element of ``bars``."""
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                if tag in BLOCK:
                    self._flush()
                for each in reversed(self.open[i:]):
                    self.tokens.append(_hash(f"{each.path}/"))
                    self.count[each.tag] -= 1
                del self.open[i:]
                return
            if self.open[i].tag in bars:
                return

    def _flush(self) -> None:
        """Ends a block: its text, white space as one space, character references decoded."""
        if not self.text:
            return
        text, linked = " ".join("".join(self.text).split()), not self.plain
        self.text.clear()
        self.plain = False
        if not text:
            return
        top, at = self.open[-1], len(self.tokens)
        if not top.main:
            self.tokens.extend(_hash(f"{top.path} {w}") for w in text.split(" "))
        self.blocks.append((text, at, top.main, top.furniture > 0, linked, len(self.tokens) - at))
        self.within.append(top.article)


BLOCKS = "array<struct<at:int,main:boolean,furniture:boolean,linked:boolean,n:int>>"
BLOCK_FIELDS = {"at": pa.int32(), "main": pa.bool_(), "furniture": pa.bool_(), "linked": pa.bool_(), "n": pa.int32()}
COUNT_FIELDS = {"token": pa.int64(), "n": pa.int64(), "first": pa.int64()}


def _lists(rows: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    flat = list(zip(*(t for row in rows for t in row), strict=True)) or [()] * len(fields)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(flat, fields.values(), strict=True)], list(fields)))


def parsed(pages: DataFrame, html: str) -> DataFrame:
    """(host_, tokens_, blocks_) of pages: what the template is made from; no text."""
    arrow_limits(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rounds(batch, html):
                read = [Page(source or "") for source in part.column(html).to_pylist()]
                made = [pa.array([p.tokens for p in read], pa.list_(pa.int64())), _lists([[b[1:] for b in p.blocks] for p in read], BLOCK_FIELDS)]
                yield pa.RecordBatch.from_arrays([part.column("host_"), *made], ["host_", "tokens_", "blocks_"])

    return pages.select("host_", html).mapInArrow(run, f"host_ string, tokens_ array<bigint>, blocks_ {BLOCKS}")


def counted(pages: DataFrame) -> DataFrame:
    """(host_, row_, counts_): each page's different tokens, how often it has them and where first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ends = batch.column("tokens_").flatten().to_numpy(), np.cumsum([0, *batch.column("tokens_").value_lengths().to_numpy()])
            found = [np.unique(tokens[a:b], return_index=True, return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            flat = [pa.array(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]), pa.int64()) for i in (0, 2, 1)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32()), pa.StructArray.from_arrays(flat, list(COUNT_FIELDS)))
            yield pa.RecordBatch.from_arrays([batch.column("host_"), batch.column("row_"), lists], ["host_", "row_", "counts_"])

    return pages.select("host_", "row_", "tokens_").mapInArrow(run, "host_ string, row_ bigint, counts_ array<struct<token:bigint,n:bigint,first:bigint>>")


def classes(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host_, vector, pages, tokens in order) of the equivalence classes of each host that are on at least SHARE of its pages.

    A token's occurrence vector is known by its hash: exclusive or over pages of
    a hash of page and count, so partial results of tasks are all that is shuffled.
    """
    each = counted(pages).select("host_", "row_", F.explode("counts_").alias("c"))
    known = each.groupBy("host_", F.col("c.token").alias("token")).agg(F.bit_xor(F.xxhash64("row_", "c.n")).alias("vector"), F.count("*").alias("on"), F.sum("c.first").alias("place"))
    common = known.join(sizes, "host_").where(F.col("on") >= F.col("pages_") * SHARE)
    ordered = F.array_sort(F.collect_list(F.struct("place", "token")))
    return common.groupBy("host_", "vector").agg(F.max("on").alias("on"), ordered.alias("t")).select("host_", F.struct(F.col("on"), F.size("t").alias("size"), F.xxhash64("vector").alias("id"), F.col("t.token").alias("tokens")).alias("class"))


class Walk:
    """The classes of one host, greatest first, and their spans in a page."""

    def __init__(self, found: list[dict]):
        self.ids = [c["id"] for c in found]
        self.sizes = [len(c["tokens"]) for c in found]
        self.on = [c["on"] for c in found]
        self.rank = {c["id"]: (-c["on"], -c["size"], c["id"]) for c in found}
        self.place = {t: (n, i) for n, c in enumerate(found) for i, t in enumerate(c["tokens"])}

    def broken(self, tokens: list[int]) -> list[int]:
        """Ids of the classes that keep no order in a page, or whose spans cross those of a greater one."""
        bad: set[int] = set()
        due = [0] * len(self.ids)
        for token in tokens:
            if token in self.place:
                n, i = self.place[token]
                if i != due[n]:
                    bad.add(n)
                due[n] = (i + 1) % self.sizes[n]
        bad |= {n for n, d in enumerate(due) if d}
        stack: list[int] = []
        for token in tokens:
            n, i = self.place.get(token, (-1, 0))
            if n < 0 or n in bad:
                continue
            if i == 0:
                stack.append(n)
            else:
                while stack and stack[-1] != n and n not in bad:
                    top = stack[-1]
                    if self.rank[self.ids[top]] > self.rank[self.ids[n]]:
                        bad.add(top)
                        stack.pop()
                    else:
                        bad.add(n)
                if n in bad:
                    stack = [m for m in stack if m != n]
                    continue
            if i == self.sizes[n] - 1 and stack:
                stack.pop()
        return [self.ids[n] for n in bad]

    def constant(self, words: list[int], pages: int) -> bool:
        """Whether words are template text: all of one class of at least three tokens, which every page of the host has."""
        of = {self.place.get(t, (-1, 0))[0] for t in words}
        n = of.pop() if len(of) == 1 else -1
        return n >= 0 and self.sizes[n] >= 3 and self.on[n] == pages

    def slots(self, tokens: list[int], places: list[int]) -> list[int]:
        """The slot at each of the places (numbers of tokens before them, in order): the innermost class that is open there and its last token."""
        out, stack, k = [], [], 0
        for at in range(len(tokens) + 1):
            while k < len(places) and places[k] == at:
                out.append(stack[-1][0] * 1_000_003 + stack[-1][1] & (1 << 62) - 1 if stack else 0)
                k += 1
            if at == len(tokens) or tokens[at] not in self.place:
                continue
            n, i = self.place[tokens[at]]
            if i == 0:
                stack.append((self.ids[n], 0))
            elif stack and stack[-1][0] == self.ids[n]:
                stack[-1] = (self.ids[n], i)
            if i == self.sizes[n] - 1 and stack and stack[-1][0] == self.ids[n]:
                stack.pop()
        return out


_CLASS = "array<struct<on:bigint,size:int,id:bigint,tokens:array<bigint>>>"


#: Hosts whose walks a task keeps at a time.
MOST_WALKS = 256


class _Hosts:
    """What a task knows of the hosts that it has met lately, so that a host's values are taken apart once and not once a page."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """The walk, and the sets of slots where the rows have them, of each row."""
        sets = [batch.column(c) for c in ("main_slots_", "text_slots_") if c in batch.schema.names]
        classes = batch.column("classes_")
        for i, host in enumerate(batch.column("host_").to_pylist()):
            if host not in self.known:
                if len(self.known) >= MOST_WALKS:
                    self.known.clear()
                self.known[host] = (Walk(classes[i].as_py() or []), *(set(c[i].as_py()) for c in sets))
            yield self.known[host]


def _broken(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = _Hosts()
        for batch in batches:
            pairs = {(h, i) for h, t, (w,) in zip(batch.column("host_").to_pylist(), batch.column("tokens_").to_pylist(), hosts.of(batch), strict=True) for i in w.broken(t)}
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in pairs], pa.string()), pa.array([i for _, i in pairs], pa.int64())], ["host_", "id"])

    return rows.select("host_", "tokens_", "classes_").mapInArrow(run, "host_ string, id bigint").distinct()


def _slots(rows: DataFrame) -> DataFrame:
    """(host_, slot, main, linked) of the blocks of pages that aren't furniture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = _Hosts()
        for batch in batches:
            found = set()
            for host, tokens, blocks, (walk,) in zip(*(batch.column(c).to_pylist() for c in ("host_", "tokens_", "blocks_")), hosts.of(batch), strict=True):
                for slot, block in zip(walk.slots(tokens, [b["at"] for b in blocks]), blocks, strict=True):
                    if not block["furniture"]:
                        found.add((host, slot, block["main"], block["linked"]))
            flat = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(flat, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], ["host_", "slot", "main", "linked"])

    return rows.mapInArrow(run, "host_ string, slot bigint, main boolean, linked boolean")


def met(pages: DataFrame, hosts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Pages with the values of their host. ``hosts`` is written, a row a host; broadcast if it is small, else pages of hosts with many are dealt over salts."""
    size = hosts.agg(F.count("*").alias("rows"), F.sum(F.size(F.flatten("classes_.tokens"))).alias("tokens")).first()
    if size.rows + (size.tokens or 0) <= MOST_BROADCAST:
        return pages.join(F.broadcast(hosts), "host_")
    return salted_join(pages, hosts, "host_", ["row_"], hot)


def template(pages: DataFrame, sizes: DataFrame, hot: DataFrame | None, tables: Scratch) -> DataFrame:
    """(host_, pages_, classes_, main_slots_, text_slots_) of each host, of parsed pages with ``host_`` and ``row_``.

    A host's row is no longer than twice its mean page.
    """
    listed = F.array_sort(F.collect_list("class")).cast(_CLASS).alias("classes_")
    filled = lambda found: sizes.join(found, "host_", "left").withColumn("classes_", F.coalesce("classes_", F.array().cast(_CLASS)))
    found = tables.write(classes(pages, sizes), "classes")
    every = tables.write(filled(found.groupBy("host_").agg(listed)), "listed")
    bad = tables.write(_broken(met(pages.select("host_", "row_", "tokens_"), every, hot)), "broken")
    known = found["class"]["id"]
    valid = found.join(bad.withColumnRenamed("host_", "in_"), (F.col("host_") == F.col("in_")) & (known == F.col("id")), "left_anti")
    hosts = tables.write(filled(valid.groupBy("host_").agg(listed)), "valid")
    # A host's slots: those where an article's text isn't all links on some page, and those where any text isn't.
    slot = _slots(met(pages, hosts, hot)).groupBy("host_", "slot").agg(F.max(F.col("main") & ~F.col("linked")).alias("main"), F.min("linked").alias("linked"))
    chosen = slot.groupBy("host_").agg(F.collect_set(F.when(F.col("main"), F.col("slot"))).alias("main_slots_"), F.collect_set(F.when(~F.col("linked"), F.col("slot"))).alias("text_slots_"))
    none = F.array().cast("array<bigint>")
    return hosts.join(chosen, "host_", "left").select("host_", "pages_", "classes_", F.coalesce("main_slots_", none).alias("main_slots_"), F.coalesce("text_slots_", none).alias("text_slots_"))


def teasers(page: Page, slots: list[int], main_slots: set[int]) -> set[int]:
    """Numbers of a page's article elements without a slot that holds an article's text; none if the whole page has no such slot."""
    said = {article for slot, article, (_, _, main, furniture, _, _) in zip(slots, page.within, page.blocks, strict=True) if main and not furniture and slot in main_slots}
    if not said:
        return set()
    for i in range(len(page.articles) - 1, 0, -1):  # Those inside have greater numbers.
        if i in said:
            said.add(page.articles[i])
    return set(range(1, len(page.articles))) - said


def extract(page: Page, walk: Walk, main_slots: set[int], text_slots: set[int], pages: int) -> str:
    """The text of a page's blocks that stand in slots of the template which are extracted, and pass the check of each block."""
    own_main = any(main and not furniture for _, _, main, furniture, _, _ in page.blocks)
    slots = walk.slots(page.tokens, [b[1] for b in page.blocks])
    beside = teasers(page, slots, main_slots) if own_main and pages >= MIN_PAGES else set()
    kept = []
    for slot, article, (text, at, main, furniture, _, n) in zip(slots, page.within, page.blocks, strict=True):
        if furniture:
            continue
        if own_main:
            fits = main and article not in beside
        else:
            fits = pages < MIN_PAGES or (slot in text_slots and not walk.constant(page.tokens[at : at + n], pages))
        if fits:
            kept.append(text)
    return "\n".join(kept)


def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without their html, with the main ``text`` and its length in characters, ``n_chars``.

    Pages are read twice, for the template and for the text, so that no text is
    written in between; what is kept for the result is one row a host.
    """
    spark = pages.sparkSession
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    base = pages.select(F.struct(*(F.col(c) for c in others), F.lit(0).alias("none_")).alias("row_of_"), host_of(F.col(url)).alias("host_"), F.col(html).alias("html_"))
    with Scratch(spark) as tables:
        read = tables.write(parsed(base, "html_").withColumn("row_", F.monotonically_increasing_id()), "parsed")
        sizes = tables.write(read.groupBy("host_").agg(F.count("*").alias("pages_")), "host_sizes")
        hosts = written(template(read, sizes, hot_keys(sizes, "host_", "pages_"), tables), "template")
    # Salts for the second reading come from the pages' own numbers.
    rows = met(base.withColumn("row_", F.monotonically_increasing_id()), hosts, hot_keys(hosts, "host_", "pages_"))
    schema = base.select("row_of_", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = _Hosts()
        for batch in batches:
            for part in rounds(batch, "html_"):
                sources, counts = part.column("html_").to_pylist(), part.column("pages_").to_pylist()
                texts = [extract(Page(h or ""), *known, n) for h, known, n in zip(sources, hosts.of(part), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row_of_"), pa.array(texts, pa.string())], ["row_of_", "text"])

    out = rows.select("row_of_", "host_", "html_", "pages_", "classes_", "main_slots_", "text_slots_").mapInArrow(run, schema)
    return out.select(*(F.col("row_of_")[c].alias(c) for c in others), "text", F.length("text").cast("long").alias("n_chars"))
