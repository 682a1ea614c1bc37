"""Main text of web pages by differencing each page with the nearest URL of its host.

A page is read to lines, the texts of its blocks, each with what stands around it: whether it is inside the article, inside something
that is never main text (by element, or by a word of its class, id or role), or inside something in an article that may be either. Pages of
a host are sorted by path; the LOOK pages before and the LOOK after a page are its neighbours, the nearest first. Its lines are aligned
by longest common subsequence with those of the nearest neighbour that is no copy (one that shares less than COPY of its lines), and
shared lines are deleted: what a site's pages have in common is its frame. Where all neighbours are copies, a line goes if the two
nearest that aren't equal to the page both have it; a page with fewer such neighbours keeps its lines.

What differencing decides: all lines outside of an article and outside of a frame's elements, on pages with and without an article; and
lines in an article in an element whose class has one of MAYBE_WORDS. Other lines of an article stay though shared, as passages are
quoted and copied, and lines inside a frame's elements always go, as a page's menu may be its own.

Pages are dealt by ranges of host and path, and the pages at a range's borders are lent to the other ranges: neighbours are those
among all of the host's pages, however many ranges there are. A null URL is an empty one, and such pages are one host.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline. A null or
empty page has an empty text. Repeated page ids are pages of their own. An attribute's value is quoted only after an equals sign; a
tag that never ends is dropped with the rest of the page, as browsers do. Reading takes time in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts

#: Pages a range has about, if there are fewer ranges than partitions.
GROUP_PAGES = 1000
#: Neighbours on either side.
LOOK = 4
#: A neighbour that shares this share of the lines is a copy.
COPY = 0.9
#: Pairs of equal lines up to which they are gone through one by one; beyond it, an alignment is split in halves (Hirschberg).
MATCHES = 2_000_000
#: Of the places of repeated lines that are kept meanwhile.
MASK_BYTES = 64 << 20

#: Elements whose text is none of the page's.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "textarea", "button"}
#: Elements whose content is taken as it is, up to their end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
FRAME = {"nav", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Words of a class, id or role that mark a frame's elements, and those that do so only outside of an article: inside, they may be its subject.
FRAME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar "
    "navigation newsletter overlay pagination paywall popup promo respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
MAYBE_WORDS = set("alert announcement banner complementary contentinfo header hidden notice promoted related reply replies search tags".split())
#: Elements of an article's own text: only a class that is a word of FRAME_WORDS as a whole marks them.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "tr", "table", "figure", "figcaption"}
MAIN_WORDS = {"main", "article"}
#: Beside these, a word of FRAME_WORDS tells what an element has or lacks, not what it is.
ABOUT = {"has", "with", "no", "without", "is"}

# Possessive throughout: no part is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_MARKED = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _marks(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element's attributes make it a frame's, whether (in an article) they may, and whether they make it the main one."""
    frame = maybe = main = False
    for key, a, b, c in _MARKED.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            frame = True
        elif key in ("class", "id", "role"):
            for part in value.split():
                if inside and name in TEXT:
                    frame |= part.lower() in FRAME_WORDS
                    maybe |= part.lower() in MAYBE_WORDS
                    continue
                words = {w.lower() for w in _WORDS.findall(part)}
                if not words & ABOUT:
                    frame |= bool(words & FRAME_WORDS) or (not inside and bool(words & MAYBE_WORDS))
                    maybe |= inside and bool(words & MAYBE_WORDS - {"header"})
            frame |= key == "role" and value in ("search", "banner")
            main |= key == "role" and value in MAIN_WORDS
        elif key == "itemprop":
            main |= value == "articleBody"
    return frame, maybe, main and not frame


class _Open:
    """The open elements: of each its name, and whether it is in an article, in a frame, silent, and maybe in a frame."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, name: str, *state: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, *state))

    def pop(self) -> None:
        name = self.stack.pop()[0]
        self.places[name].pop()
        if name not in INLINE:
            self.blocks.pop()

    def close(self, name: str) -> None:
        """Up to the last one of that name, if there is one; an inline end tag closes no block."""
        at = self.places.get(name)
        if at and not (name in INLINE and self.blocks[-1] > at[-1]):
            at = at[-1]
            while len(self.stack) > at:
                self.pop()


Line = tuple[str, bool, bool, bool]


def lines(html: str) -> list[Line]:
    """Each block's text, and whether it stands inside an article, inside a frame, and in an article inside what may be one."""
    out: list[Line] = []
    text: list[str] = []
    open_ = _Open()
    stack = open_.stack

    def flush() -> None:
        if text:
            if said := " ".join(unescape("".join(text)).split()):
                _, inside, frame, _, maybe = stack[-1]
                out.append((said, inside, frame, maybe))
            text.clear()

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not stack[-1][3]:
            text.append(html[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        closing, name = m[1], (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if closing:
            open_.close(name)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p":
            while stack[-1][0] == "p" or (stack[-1][0] in INLINE and open_.places.get("p")):
                open_.pop()
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
            open_.pop()
        _, main, frame, silent, maybe = stack[-1]
        marked, perhaps, role = _marks(name, m[3], main) if m[3] else (False, False, False)
        if name in ("html", "body", "main", "article"):
            marked = perhaps = False
        changed = (name in FRAME or marked or (name == "header" and not main)) and not frame
        if changed or name in SILENT or (perhaps and not maybe):
            flush()
        open_.push(name, main or name in MAIN or role, frame or changed, silent or name in SILENT, maybe or perhaps)
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = stop.start() if stop else end
    flush()
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of a longest common subsequence of a and each beginning of b, by bits of one integer."""
    n = len(b)
    where: dict[str, list[int]] = {}
    for k, x in enumerate(b):
        where.setdefault(x, []).append(k)

    def mask(x: str) -> int:
        bits = np.zeros(n, dtype=np.uint8)
        bits[where[x]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    often = sorted((x for x in set(a) if x in where), key=lambda x: -len(where[x]))
    masks = {x: mask(x) for x in often[: 1 + 8 * MASK_BYTES // (n + 1)]}
    full = (1 << n) - 1
    v = full
    for x in a:
        if x in where:
            u = v & (masks[x] if x in masks else mask(x))
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b."""
    found: set[int] = set()
    left = [(0, len(a), 0, len(b))]
    while left:
        lo, i, at, j = left.pop()
        while lo < i and at < j and a[lo] == b[at]:
            found.add(lo)
            lo, at = lo + 1, at + 1
        while i > lo and j > at and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        where: dict[str, list[int]] = {}
        for k in range(at, j):
            where.setdefault(b[k], []).append(k)
        if i - lo > 1 and sum(len(where.get(x, ())) for x in a[lo:i]) > MATCHES:
            half = (lo + i) // 2
            total = _lengths(a[lo:half], b[at:j]) + _lengths(a[half:i][::-1], b[at:j][::-1])[::-1]
            cut = at + int(total.argmax())
            left += [(lo, half, at, cut), (half, i, cut, j)]
            continue
        tails: list[int] = []  # of the runs of each length, the least end in b
        links: list[tuple[int, tuple | None]] = []
        for k in range(lo, i):
            for n in reversed(where.get(a[k], ())):
                r = bisect_left(tails, n)
                link = (k, links[r - 1] if r else None)
                if r == len(tails):
                    tails.append(n)
                    links.append(link)
                else:
                    tails[r], links[r] = n, link
        link = links[-1] if links else None
        while link:
            found.add(link[0])
            link = link[1]
    return found


def shared_with(own: list[str], neighbours: list[list[str]]) -> set[int]:
    """Places in own that differencing deletes; neighbours: the nearest first."""
    copies = []
    for other in neighbours:
        if other == own:
            continue
        common = shared_lines(own, other)
        if len(common) < COPY * len(own):
            return common
        if len(copies) < 2:
            copies.append(common)
    return copies[0] & copies[1] if len(copies) == 2 else set()


def main_text(page: list[Line], neighbours: list[list[Line]]) -> str:
    """The text of a page's lines, without the frame's: its elements' lines, and what differencing with the neighbours, the nearest first, finds shared outside of the article's own text."""
    open_ = [i for i, (_, inside, frame, maybe) in enumerate(page) if not frame and (maybe or not inside)]
    gone = shared_with([x[0] for x in page], [[x[0] for x in n] for n in neighbours]).intersection(open_) if open_ and neighbours else set()
    return "\n".join(x[0] for i, x in enumerate(page) if not x[2] and i not in gone)


def nearest_first(before: list, after: list) -> list:
    """Neighbours in order of distance, of two at one distance that before first; before and after start with the nearest."""
    return [x[k] for k in range(max(len(before), len(after))) for x in (before, after) if k < len(x)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket, host and path: bucket, host, lent, page_id, url, html. A lent page is another bucket's and only a neighbour."""
    held: deque[tuple] = deque()  # pages of one bucket and host: lent, page_id, url, lines
    place = 0  # in held of the first page whose text is still to come
    key = None
    done: list[tuple] = []

    def settle(last: bool) -> None:
        """Texts of the pages that have all neighbours they will get."""
        nonlocal place
        while place < len(held) and (last or place + LOOK < len(held)):
            lent, page_id, url, own = held[place]
            if not lent:
                before = [held[k][3] for k in range(place - 1, max(-1, place - 1 - LOOK), -1)]
                after = [held[k][3] for k in range(place + 1, min(len(held), place + 1 + LOOK))]
                done.append((page_id, url, main_text(own, nearest_first(before, after))))
            place += 1
            if place > LOOK:
                held.popleft()
                place -= 1

    def batch_of() -> pa.RecordBatch:
        rows = list(zip(*done, strict=True)) if done else [(), (), ()]
        out = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["page_id", "url", "text"])
        done.clear()
        return out

    for batch in batches:
        for bucket, host, lent, page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if key != (bucket, host):
                settle(True)
                held.clear()
                place, key = 0, (bucket, host)
            held.append((lent, page_id, url, lines(html or "")))
            settle(False)
            if len(done) >= 1000:
                yield batch_of()
    settle(True)
    yield batch_of()


KEY = ["host", "path", "page_id", "url"]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first LOOK and the last LOOK rows, of sorted ones; all of them, each once, if there are no more."""
    first, last = [], deque(maxlen=LOOK)
    for batch in batches:
        for i in range(batch.num_rows):
            if len(first) < LOOK:
                first.append(batch.slice(i, 1))
            elif i >= batch.num_rows - LOOK:
                last.append(batch.slice(i, 1))
    yield from first
    yield from last


def _lendings(ends: dict[int, list[tuple]]) -> list[tuple[tuple, int]]:
    """Of the ends of each bucket, in order: pages of other buckets within LOOK places of its borders, with the bucket that they are lent to."""
    buckets = sorted(ends)
    out = []
    for n, b in enumerate(buckets):
        for others, nearest in ((buckets[:n][::-1], -1), (buckets[n + 1 :], 1)):
            found: list[tuple] = []
            for o in others:
                found += ends[o][::nearest][: LOOK - len(found)]
                if len(found) >= LOOK:
                    break
            out += [(k, n) for k in dict.fromkeys(found)]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page (columns page_id, url, html)."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_replace(F.regexp_replace(bare, "[?#].*$", ""), "^[^/]*", "")
    own = own.withColumn("host", F.lower(F.regexp_extract(bare, "^[^/?#]*", 0))).withColumn("path", path)
    n = max(1, min(parts(spark), -(-own.count() // GROUP_PAGES)))
    schema = "host string, path string, page_id long, url string"
    ends = own.select(*KEY).repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).mapInArrow(_ends, schema)
    by_bucket: dict[int, list[tuple]] = {}
    for p, *key in ends.select(F.spark_partition_id(), *KEY).collect():  # 2 * LOOK rows of a partition at most
        by_bucket.setdefault(p, []).append(tuple(key))

    key = F.struct(*KEY)
    starts = [keys[0] for _, keys in sorted(by_bucket.items())][1:]
    types = ("string", "string", "long", "string")
    borders = F.array(*(F.struct(*(F.lit(x).cast(t).alias(c) for c, x, t in zip(KEY, k, types, strict=True))) for k in starts))
    own = own.withColumn("b", F.size(F.filter(borders, lambda x: x <= key)) if starts else F.lit(0))
    lent = spark.createDataFrame([(*k, b) for k, b in _lendings(by_bucket)], "h string, p string, i long, u string, to int").groupBy("h", "p", "i", "u").agg(F.collect_list("to").alias("to"))
    on = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")) & F.col("page_id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u"))
    own = own.join(F.broadcast(lent), on, "left")  # 2 * LOOK rows of a bucket at most
    given = F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda b: F.struct(b.alias("b"), F.lit(True).alias("lent")))
    own = own.withColumn("to", F.explode(F.concat(F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("lent"))), given)))
    dealt = own.select(F.col("to.b").alias("b"), F.col("to.lent").alias("lent"), *KEY, "html").repartitionById(n, "b").sortWithinPartitions("b", *KEY, "html")
    return dealt.select("b", "host", "lent", "page_id", "url", "html").mapInArrow(_texts, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
