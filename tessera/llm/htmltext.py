"""Main text of web pages, by nearest-URL page differencing, checked by markup.

A page is cut into lines at its block tags, once. Pages are paired by URL: in the order of host and path each page meets the two
before and the two after it on the same host, those first whose path has most first parts in common. All lines of both,
those of menus, adverts and footers as well, are aligned by longest common subsequence. A neighbour most of whose lines are shared is a copy and
says nothing of frames. Lines shared with two other neighbours, or with the only one there is, are the site's
frame and are deleted. Markup checks this twice. A shared line in a paragraph, heading, list, table or quotation of an
article (or main part) stays: passages quoted in several pages are text, not a frame, and so is a sentence that a neighbour has in an advert; so
is an article whose every line is shared. And what stands in menus, headers, footers, sidebars, notices, adverts,
forms and reader comments goes also where the neighbours have others; scripts and styles are never lines. Of the
rest, what stands in an article is the text; a page without one has all its other lines, or those of an element named
as content.

The lines of a page, compressed, and their 64-bit digests are one row. The URLs alone are range-partitioned first, which gives the bounds of parts of even size; the one pass over the pages
deals its rows to these, so a host with a third of all pages is spread evenly, and each part is one pass with a window of five rows. The first and last four rows of each part
are decided afterwards, next to those of the part beside it: as many short groups as there are parts.

Cases: null html gives an empty text; a null URL or one without `://` has an empty host and path, and such pages are one
host. Repeated rows give a row each. Unclosed and crossed tags end with their page at the latest; an article that starts
inside an unclosed menu still counts. Only the named columns take part.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import SLICE_BYTES, named, parts_of, stored
from .urlfilter import host_and_path

#: Columns of a block of an alignment: a block's lines take a bit for each line in it at most, 32 MB.
BLOCK = 1 << 14
#: Bytes of html that a part is made for.
PART_BYTES = 16 << 20
#: Share of two pages' lines beyond which they are copies.
COPY = 0.8
#: Rows at a partition's beginning and end that are kept for the neighbours beyond it: two to decide and the two that these need.
EDGE = 4
#: Elements whose content is never text.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title form button select textarea option datalist nav menu header footer aside dialog".split())
#: Elements that an article inside ends, if they were left open.
_LOOSE = frozenset("nav menu header aside footer form".split())
#: Elements whose content isn't even a line.
NEVER = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea option datalist".split())
#: Elements of running text: in an article their lines stay though a neighbour shares them.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening block ends, as their end tags may be left out.
_IMPLIED = frozenset("p li dt dd option tr td th".split())
#: Words in class, id or role that name what isn't main text.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer colophon cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "subscription social share sharing related recommended comment comments discussion disqus replies respond widget toolbar pagination pager search login complementary contentinfo dialog paywall skip".split()
)
#: Words in class, id or role that name the main part where no article or main element does.
CONTENT_WORDS = frozenset("article content main post entry story body".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|[\s=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD, _WITHOUT = re.compile(r"[a-z]+"), re.compile(r"\b(?:no|has|with|without)[-_][a-z]+")


def _words(attributes: str) -> set[str]:
    """Words of an element's class, id and role."""
    return set(_WORD.findall(_WITHOUT.sub(" ", " ".join("".join(m) for m in _NAMES.findall(attributes)).lower())))


def lines_of(page: str) -> list[tuple[int, str]]:
    """The page's lines in order, each with its rank: 4 in running text of an article or main element, 3 elsewhere in one, 2 in an element named as content, 1 outside, 0 in what markup calls a frame."""
    found: list[tuple[int, str]] = []
    held: list[str] = []
    open_: list[tuple[str, int, bool]] = []  # name, rank inside, whether dropped
    rank, dropped, at = 1, False, 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                running = rank == 3 and any(n in RUNNING for n, r, _ in open_ if r == 3)
                found.append((0 if dropped else rank + running, text))
            held.clear()

    def never() -> bool:
        return dropped and any(n in NEVER for n, _, _ in open_)

    for token in _TOKEN.finditer(page):
        if token.start() > at and not never():
            held.append(page[at : token.start()])
        at = token.end()
        name = token[3] or token[6]
        if name is None:
            if token[1]:
                flush() if token[1].lower() in ("textarea", "iframe") else None
            continue
        name, attributes = name.lower(), (token[4] if token[3] else token[7]) or ""
        if token[2] or token[5]:
            if name not in INLINE:
                flush()
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if any(n not in INLINE for n, _, _ in open_[k:]):
                        flush()
                    del open_[k:]
                    break
                if name in INLINE and open_[k][0] not in INLINE:
                    break
            rank, dropped = open_[-1][1:] if open_ else (1, False)
            continue
        if name in VOID or attributes.endswith("/") and name not in ("article", "main", "div", "p", "section"):
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
            while open_ and (open_[-1][0] in INLINE or open_[-1][0] in _IMPLIED and (open_[-1][0] in ("p", "option") or open_[-1][0] == name)):
                if open_[-1][0] in INLINE and not any(n in _IMPLIED for n, _, _ in open_):
                    break
                open_.pop()
            rank, dropped = open_[-1][1:] if open_ else (1, False)
        words = _words(attributes) if attributes else set()
        frame = bool(words & FRAME_WORDS) and name not in ("html", "body")
        if name in ("article", "main") and not frame:
            if dropped and open_ and all(n in _LOOSE or n in INLINE or n in _IMPLIED or n in ("ul", "ol", "div") for n, _, d in open_ if d):
                open_ = [x for x in open_ if not x[2]]
                dropped = False
            inside = (name, 3, dropped)
        else:
            better = 2 if words & CONTENT_WORDS and name not in ("html", "body") else 1
            inside = (name, max(rank, better), dropped or frame or name in DROPPED or bool(attributes and _HIDDEN.search(attributes)))
        open_.append(inside)
        rank, dropped = inside[1:]
    if at < len(page) and not never():
        held.append(page[at:])
    flush()
    return found


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of `a` and each beginning of `b`, by bit-parallel rows, `BLOCK` columns after the other: what a row carries over to the next block is a bit."""
    found, carried = [], bytearray(len(a))
    for start in range(0, len(b), BLOCK):
        block = b[start : start + BLOCK]
        places: dict[int, int] = {}
        for j, x in enumerate(block):
            places[x] = places.get(x, 0) | 1 << j
        size = len(block)
        every = (1 << size) - 1
        row = every
        for i, x in enumerate(a):
            both = row & places.get(x, 0)
            if both or carried[i]:
                total = row + both + carried[i]
                carried[i] = total >> size
                row = (total | (row - both)) & every
        found.append(1 - np.unpackbits(np.frombuffer(row.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size].astype(np.int64))
    return np.concatenate([[0], np.cumsum(np.concatenate(found))]) if found else np.zeros(1, np.int64)


def shared(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`: equal ends first, then halves of `a`, so memory is linear. Lines that only one of both has are left out before."""
    both = set(a) & set(b)
    kept = [i for i, x in enumerate(a) if x in both]
    return [kept[k] for k in _shared([a[i] for i in kept], [x for x in b if x in both])]


def _shared(a: list[int], b: list[int]) -> list[int]:
    found: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append(j)
        if i >= j or k >= m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                found.append(i)
            continue
        half = (i + j) // 2
        total = _lengths(a[i:half], b[k:m]) + _lengths(a[half:j][::-1], b[k:m][::-1])[::-1]
        cut = k + int(total.argmax())
        work += [(i, half, k, cut), (half, j, cut, m)]
    return sorted(found)


def digest(line: str) -> int:
    """64 bits of a line, as a signed long."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Page(NamedTuple):
    """A page's row: its lines as text, their digests and ranks."""

    page_id: object
    url: str | None
    host: str
    path: str
    digests: list[int]
    ranks: bytes
    lines: bytes

    def texts(self) -> list[str]:
        return zlib.decompress(self.lines).decode("utf-8", "surrogatepass").split("\n") if self.digests else []


def common_parts(a: str, b: str) -> int:
    """How many first parts two paths have in common."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def frames(page: Page, around: Sequence[Page | None]) -> set[int]:
    """Places of the page's lines that neighbours of other content share.

    around: the rows before and after, nearest first.
    """
    near = sorted((p for p in around if p is not None and p.host == page.host), key=lambda p: -common_parts(page.path, p.path))
    others = []
    for p in near:
        places = shared(page.digests, p.digests)
        if 2 * len(places) <= COPY * (len(page.digests) + len(p.digests)):
            others.append(places)
    counts = Counter(i for places in others for i in places)
    return {i for i, n in counts.items() if n >= min(2, len(others))}


def main_lines(page: Page, around: Sequence[Page | None]) -> list[str]:
    """The lines of a page's best part, less its frames."""
    best = min(max(page.ranks, default=0), 3)
    if not best:
        return []
    frame = frames(page, around)
    own = [i for i, rank in enumerate(page.ranks) if rank >= best]
    gone = {i for i in own if i in frame and page.ranks[i] < 4}
    if best == 3 and len(gone) == len(own):
        gone = set()
    texts = page.texts()
    return [texts[i] for i in own if i not in gone]


def _text(page: Page, around: Sequence[Page | None]) -> str:
    return " ".join(main_lines(page, around)).encode("utf-8", "replace").decode()


def _parsed(bounds: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed rows with their part: the first whose largest key isn't below the row's."""
    for batch in batches:
        for part in parts_of(batch, "html"):
            digests, ranks, lines = [], [], []
            for p in part.column("html"):
                found = lines_of(p.as_py() or "")
                digests.append([digest(t) for _, t in found])
                ranks.append(bytes(r for r, _ in found))
                lines.append(zlib.compress("\n".join(t for _, t in found).encode("utf-8", "surrogatepass"), 1))
            kept = [part.column(c) for c in ("page_id", "url", "host", "path")]
            keys = zip(*(part.column(c).to_pylist() for c in ("host", "path", "address", "spread")), strict=True)
            parts = pa.array([bisect_left(bounds, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.list_(pa.int64())), pa.array(ranks, pa.binary()), pa.array(lines, pa.binary()), part.column("spread"), parts], names=[*Page._fields, "spread", "part"])


def _pages(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """Rows one by one: the page, then further columns."""
    for batch in batches:
        columns = [batch.column(c) for c in (*Page._fields, *more)]
        for i in range(batch.num_rows):
            values = [c[i].as_py() for c in columns]
            yield Page(*values[: len(Page._fields)]), *values[len(Page._fields) :]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _in_parts(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 64
        if total > SLICE_BYTES:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _passed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A part's rows in order, each with its text where both neighbours on each side are in it; the first and last `EDGE` rows keep what their texts follow from."""
    held: deque[tuple[int, Page]] = deque()
    part = None

    def out(at: int, end: int | None) -> tuple:
        place = {i: p for i, p in held}
        page = place[at]
        whole = at >= 2 and (end is None or at + 2 < end)
        text = _text(page, [place.get(at + k) for k in (-1, 1, -2, 2)]) if whole else None
        edge = at < EDGE or end is not None and at >= end - EDGE
        return (page.page_id, page.url, text, part, at, *(page[2:] if edge else [None] * (len(Page._fields) - 2)))

    n = 0
    for page, part in rows:  # noqa: B007
        held.append((n, page))
        n += 1
        if n > EDGE:
            yield out(n - 1 - EDGE, None)
            while held[0][0] < n - 1 - EDGE - 1:
                held.popleft()
    for at in range(max(0, n - EDGE), n):
        yield out(at, n)


def _windows(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = groupby(_pages(batches, "part"), key=lambda r: r[1])
    yield from _in_parts((row for _, rows in parts for row in _passed(rows)), schema, lambda r: len(r[2] or "") + len(r[-1] or b""))


def _met(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of chains of neighbouring rows at partitions' edges those without a text, with it."""
    for _, chain in groupby(rows, key=lambda r: r[1]):
        near: list[tuple[Page, bool]] = [(page, open_) for page, _, open_ in chain]  # eight rows, and less for each partition with fewer
        for k, (page, open_) in enumerate(near):
            if open_:
                yield page.page_id, page.url, _text(page, [near[k + d][0] if 0 <= k + d < len(near) else None for d in (-1, 1, -2, 2)])


def _edges(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _in_parts(_met(_pages(batches, "chain", "open")), schema, lambda r: len(r[2]))


def main_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`page_id, url, text` of every page."""
    pages = named(df, page_id=id_col, url=url_col, html=html_col)
    host, path = host_and_path(F.col("url"))
    keys = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}"
    rest = "host string, path string, digests array<bigint>, ranks binary, lines binary"
    pages = pages.select("*", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("address"), F.xxhash64("page_id").alias("spread"))
    order = ("host", "path", "address", "spread")
    n_parts = (pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0) // PART_BYTES + 1  # follows the bytes of the pages, not of their URLs
    ranged = pages.select(*order).repartitionByRange(n_parts, *order).select(F.struct(*order).alias("key"), F.spark_partition_id().alias("part"))
    bounds = sorted(tuple(r.key) for r in ranged.groupBy("part").agg(F.max("key").alias("key")).collect())  # a row a part
    parsed = pages.mapInArrow(lambda b: _parsed(bounds, b), f"{keys}, {rest}, spread bigint, part int")
    ordered = parsed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "host", "path", F.coalesce("url", F.lit("")), "spread")
    wanted = f"{keys}, text string, part int, place bigint, {rest}"
    schema = to_arrow_schema(_schema(df, wanted))
    passed = stored(ordered.mapInArrow(lambda b: _windows(schema, b), wanted))

    chains, chain = [], 0
    for part, n in sorted(passed.groupBy("part").count().collect()):  # a row a partition
        chains.append((part, n, chain, chain := chain + (n >= 2 * EDGE)))
    of_part = df.sparkSession.createDataFrame(chains, "part int, n bigint, head int, tail int")
    edges = passed.where("lines is not null").join(F.broadcast(of_part), "part")
    edges = edges.withColumn("chain", F.when((F.col("place") < EDGE) | (F.col("n") < 2 * EDGE), F.col("head")).otherwise(F.col("tail"))).withColumn("open", F.col("text").isNull())
    placed = edges.repartition("chain").sortWithinPartitions("chain", "part", "place")
    texts = to_arrow_schema(_schema(df, f"{keys}, text string"))
    met = placed.select(*Page._fields, "chain", "open").mapInArrow(lambda b: _edges(texts, b), f"{keys}, text string")
    return passed.where("text is not null").select("page_id", "url", "text").unionByName(met)


def _schema(df: DataFrame, ddl: str) -> StructType:
    return df.sparkSession.createDataFrame([], ddl).schema
