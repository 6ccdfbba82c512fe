"""Places of regular expressions in texts, with Spark's own functions only.

A span is a struct `start, end, rank, kind, match`: code points, end exclusive; rank is the place of
its kind in the order in which kinds at one start are written. The time of all of it is in proportion to a text's length and to its number of
matches to the power of 4/3.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

SPAN = "struct<start:int,end:int,rank:int,kind:string,match:string>"
#: Code points of a chunk of a text; a place in a text is looked up in its chunk.
CHUNK = 2048


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], none: Column) -> Column:
    """Each element joined with all before it: within its block, and with what the blocks before it joined to. Blocks of the cube root of n elements make that n to the power of 4/3 steps. none: what joins to no change."""

    def of(a: Column) -> Column:
        width = F.greatest(F.ceil(F.cbrt(F.size(a))), F.lit(8)).cast("int")
        joined = lambda part: F.aggregate(part, none, join)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda b: joined(F.slice(a, b * width + 1, width)))
        before = bound(blocks, lambda t: F.transform(t, lambda x, j: joined(F.slice(t, F.lit(1), j))))
        within = lambda i: F.slice(a, i - i % width + 1, i % width + 1)
        every = bound(before, lambda p: F.transform(a, lambda x, i: F.aggregate(within(i), F.get(p, F.floor(i / width).cast("int")), join)))
        return F.when(F.size(a) > 0, every).otherwise(a)

    return bound(values, of)


def chunks(text: Column) -> Column:
    """The text in pieces of `CHUNK` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points of a text in chunks from `start` up to `end`."""
    first = F.floor(start / CHUNK).cast("int")
    n = F.greatest(F.floor((end - 1) / CHUNK).cast("int") - first + 1, F.lit(0))

    def part(c: Column, i: Column) -> Column:
        at = (first + i) * CHUNK
        low = F.greatest(start - at, F.lit(0))
        return F.substring(c, low + 1, F.least(end - at, F.lit(CHUNK)) - low)

    return F.array_join(F.transform(F.slice(pieces, first + 1, n), part), "")


def find(text: Column, pattern: str, kind: str, rank: int, *, group: int | None = None) -> Column:
    """All leftmost non-overlapping matches. With `group` each span also has what that group matched, as `part`.

    Spark has no function that returns places, so the lengths of matches and of what lies between them are added up; a text
    without a match is read once only.
    """
    of = SPAN if group is None else SPAN[:-1] + ",part:string>"
    none = F.array().cast(f"array<{of}>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda g: F.length(g))
        ends = running(F.zip_with(gaps, found, lambda g, m: g + F.length(m)), lambda a, b: a + b, F.lit(0))
        fields = lambda e, m: [(e - F.length(m)).alias("start"), e.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.alias("match")]
        if group is None:
            return F.when(F.size(found) > 0, F.zip_with(ends, found, lambda e, m: F.struct(*fields(e, m)))).otherwise(none)
        parts = F.arrays_zip(found.alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
        return F.when(F.size(found) > 0, F.zip_with(ends, parts, lambda e, p: F.struct(*fields(e, p["match"]), p["part"].alias("part")))).otherwise(none)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def plain(spans: Column) -> Column:
    """Spans without further fields."""
    return F.transform(spans, lambda s: F.struct(*(s[f].alias(f) for f in ("start", "end", "rank", "kind", "match"))))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def written(spans: Column) -> Column:
    """`kind:start:end` by start, then kind, comma-joined."""
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """Spans `start, rank, end, kind` sorted by start, then rank."""
    key = F.transform(spans, lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    return F.array_sort(key)


def masked(rows: DataFrame, text: str, found: str) -> DataFrame:
    """`rows` with `masked`, the text with every found span replaced by its kind in brackets; spans that overlap are one, named after the first."""
    reach = lambda spans: running(F.transform(spans, lambda s: s.end), lambda a, b: F.greatest(a, b), F.lit(0))

    def apart(x: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(x.spans) - 1), lambda i: (i == 0) | (F.get(x.spans, i).start >= F.get(x.ends, i - 1)))

        def groups(h: Column) -> Column:
            last = lambda j: F.coalesce(F.get(h, j + 1), F.size(x.spans)) - 1
            return F.transform(h, lambda i, j: F.struct(F.get(x.spans, i).start.alias("start"), F.get(x.ends, last(j)).alias("end"), F.get(x.spans, i).kind.alias("kind")))

        return bound(heads, groups)

    def replaced(x: Column) -> Column:
        pieces = F.transform(x.spans, lambda s, i: F.concat(cut(x.chunks, F.when(i == 0, 0).otherwise(F.get(x.spans, i - 1).end), s.start), F.lit("["), F.upper(s.kind), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), cut(x.chunks, F.element_at(x.spans, -1).end, x.size))

    whole = F.col(text)
    merged = bound(in_order(F.col(found)), lambda spans: bound(F.struct(spans.alias("spans"), reach(spans).alias("ends")), apart))
    done = bound(F.struct(merged.alias("spans"), chunks(whole).alias("chunks"), F.length(whole).alias("size")), replaced)
    return rows.withColumn("masked", F.when(F.size(found) > 0, done).otherwise(whole))


def outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: of the others before one in order of starts, none reaches into it, and none after it starts in it."""
    tagged = lambda a, own: F.transform(a, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), own.alias("own"), s["rank"].alias("rank"), s.kind.alias("kind"), s.match.alias("match")))
    every = F.array_sort(F.concat(tagged(spans, F.lit(True)), tagged(others, F.lit(False))))

    def kept(x: Column) -> Column:
        free = F.filter(x.spans, lambda s, i: s.own & (F.get(x.before, i) <= s.start) & (F.get(x.after, F.size(x.spans) - 1 - i) >= s.end))
        return F.transform(free, lambda s: F.struct(*(s[f].alias(f) for f in ("start", "end", "rank", "kind", "match"))))

    before = lambda a: running(F.transform(a, lambda s: F.when(s.own, 0).otherwise(s.end)), lambda p, q: F.greatest(p, q), F.lit(0))
    far = F.lit(2**31 - 1)
    after = lambda a: running(F.transform(F.reverse(a), lambda s: F.when(s.own, far).otherwise(s.start)), lambda p, q: F.least(p, q), far)
    met = bound(every, lambda a: bound(F.struct(a.alias("spans"), before(a).alias("before"), after(a).alias("after")), kept))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), met).otherwise(spans)
