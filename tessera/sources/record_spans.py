"""Where the records of JSON and XML documents stand: code points and lines, so a claim can point at what it cites.

A document is a row. One pass over its tokens keeps the depth, or the open elements of one name, and nothing else; records are given one by one as they end.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

_JSON = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\],:]', re.S)
_XML = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([\w.:-]+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)

Span = tuple[str, int, int]  # path, start, end


def json_spans(text: str) -> Iterator[Span]:
    """Every object and list of a JSON text, as they end, with the path to it: names and numbers of places, parted by slashes. A text that ends early gives what ended; unpaired closing marks are passed over."""
    open_: list[list] = []  # start, path, name or number of the next value, whether a list
    name: str | None = None
    for token in _JSON.finditer(text):
        mark = token[0]
        top = open_[-1] if open_ else None
        if mark in "{[":
            step = [] if top is None else [str(top[2]) if top[3] else name or ""]
            open_.append([token.start(), [*(top[1] if top else []), *step], 0, mark == "["])
            name = None
        elif mark in "}]":
            if top is not None and top[3] == (mark == "]"):
                open_.pop()
                yield "/".join(top[1]), top[0], token.end()
        elif mark == ",":
            if top is not None and top[3]:
                top[2] += 1
            name = None
        elif mark[0] == '"' and top is not None and not top[3] and name is None:
            name = mark[1:-1]


def xml_spans(text: str) -> Iterator[Span]:
    """Every element of an XML text, as they end, with its name, any prefix left out. A closing tag ends the last open element of its name, and with it those left open inside."""
    open_: list[tuple[str, int]] = []
    for token in _XML.finditer(text):
        if token[2] is None:
            continue
        name = token[2].rpartition(":")[2]
        if token[1]:
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if at is not None:
                yield name, open_[at][1], token.end()
                del open_[at:]
        elif token[3].endswith("/"):
            yield name, token.start(), token.end()
        else:
            open_.append((name, token.start()))


def _lines(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """First and last line, from 1, of spans in any order: line ends are looked up, not counted anew."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return [(bisect.bisect_left(ends, a) + 1, bisect.bisect_left(ends, b - 1) + 1) for _, a, b in spans]


def _found(scan: Callable[[str], Iterator[Span]], wanted: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = re.compile(wanted)
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column("text")[row].as_py() or ""
            spans = [s for s in scan(text) if path.fullmatch(s[0])]
            for start in range(0, len(spans), 10_000):
                part = spans[start : start + 10_000]
                lines = _lines(text, part)
                columns = [[s[0] for s in part], [s[1] for s in part], [s[2] for s in part], [a for a, _ in lines], [b for _, b in lines], [text[a:b] for _, a, b in part]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("id")[row].as_py()] * len(part), batch.schema.field("id").type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "path", "start", "end", "first_line", "last_line", "record"])


def _spans(df: DataFrame, id_col: str, text_col: str, scan: Callable[[str], Iterator[Span]], wanted: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lambda b: _found(scan, wanted, b), f"id {rows.schema['id'].dataType.simpleString()}, path string, start bigint, end bigint, first_line bigint, last_line bigint, record string")


def json_records(df: DataFrame, id_col: str, text_col: str, path: str = r"entry/\d+/resource") -> DataFrame:
    """`id, path, start, end, first_line, last_line, record` of the objects and lists of JSON documents whose whole path the expression matches. Null texts have none."""
    return _spans(df, id_col, text_col, json_spans, path)


def xml_elements(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """The same of the elements of XML documents whose name, without a prefix, the expression matches; an element inside another of the name is one of its own."""
    return _spans(df, id_col, text_col, xml_spans, name)
