"""Turtle files as quads: each file is read in one piece by one task, files side by side."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .quads import apart

_RDF, _XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<word>@(?:prefix|base)\b|(?i:prefix|base)(?=\s))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)"""
    r"""|(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<blank>_:[\w][\w.-]*(?<!\.))|(?P<name>[^\W\d_][\w.-]*:(?:[\w:%\\.-]*[\w:%\\-])?|:(?:[\w:%\\.-]*[\w:%\\-])?)"""
    r"""|(?P<bool>true\b|false\b)|(?P<a>a\b)|(?P<sign>[.;,\[\]()])""",
    re.S,
)


def triples(text: str, base: str) -> Iterator[tuple[str, str, str]]:
    """The triples of a Turtle text as N-Triples terms; what isn't Turtle is a ValueError."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not Turtle at {text[at : at + 40]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    prefixes: dict[str, str] = {}
    found: list[tuple[str, str, str]] = []
    place, blanks = 0, 0

    def take(*wanted: str) -> tuple[str, str]:
        nonlocal place
        kind, token = tokens[place]
        if wanted and kind not in wanted and token not in wanted:
            raise ValueError(f"{token or 'the end'} where {' or '.join(wanted)} should be")
        place += 1
        return kind, token

    def blank() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:genid-{blanks}"

    def iri(kind: str, token: str) -> str:
        if kind == "iri":
            return f"<{urljoin(base, re.sub(r'\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})', lambda m: chr(int(m[1] or m[2], 16)), token[1:-1])) if token != '<>' else base}>"
        prefix, _, rest = token.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"no prefix {prefix}:")
        return f"<{prefixes[prefix]}{re.sub(r'\\(.)', r'\1', rest)}>"

    def literal(kind: str, token: str) -> str:
        body = token[3:-3] if kind == "long" else token[1:-1]
        body = re.sub(r"""\\'""", "'", body).replace("\n", "\\n").replace("\r", "\\r")
        body = re.sub(r'(?<!\\)((?:\\\\)*)"', r'\1\\"', body)
        if tokens[place][0] == "lang":
            return f'"{body}"{take()[1]}'
        if tokens[place][0] == "type":
            take()
            return f'"{body}"^^{iri(*take("iri", "name"))}'
        return f'"{body}"'

    def term() -> str:
        kind, token = take()
        if kind in ("iri", "name"):
            return iri(kind, token)
        if kind in ("text", "long"):
            return literal(kind, token)
        if kind == "blank":
            return token
        if kind == "number":
            return f'"{token}"^^<{_XSD}{"double" if "e" in token.lower() else "decimal" if "." in token else "integer"}>'
        if kind == "bool":
            return f'"{token}"^^<{_XSD}boolean>'
        if token == "[":
            own = blank()
            if tokens[place][1] != "]":
                properties(own)
            take("]")
            return own
        if token == "(":
            items = []
            while tokens[place][1] != ")":
                items.append(term())
            take(")")
            nodes = [blank() for _ in items]
            for k, (node, item) in enumerate(zip(nodes, items, strict=True)):
                found.append((node, f"<{_RDF}first>", item))
                found.append((node, f"<{_RDF}rest>", nodes[k + 1] if k + 1 < len(nodes) else f"<{_RDF}nil>"))
            return nodes[0] if nodes else f"<{_RDF}nil>"
        raise ValueError(f"{token or 'the end'} where a term should be")

    def properties(subject: str) -> None:
        while True:
            kind, token = take("iri", "name", "a")
            predicate = f"<{_RDF}type>" if kind == "a" else iri(kind, token)
            while True:
                found.append((subject, predicate, term()))
                if tokens[place][1] != ",":
                    break
                take()
            while tokens[place][1] == ";":
                take()
            if tokens[place][1] in (".", "]") or tokens[place][0] == "end":
                return

    while tokens[place][0] != "end":
        if tokens[place][0] == "word":
            word = take()[1]
            if "prefix" in word.lower():
                name = take("name")[1]
                prefixes[name[:-1]] = iri(*take("iri"))[1:-1]
            else:
                base = iri(*take("iri"))[1:-1]
            if word.startswith("@"):
                take(".")
            continue
        own = tokens[place][1] == "["
        subject = term()
        if not (own and tokens[place][1] == "."):
            properties(subject)
        take(".")
        yield from found
        found.clear()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                for part in itertools.batched(triples(content.decode(), path), 10_000):
                    yield pa.RecordBatch.from_arrays([*(pa.array([t[k] for t in part], pa.string()) for k in range(3)), pa.array([path] * len(part), pa.string())], names=["s", "p", "o", "g"])
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from e


def read_turtle(spark: SparkSession, paths: str | list[str], graph: str | None = None) -> DataFrame:
    """`s, p, o, g` of Turtle files, each triple of a graph once. Without a graph each file is one, named by its path, which is also its base IRI. A file that is no Turtle is an error that names it."""
    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_rows, "s string, p string, o string, g string")
    named = rows.withColumn("g", F.lit(graph)) if graph else rows
    return named.select(apart(F.col("s"), F.col("g")).alias("s"), "p", apart(F.col("o"), F.col("g")).alias("o"), "g").distinct()
