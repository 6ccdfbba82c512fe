"""Shapes compiled to one plan: all targets, one join with the values of all paths, and grouped counts.

Shapes are declared; their checks are a small table that is joined to the focus nodes, so a graph is read once for any number of shapes, and a shape more is rows more, not
a plan more. The checks of values are expressions over the columns of that table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
XSD_STRING, LANG_STRING = "http://www.w3.org/2001/XMLSchema#string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
#: Checks of all shapes; their table is broadcast.
MOST_CHECKS = 10_000


class Check(NamedTuple):
    """What the values of a path have to be: their number, datatype, kind (`iri`, `blank` or `literal`), written form, membership, and class. inverse: the values are the nodes that name the focus node."""

    path: str
    inverse: bool = False
    least: int | None = None
    most: int | None = None
    datatype: str | None = None
    kind: str | None = None
    pattern: str | None = None
    among: tuple[str, ...] | None = None
    of_class: str | None = None


class Shape(NamedTuple):
    """target: a `class` whose nodes are meant, the `subjects` or `objects` of a predicate, or one `node`."""

    target: str
    term: str
    checks: Sequence[Check]


def _kind(term: Column) -> Column:
    return F.when(F.startswith(term, F.lit("<")), "iri").when(F.startswith(term, F.lit("_:")), "blank").otherwise("literal")


def _datatype(term: Column) -> Column:
    named = F.regexp_extract(term, r'"\^\^<([^>]*)>$', 1)
    return F.when(_kind(term) == "literal", F.when(named != "", named).when(term.rlike(r'"@[A-Za-z0-9-]+$'), LANG_STRING).otherwise(XSD_STRING))


def _said(term: Column) -> Column:
    """What a pattern reads: a literal's text, or an IRI."""
    return F.when(_kind(term) == "literal", F.regexp_extract(term, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)).when(_kind(term) == "iri", F.regexp_extract(term, r"^<(.*)>$", 1))


def targets(graph: DataFrame, shapes: Mapping[str, Shape]) -> DataFrame:
    """`shape, focus` of all shapes: each triple is met with the shapes that its class or predicate is the target of."""
    spark = graph.sparkSession
    listed = F.broadcast(spark.createDataFrame([(name, s.target, s.term) for name, s in shapes.items()], "shape string, target string, term string"))
    rows = [
        graph.where(F.col("p") == TYPE).select(F.col("s").alias("focus"), F.lit("class").alias("target"), F.col("o").alias("term")),
        graph.select(F.col("s").alias("focus"), F.lit("subjects").alias("target"), F.col("p").alias("term")),
        graph.select(F.col("o").alias("focus"), F.lit("objects").alias("target"), F.col("p").alias("term")),
    ]
    of = {s.target for s in shapes.values()}
    found = spark.createDataFrame([(name, s.term) for name, s in shapes.items() if s.target == "node"], "shape string, focus string")
    for kind, part in zip(("class", "subjects", "objects"), rows, strict=True):
        if kind in of:
            found = found.unionByName(part.join(listed, ["target", "term"]).select("shape", "focus"))
    return found.distinct()


def violations(graph: DataFrame, shapes: Mapping[str, Shape]) -> DataFrame:
    """`shape, focus, path, constraint, value`: what breaks the shapes, the value null for numbers of values. Repeated triples count once; a graph without triples breaks only what is asked of single nodes.

    An IRI has no datatype and a blank node no written form, so both break such a check.
    """
    spark = graph.sparkSession
    checks = [(name, k, *c[:-2], list(c.among) if c.among is not None else None, c.of_class) for name, s in shapes.items() for k, c in enumerate(s.checks)]
    if len(checks) > MOST_CHECKS:
        raise ValueError(f"{len(checks)} checks are more than {MOST_CHECKS}")
    listed = spark.createDataFrame(checks, "shape string, number int, path string, inverse boolean, least int, most int, datatype string, kind string, pattern string, among array<string>, of_class string")
    graph = graph.select("s", "p", "o").distinct()
    asked = targets(graph, shapes).join(F.broadcast(listed), "shape")
    ends = graph.select(F.col("p").alias("path"), F.lit(False).alias("inverse"), F.col("s").alias("focus"), F.col("o").alias("value"))
    if any(c[3] for c in checks):
        ends = ends.unionByName(graph.select(F.col("p").alias("path"), F.lit(True).alias("inverse"), F.col("o").alias("focus"), F.col("s").alias("value")))
    ends = ends.join(F.broadcast(listed.select("path", "inverse").distinct()), ["path", "inverse"], "left_semi")
    met = asked.join(ends, ["focus", "path", "inverse"], "left")

    counted = met.groupBy("shape", "focus", "number", "path", "least", "most").agg(F.count("value").alias("n"))
    broken = F.array_compact(F.array(F.when(F.col("n") < F.col("least"), "least"), F.when(F.col("n") > F.col("most"), "most")))
    numbers = counted.select("shape", "focus", "path", F.explode(broken).alias("constraint"), F.lit(None).cast("string").alias("value"))

    value = F.col("value")
    wrong = lambda column, right: F.when(F.col(column).isNotNull() & ~F.coalesce(right, F.lit(False)), column)
    of_value = F.array_compact(F.array(wrong("datatype", _datatype(value) == F.col("datatype")), wrong("kind", _kind(value) == F.col("kind")), wrong("pattern", F.rlike(_said(value), F.col("pattern"))), wrong("among", F.array_contains("among", value))))
    held = met.where(value.isNotNull())
    values = held.select("shape", "focus", "path", F.explode(of_value).alias("constraint"), "value")
    found = numbers.unionByName(values)
    if any(c[-1] for c in checks):
        classes = graph.where(F.col("p") == TYPE).select(F.col("s").alias("value"), F.col("o").alias("of_class"))
        other = held.where("of_class is not null").join(classes, ["value", "of_class"], "left_anti")
        found = found.unionByName(other.select("shape", "focus", "path", F.lit("of_class").alias("constraint"), "value"))
    return found.distinct()


def broken_nodes(graph: DataFrame, shapes: Mapping[str, Shape]) -> DataFrame:
    """`shape, n_focus, n_broken`: how many nodes each shape is about, and how many of them break it."""
    about = targets(graph.select("s", "p", "o").distinct(), shapes)
    wrong = violations(graph, shapes).select("shape", "focus").distinct().withColumn("broken", F.lit(1))
    return about.join(wrong, ["shape", "focus"], "left").groupBy("shape").agg(F.count("*").alias("n_focus"), F.count("broken").alias("n_broken"))
