"""Shapes: checks of nodes' values and of how many they have."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


def value_violations(rows: DataFrame, node: str, checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """`node, constraint, value` for each value that fails a check, in one pass over the rows.

    checks: the constraint's name to the column it is about and the condition that holds for good values. A null value
    breaks none, as there is no value; a condition that can't be told of a value counts as broken.
    """
    failed = [
        F.when(F.col(column).isNotNull() & ~F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("constraint"), F.col(column).cast("string").alias("value")))
        for name, (column, holds) in checks.items()
    ]
    return rows.select(F.col(node).alias("node"), F.explode(F.array_compact(F.array(*failed))).alias("_v")).select("node", "_v.constraint", "_v.value")


def count_violations(nodes: DataFrame, values: DataFrame, node: str, *, least: int = 0, most: int | None = None) -> DataFrame:
    """`node, n` of the nodes whose distinct rows in `values` are fewer than `least` or more than `most`; values are made distinct and counted partially before they meet the nodes."""
    counts = values.distinct().groupBy(node).agg(F.count("*").alias("n"))
    found = nodes.select(node).distinct().join(counts, node, "left").select(F.col(node).alias("node"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return found.where((F.col("n") < least) | (F.col("n") > most if most is not None else F.lit(False)))


def targets(types: DataFrame, subclasses: DataFrame, wanted: str) -> DataFrame:
    """`node` of the nodes (`node, class`) of a class or of one below it; `subclasses` (`a, b`) has every class `a` below or equal to `b`, as a closure gives it."""
    below = subclasses.where(F.col("b") == wanted).select(F.col("a").alias("class"))
    return types.where(F.col("class") == wanted).select("node").unionByName(types.join(below, "class", "left_semi").select("node")).distinct()


def focus_nodes(graph: DataFrame, *, subjects_of: Sequence[str] = (), objects_of: Sequence[str] = (), nodes: Sequence[str] = ()) -> DataFrame:
    """`node` of the graph `s, p, o` that a shape targets: subjects and objects of predicates, and named nodes, each once."""
    found = graph.where(F.col("p").isin(list(subjects_of))).select(F.col("s").alias("node"))
    found = found.unionByName(graph.where(F.col("p").isin(list(objects_of))).select(F.col("o").alias("node")))
    if nodes:
        found = found.unionByName(graph.sparkSession.createDataFrame([(n,) for n in nodes], "node string"))
    return found.distinct()


def query_violations(nodes: DataFrame, rows: DataFrame, message: str) -> DataFrame:
    """`node, message` for each row that a constraint's query finds about a focus node (`node`). The message names the query's columns in braces; a column without a value is left as it is named."""
    text = F.lit("")
    for k, piece in enumerate(re.split(r"\{(\w+)\}", message)):
        text = F.concat(text, F.lit(piece) if k % 2 == 0 else F.coalesce(F.col(piece).cast("string"), F.lit("{" + piece + "}")))
    return rows.join(nodes.select("node").distinct(), "node", "left_semi").select("node", text.alias("message"))


def literal_checks(lex: Column, datatype: Column, *, datatypes: Sequence[str] = (), least_length: int | None = None, most_length: int | None = None, languages: Sequence[str] = (), lang: Column | None = None) -> Column:
    """Whether a literal has one of the datatypes, a length and one of the languages (or a part of one), as far as they are given."""
    holds = datatype.isin(list(datatypes)) if datatypes else F.lit(True)
    if least_length is not None:
        holds = holds & (F.length(lex) >= least_length)
    if most_length is not None:
        holds = holds & (F.length(lex) <= most_length)
    for n, wanted in enumerate(languages):
        fits = (F.lower(lang) == wanted.lower()) | F.startswith(F.lower(lang), F.lit(wanted.lower() + "-"))
        any_ = fits if n == 0 else any_ | fits
    return holds & any_ if languages else holds
