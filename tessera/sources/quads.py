"""Quads from N-Triples files and from tables, and back."""

from __future__ import annotations

from collections.abc import Mapping

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.texts import escaped, unescaped

_IRI = r"<[^\x00-\x20<>\"{}|^`\\]*>"
_BLANK = r"_:[A-Za-z0-9_][A-Za-z0-9_.-]*"
_LITERAL = r'"(?:[^"\\\n\r]|\\.)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?'
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"


def apart(term: Column, graph: Column) -> Column:
    """A term whose blank label carries its graph, so that those of two graphs stay apart."""
    return F.when(term.startswith("_:"), F.concat(F.lit("_:"), F.sha2(graph, 256).substr(1, 12), F.lit("."), F.substring(term, 3, 1 << 20))).otherwise(term)


def read_ntriples(spark: SparkSession, path: str | list[str], graph: str | None = None) -> DataFrame:
    """`s, p, o, g` of N-Triples files, each triple of a graph once. Without a graph each file is one, named by its path. A line that is no triple is an error that names its file."""
    lines = spark.read.text(path).select("value", (F.lit(graph) if graph else F.col("_metadata.file_path")).alias("g")).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    line = F.when(F.col("value").rlike(_LINE), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple in "), F.col("g"), F.lit(": "), F.substring("value", 1, 200))))
    parts = lines.select(line.alias("line"), "g").select(*(F.regexp_extract("line", _LINE, i).alias(c) for i, c in enumerate("spo", 1)), "g")
    return parts.select(apart(F.col("s"), F.col("g")).alias("s"), "p", apart(F.col("o"), F.col("g")).alias("o"), "g").distinct()


def files(spark: SparkSession, folder: str, *, left_out: str = "a^", only: str = r"\.(?:nt|ttl)$") -> list[str]:
    """Paths of a folder's graph files, at any depth, in order; those that match `left_out` (what is built anew, say) aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.col("path").rlike(only) & ~F.col("path").rlike(left_out))
    return [r.path for r in found.orderBy("path").collect()]  # names of files only


def graphs(dump: DataFrame, names: list[str] | None = None) -> DataFrame:
    """`g, n_triples` of the graphs of a dump, or of the named ones."""
    kept = dump if names is None else dump.where(F.col("g").isin(names))
    return kept.groupBy("g").agg(F.count("*").alias("n_triples"))


def select_json(results: DataFrame, text: str, variables: list[str]) -> DataFrame:
    """A column of N-Triples terms for each variable, null where unbound, of query results in JSON: a row for each binding."""
    term = "struct<type:string,value:string,datatype:string,`xml:lang`:string>"
    rows = results.select(F.explode(F.from_json(F.col(text), f"struct<results:struct<bindings:array<map<string,{term}>>>>").results.bindings).alias("b"))

    def nt(x: Column) -> Column:
        quoted = F.concat(F.lit('"'), escaped(x["value"]), F.lit('"'))
        tail = F.when(x["xml:lang"].isNotNull(), F.concat(F.lit("@"), x["xml:lang"])).when(x["datatype"].isNotNull(), F.concat(F.lit("^^<"), x["datatype"], F.lit(">"))).otherwise("")
        return F.when(x["type"] == "uri", F.concat(F.lit("<"), x["value"], F.lit(">"))).when(x["type"] == "bnode", F.concat(F.lit("_:"), x["value"])).when(x["value"].isNotNull(), F.concat(quoted, tail))

    return rows.select(*(nt(F.try_element_at(F.col("b"), F.lit(v))).alias(v) for v in variables))


def ntriples(quads: DataFrame) -> DataFrame:
    """`value`, the sorted distinct lines, to be written with `.write.text`."""
    return quads.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).distinct().orderBy("value")


def quads_of(table: DataFrame, key: str, kind: str, graph: str, links: Mapping[str, str] | None = None) -> DataFrame:
    """Rows as quads: subject `<kind/key>`, a predicate for each other column, its value as a literal, or as `<other/value>` for the columns of `links`; nulls give no quad.

    Each column is a branch of a union with its predicate as a constant, so a pattern of one predicate scans one column and all other branches vanish from the plan.
    """
    links = links or {}
    text = lambda c: F.col(c).cast("string")
    subject = F.concat(F.lit(f"<{kind}/"), text(key), F.lit(">")).alias("s")
    found = None
    for c in (c for c in table.columns if c != key):
        term = F.concat(F.lit(f"<{links[c]}/"), text(c), F.lit(">")) if c in links else F.concat(F.lit('"'), escaped(text(c)), F.lit('"'))
        rows = table.where(F.col(c).isNotNull()).select(subject, F.lit(f"<{c}>").alias("p"), term.alias("o"), F.lit(graph).alias("g"))
        found = rows if found is None else found.unionByName(rows)
    return found


def value(term: Column, *, plain: bool = True) -> Column:
    """The lexical value of a literal, or the last part of an IRI of `quads_of`. plain: literals have no escapes; else they are undone."""
    lexical = F.regexp_extract(term, r'(?s)^"(.*)"', 1)
    return F.when(term.startswith('"'), lexical if plain else unescaped(lexical)).otherwise(F.regexp_extract(term, r"([^/<>]*)>$", 1))
