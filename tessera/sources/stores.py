"""Quads kept as tables: terms, states as of a step, removals, and copies that are checked when read again."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def term_table(quads: DataFrame) -> DataFrame:
    """`nt, kind, lex, datatype, lang` of each term once: kind 1 is a blank node, 2 an IRI, 3 a literal; a literal without a datatype is a string."""
    terms = quads.select(F.explode(F.array("s", "p", "o")).alias("nt")).distinct()
    nt = F.col("nt")
    kind = F.when(nt.startswith("_:"), 1).when(nt.startswith("<"), 2).otherwise(3)
    lang = F.nullif(F.lower(F.regexp_extract("nt", r'^".*"@([A-Za-z0-9-]+)$', 1)), F.lit(""))
    typed = F.nullif(F.regexp_extract("nt", r'^".*"\^\^<([^>]*)>$', 1), F.lit(""))
    lex = F.when(kind == 2, F.regexp_extract("nt", "^<(.*)>$", 1)).when(kind == 3, F.regexp_extract("nt", r'^"((?:[^"\\]|\\.)*+)"', 1)).otherwise(F.substring("nt", 3, 1 << 20))
    datatype = F.when(kind == 3, F.when(lang.isNotNull(), "langString").otherwise(F.coalesce(typed, F.lit("string"))))
    return terms.select("nt", kind.alias("kind"), lex.alias("lex"), datatype.alias("datatype"), lang.alias("lang"))


def order_key(term: F.Column) -> F.Column:
    """A key that sorts unbound terms first, then blank nodes, IRIs and literals, each by code point."""
    kind = F.when(term.isNull(), "0").when(term.startswith("_:"), "1").when(term.startswith("<"), "2").otherwise("3")
    return F.concat(kind, F.coalesce(term, F.lit("")))


def as_of(quads: DataFrame, steps: DataFrame, step: int) -> DataFrame:
    """The quads of the graphs that `steps` (`g, step`) wrote up to a step."""
    return quads.join(steps.where(F.col("step") <= step).select("g"), "g", "left_semi").select(*quads.columns)


def without_graphs(quads: DataFrame, graphs: DataFrame) -> DataFrame:
    """The quads of other graphs than those of `graphs` (`g`)."""
    return quads.join(graphs.select("g"), "g", "left_anti").select(*quads.columns)


def without_subjects(quads: DataFrame, subjects: DataFrame) -> DataFrame:
    """The quads but those of the subjects (`s, g`) in that graph."""
    return quads.join(subjects.select("s", "g"), ["s", "g"], "left_anti").select(*quads.columns)


def overlaid(local: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    """The local rows, and the packed ones whose key no local row has."""
    return local.unionByName(packed.join(local.select(key), key, "left_anti"))


def _graph_sums(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.xxhash64("s", "p", "o").cast("decimal(38,0)")).cast("string").alias("checksum"))


def dump(quads: DataFrame, path: str) -> None:
    """Quads as Parquet, and beside them each graph's count and checksum."""
    quads.select("s", "p", "o", "g").write.parquet(f"{path}/quads")
    _graph_sums(quads.sparkSession.read.parquet(f"{path}/quads")).write.parquet(f"{path}/graphs")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The quads of a copy; a copy that has lost, gained or changed quads is an error."""
    quads, told = spark.read.parquet(f"{path}/quads"), spark.read.parquet(f"{path}/graphs")
    wrong = told.exceptAll(_graph_sums(quads)).unionByName(_graph_sums(quads).exceptAll(told)).select("g").limit(1).collect()
    if wrong:
        raise ValueError(f"the copy of graph {wrong[0].g!r} isn't whole")
    return quads
