"""Indexes of codes, mappings, set fingerprints, handles and what is named but not described.

Every index is a table of rows, never a list per code: a code that a third of all rows have stays spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .lineage import unused

#: Fewest digits of a handle.
LEAST_DIGITS = 8


def inverted(rows: DataFrame, code: str, subject: str) -> DataFrame:
    """`code, subject` once each. Written after `by_range`, a reader skips the files of other codes."""
    return rows.select(F.col(code).alias("code"), F.col(subject).alias("subject")).where("code is not null and subject is not null").distinct()


def by_range(index: DataFrame) -> DataFrame:
    """An index in the order of its codes and subjects, to be written; a frequent code spans several files."""
    return index.repartitionByRange("code", "subject").sortWithinPartitions("code", "subject")


def inverse_mapping(rows: DataFrame, source: str, target: str, precise: str | None = None) -> DataFrame:
    """`target, source, precise` of each mapping once, turned round; a mapping is precise if any row says so."""
    said = F.lit(False) if precise is None else F.coalesce(F.col(precise), F.lit(False))
    named = rows.select(F.col(target).alias("target"), F.col(source).alias("source"), said.alias("precise"))
    return named.where("target is not null and source is not null").groupBy("target", "source").agg(F.max("precise").alias("precise"))


def fingerprint(rows: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """`n, fingerprint` of the distinct texts of each group, whatever their order: the sum of the first six bytes of their SHA-256.

    Texts are made distinct by their digests and summed partially before any row of a group moves.
    """
    digests = rows.where(F.col(text).isNotNull()).select(*by, F.sha2(text, 256).alias("_digest")).distinct()
    number = F.conv(F.substring("_digest", 1, 12), 16, 10).cast("decimal(20,0)")
    return digests.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def resolved(asked: DataFrame, handle: str, held: DataFrame, digits: str) -> DataFrame:
    """`asked` with the columns of the one row whose digits start with the handle; handles of none, of several rows or too short are left out.

    The first digits are the join's key, so no handle meets all rows.
    """
    held = held.select(*(F.col(c) for c in held.columns if c != handle))
    key, n = unused(held, "_key"), unused(held, "_n")
    first = lambda c: F.substring(c, 1, LEAST_DIGITS)
    wanted = asked.select(handle).where(F.length(handle) >= LEAST_DIGITS).distinct().withColumn(key, first(handle))
    met = wanted.join(held.withColumn(key, first(digits)), key).where(F.startswith(F.col(digits), F.col(handle))).drop(key)
    others = [c for c in met.columns if c != handle]
    one = met.groupBy(handle).agg(F.count("*").alias(n), *(F.min(c).alias(c) for c in others)).where(F.col(n) == 1).drop(n)
    return asked.join(one, handle)


def undescribed(quads: DataFrame) -> DataFrame:
    """`name` of the objects that are IRIs and no quad's subject."""
    named = quads.where("startswith(o, '<')").select(F.col("o").alias("name")).distinct()
    return named.join(quads.select(F.col("s").alias("name")), "name", "left_anti")


def missing_references(resources: DataFrame, name: str, json: str) -> DataFrame:
    """`name`: every `reference` of the JSON texts, at any depth, that isn't a name of `resources`."""
    found = F.regexp_extract_all(F.col(json), F.lit(r'"reference"\s*:\s*"((?:[^"\\]|\\.)+)"'), F.lit(1))
    asked = resources.select(F.explode(found).alias("name")).distinct()
    return asked.join(resources.select(F.col(name).alias("name")), "name", "left_anti")


def per_kind(rows: DataFrame, source: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """`source`, a count for each of the kinds, and `other` for all else: one partial aggregation, no pivot of unknown width."""
    counts = [F.count_if(F.col(kind).eqNullSafe(k)).alias(k) for k in kinds]
    return rows.groupBy(source).agg(*counts, F.count_if(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False))).alias("other"))
