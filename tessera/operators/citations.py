"""Checks of what a reply cites, of what it says is absent, and of its own references."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import terms


def check_citations(claims: DataFrame, fields: DataFrame) -> DataFrame:
    """`citation, verdict, missing, found_at` of claims `citation, cite, line, kind, given` against fields `cite, line, kind, said`.

    A claimed field holds if the record at the cited line says it, letter case and spaces apart. Verdicts: `ok`, `nothing to check`, `no such record`, `not at that line` (other lines of the document say all of it: `found_at`), `says otherwise`.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    claims = claims.select("citation", "cite", "line", "kind", plain(F.col("given")).alias("given")).distinct()
    said = fields.select("cite", F.col("line").alias("at"), "kind", plain(F.col("said")).alias("given")).distinct()
    wanted = claims.groupBy("citation", "cite", "line").agg(F.count("given").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    met = claims.join(said, ["cite", "kind", "given"]).groupBy("citation", "at").agg(F.countDistinct("kind", "given").alias("held"), F.collect_set("kind").alias("has"))
    lines = wanted.join(met, "citation", "left")
    here = F.col("at") == F.col("line")
    found = lines.groupBy("citation", "cite", "line", "n", "kinds").agg(
        F.max(F.when(here, F.col("held"))).alias("held"),
        F.flatten(F.collect_set(F.when(here, F.col("has")))).alias("has"),
        F.array_sort(F.collect_set(F.when(~here & (F.col("held") == F.col("n")), F.col("at")))).alias("found_at"),
    )
    records = said.select("cite", F.col("at").alias("line")).distinct().withColumn("there", F.lit(True))
    all_ = found.join(records, ["cite", "line"], "left")
    verdict = F.when(F.col("n") == 0, "nothing to check").when(F.col("there").isNull(), "no such record").when(F.coalesce("held", F.lit(0)) == F.col("n"), "ok").when(F.size("found_at") > 0, "not at that line").otherwise("says otherwise")
    return all_.select("citation", verdict.alias("verdict"), F.when(verdict.isin("ok", "nothing to check", "no such record"), F.array().cast("array<string>")).otherwise(F.array_except("kinds", "has")).alias("missing"), F.when(verdict == "not at that line", F.col("found_at")).otherwise(F.slice("found_at", 1, 0)).alias("found_at"))


def counts_against(text: Column, code: str | None, term: str | None, after: str | None) -> Column:
    """Whether a text mentions what is said to be absent: it is dated on or after the day, or has no date."""
    said = F.lit(False)
    if code:
        said = said | terms.mentions_code(text, code)
    if term and term.strip():
        said = said | F.contains(F.lower(text), F.lit(term.lower()))
    latest = terms.latest_date(text)
    return said & (F.lit(True) if after is None else latest.isNull() | (latest >= F.lit(after)))


def check_absences(absences: DataFrame, calls: DataFrame) -> DataFrame:
    """`absence, backed, reason` of absences `absence, looked_for, coverage, query` (nulls where not said) against calls `query, ok, whole, holds`.

    An absence is backed if its query ran and answered, nothing in an answer matches, and an answer is whole.
    """
    ran = calls.groupBy("query").agg(F.max("ok").alias("ok"), F.max(F.col("ok") & F.col("holds")).alias("holds"), F.max(F.col("ok") & F.col("whole")).alias("whole"))
    met = absences.join(ran, "query", "left")
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    reason = (
        F.when(empty("looked_for"), "nothing to look for")
        .when(empty("coverage"), "no coverage")
        .when(F.col("query").isNull(), "no query")
        .when(F.col("ok").isNull(), "query not run")
        .when(~F.col("ok"), "query refused")
        .when(F.col("holds"), "query found it")
        .when(~F.col("whole"), "query cut short")
    )
    return met.select("absence", reason.isNull().alias("backed"), reason.alias("reason"))


def check_records_absences(absences: DataFrame, sources: DataFrame, files: DataFrame, read: DataFrame, holding: DataFrame) -> DataFrame:
    """`absence, backed, reason, files` of absences `absence` with the sources they name (`absence, file`), all `files`, those `read`, and those `holding` what is absent (`absence, file`).

    Sources that leave files out, weren't read or hold it back nothing; the reason names the first of these and its files, sorted. An absence that names no source means all files.
    """
    listed = lambda c: F.array_sort(F.collect_set(c))
    unread = lambda df: df.join(read.select("file"), "file", "left_anti")
    whole = files.agg(listed("file").alias("all")).crossJoin(unread(files).agg(listed("file").alias("all_unread")))  # one row, as long as the longest list of the result
    own = sources.groupBy("absence").agg(F.collect_set("file").alias("own"))
    own = own.join(unread(sources).groupBy("absence").agg(listed("file").alias("own_unread")), "absence", "left")
    held = holding.join(sources, ["absence", "file"], "left_semi").groupBy("absence").agg(listed("file").alias("own_held"))
    all_held = holding.join(files.select("file"), "file", "left_semi").groupBy("absence").agg(listed("file").alias("all_held"))
    met = absences.select("absence").join(own, "absence", "left").join(held, "absence", "left").join(all_held, "absence", "left").crossJoin(F.broadcast(whole))
    names = F.col("own").isNotNull()
    some = lambda c: F.when(F.size(c) > 0, c)
    left = some(F.when(names, F.array_except("all", "own")))
    not_read, holds = (some(F.when(names, F.col(f"own_{c}")).otherwise(F.col(f"all_{c}"))) for c in ("unread", "held"))
    reason = F.when(left.isNotNull(), "sources leave out").when(not_read.isNotNull(), "source not read").when(holds.isNotNull(), "records hold it")
    return met.select("absence", reason.isNull().alias("backed"), reason.alias("reason"), F.coalesce(left, not_read, holds, F.array().cast("array<string>")).alias("files"))


def check_references(items: DataFrame, references: DataFrame) -> DataFrame:
    """`item, fault` where a reply's numbering is wrong: an item number given twice, a reference to none, an item nothing refers to. items: `item`; references: `item`."""
    numbers = items.groupBy("item").count()
    twice = numbers.where("count > 1").select("item", F.lit("given twice").alias("fault"))
    none = references.select("item").distinct().join(numbers, "item", "left_anti").select("item", F.lit("no such item").alias("fault"))
    return twice.unionByName(none).unionByName(numbers.select("item").join(references.select("item").distinct(), "item", "left_anti").select("item", F.lit("not referred to").alias("fault")))


def per_arm(verdicts: DataFrame, arm: str, verdict: str) -> DataFrame:
    """`arm, verdict, n`: how often each arm got each verdict."""
    return verdicts.groupBy(arm, verdict).agg(F.count("*").alias("n"))
