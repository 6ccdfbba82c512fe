"""Differences, keyed refresh, preferences, fallbacks, reference tables and agreement."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from . import carry
from .lineage import unused


def multiset_difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """`side, n` and the columns: rows that `expected` has more often (missing) and `found` has more often (unexpected). One grouping of the tagged union."""
    columns, sign = expected.columns, unused(expected, "_sign")
    both = expected.withColumn(sign, F.lit(1)).unionByName(found.select(*columns).withColumn(sign, F.lit(-1)))
    counted = both.groupBy(*columns).agg(F.sum(sign).alias(sign)).where(F.col(sign) != 0)
    return counted.select(F.when(F.col(sign) > 0, "missing").otherwise("unexpected").alias("side"), *columns, F.abs(sign).alias("n"))


def holds(asked: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`asked` with `held`, whether the other table has its key."""
    there = unused(asked, "_there")
    met = asked.join(held.select(*keys).distinct().withColumn(there, F.lit(True)), list(keys), "left")
    return met.select(*asked.columns, F.coalesce(there, F.lit(False)).alias("held"))


def replaced(base: DataFrame, fresh: DataFrame, keys: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """`base` with the rows of the touched keys (those of `fresh` by default) replaced by the rows of `fresh`: a keyed refresh of a derived table."""
    return base.join((fresh if touched is None else touched).select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def refreshed_files(fresh: DataFrame, path: str, by: str) -> None:
    """Write `fresh` over the parts of a table, kept in folders by a column, that it has rows of; all other folders stay as they are."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def rank_of(source: Column, preference: Sequence[str]) -> Column:
    """The place of a source in a preference; what isn't named comes after all that is."""
    if not preference:
        return F.lit(0)
    ranked = F.create_map(*(F.lit(x) for i, s in enumerate(preference) for x in (s, i)))
    return F.coalesce(F.try_element_at(ranked, source), F.lit(len(preference)))


def preferred(rows: DataFrame, key: Sequence[str], source: str, preference: Sequence[str]) -> DataFrame:
    """Each key's row of the first source in the preference's order, then by the source's name."""
    place = unused(rows, "_place")
    order = [rank_of(F.col(source), preference).asc(), F.col(source).asc()]
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(place) == 1).drop(place)


def first_step(*steps: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the earliest step that has any for a key, the first of them in the order: `step` counts from 0."""
    found = None
    for i, rows in enumerate(steps):
        rows = rows.withColumn("step", F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    place = unused(found, "_place")
    window = Window.partitionBy(*key).orderBy("step", *order)
    return found.withColumn(place, F.row_number().over(window)).where(F.col(place) == 1).drop(place)


def class_walk(own: DataFrame, maps: DataFrame, precise: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of codes, and the relations withheld.

    own: rows `code, relation, class`; maps: `form, ingredient`; precise: `form` of the forms that a version states precisely. First a code's own rows (step 0); for relations
    it has none of, those of its forms that are precise (1), then those of its ingredient (2). One row a code, relation and class: the least step, then the least `through`.
    Withheld are relations that a code reaches by none of these while another form of its ingredient bears them.
    """
    codes = maps.select(F.col("form").alias("code")).unionByName(maps.select(F.col("ingredient").alias("code"))).unionByName(own.select("code")).distinct()
    direct = codes.join(own, "code").select("code", "relation", "class", F.lit(0).alias("step"), F.col("code").alias("through"))
    stated = maps.join(precise.select("form").distinct(), "form", "left_semi")
    forms = stated.join(own.withColumnRenamed("code", "form"), "form").select(F.col("ingredient").alias("code"), "relation", "class", F.lit(1).alias("step"), F.col("form").alias("through"))
    above = stated.join(own.withColumnRenamed("code", "ingredient"), "ingredient").select(F.col("form").alias("code"), "relation", "class", F.lit(2).alias("step"), F.col("ingredient").alias("through"))
    has = direct.select("code", "relation").distinct()
    walked = direct.unionByName(forms.unionByName(above).join(has, ["code", "relation"], "left_anti"))
    found = walked.groupBy("code", "relation", "class").agg(F.min(F.struct("step", "through")).alias("_f")).select("code", "relation", "class", "_f.step", "_f.through")
    bearing = stated.join(own.withColumnRenamed("code", "form"), "form").select("ingredient", "relation").distinct()  # a form that alone bears a relation reaches it itself, so it isn't withheld
    borne = stated.join(bearing, "ingredient").select(F.col("form").alias("code"), "relation").distinct()
    return found, borne.join(found.select("code", "relation").distinct(), ["code", "relation"], "left_anti")


def search(names: DataFrame, code: str, name: str, text: str, limit: int = 50, after: object | None = None) -> DataFrame:
    """Rows whose code equals the text or whose name contains it, letter case apart; blank text finds all; the first `limit` by code, after a code for the next page."""
    wanted = text.strip().lower()
    found = names if not wanted else names.where((F.lower(F.col(code).cast("string")) == wanted) | F.contains(F.lower(name), F.lit(wanted)))
    return (found if after is None else found.where(F.col(code) > F.lit(after))).orderBy(code).limit(limit)


def code_named(rows: DataFrame, notation: str, series: str, preference: Sequence[str]) -> DataFrame:
    """For each notation the row of the first series that holds it."""
    return preferred(rows, [notation], series, preference)


def about(codes: DataFrame, preference: Sequence[str], **attributes: DataFrame) -> DataFrame:
    """`code` with a column for each attribute (rows `code, series, value`): the values, sorted, that the first series by preference gives, null where none does."""
    found = codes.select("code").distinct()
    for name, rows in attributes.items():
        by_series = rows.groupBy("code", "series").agg(F.array_sort(F.collect_set("value")).alias("_values"))
        first = by_series.groupBy("code").agg(F.min_by("_values", F.struct(rank_of(F.col("series"), preference), "series")).alias(name))
        found = found.join(first, "code", "left")
    return found


def facts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """`code, direction, series, predicate, value` of everything that rows `subject, predicate, object, series` say of the codes, and of what says something of them."""
    said = asked.join(rows.withColumnRenamed("subject", "code"), "code").select("code", F.lit("says").alias("direction"), "series", "predicate", F.col("object").alias("value"))
    told = asked.join(rows.withColumnRenamed("object", "code"), "code").select("code", F.lit("is named by").alias("direction"), "series", "predicate", F.col("subject").alias("value"))
    return said.unionByName(told).distinct()


def listing(rows: DataFrame, labels: Sequence[str], maps: str) -> DataFrame:
    """`code, names, maps_to` of rows `subject, predicate, object`: the labels in small letters, sorted and joined by line ends, and the sorted codes it maps to."""
    label, mapped = F.col("predicate").isin(*labels), F.col("predicate") == maps
    found = rows.groupBy(F.col("subject").alias("code")).agg(F.array_sort(F.collect_set(F.when(label, F.lower("object")))).alias("names"), F.array_sort(F.collect_set(F.when(mapped, F.col("object")))).alias("maps_to"))
    return found.select("code", F.array_join("names", "\n").alias("names"), "maps_to")


def classified(asked: DataFrame, held: DataFrame, covers: DataFrame, preference: Sequence[str]) -> DataFrame:
    """What the classification series say of variants: `variant, outcome, series, subject`.

    asked: `variant, gene, code`, a row for each code of a variant; held: `series, code, subject`; covers: `series, gene`. A series finds a variant if its codes lead to exactly one subject. With a gene, the first series that covers it answers,
    else the first that names no gene and finds it; a gene that series state but none covers is `not covered`. Without a gene the first series that finds it answers.
    """
    variants = asked.groupBy("variant").agg(F.max("gene").alias("gene"))
    series = held.select("series").unionByName(covers.select("series")).distinct()
    met = asked.join(held, "code").groupBy("variant", "series").agg(F.countDistinct("subject").alias("n"), F.min("subject").alias("subject")).where("n = 1").drop("n")
    named = covers.select("series").distinct().withColumn("states", F.lit(True))
    pairs = variants.crossJoin(F.broadcast(series.join(named, "series", "left").withColumn("place", rank_of(F.col("series"), preference))))  # a few series
    pairs = pairs.join(covers.withColumn("covers", F.lit(True)), ["series", "gene"], "left").join(met, ["variant", "series"], "left")
    pairs = pairs.select("variant", "gene", "series", "place", "subject", F.coalesce("covers", F.lit(False)).alias("covers"), F.coalesce("states", F.lit(False)).alias("states"))
    first = lambda when: F.min(F.when(when, F.struct("place", "series", "subject")))
    found = pairs.groupBy("variant", "gene").agg(first(F.col("covers")).alias("covering"), first(F.col("subject").isNotNull()).alias("any"), first(F.col("subject").isNotNull() & ~F.col("states")).alias("unnamed"), first(F.col("states")).alias("stating"), first(F.lit(True)).alias("first"))
    chosen = F.when(F.col("gene").isNull(), F.coalesce("any", "first")).otherwise(F.coalesce("covering", "unnamed", "stating", "first"))
    uncovered = F.col("gene").isNotNull() & F.col("covering").isNull() & F.col("unnamed").isNull() & F.col("stating").isNotNull()
    outcome = F.when(uncovered, "not covered").when(chosen.subject.isNotNull(), "rows").otherwise("not found")
    return found.select("variant", outcome.alias("outcome"), chosen.series.alias("series"), F.when(outcome == "rows", chosen.subject).alias("subject"))


def pivoted(rows: DataFrame, fields: dict[str, str], labels: DataFrame) -> DataFrame:
    """`subject` with a column for each field, the least value of its predicate, and `<field>_label`, the value's label (`code, label`), else the value itself."""
    found = rows.groupBy("subject").agg(*(F.min(F.when(F.col("predicate") == p, F.col("object"))).alias(f) for f, p in fields.items()))
    for f in fields:
        found = found.join(labels.select(F.col("code").alias(f), F.col("label").alias("_label")), f, "left").withColumn(f"{f}_label", F.coalesce("_label", f)).drop("_label")
    return found


def panel_rows(nested: DataFrame, members: DataFrame, results: DataFrame) -> DataFrame:
    """`panel, member, result`: of every member a panel nests, at any depth, the results; a required member without one keeps a row.

    nested: `a, b`, the closure of panels' members; members: `member, required`; results: `member, result`.
    """
    each = nested.select(F.col("a").alias("panel"), F.col("b").alias("member")).join(members.groupBy("member").agg(F.max("required").alias("required")), "member")
    return each.join(results, "member", "left").where(F.col("result").isNotNull() | F.col("required")).select("panel", "member", "result")


def by_system(codes: DataFrame, code: str, spaces: Sequence[str]) -> DataFrame:
    """`codes` with `iri`: a row for each URI space that a code may stand in; a code that is an IRI already stays one row."""
    every = F.when(F.col(code).rlike("^[a-z][a-z0-9+.-]*:"), F.array(F.col(code))).otherwise(F.array(*(F.concat(F.lit(s), F.col(code)) for s in spaces)))
    return codes.withColumn("iri", F.explode(every))


def differing(reports: DataFrame, rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The reports (`report, row, origin`) of held rows (`row, origin`) on which the version's verdict (`report, row, origin, verdict`) is that it differs."""
    held = reports.join(rows.select("row", "origin").distinct(), ["row", "origin"], "left_semi")
    return held.join(verdicts.where("verdict = 'differs'").select("report", "row", "origin").distinct(), ["report", "row", "origin"], "left_semi")


def unheld(named: DataFrame, held: DataFrame, version: str) -> DataFrame:
    """The versions that are named but not held."""
    return named.select(version).distinct().join(held.select(version), version, "left_anti")


def too_few(nodes: DataFrame, key: str, values: DataFrame, least: int) -> DataFrame:
    """`key, n` of the nodes with fewer than `least` rows in `values`: a minimum-count shape."""
    counts = values.groupBy(key).agg(F.count("*").alias("n"))
    return nodes.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n")).where(F.col("n") < least)


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """`n, agreement, kappa` of two judges' verdicts, of any number of kinds; kappa is null where chance alone agrees fully. One row a pair of verdicts decides."""
    cells = rows.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().groupBy("a", "b").count()
    total = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("same"))
    of = lambda side: cells.groupBy(F.col(side).alias("verdict")).agg(F.sum("count").alias(side))
    chance = of("a").join(of("b"), "verdict").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("chance"))
    r = total.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("agreement"), (F.coalesce("chance", F.lit(0.0)) / F.col("n") / F.col("n")).alias("chance"))
    return r.select(F.coalesce("n", F.lit(0)).alias("n"), "agreement", F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def went_back(states: DataFrame, record: Sequence[str], order: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """The states with a value below an earlier one of the same record, with the highest `before`. bucket: a column that never falls in the order, such as the month; a long record is many tasks."""
    return carry.before(states, record, order, bucket, F.col(value), "before").where(F.col("before") > F.col(value))
