"""Filing of matches in the order of arrival, batch by batch, and the upkeep of what was filed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .entries import components
from .lineage import stored


def file_batch(arrived: DataFrame, matches: DataFrame, entries: DataFrame, different: DataFrame) -> DataFrame:
    """`record, other`: the Sames that a batch of newly arrived records is filed with.

    arrived: `record`; matches: `a, b` in any order, of which at least one record arrived in the batch and none later; entries: `record, entry` as of the batch before, a record without one standing for itself; different: pairs `a, b` judged
    different. Of the records that a new one matches, each entry gives the least, preferring one not judged different from it. With batches of one record this is filing in strict order of arrival.
    """
    both = matches.select("a", "b").unionByName(matches.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    mine = both.join(arrived.select(F.col("record").alias("a")), "a", "left_semi")
    apart = different.select("a", "b").unionByName(different.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("_apart", F.lit(True))
    known = mine.join(entries.select(F.col("record").alias("b"), "entry"), "b", "left").join(apart, ["a", "b"], "left")
    return file_known(known.select("a", "b", "entry", F.coalesce("_apart", F.lit(False)).alias("apart")))


def file_known(matches: DataFrame) -> DataFrame:
    """`record, other` as `file_batch` files them, of matches `a, b` from a newly arrived record that bring the other's `entry` (null: itself) and whether the two are judged different (`apart`, never null).

    Both may come in any number. Rows are only counted into the least ones of an entry where they arise, so none are shuffled as pairs.
    """
    best = matches.groupBy("a", F.coalesce("entry", "b").alias("_entry")).agg(F.min(F.when(~F.col("apart"), F.col("b"))).alias("_free"), F.min("b").alias("_any"))
    return best.select(F.col("a").alias("record"), F.coalesce("_free", "_any").alias("other"))


def pairs_of(sames: DataFrame, different: DataFrame) -> DataFrame:
    """`a, b` joined by Sames (`same, member`) as Different pairs (`a, b`) split them: a Same without such a pair links each member with the least; else every pair that isn't different is a link.

    Only Sames that hold a Different are paired member by member.
    """
    members = sames.select("same", "member").distinct()
    one, two = members.select("same", F.col("member").alias("a")), members.select("same", F.col("member").alias("b"))
    apart = different.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    split = apart.join(one, "a").join(two, ["same", "b"]).select("same").distinct()
    least = members.groupBy("same").agg(F.min("member").alias("a"))
    plain = two.join(split, "same", "left_anti").join(least, "same").where("a <> b").select("a", "b")
    paired = one.join(split, "same", "left_semi").join(two, "same").where("a < b").select("a", "b").distinct().join(apart, ["a", "b"], "left_anti")
    return plain.unionByName(paired).distinct()


def entries_as_of(records: DataFrame, sames: DataFrame, different: DataFrame, moment: object) -> DataFrame:
    """`record, entry` among the records (`record, arrived`) that arrived before a moment, by the Sames whose latest member did too: the least record each is joined with."""
    there = records.where(F.col("arrived") < F.lit(moment)).select("record")
    late = sames.join(there.withColumnRenamed("record", "member"), "member", "left_anti").select("same").distinct()
    found = components(pairs_of(sames.join(late, "same", "left_anti"), different))
    return there.join(found, there.record == found.node, "left").select("record", F.coalesce("root", "record").alias("entry"))


def still_joined(sames: DataFrame, current: DataFrame) -> DataFrame:
    """`same` of the stale Sames (`same, member`) of which one member is joined with every other by the current pairs (`a, b`).

    A member in fewer pairs than its Same has other members can't be; pairs are counted where they arise, and only those of the members that are left are shuffled.
    """
    members = sames.select("same", "member").distinct()
    sizes = members.groupBy("same").agg((F.count("*") - 1).alias("others"))
    held = current.select(F.explode(F.array("a", "b")).alias("member")).groupBy("member").agg(F.count("*").alias("_held"))
    able = stored(members.join(sizes, "same").join(held, "member").where("_held >= others").select(F.col("member").alias("a")).distinct())
    both = current.select("a", "b").join(able, "a", "left_semi").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")).join(able, "a", "left_semi")).distinct()
    met = members.withColumnRenamed("member", "a").join(both, "a").join(members.withColumnRenamed("member", "b"), ["same", "b"])
    reach = met.groupBy("same", "a").agg(F.count("*").alias("n"))
    return reach.join(sizes, "same").where("n = others").select("same").distinct()


def to_recheck(judgments: DataFrame, current: DataFrame) -> DataFrame:
    """The judgments (`judgment, rule, version, member`) of versions that are no longer current (`rule, version`) and still have two members or more."""
    stale = judgments.join(current.select("rule", "version"), ["rule", "version"], "left_anti")
    return stale.groupBy("judgment", "rule").agg(F.countDistinct("member").alias("members")).where("members >= 2").select("judgment", "rule", "members")


def no_longer_reached(asserted: DataFrame, current: DataFrame) -> DataFrame:
    """The judgments asserted (`judgment, hash`) under an earlier hash of the rules, but not under the current ones (`hash`)."""
    now = asserted.join(current.select("hash"), "hash", "left_semi").select("judgment")
    return asserted.join(current.select("hash"), "hash", "left_anti").select("judgment").distinct().join(now, "judgment", "left_anti")


def findings(pairs: DataFrame, rule: str) -> DataFrame:
    """`name, a, b`: one finding for each pair, whichever way round it was found, named by the digest of the rule and both records."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return once.select(F.sha2(F.concat_ws(" ", F.lit(rule), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("name"), "a", "b")


def fresh(joins: DataFrame, before: DataFrame) -> DataFrame:
    """The joins (`a, b`) of a new table version that the old one didn't make."""
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return order(joins).join(order(before), ["a", "b"], "left_anti")


def to_retract(judgments: DataFrame, wrong: DataFrame, line: DataFrame) -> DataFrame:
    """`judgment` of those made by wrong rules (`hash`) that stand on the line of versions (`hash`)."""
    return judgments.join(wrong.join(line, "hash", "left_semi"), "hash", "left_semi").select("judgment").distinct()


def checked_rules(rules: DataFrame) -> DataFrame:
    """`rules` (`term, justification, text, hash`) if each has one row, a justification of its own and the hash of its text; otherwise reading them is an error that names the first that hasn't."""
    counted = rules.groupBy("term").agg(F.count("*").alias("_rows")).join(rules, "term").join(rules.groupBy("justification").agg(F.count("*").alias("_own")), "justification")
    wrong = F.when(F.col("_rows") > 1, "several rows").when(F.col("_own") > 1, "a justification of another rule").when(F.sha2("text", 256) != F.col("hash"), "another hash than its text has")
    checked = F.when(wrong.isNull(), F.col("term")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("rule"), "term", F.lit("has"), wrong)))
    return counted.select(checked.alias("term"), "justification", "text", "hash")


def refused(records: DataFrame) -> DataFrame:
    """`record, reason` of records (`record, version, first_revision, arrived`) that can't be matched: no version, no first revision, or a time of arrival without a zone."""
    reason = F.when(F.col("version").isNull(), "no version").when(F.col("first_revision").isNull(), "no first revision").when(~F.coalesce(F.col("arrived").rlike(r"(?:Z|[+-]\d\d:\d\d)$"), F.lit(False)), "no zoned time")
    return records.withColumn("reason", reason).where("reason is not null").select("record", "reason")


def taken(acts: DataFrame) -> DataFrame:
    """`record` of those whose acts (`record, kept, withdrawn`) keep them: any act keeps and none withdraws."""
    return acts.groupBy("record").agg(F.max("kept").alias("kept"), F.max("withdrawn").alias("withdrawn")).where("kept and not withdrawn").select("record")


def evaluated(records: Mapping[str, DataFrame], rules: Mapping[str, tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """`rule, record, other` of rules that each name a class of records and a plan from its records to pairs: one union, so Spark runs the rules side by side."""
    found = None
    for name, (kind, plan) in rules.items():
        pairs = plan(records[kind]).select(F.lit(name).alias("rule"), F.col("record").cast("string").alias("record"), F.col("other").cast("string").alias("other"))
        found = pairs if found is None else found.unionByName(pairs)
    return found


def repeats(arrivals: DataFrame, held: DataFrame) -> DataFrame:
    """`arrivals` (`record, version, source_version, changed`) with `repeat`: whether held revisions (the same columns and `current`) make it write nothing.

    If the record holds the version, but under another source version or time, and the arrival has a time of change, it repeats only what is current; else if the exact three or the version are held.
    """
    exact = held.select("record", "version", "source_version", "changed").distinct().withColumn("_exact", F.lit(True))
    known = held.groupBy("record", "version").agg(F.max("current").alias("_current"), F.lit(True).alias("_held"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("record", "version", "source_version", "changed")]
    met = arrivals.alias("a").join(exact.alias("e"), on, "left").select("a.*", "e._exact").join(known, ["record", "version"], "left")
    is_held, is_exact = F.coalesce("_held", F.lit(False)), F.coalesce("_exact", F.lit(False))
    repeat = F.when(is_held & ~is_exact & F.col("changed").isNotNull(), F.coalesce("_current", F.lit(False))).otherwise(is_exact | is_held)
    return met.select(*arrivals.columns, repeat.alias("repeat"))


def clock_lag(observed: DataFrame, source: str, said: str, seen: str) -> DataFrame:
    """`source, days`: by how many whole days every time that a source says is behind when it was seen; sources without a lag of a day are left out."""
    lag = F.floor((F.unix_micros(F.col(seen).cast("timestamp")) - F.unix_micros(F.col(said).cast("timestamp"))) / F.lit(86_400_000_000))
    return observed.groupBy(source).agg(F.min(lag).alias("days")).where("days >= 1")


def received(mine: DataFrame, theirs: DataFrame, protected: Column) -> DataFrame:
    """`file, act` for another writer's files (`file, digest`): `copy` what is missing, `keep` what is the same, `refuse` what differs where a file is protected, else `conflict`."""
    met = theirs.select("file", F.col("digest").alias("_theirs")).join(mine.select("file", F.col("digest").alias("_mine")), "file", "left")
    act = F.when(F.col("_mine").isNull(), "copy").when(F.col("_mine") == F.col("_theirs"), "keep").when(protected, "refuse").otherwise("conflict")
    return met.select("file", act.alias("act"))


def profiles(records: DataFrame, claims: DataFrame) -> DataFrame:
    """`record, standing`: `disclaimed` if any act (`record, act`) disclaims it, `held back` if any holds it back, `claimed` if any claims it, else `unclaimed`."""
    has = lambda act: F.max(F.col("act") == act)
    each = claims.groupBy("record").agg(has("disclaim").alias("d"), has("hold back").alias("h"), has("claim").alias("c"))
    standing = F.when(F.col("d"), "disclaimed").when(F.col("h"), "held back").when(F.col("c"), "claimed").otherwise("unclaimed")
    return records.select("record").distinct().join(each, "record", "left").select("record", standing.alias("standing"))


def derived(graph: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """`s, p, o, g` of what an ordered list of derivations adds to a graph `s, p, o`: each sees what those before it added, and adds only triples that aren't there, under its own name."""
    whole, found = graph.select("s", "p", "o"), None
    for name, step in steps.items():
        new = step(whole).select("s", "p", "o").distinct().join(whole, ["s", "p", "o"], "left_anti")
        whole = whole.unionByName(new)
        named = new.withColumn("g", F.lit(name))
        found = named if found is None else found.unionByName(named)
    return found


def views(records: DataFrame, builds: Mapping[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """The view of each kind of records (`kind`) that is held at all; kinds are looked for in one aggregation."""
    held = {r.kind for r in records.where(F.col("kind").isin(*builds)).select("kind").distinct().collect()}  # as many as there are views
    return {kind: build(records.where(F.col("kind") == kind)) for kind, build in builds.items() if kind in held}


def in_view(rows: DataFrame, entry: str, view: str) -> DataFrame:
    """`rows` with their placeholder entries named within a view: `<view>#<digest>`."""
    return rows.withColumn(entry, F.concat(F.lit(f"{view}#"), F.sha2(F.col(entry).cast("string"), 256)))


def used_versions(rows: DataFrame, view: str, version: str) -> DataFrame:
    """`view, versions`: the table versions that a view's rows were made with, sorted."""
    return rows.where(F.col(version).isNotNull()).groupBy(view).agg(F.array_sort(F.collect_set(version)).alias("versions"))


def current_versions(versions: DataFrame) -> DataFrame:
    """`series, version` of the versions (`series, version, revises`) that no other revises, where a series has exactly one; several heads are an error of the feed and left out."""
    heads = versions.join(versions.select(F.col("revises").alias("version"), "series").dropna(), ["series", "version"], "left_anti")
    return heads.groupBy("series").agg(F.min("version").alias("version"), F.count("*").alias("n")).where("n = 1").drop("n")
