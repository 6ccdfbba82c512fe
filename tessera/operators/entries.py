"""Records judged the same, as connected components, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from . import carry
from .lineage import forget, stored, unused


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of the edges `a, b` is a root or hangs on one root alone: then large and small stars change nothing any more."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("roots"), F.lit(0).alias("hangs")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("roots"), F.lit(1).alias("hangs")))
    return ends.groupBy("node").agg(F.max("roots").alias("roots"), F.sum("hangs").alias("hangs")).where("hangs > 1 or (roots = 1 and hangs = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """`node, root`: the least node that each node of the edges `a, b` reaches.

    Large-star and small-star steps by grouping and joining until all edges are stars; only that reaches
    the driver. Rows never outnumber edges and nodes, and each round's table replaces the one before.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        newer = stored(small)
        forget(edges)
        edges = newer
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def entries(records: DataFrame, same: DataFrame) -> DataFrame:
    """`record, kind, entry` of `records` (`record, kind`): records connected by `same` (`a, b`) and of one kind share an entry, named by the digest of the least of them."""
    found = records.join(components(same), records.record == F.col("node"), "left").withColumn("root", F.coalesce("root", "record"))
    least = found.groupBy("root", "kind").agg(F.min("record").alias("least"))
    return found.join(least, ["root", "kind"]).select("record", "kind", F.sha2("least", 256).alias("entry"))


# Links: enough pairs to connect all that a rule joins, one or two for each record instead of every pair of a block


def linked(records: DataFrame, record: str, block: Sequence[str]) -> DataFrame:
    """`record, other`: each record that shares a block's columns, none null, with the block's least. The least is found by a partial aggregation."""
    rows = records.select(F.col(record).alias("record"), *block).dropna(subset=list(block)).distinct()
    least = rows.groupBy(*block).agg(F.min("record").alias("other"), F.count("*").alias("_held")).where("_held > 1")
    return rows.join(least, list(block)).where("record <> other").select("record", "other").distinct()


def linked_unequal(records: DataFrame, record: str, block: Sequence[str], differing: str) -> DataFrame:
    """`record, other` of one block with different values of a column: each record with the least record of another value than its own.

    Two rows a block decide: the least record, and the least of those with another value than that one's.
    """
    rows = records.select(F.col(record).alias("record"), *block, F.col(differing).alias("_own")).dropna(subset=[*block, "_own"])
    values = rows.groupBy(*block, "_own").agg(F.min("record").alias("least"))
    order = Window.partitionBy(*block).orderBy("least")
    first = values.withColumn("place", F.row_number().over(order)).where("place <= 2")
    pair = first.groupBy(*block).agg(F.min_by("least", "place").alias("one"), F.min_by("_own", "place").alias("one_own"), F.max_by("least", "place").alias("two"), F.max("place").alias("n")).where("n = 2")
    met = rows.join(pair, list(block)).select("record", F.when(F.col("_own") == F.col("one_own"), F.col("two")).otherwise(F.col("one")).alias("other"))
    return met.select(F.least("record", "other").alias("record"), F.greatest("record", "other").alias("other")).distinct()


def overlap_links(spans: DataFrame, record: str, block: Sequence[str], start: str, end: str, bucket: Column) -> DataFrame:
    """`record, other` of one block whose closed intervals overlap: each with the one that reaches furthest of those that start no later.

    bucket: a column that never falls as `start` grows (a month, say): a block with many intervals is many tasks. An interval without a start joins nothing; one without an end never ends.
    """
    rows = spans.where(F.col(start).isNotNull())
    reach = F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("end"), F.col(record).alias("other"))
    met = carry.before(rows, block, [start, record], bucket, reach, "_reach")
    return met.where(F.col("_reach.open") | (F.col("_reach.end") >= F.col(start))).select(F.col(record).alias("record"), F.col("_reach.other").alias("other"))


# Pairs: where every pair is asked for


def dealt(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    """The rows in four parts a core by the block's columns. Adaptive execution merges parts by their bytes, which are few where pairs are many, so their number is given."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *block)


def blocked_pairs(records: DataFrame, record: str, block: Sequence[str], origin: str | None = None, *, most: int | None = None) -> DataFrame:
    """`record, other` of records that agree on the block's columns, the smaller first; with `origin` also the sorted origins that join them.

    Rows grow with the square of a block. With `most`, blocks of more records are left out; `full_blocks` names them, and `linked` connects them.
    Records, not pairs, are shuffled: a pair meets more than once only if both its records are in several blocks, so only such pairs are grouped.
    """
    if most is not None:
        records = records.join(full_blocks(records, record, block, most).select(*block), list(block), "left_anti")
    rows = records.select(F.col(record).alias("record"), *(F.col(c).alias(f"_block{i}") for i, c in enumerate(block)), *([F.col(origin).alias("origin")] if origin else []))
    on = [f"_block{i}" for i in range(len(block))]
    one = rows.groupBy("record", *on).agg(F.array_sort(F.collect_set("origin")).alias("origins")) if origin else rows.distinct()
    one = one.withColumn("_several", F.count("*").over(Window.partitionBy("record")) > 1)
    two = one.select(F.col("record").alias("other"), *on, F.col("_several").alias("_other_several"))
    met = dealt(one, on).join(dealt(two, on), on).where("record < other").drop(*on)
    often = met.where("_several and _other_several")
    again = often.groupBy("record", "other").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins")) if origin else often.select("record", "other").distinct()
    return met.where("not (_several and _other_several)").select(again.columns).unionByName(again)


def full_blocks(records: DataFrame, record: str, block: Sequence[str], most: int) -> DataFrame:
    """The block's columns and `n_records` of the blocks with more than `most` records."""
    return records.groupBy(*block).agg(F.countDistinct(record).alias("n_records")).where(F.col("n_records") > most)


def overlapping(spans: DataFrame, record: str, block: Sequence[str], start: str, end: str) -> DataFrame:
    """`record, other` of one block whose closed intervals overlap, the smaller record first."""
    one = spans.select(F.col(record).alias("record"), *block, F.col(start).alias("s1"), F.col(end).alias("e1"))
    two = spans.select(F.col(record).alias("other"), *block, F.col(start).alias("s2"), F.col(end).alias("e2"))
    return one.join(two, list(block)).where("record < other and s1 <= e2 and s2 <= e1").select("record", "other")


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose two members are in no other pair."""
    n = unused(pairs, "_n")
    left = pairs.groupBy(a).agg(F.count("*").alias(n)).where(F.col(n) == 1).select(a)
    right = pairs.groupBy(b).agg(F.count("*").alias(n)).where(F.col(n) == 1).select(b)
    return pairs.join(left, a, "left_semi").join(right, b, "left_semi")


def mapped_codes(rows: DataFrame, code: str, target: str, version: str) -> DataFrame:
    """`code, other, origins`: different codes that one table version maps to one target, with the sorted versions that do. As many rows as the table's codes allow, whatever the records."""
    one = rows.select(F.col(code).alias("code"), F.col(target).alias("_target"), F.col(version).alias("origin")).distinct()
    met = one.join(one.withColumnRenamed("code", "other"), ["_target", "origin"]).where("code < other")
    return met.groupBy("code", "other").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def near_codes(rows: DataFrame, a: str, b: str, version: str) -> DataFrame:
    """`code, other, hops`: different codes one or two rows of one table version apart, the fewest hops."""
    edge = rows.select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(version).alias("v")).dropna().distinct()
    both = edge.unionByName(edge.select(F.col("y").alias("x"), F.col("x").alias("y"), "v")).distinct()
    two = both.join(both.select(F.col("x").alias("y"), F.col("y").alias("z"), "v"), ["y", "v"]).select("x", F.col("z").alias("y"), F.lit(2).alias("hops"))
    every = both.select("x", "y", F.lit(1).alias("hops")).unionByName(two).where("x < y")
    return every.groupBy(F.col("x").alias("code"), F.col("y").alias("other")).agg(F.min("hops").alias("hops"))


def found_once(records: DataFrame, record: str, code: str, listed: DataFrame) -> DataFrame:
    """`record, found` of the records of whose codes the table (`code, found`) finds exactly one different row; the others are left out."""
    met = records.select(F.col(record).alias("record"), F.col(code).alias("code")).join(listed, "code")
    return met.groupBy("record").agg(F.min("found").alias("found"), F.max("found").alias("_most")).where("found = _most").drop("_most")


def one_time(records: DataFrame, block: Sequence[str], time: str) -> DataFrame:
    """The records of the blocks in which all that have a time have the same one."""
    agreed = records.groupBy(*block).agg(F.min(time).alias("_low"), F.max(time).alias("_high")).where("_low <=> _high").select(*block)
    return records.join(agreed, list(block), "left_semi")


# What is derived


def least_of_each(records: DataFrame, entry: Sequence[str], order: Sequence[F.Column]) -> DataFrame:
    """The first row of each entry in the order, which has to be total."""
    place = unused(records, "_place")
    return records.withColumn(place, F.row_number().over(Window.partitionBy(*entry).orderBy(*order))).where(F.col(place) == 1).drop(place)


def heads(revisions: DataFrame, revision: str, previous: str) -> DataFrame:
    """The revisions that no other names as its previous one."""
    return revisions.join(revisions.select(F.col(previous).alias(revision)), revision, "left_anti")


def first_arrivals(arrivals: DataFrame, key: Sequence[str], order: Sequence[F.Column]) -> DataFrame:
    """Of arrivals with the same key the first; what came again writes nothing."""
    return least_of_each(arrivals, key, order)


def descent(revisions: DataFrame, revision: str, previous: str, *, most_rounds: int = 64) -> DataFrame:
    """`revision, first, steps`: the revision that each goes back to, and over how many steps. Paths double each round; a line that leads back to itself is an error."""
    line = stored(revisions.select(F.col(revision).alias("revision"), F.coalesce(F.col(previous), F.col(revision)).alias("first"), F.col(previous).isNotNull().cast("long").alias("steps")))
    for _ in range(most_rounds):
        further = line.select(F.col("revision").alias("first"), F.col("first").alias("_next"), F.col("steps").alias("_more"))
        longer = stored(line.join(further, "first", "left").select("revision", F.coalesce("_next", "first").alias("first"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")))
        if longer.join(line.select("revision", F.col("first").alias("_was")), "revision").where("first <> _was").isEmpty():
            return longer
        forget(line)
        line = longer
    raise ValueError("a line of revisions leads back to itself")
