"""Feeds of reference tables: which current versions can be kept, and why others can't.

A feed says of each series its current version, of versions what they revise and where their rows are. A version that isn't held yet is kept if it descends from the
one that is held, its file was answered and has the checksum that the feed gives.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .lineage import forget, stored


def descends(pairs: DataFrame, revisions: DataFrame, *, most_rounds: int = 10_000) -> DataFrame:
    """The pairs `version, held` of which the version goes back to the held one, over any number of revisions (`version, revises`) and any of several; a version goes back to itself.

    Each round looks one revision further back from where the last one came to first; pairs that are decided take no further part, and cycles end.
    """
    revisions = revisions.select("version", "revises").dropna().distinct()
    wanted = stored(pairs.select("version", "held").dropna().distinct())
    front = stored(wanted.withColumn("at", F.col("version")))
    seen, found, tables = front, wanted.where("version = held"), []
    for _ in range(most_rounds):
        open_ = front.join(found, ["version", "held"], "left_anti")
        step = open_.join(revisions.select(F.col("version").alias("at"), F.col("revises").alias("further")), "at").select("version", "held", F.col("further").alias("at")).distinct()
        newer = stored(step.join(seen, ["version", "held", "at"], "left_anti"))
        tables.append(newer)
        if newer.isEmpty():
            result = stored(found)
            forget(wanted, front, *tables)
            return result
        seen, found, front = seen.unionByName(newer), found.unionByName(newer.where("at = held").select("version", "held")).distinct(), newer
        if len(tables) % 8 == 0:  # few tables are read however long the line of revisions is
            whole = stored(seen), stored(found)
            forget(*tables[:-1])
            seen, found = whole
            tables = [newer, *whole]
    raise ValueError("revisions go back further than the most rounds")


def checked(series: DataFrame, revisions: DataFrame, distributions: DataFrame, held: DataFrame, files: DataFrame, *, kinds: Sequence[str]) -> DataFrame:
    """`series, version, outcome, reason` of each series' current version that isn't held: `kept`, `refused`, or `later` where its file wasn't answered.

    series: `series, kind, current`; revisions: `version, revises`; distributions: `version, url, checksum`; held: `series, version`, the default one of each series, and any others with a null series; files: `url, content`, null where it wasn't
    answered. Series without a current version or of a kind that isn't read are left out. Of several distributions of a version the first by URL counts.
    """
    known = held.select(F.col("version").alias("current")).distinct()
    default = held.where("series is not null").groupBy("series").agg(F.min("version").alias("held"))
    asked = series.where(F.col("current").isNotNull() & F.col("kind").isin(*kinds)).select("series", F.col("current")).distinct().join(known, "current", "left_anti").join(default, "series", "left")
    back = descends(asked.select(F.col("current").alias("version"), "held"), revisions).select(F.col("version").alias("current"), "held", F.lit(True).alias("_descends"))
    place = distributions.groupBy("version").agg(F.min(F.struct("url", "checksum")).alias("d")).select(F.col("version").alias("current"), "d.url", "d.checksum")
    answers = files.groupBy("url").agg(F.max(F.sha2("content", 256)).alias("_digest"))
    met = asked.join(back, ["current", "held"], "left").join(place, "current", "left").join(answers, "url", "left")
    refused = F.when(F.col("held").isNotNull() & F.col("_descends").isNull(), F.concat(F.lit("it doesn't descend from "), F.col("held").cast("string"), F.lit(", which is held")))
    refused = refused.when(F.col("url").isNull() | F.col("checksum").isNull(), "no download and checksum")
    late = F.when(refused.isNull() & F.col("_digest").isNull(), F.concat("url", F.lit(" wasn't answered")))
    wrong = F.when(late.isNull() & refused.isNull() & (F.col("_digest") != F.lower("checksum")), "another checksum than the feed gives")
    outcome = F.when(F.coalesce(refused, wrong).isNotNull(), "refused").when(late.isNotNull(), "later").otherwise("kept")
    return met.select("series", F.col("current").alias("version"), outcome.alias("outcome"), F.coalesce(refused, late, wrong).alias("reason"))
