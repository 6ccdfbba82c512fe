"""Notes that grew: one text begins or ends another's, by whole lines.

A digest of a text's first lines is the exclusive or of the digests of each line with its place, so all beginnings of a text are one running window over its
lines, and all its ends one over the lines with their places from the end: as many rows as lines, whatever the texts. A text meets those that have it as a beginning or
end by an equality of digests, and the texts themselves decide. Texts stand for their notes until the end, so copies don't multiply.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window


def extensions(texts: DataFrame) -> DataFrame:
    """`type, short, long` of texts (`type, id, text`, an id a text) of one type of which the first begins or ends the second, by whole lines. Null and empty texts extend nothing and are extended by nothing."""
    rows = texts.where((F.length("text") > 0) & F.col("type").isNotNull()).select("type", "id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = rows.select("type", "id", "place", F.xxhash64("line", "place").alias("first"), F.xxhash64("line").alias("_line"))
    own = Window.partitionBy("type", "id")
    placed = lines.withColumn("n", F.count("*").over(own)).withColumn("last", F.xxhash64("_line", F.col("n") - 1 - F.col("place"), F.lit("end")))
    upto, after = own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0), own.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("type", "id", "place", "n", F.bit_xor("first").over(upto).alias("begins"), F.bit_xor("last").over(after).alias("ends"))
    whole = run.where("place = n - 1").select("type", F.col("id").alias("short"), "n", F.col("begins").alias("digest"), F.lit("begins").alias("way"))
    whole = whole.unionByName(run.where("place = 0").select("type", F.col("id").alias("short"), "n", F.col("ends").alias("digest"), F.lit("ends").alias("way")))
    cuts = run.where("place < n - 1").select("type", F.col("id").alias("long"), (F.col("place") + 1).cast("bigint").alias("n"), F.col("begins").alias("digest"), F.lit("begins").alias("way"))
    cuts = cuts.unionByName(run.where("place > 0").select("type", F.col("id").alias("long"), (F.col("n") - F.col("place")).alias("n"), F.col("ends").alias("digest"), F.lit("ends").alias("way")))
    met = cuts.join(whole, ["type", "n", "digest", "way"]).select("type", "short", "long").distinct()
    text = lambda name: texts.select("type", F.col("id").alias(name), F.col("text").alias(f"{name}_text"))
    read = met.join(text("short"), ["type", "short"]).join(text("long"), ["type", "long"])
    real = F.startswith("long_text", F.concat("short_text", F.lit("\n"))) | F.endswith("long_text", F.concat(F.lit("\n"), F.col("short_text")))
    return read.where(real).select("type", "short", "long")


def unwitnessed(extends: DataFrame) -> DataFrame:
    """The extensions (`type, short, long`) without a witness: a third text that extends the short one too, and neither extends the long one nor is extended by it.

    Every text that extends the short one must be the long one or be on a line with it; those are counted on the paths short - one - other that close.
    """
    pairs = extends.select("type", "short", "long").distinct()
    step = pairs.select("type", F.col("short").alias("long"), F.col("long").alias("further"))
    closed = pairs.join(step, ["type", "long"]).join(pairs.select("type", "short", F.col("long").alias("further")), ["type", "short", "further"], "left_semi")
    on_line = closed.select("type", "short", F.explode(F.array("long", "further")).alias("long")).groupBy("type", "short", "long").agg(F.count("*").alias("related"))
    every = pairs.groupBy("type", "short").agg(F.count("*").alias("all"))
    return pairs.join(every, ["type", "short"]).join(on_line, ["type", "short", "long"], "left").where(F.col("all") == 1 + F.coalesce("related", F.lit(0))).select("type", "short", "long")


def grown(notes: DataFrame) -> DataFrame:
    """`record, other`: notes (`note, type, organization, date, text`) of one type and organization of which the second's text begins or ends with the first's, is dated no earlier where both are dated, and has no witness against it among all notes of the type.

    Of notes with one text, each longer one is linked with the shorter of the earliest date, one without a date before all, and each shorter one with the longer of the latest: what the rule joins is connected, copies aren't paired with copies. Ties go to
    the least note. A note without a type, organization or text joins nothing, though without an organization it may be a witness.
    """
    rows = notes.select("note", "type", "organization", "date", "text").where((F.length("text") > 0) & F.col("type").isNotNull())
    rows = rows.withColumn("id", F.sha2("text", 256))
    texts = rows.groupBy("type", "id").agg(F.first("text").alias("text"))
    pairs = unwitnessed(extensions(texts))
    own = rows.drop("text").where("organization is not null")
    group = ["type", "organization", "id"]
    first = own.groupBy(*group).agg(F.min(F.struct(F.col("date").isNotNull().alias("dated"), "date", "note")).alias("e"))
    last = own.groupBy(*group).agg(F.max(F.struct(F.col("date").isNull().alias("undated"), "date")).alias("e"))
    last = own.join(last, group).where(F.col("date").eqNullSafe(F.col("e.date"))).groupBy(*group).agg(F.min("note").alias("other"), F.first("date").alias("last_date"))
    fits = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(b) >= F.col(a))

    longer = pairs.join(own.withColumnRenamed("id", "long"), ["type", "long"]).join(first.select("type", "organization", F.col("id").alias("short"), F.col("e.note").alias("record"), F.col("e.date").alias("first_date")), ["type", "organization", "short"])
    shorter = pairs.join(own.withColumnRenamed("id", "short"), ["type", "short"]).join(last.withColumnRenamed("id", "long"), ["type", "organization", "long"])
    found = longer.where(fits("first_date", "date")).select("record", F.col("note").alias("other"))
    return found.unionByName(shorter.where(fits("date", "last_date")).select(F.col("note").alias("record"), "other")).distinct()
