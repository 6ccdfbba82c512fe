"""Pages, handles and coverage."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from . import carry
from .lineage import forget, stored, unused

#: Keys of a page that are broadcast at most; a page of more is a join.
MOST_KEYS = 100_000


def keyset_page(rows: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The rows of the first `size` keys after a key; rows of one key are never split. Keys are ranked by a distributed top-k, not by sorting all rows in one task."""
    rest = rows if after is None else rows.where(F.col(key) > F.lit(after))
    keys = rest.select(key).distinct().orderBy(key).limit(size)
    return rest.join(F.broadcast(keys) if size <= MOST_KEYS else keys, key, "left_semi")


def next_key(rows: DataFrame, key: str, after: object | None, size: int) -> object | None:
    """The key to continue after, null at the end."""
    rest = rows if after is None else rows.where(F.col(key) > F.lit(after))
    ends = rest.select(key).distinct().orderBy(key).limit(size + 1).agg(F.count("*").alias("n"), F.max(key).alias("last")).first()
    return rest.select(key).distinct().where(F.col(key) < F.lit(ends.last)).agg(F.max(key)).first()[0] if ends.n > size else None


def offset_page(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows from an offset in a total order, with the `total` number of rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def runs(rows: DataFrame, series: Sequence[str], order: Sequence[str], entry: str, bucket: Column) -> DataFrame:
    """`rows` with `run`, the number within a series of the run of neighbouring rows with equal entry; a null entry stands alone. bucket: never falls in the order, so a long series is many tasks."""
    was, starts = unused(rows, "_was"), unused(rows, "_starts")
    near = carry.before(rows, series, order, bucket, F.struct(*order, F.col(entry).alias("_entry_before")), was)
    same = F.col(entry).isNotNull() & F.col(was)["_entry_before"].eqNullSafe(F.col(entry))
    counted = near.withColumn(starts, F.when(same, 0).otherwise(1))
    found = carry.before(counted, series, order, bucket, F.col(starts), "run", sums=True)
    return found.select(*rows.columns, (F.col("run") + F.col(starts)).alias("run"))


def handles(rows: DataFrame, digits: str, least: int = 8, block: int = 4) -> DataFrame:
    """`rows` with `handle`, the shortest beginning of its distinct hexadecimal digits that no other row has, of `least` digits at least.

    Neighbours in sorted order decide. Rows with different first `block` digits (fewer than `least`) never need
    each other, so the sort is by block.
    """
    window = Window.partitionBy(F.substring(digits, 1, block)).orderBy(digits)
    earlier, later = unused(rows, "_earlier"), unused(rows, "_later")

    def common(other: Column) -> Column:
        pairs = F.zip_with(F.split(digits, ""), F.split(F.coalesce(other, F.lit("")), ""), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda s, x: F.struct((s.n + s.on * x).alias("n"), (s.on * x).alias("on")), lambda s: s.n)

    near = rows.withColumn(earlier, F.lag(digits).over(window)).withColumn(later, F.lead(digits).over(window))
    length = F.greatest(common(F.col(earlier)), common(F.col(later)), F.lit(least - 1)) + 1
    return near.select(*rows.columns, F.col(digits).substr(F.lit(1), length).alias("handle"))


def gaps(spans: DataFrame, series: Sequence[str], start: str, end: str, bucket: Column) -> DataFrame:
    """`series, n_gaps, covered_from, covered_to`: how many holes the half-open intervals of each series leave between its least start and greatest end. bucket: never falls as the start grows."""
    reach = unused(spans, "_reach")
    near = carry.before(spans, series, [start, end], bucket, F.col(end), reach)
    hole = (F.col(start) > F.col(reach)).cast("int")
    return near.groupBy(*series).agg(F.coalesce(F.sum(hole), F.lit(0)).cast("long").alias("n_gaps"), F.min(start).alias("covered_from"), F.max(end).alias("covered_to"))


def covers(spans: DataFrame, wanted: DataFrame, series: Sequence[str], start: str, end: str, bucket: Column) -> DataFrame:
    """`series, whole`: whether the half-open intervals of each series cover 0 to its `total` without a hole, and nothing beyond."""
    found = gaps(spans, series, start, end, bucket)
    whole = (F.col("n_gaps") == 0) & (F.col("covered_from") == 0) & (F.col("covered_to") == F.col("total"))
    return wanted.join(found, list(series), "left").select(*series, F.coalesce(whole, F.lit(False)).alias("whole"))


def sized_pages(rows: DataFrame, series: Sequence[str], order: str, size: str, budget: int) -> DataFrame:
    """`rows` with `page`, from 1: as many rows in order as fit a budget of characters; a row that alone is larger has a page of its own.

    order: a number without gaps from 1 on within each series. Where a page would begin at a row, the next begins after the last row whose running size still fits. Following these steps from the first row on, by doubling them,
    marks the rows at which pages begin: as many rounds as the number of pages has binary digits.
    """
    total, at, key = (unused(rows, f"_{n}") for n in ("total", "at", "key"))
    bucket = F.floor(F.col(order) / 4096)
    summed = stored(carry.before(rows.select(*series, order, size), series, [order], bucket, F.col(size), total, sums=True).withColumn(at, F.col(order).cast("long")))
    # where the running size passes a page's budget: one sorted list of both, running sizes before limits of the same value
    ends = summed.select(*series, (F.col(total) + F.col(size)).alias(key), F.lit(0).alias("_limit"), at, F.col(at).alias("_last"))
    limits = summed.select(*series, (F.col(total) + budget).alias(key), F.lit(1).alias("_limit"), at, F.lit(0).cast("long").alias("_last"))
    both = carry.before(ends.unionByName(limits), series, [key, "_limit", at], F.floor(F.col(key) / (4096 * max(1, budget // 64))), F.col("_last"), "_fits")
    step = stored(both.where("_limit = 1").select(*series, at, (F.greatest(F.coalesce("_fits", F.lit(0)), F.col(at)) + 1).alias("_next")))
    begins = stored(step.where(F.col(at) == 1).select(*series, at))
    while True:
        reached = begins.join(step, [*series, at]).select(*series, F.col("_next").alias(at))
        more = stored(begins.unionByName(reached.join(step.select(*series, at), [*series, at], "left_semi")).distinct())
        grown = more.count() > begins.count()
        forget(begins)
        begins = more
        if not grown:
            break
        hop = step.select(*series, F.col(at).alias("_next"), F.col("_next").alias("_then"))
        longer = stored(step.join(hop, [*series, "_next"], "left").select(*series, at, F.coalesce("_then", "_next").alias("_next")))
        forget(step)
        step = longer
    started = rows.join(begins.select(*series, F.col(at).cast(rows.schema[order].dataType).alias(order), F.lit(1).alias(at)), [*series, order], "left").withColumn(at, F.coalesce(at, F.lit(0)))
    found = carry.before(started, series, [order], bucket, F.col(at), "page", sums=True)
    return found.select(*rows.columns, (F.col("page") + F.col(at)).alias("page"))


def rendering_order(day: Column, line: Column, entry: Column) -> list[Column]:
    """The order in which dated rows are shown: latest first, those without a day last, then by line and entry."""
    return [day.desc_nulls_last(), line.asc(), entry.asc()]
