"""Running values over a series that is too long for one task.

A series is cut into buckets that follow its order, such as months. Within a bucket a window runs; each bucket's total is one row,
and the totals of earlier buckets, few rows a series, are carried to it by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .lineage import unused


def before(rows: DataFrame, series: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str, *, sums: bool = False) -> DataFrame:
    """`rows` with `name`, the largest value (or with `sums` the sum, 0 of none) of the series' rows before this one.

    order: columns in a total order of the series; bucket: never falls in that order.
    """
    b, v, inside, total, carry = (unused(rows, f"_{n}") for n in ("bucket", "value", "inside", "total", "carry"))
    gather = F.sum if sums else F.max
    valued = rows.withColumn(b, bucket).withColumn(v, value)
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    carried = valued.groupBy(*series, b).agg(gather(v).alias(total)).withColumn(carry, gather(total).over(earlier(*series).orderBy(b)))
    own = valued.withColumn(inside, gather(v).over(earlier(*series, b).orderBy(*order)))
    keys = {c: unused(valued, f"_of_{c}") for c in (*series, b)}
    met = own.join(carried.select(*(F.col(c).alias(k) for c, k in keys.items()), carry), [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    both = F.coalesce(F.col(inside), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0)) if sums else F.greatest(inside, carry)
    return met.select(*rows.columns, both.alias(name))
