"""Arrivals as a stream: what comes again is dropped, derived tables are refreshed by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def first_arrivals(stream: DataFrame, key: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """The arrivals of a stream, each key once within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def counts_by_window(stream: DataFrame, time: str, by: str, width: str, delay: str = "1 day") -> DataFrame:
    """`start, by, n`: arrivals in windows of event time, late ones up to the delay."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), by, "n")


def refreshing(stream: DataFrame, key: Sequence[str], path: str, derive: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A writer that appends each batch's rows derived from its touched keys as a generation `batch=n` under `path`; the newest generation of a key counts. A batch that is run again overwrites its own generation.

    A batch's rows without a key, which no generation could replace, are left out.
    """

    def write(batch: DataFrame, n: int) -> None:
        derive(batch.dropna(subset=list(key))).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write)


def current(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of each key's newest generation."""
    newest = table.groupBy(*key).agg(F.max("batch").alias("batch"))
    return table.join(newest, [*key, "batch"], "left_semi").drop("batch")


def compacted(table: DataFrame, key: Sequence[str], path: str) -> None:
    """Write the newest generation of every key to another place, as one generation for each batch that still has any, so that a reader no longer meets those replaced."""
    newest = table.groupBy(*key).agg(F.max("batch").alias("batch"))
    table.join(newest, [*key, "batch"], "left_semi").write.mode("overwrite").partitionBy("batch").parquet(path)
