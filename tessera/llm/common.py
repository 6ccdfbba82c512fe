"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import forget, shared_folder, stored, unused

__all__ = ["forget", "named", "of_texts", "parts_of", "shared_folder", "spread_join", "stored", "table", "texts_of", "unused"]

#: Python works on slices of a batch of about this many bytes of text, so that a batch of long texts stays small.
SLICE_BYTES = 1 << 20
#: A key of more than one part in so many of all rows is joined by broadcast; there are fewer such keys than this.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a folder that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python texts of an Arrow column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges `start, length` of rows in which the texts take about `most` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > most:
            yield start, row - start
            start, held = row, 0
        held += size + 64
    if start < len(column):
        yield start, len(column) - start


def parts_of(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which the column takes about `most` bytes."""
    for start, length in slices(batch.column(column), most):
        yield batch.slice(start, length)


def of_texts(function: Callable[[list[str]], pa.StructArray], schema: str) -> Callable[[Column], Column]:
    """A column function that gets the texts of a slice, null as empty, and returns one struct for each.

    Only texts travel to Python and only results come back; a row's other columns stay where they are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [function(texts_of(texts.slice(start, length))) for start, length in slices(texts)]
            yield pa.concat_arrays(found) if found else function([])

    return F.arrow_udf(run, f"struct<{schema}>")


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so columns of any other name can't clash."""
    return df.select(*(F.col(f"`{c}`").alias(alias) for alias, c in columns.items()))


def spread_join(rows: DataFrame, small: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join with a table of one row a key and `n`, how many of the rows have that key.

    Keys that more than a thousandth of all rows have, a thousand at most, are broadcast, so their rows stay spread as they are; all others are shuffled and merged, whatever size Spark takes either side for.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_PARTS > total
    keep = [c for c in small.columns if c != n]
    often = F.broadcast(small.where(hot).select(*keep))
    rest = rows.join(F.broadcast(small.where(hot).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(small.where(~hot).select(*keep).hint("merge"), key))


def plain_lists(values: Sequence[Sequence[float]], kind: pa.DataType) -> pa.ListArray:
    """A list column of equally or unequally long rows."""
    return pa.array([list(v) for v in values], pa.list_(kind))
