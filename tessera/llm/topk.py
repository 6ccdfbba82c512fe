"""Exact top-k search by tiled matrix products.

Vectors are turned into whole numbers, floor(256 x). Queries are taken in rounds of a bounded size, one after the other:
a round's queries are broadcast as one matrix and every partition of the vectors multiplies it with
its shards, tile by tile. A tile keeps only each query's best k by partial selection, a partition
merges its tiles, and the partitions' lists are merged as a tree, `FAN_IN` lists at a time. What a round finds is
written to the shared folder and its broadcast destroyed before the next begins, so neither driver nor executors ever hold more than one round's matrix.

Products are taken in float64 where their sums stay below 2^53 and so are exact, else with whole
numbers of any size; a score outside 64 bits is an error.

Cases: vectors that are null, empty, or hold null, NaN or infinite components take no part, and neither
do rows without an id; vectors of different lengths never meet. Ties go to the smaller id. Rows that
share the query's id are its own and are no candidates for it; a repeated query row gives its list again; other
repeated rows are candidates each. A query without candidates and an empty table give no rows. Only the named columns take part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import forget, named, shared_folder, stored

SCALE = 256
#: Queries of one round: their matrix is what is broadcast, 8 bytes a component.
QUERIES_A_ROUND = 16_384
#: Queries and vectors of one tile.
TILE = (1024, 8192)
#: Lists that meet in one merging step.
FAN_IN = 32


def whole(vectors: pa.ListArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Which rows take part, and by length: their row numbers and matrix of floor(256 x) in float64."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = (lengths > 0) & (bad[ends[1:]] == bad[ends[:-1]])
    found = {}
    for length in np.unique(lengths[fine]):
        rows = np.flatnonzero(fine & (lengths == length))
        found[int(length)] = rows, np.floor(SCALE * values[ends[rows][:, None] + np.arange(length)])
    return fine, found


def product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64."""
    if not len(queries) or not len(vectors):
        return np.zeros((len(queries), len(vectors)), np.int64)
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], object) @ np.array([[int(x) for x in row] for row in vectors], object).T
    if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) >= 2**63:
        raise ArithmeticError("an inner product doesn't fit 64 bits")
    return exact.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score first, then smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _tiles(asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best k of a partition's vectors for each query of the round. asked: by length, the queries' numbers, ids and matrix."""
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for length, (rows, matrix) in whole(batch.column("embedding"))[1].items():
            numbers, own, queries = asked.get(length, ((), (), None))
            for q in range(0, len(numbers), TILE[0]):
                for v in range(0, len(rows), TILE[1]):
                    tile, tile_ids = product(queries[q : q + TILE[0]], matrix[v : v + TILE[1]]), ids[rows[v : v + TILE[1]]]
                    for i, scores in enumerate(tile):
                        others = tile_ids != own[q + i]
                        scores, found = scores[others], tile_ids[others]
                        held = lists.get(numbers[q + i])
                        if held is not None:
                            over = scores >= held[0][-1] if len(held[0]) == k else slice(None)
                            scores, found = np.concatenate([held[0], scores[over]]), np.concatenate([held[1], found[over]])
                        top = best(scores, found, k)
                        lists[numbers[q + i]] = scores[top], found[top]
    for start in range(0, len(keys := [n for n, x in lists.items() if len(x[0])]), 4096):
        part = keys[start : start + 4096]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, [len(lists[n][0]) for n in part]), pa.int64()),
                pa.array(np.concatenate([lists[n][1] for n in part]), pa.int64()),
                pa.array(np.concatenate([lists[n][0] for n in part]), pa.int64()),
            ],
            names=["number", "vec_id", "score"],
        )


def merged(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """Lists `number, part, vec_id, score` merged to one of k entries a query, `FAN_IN` parts at a time: `number, top`."""
    entry = F.struct((-F.col("score")).alias("minus"), "vec_id", "score")
    rows = lists.select("number", "part", entry.alias("e"))
    while True:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN))
        merged = rows.groupBy("number", "part").agg(F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("top"))
        if parts <= 1:
            return merged.select("number", "top")
        rows = merged.select("number", "part", F.explode("top").alias("e"))


def search(queries: DataFrame, vectors: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", queries_a_round: int = QUERIES_A_ROUND) -> DataFrame:
    """`query_id, rank, vec_id, score` of each query's k highest inner products among all `vectors`."""
    spark = vectors.sparkSession
    every = named(vectors, vec_id=id_col, embedding=vector_col).where("vec_id is not null")
    every = every.withColumn("vec_id", F.col("vec_id").cast("long"))
    asked = named(queries, vec_id=id_col, embedding=vector_col).where("vec_id is not null and embedding is not null")
    asked = stored(asked.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.monotonically_increasing_id().alias("number")))
    rounds = max(1, -(-asked.count() // queries_a_round))
    parts = every.rdd.getNumPartitions()
    folder = f"{shared_folder(spark)}/top-{uuid.uuid4().hex}"
    for turn in range(rounds):
        of_round = asked.where(F.pmod(F.xxhash64("number"), F.lit(rounds)) == turn).toArrow()  # about `queries_a_round` rows
        ids, numbers = (of_round.column(c).to_numpy() for c in ("vec_id", "number"))
        matrices = {n: (numbers[rows], ids[rows], matrix) for n, (rows, matrix) in whole(of_round.column("embedding"))[1].items()} if len(ids) else {}
        sent = spark.sparkContext.broadcast(matrices)
        tiles = every.mapInArrow(lambda batches, sent=sent: _tiles(sent.value, k, batches), "number long, vec_id long, score long")
        merged(tiles.withColumn("part", F.spark_partition_id()), k, parts).write.parquet(f"{folder}/round={turn}")
        sent.destroy()
    entry = "struct<minus:bigint,vec_id:bigint,score:bigint>"
    tops = spark.read.schema(f"number bigint, top array<{entry}>, round int").parquet(folder).drop("round")
    ranked = tops.select("number", F.posexplode("top").alias("at", "e")).select("number", (F.col("at") + 1).alias("rank"), "e.vec_id", "e.score")
    found = stored(ranked.join(asked.select("number", F.col("vec_id").alias("query_id")), "number").select("query_id", "rank", "vec_id", "score"))
    forget(asked)
    return found
