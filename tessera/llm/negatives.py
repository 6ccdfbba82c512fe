"""Hard negatives of anchors, by distributed radix selection.

Vectors are turned into whole numbers, floor(256 x), and a score is their inner product. A window is a range of scores of one
anchor, of rows with its label or of rows with another: first one window an anchor, of all scores of its own label, whose best
rows are its positives; then one for each positive, of the other labels' scores between a share of the positive's and the positive's.
The best k of a window are found digit by digit: every task counts its rows' scores by the leading digit below the window's
upper end, the counts of all tasks are added up, and the digit in which the k-th row lies becomes the window of the next pass.
It ends when the digit is a single score or what lies at or above it is few. Then only rows from there on are gathered,
k a task at most, and merged as a tree. So a window in which a third of all rows tie moves counts, not rows.

Anchors are taken in rounds of a bounded size, whose vectors and windows are broadcast; what a round finds is written to the shared
folder before the next begins. Only one row a window and pass reaches the driver. Each pass reads the vectors and multiplies its tiles anew.

Cases: rows without an id or label, and vectors that are null, empty or hold null, NaN or infinite components, take no part;
vectors of different lengths never meet. Ties go to the smaller id. Rows that share the anchor's id are its own; a repeated anchor gives its
lists again, other repeated rows count each. An anchor without positives, a positive without negatives and an empty table give no rows. A
score outside 64 bits is an error. Only the named columns take part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window

from .common import forget, named, shared_folder, stored
from .topk import SCALE, best, merged, product, whole

#: Anchors of one round: their matrix and windows are what is broadcast.
ANCHORS_A_ROUND = 4096
#: Anchors and vectors of one tile.
TILE = (256, 8192)
#: Bits of a digit: a task holds so many counts of each window of a round, 4 bytes each.
DIGIT = 8
#: A window isn't refined further if at most so many times k rows are at or above its digit.
FEW = 8


class Asked(NamedTuple):
    """A round's anchors; by length their numbers in the round and their matrix."""

    ids: np.ndarray
    labels: np.ndarray
    matrices: dict[int, tuple[np.ndarray, np.ndarray]]


class Windows(NamedTuple):
    """Ranges of scores, an anchor's after the other's: `first[i] : first[i + 1]` are those of anchor i. need: how many rows are still sought in the range."""

    first: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shift: np.ndarray
    need: np.ndarray
    open: np.ndarray


def shift_of(low: int, high: int) -> int:
    """By how many bits a distance below `high` is shifted to give its leading digit."""
    return max(0, (high - low).bit_length() - DIGIT)


def digits(scores: np.ndarray, high: int, shift: int) -> np.ndarray:
    """Leading digits of the scores' distances below `high`: 0 is best. Distances may take 64 bits, so they are unsigned."""
    below = np.array([high], np.int64).view(np.uint64) - np.ascontiguousarray(scores, np.int64).view(np.uint64)
    return (below >> np.uint64(shift)).astype(np.int64)


def _scores(asked: Asked, windows: Windows, same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor and tile the scores and ids of the rows that take part in any of its open windows."""
    some = np.add.reduceat(np.append(windows.open, False), windows.first[:-1]) > 0
    some &= windows.first[1:] > windows.first[:-1]
    for batch in batches:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for length, (rows, matrix) in whole(batch.column("embedding"))[1].items():
            numbers, anchors = asked.matrices.get(length, (np.zeros(0, np.int64), None))
            at = np.flatnonzero(some[numbers])
            for q in range(0, len(at), TILE[0]):
                block = at[q : q + TILE[0]]
                for v in range(0, len(rows), TILE[1]):
                    own = rows[v : v + TILE[1]]
                    for i, scores in zip(numbers[block], product(anchors[block], matrix[v : v + TILE[1]]), strict=True):
                        a, b = windows.first[i], windows.first[i + 1]
                        of = windows.open[a:b]
                        fits = (scores >= windows.low[a:b][of].min()) & (scores <= windows.high[a:b][of].max())
                        fits &= ((labels[own] == asked.labels[i]) == same) & (ids[own] != asked.ids[i])
                        if fits.any():
                            yield int(i), scores[fits], ids[own][fits]


def _histograms(asked: Asked, windows: Windows, same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts `window, digit, need, n`."""
    counts: dict[int, np.ndarray] = {}
    for i, scores, _ in _scores(asked, windows, same, batches):
        for w in range(windows.first[i], windows.first[i + 1]):
            if windows.open[w]:
                inside = scores[(scores >= windows.low[w]) & (scores <= windows.high[w])]
                if len(inside):
                    n = np.bincount(digits(inside, windows.high[w], windows.shift[w]), minlength=1 << DIGIT).astype(np.int32)
                    counts[w] = counts[w] + n if w in counts else n
    held = list(counts)
    for start in range(0, len(held), 1024):
        part = held[start : start + 1024]
        table = np.array([counts[w] for w in part], np.int64)
        row, digit = np.nonzero(table)
        of = np.array(part, np.int64)[row]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of, digit.astype(np.int64), windows.need[of], table[row, digit])], names=["window", "digit", "need", "n"])


def _gathered(asked: Asked, windows: Windows, same: bool, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's best k rows of each window, `number, vec_id, score`."""
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, scores, ids in _scores(asked, windows, same, batches):
        for w in range(windows.first[i], windows.first[i + 1]):
            inside = (scores >= windows.low[w]) & (scores <= windows.high[w]) & windows.open[w]
            if inside.any():
                held = lists.get(w, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                s, x = np.concatenate([held[0], scores[inside]]), np.concatenate([held[1], ids[inside]])
                top = best(s, x, k)
                lists[w] = s[top], x[top]
    held = list(lists)
    for start in range(0, len(held), 4096):
        part = held[start : start + 4096]
        number = np.repeat(np.array(part, np.int64), [len(lists[w][0]) for w in part])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.concatenate([lists[w][1] for w in part])), pa.array(np.concatenate([lists[w][0] for w in part]))], names=["number", "vec_id", "score"])


def _sent(every: DataFrame, value: object) -> Broadcast:
    return every.sparkSession.sparkContext.broadcast(value)


def _located(every: DataFrame, asked: Broadcast, windows: Windows, same: bool, k: int) -> Windows:
    """The windows with their lower ends raised to where the k-th best row lies, or to a little below."""
    low, high, need = windows.low.copy(), windows.high.copy(), windows.need.copy()  # of the digit that holds the k-th row
    floor, open_ = windows.low.copy(), windows.open.copy()
    while open_.any():
        shift = np.array([shift_of(int(a), int(b)) if o else 0 for a, b, o in zip(low, high, open_, strict=True)], np.int64)
        now = _sent(every, Windows(windows.first, low, high, shift, need, open_))
        counts = every.mapInArrow(lambda b, now=now: _histograms(asked.value, now.value, same, b), "window long, digit long, need long, n long")
        counts = counts.groupBy("window", "digit", "need").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("window").orderBy("digit")))  # a digit's values at most
        found = {r.window: r for r in counts.where("upto >= need and upto - n < need").collect()}  # one row a window of the round
        now.destroy()
        for w in np.flatnonzero(open_):
            if w not in found:  # fewer than sought: all of it
                floor[w], open_[w] = low[w], False
                continue
            r, top = found[w], int(high[w])
            high[w] = top - (r.digit << int(shift[w]))
            low[w] = max(int(low[w]), top - ((r.digit + 1) << int(shift[w])) + 1)
            need[w] -= r.upto - r.n
            floor[w] = low[w]
            open_[w] = low[w] < high[w] and k - need[w] + r.n > FEW * k
    return windows._replace(low=floor)


def _best(every: DataFrame, asked: Broadcast, windows: Windows, same: bool, k: int) -> DataFrame:
    """`number, top`: the k best rows of each window."""
    now = _sent(every, _located(every, asked, windows, same, k))
    rows = every.mapInArrow(lambda b: _gathered(asked.value, now.value, same, k, b), "number long, vec_id long, score long")
    lists = stored(rows.withColumn("part", F.spark_partition_id()))
    now.destroy()
    found = stored(merged(lists, k, (lists.agg(F.max("part")).first()[0] or 0) + 1))
    forget(lists)
    return found


def _windows(counts: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Windows:
    """Windows of anchors that have so many each; those whose ends are crossed stay empty."""
    n = len(low)
    return Windows(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), low.astype(np.int64), high.astype(np.int64), np.zeros(n, np.int64), np.full(n, k, np.int64), low <= high)


def mine(anchors: DataFrame, vectors: DataFrame, k: int = 5, *, positives: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors_a_round: int = ANCHORS_A_ROUND) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`: of each anchor's best `positives` rows of its label the best k rows of other labels that score at least `share` of the positive's score and not more than it."""
    spark = vectors.sparkSession
    typed = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"]
    every = named(vectors, vec_id=id_col, label=label_col, embedding=vector_col).select(*typed).dropna()
    asked = stored(named(anchors, vec_id=id_col, label=label_col, embedding=vector_col).select(*typed, F.monotonically_increasing_id().alias("number")).dropna())
    size = F.aggregate(F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    longest = float(every.where(finite).agg(F.max(size)).first()[0] or 0.0) ** 0.5
    rounds = max(1, -(-asked.count() // anchors_a_round))
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    for turn in range(rounds):
        of_round = asked.where(F.pmod(F.xxhash64("number"), F.lit(rounds)) == turn).toArrow()  # about `anchors_a_round` rows
        ids, labels = (of_round.column(c).to_numpy() for c in ("vec_id", "label"))
        matrices = whole(of_round.column("embedding"))[1] if len(ids) else {}
        here = _sent(every, Asked(ids, labels, matrices))
        reach = np.zeros(len(ids))
        for numbers, matrix in matrices.values():
            reach[numbers] = np.sqrt((matrix**2).sum(1)) * longest * (1 + 1e-9) + 1  # no score is further from zero
        most = np.array([min(int(x), 2**63 - 1) for x in reach], np.int64)
        one = _best(every, here, _windows(np.ones(len(ids)), -most, most, positives), True, positives)
        found = one.select("number", F.posexplode("top").alias("place", "e")).select("number", "place", F.col("e.vec_id").alias("positive_id"), F.col("e.score").alias("positive_score"))
        met = sorted(found.select("number", "place", "positive_score").collect())  # `positives` rows an anchor of the round
        counts = np.bincount([r.number for r in met], minlength=len(ids)) if met else np.zeros(len(ids))
        top = [r.positive_score for r in met]
        low = [-((-share[0] * s) // share[1]) for s in top]
        two = _best(every, here, _windows(counts, np.array(low, np.int64), np.array(top, np.int64), k), False, k)
        numbered = found.withColumn("window", F.row_number().over(Window.partitionBy("number").orderBy("place")) - 1)
        starts = spark.createDataFrame(pa.table({"number": np.arange(len(ids), dtype=np.int64), "anchor_id": ids, "start": np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)}))
        numbered = numbered.join(F.broadcast(starts), "number").select((F.col("start") + F.col("window")).alias("number"), "anchor_id", "positive_id", "positive_score")  # one round's anchors
        listed = two.select("number", F.posexplode("top").alias("at", "e")).select("number", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("negative_id"), F.col("e.score").alias("negative_score"))
        numbered.join(listed, "number").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{folder}/round={turn}")
        here.destroy()
        forget(one, two)
    forget(asked)
    return spark.read.schema("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, round int").parquet(folder).drop("round")
