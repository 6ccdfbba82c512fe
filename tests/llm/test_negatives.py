"""Hard negatives against sorting every score in plain Python."""

import random

import numpy as np
import pytest

from tessera.llm import negatives


def expected(rows, anchors, k=5, positives=5):
    vec = {}
    whole = []
    for id_, label, v in rows:
        if id_ is None or label is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole.append((id_, label, [int(np.floor(256 * float(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for id_, label, v in whole:
        if not anchors(id_):
            continue
        others = sorted((-dot(v, w), j, other) for j, other, w in whole if j != id_ and len(w) == len(v))
        for s, j, _ in [x for x in others if x[2] == label][:positives]:
            fits = [(t, n) for t, n, other in others if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(id_, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, l, v, 1) for i, l, v in rows], "vec_id long, label int, embedding array<float>, number int").repartition(5)


def found(df, **how):
    return sorted(tuple(r) for r in negatives.mine(df.where("vec_id % 10 = 0"), df, **how).collect())


@pytest.mark.parametrize("anchors_a_round", [4096, 7])
def test_equal_to_sorting_every_score(spark, monkeypatch, anchors_a_round):
    pick = random.Random(anchors_a_round)
    rows = [(i, pick.randrange(3), [np.float32(pick.gauss(0.3, 0.4)).item() for _ in range(6)]) for i in range(300)]
    odd = [(300, 1, None), (310, None, [1.0] * 6), (None, 1, [1.0] * 6), (320, 1, [float("nan")] * 6), (330, 1, [None] * 6), (340, 2, []), (350, 0, [1.0, 2.0]), (351, 0, [1.0, 3.0]), (352, 1, [1.0, 2.9]), (360, 1, [0.0] * 6), (370, 1, [-3.0] * 6)]
    rows += [*odd, rows[10], rows[11]]
    monkeypatch.setattr(negatives, "FEW", 1)
    monkeypatch.setattr(negatives, "DIGIT", 3)
    assert found(frame(spark, rows), anchors_a_round=anchors_a_round) == expected(rows, lambda i: i % 10 == 0)


def test_ties_of_a_third_of_all_rows(spark):
    """Rows that tie at the k-th score are never gathered whole, and the smallest ids win."""
    pick = random.Random(1)
    same = [0.5, 0.25, 0.75, 0.5]
    rows = [(i, i % 2, same if i % 3 == 0 else [pick.random() for _ in range(4)]) for i in range(240)]
    assert found(frame(spark, rows)) == expected(rows, lambda i: i % 10 == 0)


def test_scores_of_64_bits_and_empty_tables(spark):
    rows = [(i, i % 2, [1000.0 * i, 2e5 * (20 - i), 3.5e6]) for i in range(20)]
    assert found(frame(spark, rows)) == expected(rows, lambda i: i % 10 == 0)
    assert negatives.mine(frame(spark, rows).where("false"), frame(spark, rows)).count() == 0
    assert negatives.mine(frame(spark, rows), frame(spark, rows).where("false")).count() == 0
    low = -(2**62)
    for high, shift in ((2**62, negatives.shift_of(low, 2**62)), (low + 5, 0)):
        d = negatives.digits(np.array([low, high], np.int64), high, shift)
        assert d.tolist() == [(high - low) >> shift, 0] and d.max() < 1 << negatives.DIGIT
