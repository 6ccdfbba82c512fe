"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table predicts for every document the probabilities of the domains that the table names; so a
document belongs to several of them in part. Then every document gets a rate, how often it is to be used on
average, such that the expected tokens of the domains, the sum of rate x tokens x probability, come as close as
they can to the targets, in least squares. The rates are found by projected gradient steps with momentum: each starts at 1, moves
against the gradient and is put back to the least rate allowed, 0 unless stated otherwise.

Squares are taken in the measure of the domains' overlaps (the sums of tokens x probability x probability), and a rate's gradient by the document's tokens; in that measure the
curvature is 1 in every direction, so a step of length 1 always descends and meets the targets at once where no rate is put back. A rate
follows from the deviations of the steps so far, so a step is one pass over a narrow table of tokens and probabilities that
sums one number a domain; nothing else reaches the driver and no rate is stored between steps. Steps go on until the deviations are `CLOSE_ENOUGH` or, where the targets can't be met, until three in a row lessen the squares by less than
`LITTLE_GAIN` of them each; if neither comes about in `MOST_STEPS` that is an error. Sums are of whole thousandths of
a token and so don't depend on the partitioning.

Features are the text's byte triples, A-Z in lower case, hashed to `SPACE` counts over the whole text; tokens are words between
ASCII white space. The classifier is a softmax regression on square roots of the counts, scaled to length 1, fitted on at most
`TRAINING_DOCS` labelled documents. Computing a document's probabilities costs little, so the last pass does it again rather than carry texts along or join them.

Cases: a null text counts as empty: no tokens, and the probabilities of the classifier's bias. Labels whose domain is null or that name no document take no part
in the fit; of several labels of one document the least counts, and of repeated rows of one document one does; without any label there are no domains and every rate is 1. A target for a domain without expected tokens can't be met and is left out; a domain without a
target is to have none. Repeated rows give a row each and an empty table none. Only the named columns take part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import forget, named, of_texts, stored, unused

#: Hashed features, a power of two.
SPACE = 1 << 11
#: Bound of the labelled sample that the classifier is fitted on.
TRAINING_DOCS = 1500
#: Bytes whose triples are counted at once: bounds the memory of very long texts.
COUNTED_AT_ONCE = 1 << 20
#: The deviation, as a share of a domain's tokens, at which steps end, the share of the squares that a step has to gain, and how many steps are too many.
CLOSE_ENOUGH, LITTLE_GAIN, MOST_STEPS = 1e-4, 0.01, 1000
#: What the budget has beyond the least, where rates are at least 1: without it every document of the largest domain would have to stay at just 1.
ROOM = 1.05
#: Parts of a token in which expected tokens are summed.
TOKEN_PARTS = 1000

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Square roots of the hashed counts of byte triples, scaled to length 1, and the number of words."""
    raw = (text or "").encode("utf-8", "replace").lower()
    counts, words, before = np.zeros(SPACE), 0, True
    for start in range(0, len(raw), COUNTED_AT_ONCE):
        part = np.frombuffer(raw, np.uint8, min(COUNTED_AT_ONCE + 2, len(raw) - start), start)
        white = _WHITE[part[:COUNTED_AT_ONCE]]
        words += int(np.count_nonzero(white[:-1] & ~white[1:])) + int(before and not white[0])
        before = bool(white[-1])
        if len(part) > 2:
            wide = part.astype(np.uint32)
            triples = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
            counts += np.bincount((triples * np.uint32(2654435761)) >> np.uint32(21), minlength=SPACE)
    return np.sqrt(counts / max(1.0, counts.sum())), words


class Membership:
    """A softmax regression of domains on features."""

    def __init__(self, domains: Sequence[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = list(domains), weights, bias

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        score = rows @ self.weights + self.bias
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, rows: np.ndarray, labels: Sequence[str], steps: int = 400, rate: float = 40.0, ridge: float = 1e-5) -> Membership:
        """Gradient steps with momentum; domains are the labels in order."""
        domains = sorted(set(labels))
        truth = np.array([[x == d for d in domains] for x in labels], float)
        shares = truth.mean(axis=0)
        model = cls(domains, np.zeros((SPACE, len(domains))), np.log(shares))
        moved = np.zeros_like(model.weights)
        for _ in range(steps if len(domains) > 1 else 0):
            error = (truth - model.probabilities(rows)) / len(rows)
            moved = 0.9 * moved + 0.1 * (rows.T @ error - ridge * model.weights)
            model.weights = model.weights + rate * moved
            model.bias = model.bias + error.sum(axis=0)
        return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py())[0].astype(np.float32).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])


def fitted(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", most_docs: int = TRAINING_DOCS) -> Membership | None:
    """The classifier of the domains that a labelled table gives to documents, None without one; the sample is the same one whatever the partitioning.

    Only labels are shuffled: at most `most_docs` of them are broadcast, and a document's features, not its text, leave its task.
    """
    given = named(labels, doc_id=id_col, domain=domain_col).where("doc_id is not null and domain is not null")
    given = given.groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("label"))
    bounded = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    chosen = named(df, doc_id=id_col, text=text_col).join(F.broadcast(bounded), "doc_id").select("doc_id", "label", "text")
    each = chosen.mapInArrow(_feature_rows, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, label string, features binary")
    table = each.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("f")).select("f.*").toArrow()  # `most_docs` rows
    if not table.num_rows:
        return None
    found = sorted(zip(table.column("label").to_pylist(), table.column("features").to_pylist(), strict=True))
    return Membership.fit(np.stack([np.frombuffer(f, np.float32) for _, f in found]).astype(float), [x for x, _ in found])


def _scores(model: Membership | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and probabilities, rounded to millionths, of texts."""
    found = [features(t) for t in texts]
    rows = np.stack([f for f, _ in found]) if found else np.zeros((0, SPACE))
    shares = model.probabilities(rows) if model else np.zeros((len(found), 0))
    return np.array([n for _, n in found], np.int64), np.round(shares, 6)


def _scored(model: Membership | None, texts: list[str]) -> pa.StructArray:
    tokens, shares = _scores(model, texts)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.ravel()))
    return pa.StructArray.from_arrays([pa.array(tokens), lists], names=["n_tokens", "shares"])


def score(df: DataFrame, model: Membership | None, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """A struct `row` of the columns to keep, `n_tokens` and `shares`, the probabilities in the order of the model's domains, of every document."""
    found = of_texts(lambda texts: _scored(model, texts), "n_tokens: bigint, shares: array<double>")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), found(F.col(f"`{text_col}`")).alias("scored"))
    return rows.select("row", "scored.*")


def rates_of(shares: np.ndarray, steps: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after these steps, and the point that the next step starts from. A step is a row of what each domain moves and, last, its momentum."""
    rate = np.full(len(shares), max(1.0, least))
    point = rate
    for move, momentum in zip((shares @ steps[:, :-1].T).T, steps[:, -1], strict=True) if len(steps) else ():
        before, rate = rate, np.maximum(least, point - move)
        point = rate + momentum * (rate - before)
    return rate, point


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("shares").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _totals(steps: np.ndarray, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        shares, tokens = _matrix(batch), batch.column("n_tokens").to_numpy()
        both = [np.rint((r * tokens)[:, None] * shares * TOKEN_PARTS).astype(np.int64).sum(axis=0) for r in rates_of(shares, steps, least)]
        total = np.stack(both) if total is None else total + np.stack(both)
    if total is not None and total.size:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1]), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["domain", "parts", "next_parts"])


def totals(scored: DataFrame, n: int, steps: np.ndarray, least: float) -> np.ndarray:
    """Expected tokens of the n domains after these steps, at the rates and at the point of the next step."""
    parts = scored.select("n_tokens", "shares").mapInArrow(lambda b: _totals(steps, least, b), "domain int, parts bigint, next_parts bigint")
    found = np.zeros((2, n))
    for r in parts.groupBy("domain").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("parts", "next_parts"))).collect():  # a row a domain
        found[:, r.domain] = float(r.parts) / TOKEN_PARTS, float(r.next_parts) / TOKEN_PARTS
    return found


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        shares = _matrix(batch)
        part = np.rint((shares * batch.column("n_tokens").to_numpy()[:, None]).T @ shares * TOKEN_PARTS).astype(np.int64)
        total = part if total is None else total + part
    if total is not None and total.size:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "parts"])


def overlaps(scored: DataFrame, n: int) -> np.ndarray:
    """The n domains' overlaps: tokens that two of them share."""
    parts = scored.select("n_tokens", "shares").mapInArrow(_overlaps, "cell int, parts bigint")
    found = np.zeros(n * n)
    for r in parts.groupBy("cell").agg(F.sum(F.col("parts").cast("decimal(38,0)")).alias("parts")).collect():  # a row a pair of domains
        found[r.cell] = float(r.parts) / TOKEN_PARTS
    return found.reshape(n, n)


def solved(scored: DataFrame, domains: Sequence[str], weights: Mapping[str, float], *, budget: float | None = None, least: float = 0.0, most_steps: int = MOST_STEPS) -> np.ndarray:
    """The steps to the rates.

    weights: the domains' shares of the budget. budget: tokens of all domains; by default as many as there are, or,
    where rates are at least 1, `ROOM` times as many as the largest domain needs so that none has too many.
    """
    n = len(domains)
    steps = np.zeros((0, n + 1))
    own = totals(scored, n, steps, 0.0)[0]
    given = np.array([float(weights.get(d, 0.0)) for d in domains])
    if not n or not own.sum() or not given.sum():
        return steps
    given = given / given.sum()
    if budget is None:
        budget = own.sum() if least < 1 else ROOM * float((own[given > 0] / given[given > 0]).max())
    scale, measure = np.where(own > 0, own, 1.0), np.linalg.pinv(overlaps(scored, n), rcond=1e-6, hermitian=True)
    still, age, error = 0, 0, np.inf
    while True:
        at = np.stack([own, own]) if not len(steps) and least <= 1 else totals(scored, n, steps, least)
        off, ahead = (np.where(own > 0, x - budget * given, 0.0) for x in at)
        squares = float(off @ measure @ off)
        still = still + 1 if squares > (1 - LITTLE_GAIN) * error else 0
        if np.abs(off / scale).max() <= CLOSE_ENOUGH or still == 3:
            return steps
        if len(steps) == most_steps:
            raise ArithmeticError(f"after {most_steps} steps the expected tokens still deviate by {np.abs(off / scale).max():.2g} of a domain's tokens")
        age = 0 if squares > error else age + 1  # momentum starts anew where it led away
        steps, error = np.vstack([steps, [*(measure @ ahead), age / (age + 3)]]), squares


def _rated(steps: np.ndarray, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rate = np.round(rates_of(_matrix(batch), steps, least)[0], 6)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate, pa.float64())], names=[*batch.schema.names, "rate"])


def with_rates(scored: DataFrame, steps: np.ndarray, *, least: float = 0.0) -> DataFrame:
    """`scored` with each document's `rate`."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields)
    return scored.mapInArrow(lambda b: _rated(steps, least, b), f"{schema}, rate double")


def mixed(df: DataFrame, model: Membership | None, weights: Mapping[str, float], *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0, seed: int = 42) -> DataFrame:
    """The rows of `df`, all columns, each as often as its rate says: the whole part, and once more with the probability of the rest, drawn by the id."""
    domains = model.domains if model else []
    narrow = stored(score(df, model, keep=(id_col,), text_col=text_col))
    steps = solved(narrow, domains, weights, least=least)
    forget(narrow)

    def rates(texts: list[str]) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(np.round(rates_of(_scores(model, texts)[1], steps, least)[0], 6))], names=["rate"])

    again = unused(df, "rated")
    rate = F.col(again)["rate"]
    drawn = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    copies = (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("int")).cast("int")
    rated = df.withColumn(again, of_texts(rates, "rate: double")(F.col(f"`{text_col}`")))
    repeats = rated.select(*(F.col(f"`{c}`") for c in df.columns), F.explode(F.array_repeat(F.lit(0), copies)).alias(again))
    return repeats.drop(again)
