"""Toxicity by a classifier chain.

Categories are predicted one after the other: each has a linear (logistic) model over the words of a text and
the probabilities of the categories before it. In training those probabilities are out-of-fold
predictions, so a later model sees them as uncertain as they will be. The last category is the label itself.

The labels only say whether a text is toxic, so its kinds are learnt: the features that mark toxic texts are found (chi-squared), and spherical
k-means over them parts the toxic texts of the sample into `KINDS` groups, the largest first. No list of words is given, in any language.

A text's features are its distinct words and their first four, five and six letters, hashed. Each model keeps those
that differ more between its classes than chance explains among so many, the `KEPT_FEATURES` first at most. Models are fitted on at most `TRAINING_DOCS`
labelled documents; every document is scored whole, a slice of texts at a time, as products of a sparse matrix with the models' weights.

Cases: a null text counts as empty. Without labels of both kinds every probability is that of the empty model: the
share of positive labels, 0 without any. Labels that are null or name no document are left out, and of repeated rows of one document one counts. Repeated rows give a
row each. Only the named columns take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from .common import of_texts, texts_of
from .quality import labelled

#: Bound of the labelled sample that the chain is fitted on.
TRAINING_DOCS = 6000
FOLDS = 3
#: Features of a model: at most, and how many surely differing ones are enough to leave all others out.
KEPT_FEATURES, LEAST_FEATURES = 1500, 8
#: Groups of toxic texts, the features that part them, and the fewest texts of a group.
KINDS, KIND_FEATURES, LEAST_OF_KIND = 3, 200, 5
#: Hashed features: their numbers are below this.
SPACE = 1 << 20
#: Beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
#: Words that a worker remembers.
CACHED_WORDS = 200_000

_WORDS = re.compile(r"\w+").findall


def number(feature: str) -> int:
    """The hashed number of a feature."""
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % SPACE


def numbers_of(word: str) -> tuple[int, ...]:
    """The features of a word."""
    return (number(word), *(number("^" + word[:n]) for n in BEGINNINGS if len(word) >= n))


def features(text: str) -> np.ndarray:
    """Distinct hashed features of a text, sorted."""
    found: set[int] = set()
    for word in set(_WORDS(text.lower())):
        found.update(numbers_of(word))
    return np.array(sorted(found), np.int32)


class Rows:
    """Sparse rows of distinct features: `flat`, the features of all rows, and `at`, the row of each."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.n, self.flat, self.at = len(lengths), flat, np.repeat(np.arange(len(lengths)), lengths)

    def of(self, rows: np.ndarray) -> Rows:
        """Only these rows, in this order (ascending)."""
        kept = np.isin(self.at, rows)
        return Rows(self.flat[kept], np.bincount(self.at[kept], minlength=self.n)[rows])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each row the sum of its features' weights."""
        return np.bincount(self.at, weights[self.flat], minlength=self.n)


def chi_squared(rows: Rows, truth: np.ndarray) -> np.ndarray:
    """How much each feature's share differs between the classes; 0 for features seen less than three times."""
    yes = float(truth.sum())
    seen, seen_yes = np.bincount(rows.flat, minlength=SPACE).astype(float), np.bincount(rows.flat, truth[rows.at], minlength=SPACE)
    expected = seen * yes / rows.n
    return np.where(seen >= 3, (seen_yes - expected) ** 2 / np.maximum(expected * (1 - yes / rows.n), 1e-9), 0) * np.where(seen_yes > expected, 1, -1)


def kinds_of(rows: Rows, truth: np.ndarray, most: int = KINDS, rounds: int = 20) -> np.ndarray:
    """The group of each toxic row, -1 for the others: spherical k-means over marking features, from farthest rows on."""
    found, toxic = np.full(rows.n, -1), np.flatnonzero(truth > 0)
    most = min(most, len(toxic) // LEAST_OF_KIND)
    if most < 1 or len(toxic) == rows.n:
        return found
    chi = chi_squared(rows, truth)
    marks = np.argsort(-chi, kind="stable")[:KIND_FEATURES]
    marks = marks[chi[marks] > 0]
    place = np.full(SPACE, -1)
    place[marks] = np.arange(len(marks))
    own = rows.of(toxic)
    used = place[own.flat] >= 0
    x = np.zeros((len(toxic), max(1, len(marks))))
    x[own.at[used], place[own.flat[used]]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x.mean(0)]
    while len(centres) < most:
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(1)))])
    for _ in range(rounds):
        group = (x @ np.array(centres).T).argmax(1)
        centres = [x[group == k].sum(0) / max(1e-9, np.linalg.norm(x[group == k].sum(0))) for k in range(most)]
    order = np.argsort(-np.bincount(group, minlength=most), kind="stable")
    found[toxic] = np.argsort(order)[group]
    return found


class Linear:
    """A logistic model: weights of kept features, of the categories before it, and a bias."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.kept, self.weights, self.earlier, self.bias = kept, weights, earlier, bias

    def probabilities(self, sums: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + sums + earlier @ self.earlier, -30, 30)))

    def of(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        weights = np.zeros(SPACE)
        weights[self.kept] = self.weights
        return self.probabilities(rows.sums(weights), earlier)

    @classmethod
    def fit(cls, rows: Rows, earlier: np.ndarray, truth: np.ndarray, steps: int = 150, ridge: float = 0.02) -> Linear:
        n, yes = len(truth), float(truth.sum())
        if not 0 < yes < n:
            share = np.clip(yes / n if n else 0.0, 1e-9, 1 - 1e-9)
            return cls(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
        chi = np.abs(chi_squared(rows, truth))
        kept = np.argsort(-chi, kind="stable")[:KEPT_FEATURES]
        sure = 2 * np.log(max(2, np.count_nonzero(chi)))  # what the largest of so many chance differences comes to
        kept = np.sort(kept[chi[kept] > (sure if np.count_nonzero(chi > sure) >= LEAST_FEATURES else 0)])
        place = np.full(SPACE, -1)
        place[kept] = np.arange(len(kept))
        used = place[rows.flat] >= 0
        at, flat = rows.at[used], place[rows.flat[used]]
        w, v, bias = np.zeros(len(kept)), np.zeros(earlier.shape[1]), float(np.log(yes / (n - yes)))
        weight = np.where(truth > 0, n / (2 * yes), n / (2 * (n - yes)))
        momentum = [np.zeros_like(w), np.zeros_like(v), 0.0]
        rate = 4.0 / max(1.0, np.bincount(at, minlength=n).mean()) if len(at) else 1.0
        for _ in range(steps):
            score = bias + np.bincount(at, w[flat], minlength=n) + earlier @ v
            error = weight * (truth - 1 / (1 + np.exp(-np.clip(score, -30, 30)))) / n
            gradient = [np.bincount(flat, error[at], minlength=len(w)) - ridge * w / n, earlier.T @ error - ridge * v / n, error.sum()]
            momentum = [0.9 * m + g for m, g in zip(momentum, gradient, strict=True)]
            w, v, bias = w + rate * momentum[0], v + rate * momentum[1], bias + rate * momentum[2]
        return cls(kept, w, v, bias)


class Chain:
    """The models of the categories, in order, with the weights of all features that any of them keeps."""

    def __init__(self, names: Sequence[str], models: Sequence[Linear]):
        self.names, self.models = list(names), list(models)
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(m.kept for m in models)]))
        self.place = {int(f): i for i, f in enumerate(used)}
        self.weights = np.zeros((len(models), len(used)))
        for k, m in enumerate(models):
            self.weights[k, np.searchsorted(used, m.kept)] = m.weights
        self.held: dict[str, tuple[int, ...]] = {}

    def _places(self, word: str) -> tuple[int, ...]:
        """Places of a word's features that some model keeps: of most words none."""
        found = self.held.get(word)
        if found is None:
            if len(self.held) > CACHED_WORDS:
                self.held.clear()
            found = self.held[word] = tuple(p for p in map(self.place.get, numbers_of(word)) if p is not None)
        return found

    def probabilities(self, texts: Sequence[str]) -> np.ndarray:
        """A row of the categories' probabilities for each text."""
        rows = [sorted({p for word in set(_WORDS(t.lower())) for p in self._places(word)}) for t in texts]
        at, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([p for r in rows for p in r], np.int64)
        found = np.zeros((len(rows), len(self.models)))
        for k, model in enumerate(self.models):
            found[:, k] = model.probabilities(np.bincount(at, self.weights[k][flat], minlength=len(rows)), found[:, :k])
        return found

    @classmethod
    def fit(cls, rows: Rows, truths: Mapping[str, np.ndarray], folds: np.ndarray) -> Chain:
        earlier, models = np.zeros((rows.n, 0)), []
        for truth in truths.values():
            out = np.zeros(rows.n)
            for fold in range(FOLDS):
                held, rest = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
                out[held] = Linear.fit(rows.of(rest), earlier[rest], truth[rest]).of(rows.of(held), earlier[held])
            models.append(Linear.fit(rows, earlier, truth))
            earlier = np.column_stack([earlier, out])
        return cls(list(truths), models)


def learnt(rows: Rows, label: np.ndarray, folds: np.ndarray, label_name: str = "toxic") -> Chain:
    """The chain of the learnt kinds, `kind1` and so on, and then the label."""
    kinds = kinds_of(rows, label)
    truths = {f"kind{k + 1}": (kinds == k).astype(float) for k in range(KINDS)} | {label_name: label}
    return Chain.fit(rows, truths, folds)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t).tobytes() for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])


def fitted(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = TRAINING_DOCS) -> Chain:
    """The chain of the labelled documents; features, not texts, leave their tasks, and repeated rows are one before that."""
    sample = labelled(df, labels, label_col, most_docs, id_col=id_col, text_col=text_col)
    rows = sample.mapInArrow(_rows, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label bigint, features binary")
    once = rows.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("f")).select("doc_id", "f.*", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"))
    table = once.toArrow().sort_by("doc_id")  # `most_docs` rows
    held = [np.frombuffer(f, np.int32) for f in table.column("features").to_pylist()]
    found = Rows(np.concatenate([np.zeros(0, np.int32), *held]), np.array([len(f) for f in held], np.int64))
    return learnt(found, (table.column("label").to_numpy() > 0).astype(float), table.column("fold").to_numpy(), label_col)


def _scored(chain: Chain, texts: list[str]) -> pa.StructArray:
    found = chain.probabilities(texts)
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(chain.names))], names=chain.names)


def score(df: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and the probability of each category, by its name, of every document."""
    found = of_texts(lambda texts: _scored(chain, texts), ", ".join(f"`{n}`: double" for n in chain.names))
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), found(F.col(f"`{text_col}`")).alias("scored")).select("doc_id", "scored.*")
