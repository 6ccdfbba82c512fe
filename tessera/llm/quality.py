"""Quality rules and line sequence labelling.

Counting rules reject short and repetitive texts. Of the rest, a linear-chain conditional random field
marks each line as content or boilerplate, Viterbi decoding finds the most probable sequence of marks, and the
share of characters in content lines decides whether a document stays.

The field has a weight for each line feature and for each pair of neighbouring marks, fitted to the
conditional likelihood of all labelled documents, whole. Up to `TRAINING_DOCS` of them are climbed at once by gradient ascent; where there are more,
that gives only the start and the curvature, and each further step takes the gradient over all of them, one pass of tasks that return sums. Only documents are labelled, so the truth of a
line comes from the lines. A line that stands in several documents in different surroundings (a licence, a notice) is boilerplate. In a document
of bad quality a line is boilerplate if a classifier of single lines tells it from the lines of good documents; other lines are content. So marks do change
within a text. A normal prior around hand-set weights keeps the fit steady and stands alone where no document is labelled. The least
content share is the one that best tells the good from the bad labelled documents, of equally good ones the nearest to a half.

Cases: a null text counts as empty and fails the rules; lines without a word take part in no count and no
sequence. Labels that are null or name no document are left out; of several labels of one document the largest counts, of repeated rows of one document one does.
Repeated rows give a row each. Only the named columns take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from .common import forget, named, of_texts, parts_of, spread_join, stored

#: So many labelled documents are fitted at once; of more, they are the sample that the passes over all of them start from.
TRAINING_DOCS = 2000
#: Least share of characters in content lines, where no sample says better.
LEAST_CONTENT = 0.5
#: Documents and different lines before it that make a line a shared one.
SHARED_BY = 3

_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))

#: Line features, and the prior mean of their weights towards boilerplate.
FEATURES = {"bias": -2.0, "symbols a word": 4.0, "capitals": 4.0, "repeated words": 4.0, "repeated line": 1.0, "exclamations a word": 2.0, "digits": 1.0, "very short": 0.5}
#: Prior mean of the weights of mark pairs: staying in a mark is likelier than changing it.
STAY = 1.0
#: Strength of the prior of line weights and of pair weights, a document.
PRIOR = np.array([0.005] * len(FEATURES) + [0.05] * 4)
#: Strength of the ridge of the classifier of single lines.
RIDGE = 1e-3


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in 3-word windows found twice or more."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: ASCII white space only
    n = len(words)
    inked = raw.translate(None, _WHITE)
    word_chars = len(inked) - (len(inked) - len(inked.translate(None, _CONTINUATION)))
    n_symbols = len(inked) - len(inked.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    repeated = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated += bool(line.strip(_WHITE))
        seen.add(line)
    covered = 0
    if n > 3:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        pairs = ids[:-1] * len(numbers) + ids[1:]
        if len(numbers) >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(numbers) + ids[2:]
        order = np.argsort(windows, kind="stable")
        equal = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(n - 2, bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        mask = np.zeros(n, bool)
        for shift in range(3):
            mask[shift : n - 2 + shift] |= again
        covered = int(mask.sum())
    return n, word_chars, n_symbols, repeated, covered


def lines_of(text: str | None) -> list[bytes]:
    """The lines that have a word."""
    return [line for line in (text or "").encode().split(b"\n") if line.strip(_WHITE)]


def line_features(lines: Sequence[bytes]) -> np.ndarray:
    """A row of features for each line."""
    rows = []
    seen: set[bytes] = set()
    for line in lines:
        words = line.split()
        n, ink = len(words), max(1, len(line) - line.count(b" "))
        rows.append((
            1.0,
            min(1.0, (len(line) - len(line.translate(None, _SYMBOLS))) / n),
            (len(line) - len(line.translate(None, _UPPER))) / ink,
            max(0.0, 1 - len(set(words)) / n**0.9) if n > 3 else 0.0,
            float(line in seen),
            min(1.0, line.count(b"!") / n),
            (len(line) - len(line.translate(None, b"0123456789"))) / ink,
            float(n < 4),
        ))
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def _products(m: np.ndarray, longest: int, backwards: bool) -> np.ndarray:
    """Products of 2 x 2 matrices up to each place (or from it on), scaled to a sum of 1, in rounds that double their reach; right wherever `longest` matrices reach a reset."""
    p, reach = m / m.sum((1, 2), keepdims=True), 1
    while reach < longest and reach < len(p):
        left, right = p[:-reach], p[reach:]
        both = np.stack([np.stack([left[:, i, 0] * right[:, 0, j] + left[:, i, 1] * right[:, 1, j] for j in (0, 1)], -1) for i in (0, 1)], 1)
        both /= both.sum((1, 2), keepdims=True)
        p = np.concatenate([both, p[-reach:]]) if backwards else np.concatenate([p[:reach], both])
        reach *= 2
    return p


class Field:
    """A linear-chain field of two marks: 0 content, 1 boilerplate; `least` is the least content share of a document that stays."""

    def __init__(self, weights: np.ndarray | None = None, pairs: np.ndarray | None = None, least: float = LEAST_CONTENT):
        self.weights = np.array(list(FEATURES.values())) if weights is None else weights
        self.pairs = np.array([[STAY, 0.0], [0.0, STAY]]) if pairs is None else pairs
        self.least = least

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The most probable marks, by Viterbi."""
        n = len(features)
        marks = np.zeros(n, np.int8)
        if not n:
            return marks
        (cc, cb), (bc, bb) = self.pairs.tolist()
        content, boiler, back = 0.0, 0.0, []
        for i, score in enumerate((features @ self.weights).tolist()):
            if i:
                to_content, to_boiler = bc + boiler > cc + content, bb + boiler > cb + content
                back.append((to_content, to_boiler))
                content, boiler = (bc + boiler if to_content else cc + content), (bb + boiler if to_boiler else cb + content)
            else:
                content = 0.0
            boiler += score
        marks[-1] = at = int(boiler > content)
        for i in range(n - 2, -1, -1):
            marks[i] = at = int(back[i][at])
        return marks

    def marginals(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of boilerplate for each line, and of each pair of marks of a line and the one before (no pair at a text's start).

        Forward and backward sums are running products of 2 x 2 matrices, reset where a text starts.
        """
        own = np.exp(np.clip(np.stack([np.zeros(len(x)), x @ self.weights], -1), -30, 30))
        step = np.exp(self.pairs)[None] * own[:, None, :]
        step[starts] = own[starts][:, None, :]
        after = np.full_like(step, 0.5)
        after[:-1][~starts[1:]] = step[1:][~starts[1:]]
        longest = int(np.diff(np.append(np.flatnonzero(starts), len(x))).max()) if len(x) else 0
        ahead, behind = _products(step, longest, False)[:, 0, :], _products(after, longest, True).sum(2)
        one = ahead * behind
        two = np.zeros_like(step)
        two[1:] = ahead[:-1, :, None] * step[1:] * behind[1:, None, :]
        two[starts] = 0
        total = two.sum((1, 2), keepdims=True)
        return one[:, 1] / one.sum(1), two / np.where(total > 0, total, 1)

    @property
    def all_weights(self) -> np.ndarray:
        """Line weights and then pair weights."""
        return np.concatenate([self.weights, self.pairs.ravel()])

    def with_weights(self, w: np.ndarray) -> Field:
        """A field of these line and pair weights."""
        return Field(w[: len(FEATURES)], w[len(FEATURES) :].reshape(2, 2), self.least)

    def likelihood_gradient(self, x: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Gradient of the log likelihood of the marks by all weights; those of several lots of texts add up."""
        inside = ~starts[1:]
        stays = np.array([[float(((marks[:-1] == i) & (marks[1:] == j) & inside).sum()) for j in (0, 1)] for i in (0, 1)])
        one, two = self.marginals(x, starts)
        return np.concatenate([x.T @ (marks - one), (stays - two.sum(0)).ravel()])

    def fit(self, x: np.ndarray, marks: np.ndarray, starts: np.ndarray, steps: int = 300, rate: float = 0.1, close_enough: float = 3e-3) -> Field:
        """Weights of greatest posterior: Adam steps until no part of the gradient exceeds `close_enough`. starts: where a text's lines begin."""
        if len(set(marks.tolist())) < 2:
            return self
        n_docs, found = int(starts.sum()), self.with_weights(self.all_weights)
        state = np.zeros((2, self.weights.size + 4))
        for step in range(1, steps + 1):
            gradient = found.likelihood_gradient(x, marks, starts) / n_docs - PRIOR * (found.all_weights - self.all_weights)
            if np.abs(gradient).max() <= close_enough:
                break
            state = state * [[0.9], [0.99]] + [0.1 * gradient, 0.01 * gradient**2]
            move = rate * step**-0.25 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            found = found.with_weights(found.all_weights + move)
        return found


def shared_lines(digests: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Which lines of each text stand in `SHARED_BY` texts or more, after as many different lines: copies of a text share their surroundings, a notice doesn't."""
    texts, lines, before = [], [], []
    for i, d in enumerate(digests):
        texts.append(np.full(len(d), i))
        lines.append(d)
        before.append(np.concatenate([[0], d[:-1]])[: len(d)])
    if not sum(map(len, digests)):
        return [np.zeros(0, bool) for _ in digests]
    line, number = np.unique(np.concatenate(lines), return_inverse=True)
    distinct = lambda other: np.bincount(np.unique(np.stack([number, np.unique(other, return_inverse=True)[1]]), axis=1)[0], minlength=len(line))
    shared = (distinct(np.concatenate(texts)) >= SHARED_BY) & (distinct(np.concatenate(before)) >= SHARED_BY)
    return np.split(shared[number], np.cumsum([len(d) for d in digests])[:-1])


def line_classifier(x: np.ndarray, good: np.ndarray, steps: int = 200, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic classifier that tells lines of bad documents, both kinds weighing the same. good: whether a line's document is."""
    w, kinds = np.zeros(x.shape[1]), [max(1, int(good.sum())), max(1, int((~good).sum()))]
    weight = np.where(good, 0.5 / kinds[0], 0.5 / kinds[1])
    for _ in range(steps):
        w += rate * 4 * (x.T @ (weight * (~good - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))) - RIDGE * w)
    return w


def line_truth(x: np.ndarray, good: np.ndarray, shared: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The marks of labelled documents' lines, by the classifier's weights."""
    w = line_classifier(x, good) if w is None else w
    return (shared | ~good & (x @ w > 0)).astype(np.int8)


def content_share(field: Field, text: str | None) -> float:
    """Share of characters in the lines marked as content; 0 without any line."""
    lines = lines_of(text)
    if not lines:
        return 0.0
    sizes = np.array([len(line) for line in lines])
    return float(sizes[field.decode(line_features(lines)) == 0].sum() / sizes.sum())


def labelled(df: DataFrame, labels: DataFrame, label_col: str, most: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, text, label` of at most `most` labelled documents, the same ones whatever the partitioning; only ids are broadcast."""
    bounded = _given(labels, label_col, id_col).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return named(df, doc_id=id_col, text=text_col).join(F.broadcast(bounded), "doc_id")


def _given(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """`doc_id, label`: of several labels of one document the largest."""
    return named(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


#: Least content shares that are tried.
_TRIES = np.arange(0.3, 0.951, 0.05)


def _best_least(good_stay: np.ndarray, bad_go: np.ndarray) -> float:
    """The share tried that best tells good from bad, by what part of each it decides rightly; of equally good ones the nearest to `LEAST_CONTENT`."""
    scores = good_stay + bad_go
    best = _TRIES[np.isclose(scores, max(scores))]
    return float(round(best[np.argmin(np.abs(best - LEAST_CONTENT))], 2))


def _content_share(field: Field, features: np.ndarray, sizes: bytes) -> float:
    sizes = np.frombuffer(sizes, np.int32)
    return sizes[field.decode(features) == 0].sum() / sizes.sum()


def _joined(features: Sequence[bytes]) -> tuple[list[np.ndarray], list[int], np.ndarray, np.ndarray]:
    """Features text by text, their lengths, all of them, and where texts start."""
    each = [np.frombuffer(f, np.float32).reshape(-1, len(FEATURES)).astype(float) for f in features]
    lengths = [len(f) for f in each]
    starts = np.zeros(sum(lengths), bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    return each, lengths, np.concatenate(each), starts


def learnt(field: Field, rows: Sequence[tuple[int, bytes, bytes, bytes]]) -> Field:
    """The field of documents `label, features, digests, sizes`."""
    rows = [r for r in rows if r[1]]
    if len({r[0] > 0 for r in rows}) < 2:
        return field
    features, lengths, x, starts = _joined([r[1] for r in rows])
    shared = shared_lines([np.frombuffer(r[2], np.uint64) for r in rows])
    good = np.array([r[0] > 0 for r in rows])
    found = field.fit(x, line_truth(x, np.repeat(good, lengths), np.concatenate(shared)), starts)
    shares = np.array([_content_share(found, f, r[3]) for f, r in zip(features, rows, strict=True)])
    found.least = _best_least(np.array([(shares[good] >= t).mean() for t in _TRIES]), np.array([(shares[~good] < t).mean() for t in _TRIES]))
    return found


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch, "text"):
            texts, packed = part.column("text"), []
            for i in range(part.num_rows):
                lines = lines_of(texts[i].as_py())
                digests = np.array([xxhash.xxh64_intdigest(line) for line in lines], np.uint64)
                packed.append((line_features(lines).astype(np.float32).tobytes(), digests.tobytes(), np.array([len(line) for line in lines], np.int32).tobytes()))
            columns = [pa.array([p[k] for p in packed], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "features", "digests", "sizes"])


def _line_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line: its document, place and digest, and the digest of the line before (0: none)."""
    for batch in batches:
        for part in parts_of(batch, "digests"):
            held = [np.frombuffer(d, np.int64) for d in part.column("digests").to_pylist()]
            ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(held)), [len(d) for d in held])))
            places = np.concatenate([np.arange(len(d), dtype=np.int32) for d in held])
            before = np.concatenate([np.concatenate([[0], d[:-1]])[: len(d)] for d in held]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(places), pa.array(np.concatenate(held)), pa.array(before)], names=["doc_id", "place", "line", "before"])


def _with_shared(rows: DataFrame) -> DataFrame:
    """`rows` with `shared`, the places of lines that stand in `SHARED_BY` documents or more, after as many different lines; lines that very many documents have stay spread."""
    lines = rows.mapInArrow(_line_pairs, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, place int, line bigint, before bigint")
    counts = lines.groupBy("line").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("before").alias("befores"), F.count("*").alias("n"))
    often = stored(counts.where((F.col("docs") >= SHARED_BY) & (F.col("befores") >= SHARED_BY)).select("line", "n"))
    places = spread_join(lines.select("doc_id", "place", "line"), often, "line", "n").groupBy("doc_id").agg(F.collect_list("place").alias("shared"))
    found = stored(rows.join(places, "doc_id", "left").select("label", "features", "sizes", "shared"))
    forget(often)
    return found


def _summed(rows: DataFrame, function: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of what a function gives for a lot of them; it gets whether each text is good, the texts' features and sizes, and of all their lines the features, whether their text is good, whether they are shared, and where texts start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in parts_of(batch, "features"):
                each, lengths, x, starts = _joined(part.column("features").to_pylist())
                good, shared = part.column("label").to_numpy() > 0, np.zeros(len(x), bool)
                for first, places in zip(np.flatnonzero(starts), part.column("shared").to_pylist(), strict=True):
                    shared[first + np.array(places or [], int)] = True
                found = function(good, each, part.column("sizes").to_pylist(), x, np.repeat(good, lengths), shared, starts)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], names=["sums"])

    return sum(np.frombuffer(r.sums) for r in rows.mapInArrow(run, "sums binary").collect())  # one row a task


def _climbed(slope: Callable[[np.ndarray], np.ndarray], at: np.ndarray, steep: np.ndarray, close_enough: float, most_rounds: int = 50) -> np.ndarray:
    """Where a gradient's parts are within `close_enough` of 0, or `most_rounds` later, by BFGS steps that halve when the gradient grows. slope: gradient at a point; steep: about how it falls there."""
    step, gradient = 1.0, slope(at)
    for _ in range(most_rounds):
        if np.abs(gradient).max() <= close_enough:
            break
        move = step * np.linalg.solve(steep, gradient)
        there = slope(at + move)
        fell, guess = gradient - there, steep @ move
        if fell @ move > 0:
            steep = steep + np.outer(fell, fell) / (fell @ move) - np.outer(guess, guess) / (guess @ move)
        if np.linalg.norm(there) < np.linalg.norm(gradient):
            at, gradient, step = at + move, there, min(1.0, 2 * step)
        else:
            step /= 2
    return at


def learnt_from_all(field: Field, rows: DataFrame, sample: Sequence[tuple[int, bytes, bytes, bytes]], close_enough: float = 1e-4) -> Field:
    """The field of all documents `doc_id, label, features, digests, sizes`, however many: the sample gives where to start and how steep it is there, each step's gradient is that of all rows."""
    kinds = {r.good for r in rows.select((F.col("label") > 0).alias("good")).distinct().collect()}
    if len(kinds) < 2:
        return field
    _, lengths, x, starts = _joined([r[1] for r in sample])
    good = np.repeat([r[0] > 0 for r in sample], lengths)
    n = len(FEATURES)
    rows = _with_shared(rows)

    def line_slope(w: np.ndarray) -> np.ndarray:
        def sums(_good, _each, _sizes, x, good, _shared, _starts):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.stack([np.concatenate([[k.sum()], x[k].T @ (~good - p)[k]]) for k in (good, ~good)])

        found = _summed(rows, sums).reshape(2, -1)
        return (found[:, 1:] / found[:, :1]).sum(0) / 2 - RIDGE * w

    w = line_classifier(x, good)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    both = [x[k].T @ (x[k] * (p * (1 - p))[k, None]) / max(1, k.sum()) for k in (good, ~good)]
    w = _climbed(line_slope, w, sum(both) / 2 + RIDGE * np.eye(n), close_enough)
    counts = _summed(rows, lambda _good, each, _sizes, x, good, shared, _starts: np.array([len(each), len(x), line_truth(x, good, shared, w).sum()]))
    n_docs, found = counts[0], field
    if 0 < counts[2] < counts[1]:
        start = learnt(field, sample).all_weights
        of_sample = lambda at: field.with_weights(at).likelihood_gradient(x, np.zeros(len(x)), starts) / len(sample)
        steep = np.stack([of_sample(start - e) - of_sample(start + e) for e in 1e-3 * np.eye(n + 4)]) / 2e-3  # marks don't change it

        def slope(at: np.ndarray) -> np.ndarray:
            tried = field.with_weights(at)
            whole = _summed(rows, lambda _good, _each, _sizes, x, good, shared, starts: tried.likelihood_gradient(x, line_truth(x, good, shared, w), starts))
            return whole / n_docs - PRIOR * (at - field.all_weights)

        found = field.with_weights(np.round(_climbed(slope, start, (steep + steep.T) / 2 + np.diag(PRIOR), close_enough), 6))

    def decided(good, each, sizes, *_):
        shares = np.array([_content_share(found, f, s) for f, s in zip(each, sizes, strict=True)])
        return np.concatenate([[good.sum(), (~good).sum()], *([(shares[good] >= t).sum(), (shares[~good] < t).sum()] for t in _TRIES)])

    n_good, n_bad, *right = _summed(rows, decided)
    forget(rows)
    least = _best_least(np.array(right[::2]) / n_good, np.array(right[1::2]) / n_bad)
    return Field(found.weights, found.pairs, least)


def fitted(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = TRAINING_DOCS) -> Field:
    """The field of all labelled documents: a document's features, not its text, leave its task, and repeated rows are one before that. most_docs: so many are fitted at once, more in passes over all of them."""
    texts = named(df, doc_id=id_col, text=text_col).where("doc_id is not null")
    each = texts.mapInArrow(_line_rows, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, features binary, digests binary, sizes binary").where("length(features) > 0")
    given = each.join(_given(labels, label_col, id_col), "doc_id")
    once = stored(given.groupBy("doc_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "features", "digests", "sizes")).alias("f")).select("doc_id", "f.*"))
    sample = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs + 1).collect()
    rows = [(r.label, r.features, r.digests, r.sizes) for r in sorted(sample[:most_docs], key=lambda r: r.doc_id)]
    found = learnt(Field(), rows) if len(sample) <= most_docs else learnt_from_all(Field(), once, rows)
    forget(once)
    return found


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(field: Field, least: float, texts: list[str]) -> pa.StructArray:
    counts, share = np.zeros((len(texts), len(_COUNTS)), np.int64), np.zeros(len(texts))
    for i, text in enumerate(texts):
        counts[i], share[i] = base_counts(text), content_share(field, text)
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    columns = [*(pa.array(counts[:, k]) for k in range(len(_COUNTS))), pa.array(failed), pa.array(share), pa.array(~failed & (share >= least))]
    return pa.StructArray.from_arrays(columns, names=[*_COUNTS, "base_failed", "content_share", "kept"])


def judge(df: DataFrame, field: Field, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text", least_content: float | None = None) -> DataFrame:
    """A struct `row` of the columns to keep, the counts, `base_failed`, `content_share` and `kept` of every document."""
    least = field.least if least_content is None else least_content
    found = of_texts(lambda texts: _judged(field, least, texts), ", ".join(f"{c}: bigint" for c in _COUNTS) + ", base_failed: boolean, content_share: double, kept: boolean")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), found(F.col(f"`{text_col}`")).alias("judged"))
    return rows.select("row", "judged.*")
