"""Phrases that are more than their parts: n-gram counts by sorted suffixes, then the counts of a phrase's parts joined to it.

Every word of a piece begins a suffix of at most `longest` words, cut at the piece's end, and its language is put before it
as a word of its own. Suffixes of about `SLICE` bytes of text are counted before they leave their task. They are dealt to parts by
ranges of language and first word, and of the words after it where a first word is so frequent that it fills several parts; the
bounds come from a sample of texts, which decides nothing but the parts' sizes. Each part is sorted in descending
order, so every phrase comes right after what extends it, and one stack, which holds the open phrase of each length, counts all
of a part's phrases in one pass. A phrase that is open at a part's beginning or end may go on in the part beside it, so its counts are added
up; all other phrases below the least count end here. Of what remains, far less than the text, candidates are cut at each place
and the counts of both parts joined.

A suffix is one text of words and tabs. No word has a tab, so the tab sorts before all that words have once the nine characters
below it are written as a line feed, which no word has either, and a digit.

Cases: a null text is empty, a null language `und`, and both columns may be null in one row; texts without words give nothing. Long texts are
cut into windows of `WINDOW` bytes, which overlap by the suffix's length, so any length goes through. Repeated rows count each. Ties
of score and count go to the phrase that is first by its bytes. Only the named columns take part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .common import named, parts_of, stored

#: Bytes of text whose suffixes are counted together before they are shuffled, and of a long text's window.
SLICE, WINDOW = 4 << 20, 4 << 20
#: Bytes of text that a part is made for, and the most parts; beyond that parts get larger.
PART_BYTES, MOST_PARTS = 8 << 20, 50_000
#: Suffixes looked at for each bound, and the share of the texts they come from.
SAMPLES, SAMPLED = 32, 1 / 32
#: Groups in which the first rows of a language are chosen before they meet.
SPREAD = 64

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What stands for a character that would sort before the tab, and for the tab and the line feed, which names of languages can have.
_MARKS = {chr(c): f"\n{c}" for c in range(9)} | {"\t": "\n:", "\n": "\n9"}


def _escaped(words: pa.StringArray) -> pa.StringArray:
    """Words in which nothing sorts before the tab."""
    if not pc.any(pc.match_substring_regex(words, "[\\x00-\\x0a]")).as_py():
        return words
    return pa.array(["".join(_MARKS.get(c, c) for c in w) for w in words.to_pylist()], pa.string())


def _plain(column: F.Column) -> F.Column:
    """The words that `_escaped` was given; the mark of the line feed is undone last."""
    for c, mark in _MARKS.items():
        column = F.replace(column, F.lit(mark), F.lit(c))
    return column


def _words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[pa.StringArray, np.ndarray, np.ndarray]]:
    """Words of the texts between the offsets, in order and by windows: the lower-cased words, the number of the piece that each is in, and of its text.

    A window ends at the last character that isn't a word's, so no word is cut.
    """
    start, pieces = 0, 0
    while start < len(data):
        end = min(len(data), start + WINDOW)
        if end < len(data):
            apart = np.flatnonzero(_KIND[data[start:end]])
            while not len(apart) and end < len(data):
                end = min(len(data), end + WINDOW)
                apart = np.flatnonzero(_KIND[data[start:end]])
            end = start + int(apart[-1]) + 1 if len(apart) and end < len(data) else end
        part = data[start:end]
        kind = _KIND[part]
        word = kind == 0
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        heads = offsets[(offsets > start) & (offsets < end)] - start  # of texts: a word ends where its text does
        begins[heads] = word[heads]
        at = np.flatnonzero(begins)
        if len(at):
            text = np.searchsorted(offsets, at + start, "right") - 1
            piece = np.cumsum(kind == 2)[at] + text + pieces  # neither falls, so equal sums are one piece of one text
            sizes = np.add.reduceat(word, at, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(_LOWER[part[word]])), piece, text
        pieces += int((kind == 2).sum())
        start = end


def _counted(words: pa.StringArray, piece: np.ndarray, lang: np.ndarray, langs: pa.StringArray, n: int, longest: int) -> tuple[pa.StringArray, np.ndarray]:
    """Suffixes that begin at the first `n` words, each once, in ascending order, with their counts."""
    coded = words.dictionary_encode()
    own = _escaped(coded.dictionary)
    order = pc.sort_indices(own).to_numpy()
    rank = np.empty(len(own) + 1, np.int64)
    rank[order] = np.arange(1, len(own) + 1)
    rank[-1] = 0
    ids = rank[coded.indices.to_numpy()]
    base = len(own) + 1
    columns = [lang[:n].astype(np.int64), ids[:n]]
    for k in range(1, longest):
        later = np.zeros(n, np.int64)
        m = min(n, len(ids) - k)
        if m > 0:
            later[:m] = np.where(piece[k : k + m] == piece[:m], ids[k : k + m], 0)
        columns.append(later)
    keys: list[np.ndarray] = []  # as few numbers a suffix as hold all its words
    room = 0
    for column, size in zip(columns, [len(langs), *[base] * longest], strict=True):
        if keys and room * size < 2**62:
            keys[-1], room = keys[-1] * size + column, room * size
        else:
            keys.append(column.copy())
            room = size
    at = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(n, bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[at[1:]] != key[at[:-1]]
    firsts = np.flatnonzero(new)
    counts = np.diff(np.append(firsts, n))
    chosen = at[firsts]
    spelt = pc.take(own, pa.array(order))
    parts = [pc.take(langs, pa.array(columns[0][chosen]))]
    for column in columns[1:]:
        ids_ = column[chosen]
        parts.append(pc.take(spelt, pa.array(np.where(ids_ > 0, ids_ - 1, 0), mask=ids_ == 0)))
    return pc.binary_join_element_wise(*parts, "\t", null_handling="skip"), counts


def _suffixes(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """Counted suffixes of a slice of rows `lang, text`, in ascending order, window by window."""
    texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    coded = _escaped(pc.fill_null(batch.column("lang"), "und")).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    lang, langs = rank[coded.indices.to_numpy()], pc.take(coded.dictionary, pa.array(order))
    held: tuple[pa.StringArray, np.ndarray, np.ndarray] | None = None
    for words, piece, text in _words(data, offsets - offsets[0]):
        if held is not None:
            words, piece, text = pa.concat_arrays([held[0], words]), np.concatenate([held[1], piece]), np.concatenate([held[2], text])
        n = max(0, len(words) - longest + 1)
        if n:
            yield _counted(words, piece, lang[text], langs, n, longest)
        held = words[n:], piece[n:], text[n:]
    if held is not None and len(held[0]):
        yield _counted(*held[:2], lang[held[2]], langs, len(held[0]), longest)


def _dealt(bounds: Sequence[str], longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted suffixes with their part: how many bounds aren't above the suffix."""
    cuts = np.array(bounds, object)
    for batch in batches:
        for rows in parts_of(batch, "text", SLICE):
            for keys, counts in _suffixes(rows, longest):
                at = np.searchsorted(keys.to_numpy(zero_copy_only=False), cuts) if bounds else np.zeros(0, np.int64)  # code points order as bytes do
                part = np.searchsorted(at, np.arange(len(keys)), "right").astype(np.int32)
                for start in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(part[start : start + (1 << 16)]), keys[start : start + (1 << 16)], pa.array(counts[start : start + (1 << 16)], pa.int64())], names=["part", "key", "n"])


def _looked_at(longest: int, step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every `step`-th suffix of the rows, in their own order of windows."""
    seen = 0
    for batch in batches:
        for rows in parts_of(batch, "text", SLICE):
            for keys, counts in _suffixes(rows, longest):
                ends = seen + np.cumsum(counts)
                at = np.searchsorted(ends, np.arange(-(-(seen + 1) // step) * step, ends[-1] + 1, step))
                seen = int(ends[-1])
                yield pa.RecordBatch.from_arrays([pc.take(keys, pa.array(at))], names=["key"])


class _Stack:
    """The open phrase of each length, with its count so far, over a part's sorted suffixes."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.words: list[str] = []  # of the last suffix
        self.counts: list[int] = []
        self.first: list[bool] = []  # whether the phrase has been open since the part began

    def close(self, depth: int, *, ends: bool = False) -> Iterator[tuple[str, int, int]]:
        """Phrases longer than `depth` are over; those that the part beside this one may go on with are given whatever their count."""
        while len(self.counts) > depth:
            n, first = self.counts.pop(), self.first.pop()
            if n >= self.least or first or ends or not self.counts:
                yield "\t".join(self.words[: len(self.counts) + 1]), len(self.counts), n
        del self.words[depth:]

    def add(self, keys: pa.StringArray, n: np.ndarray, *, begins: bool) -> Iterator[tuple[str, int, int]]:
        """Suffixes that follow those before; `begins` if they are the part's first."""
        lists = pc.split_pattern(keys, "\t")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        values = lists.flatten()
        coded = values.dictionary_encode()
        spelt, ids = coded.dictionary, coded.indices.to_numpy()
        lengths = lists.value_lengths().to_numpy()
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        deep = int(lengths.max())
        table = np.full((len(lengths), deep), -1, np.int64)
        for k in range(deep):
            has = lengths > k
            table[has, k] = ids[starts[has] + k]
        words = lambda row, depth: pc.take(spelt, pa.array(table[row, :depth])).to_pylist()
        mine = words(0, int(lengths[0]))
        common = 0
        while common < min(len(mine), len(self.words)) and mine[common] == self.words[common]:
            common += 1
        yield from self.close(common)
        same = np.ones(len(lengths) - 1, bool)
        open_ = len(self.counts)
        last = len(lengths) - 1
        stack: list[tuple[int, bool]] = []
        for k in range(deep):
            same = same & (table[1:, k] == table[:-1, k]) & (table[1:, k] >= 0)
            begin = np.concatenate([[0], np.flatnonzero(~same) + 1])
            sums = np.add.reduceat(n, begin)
            real = table[begin, k] >= 0
            if k < open_ and real[0]:
                sums[0] += self.counts[k]
            early = np.zeros(len(begin), bool)
            early[0] = self.first[k] if k < open_ else begins
            goes_on = np.zeros(len(begin), bool)
            goes_on[-1] = real[-1]
            for j in np.flatnonzero(real & ~goes_on & ((sums >= self.least) | early | (k == 0))):
                yield "\t".join(words(begin[j], k + 1)), k, int(sums[j])
            if goes_on[-1]:
                stack.append((int(sums[-1]), bool(early[-1])))
        self.words = words(last, int(lengths[last]))
        self.counts, self.first = [c for c, _ in stack], [f for _, f in stack]


def _phrases(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of sorted suffixes `part, key, n`, with the number of their words and their counts."""
    stack, part = _Stack(least), None

    def out(found: Iterator[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        rows = list(found)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "words", "n"])

    for batch in batches:
        parts, keys, n = batch.column("part").to_numpy(), batch.column("key"), batch.column("n").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]]) if len(parts) else np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            begins = part != parts[a]
            if begins:
                yield from out(stack.close(0, ends=True))
                part = parts[a]
            yield from out(stack.add(keys.slice(a, b - a), n[a:b], begins=begins))
    yield from out(stack.close(0, ends=True))


def counted_phrases(df: DataFrame, *, least: int, longest: int = 4, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`key, words, n` of every phrase of at most `longest` words with at least so many occurrences, and of every language, with 0 words and its number of words. A key is language and words, parted by tabs."""
    rows = named(df, lang=lang_col, text=text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = min(MOST_PARTS, size // PART_BYTES + 1)
    bounds: list[str] = []
    if n_parts > 1:
        step = max(1, int(size * SAMPLED / 8 / (SAMPLES * n_parts)))  # a word is taken for 8 bytes
        seen = rows.sample(SAMPLED, seed=13).mapInArrow(lambda b: _looked_at(longest, step, b), "key string")
        keys = sorted(r.key for r in seen.collect())  # about SAMPLES * n_parts
        bounds = list(dict.fromkeys(keys[len(keys) * k // n_parts] for k in range(1, n_parts))) if keys else []
    dealt = rows.mapInArrow(lambda b: _dealt(bounds, longest, b), "part int, key string, n bigint")
    placed = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.desc("key"))
    found = placed.mapInArrow(lambda b: _phrases(least, b), "key string, words int, n bigint")
    return found.groupBy("key", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def collocations(df: DataFrame, *, least: int = 30, longest: int = 4, most: int = 2000, inside: int = 80, scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score` of each language's `most` best phrases of 2 to `longest` words with `a >= least` occurrences.

    A phrase's score is the lowest of its cuts, floor(scale * a / (l + r)), and it goes if a longer one that contains it has at least `inside` per cent of its occurrences.
    """
    every = stored(counted_phrases(df, least=least, longest=longest, text_col=text_col, lang_col=lang_col))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    words = F.split("key", "\t")
    of = lambda start, length: F.concat_ws("\t", F.element_at("all", 1), F.slice("all", start, length))
    candidates = every.where("words >= 2").select("key", words.alias("all"), "words", F.col("n").alias("a"))
    cuts = candidates.select("key", "all", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", of(F.lit(2), F.col("k")).alias("left"), of(F.col("k") + 2, F.col("words") - F.col("k")).alias("right"))
    counts = every.where("words >= 1").select("key", "n")
    met = cuts.join(counts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr(f"(cast(a as decimal(19,0)) * {scale}) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = met.select("key", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("key").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    longer = candidates.where("words > 2").select("words", "all", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("length"))
    longer = longer.select("all", "a", "length", F.explode(F.sequence(F.lit(2), F.col("words") - F.col("length") + 2)).alias("start"))
    around = longer.groupBy(of(F.col("start"), F.col("length")).alias("key")).agg(F.max("a").alias("most"))
    kept = lowest.join(around, "key", "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("a") * inside))

    parts = F.split("key", "\t")
    shown = kept.select(parts[0].alias("own"), F.concat_ws(" ", F.slice(parts, 2, longest)).alias("phrase"), "a", "cut.*")
    shown = shown.select("own", _plain(F.col("phrase")).alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = shown.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("own", "group").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    totals = every.where("words = 0").select(F.col("key").alias("own"), "n")
    return ranked.join(totals, "own").select(_plain(F.col("own")).alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
