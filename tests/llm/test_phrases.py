"""Phrase collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import pyspark.sql.functions as F
import pytest

from tessera.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(rows, longest=4):
    n, found = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    return n, found


def expected(rows, least, most, longest=4):
    n, f = counts_of(rows, longest)
    scored = []
    for (lang, words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        longer = [g for (other, w), g in f.items() if other == lang and len(w) > len(words) and g >= least and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * g >= 80 * a for g in longer):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        scored.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out = []
    for lang in sorted({s[0] for s in scored}):
        for rank, (_, score, a, phrase, l, r) in enumerate(sorted(s for s in scored if s[0] == lang)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(l, t, 1, "x") for l, t in rows], "lang string, text string, n int, key string").repartition(parts)


def made(seed, texts=120):
    pick = random.Random(seed)
    words = ["The", "é", "日本", "a\x00b", "a", "b\x08", "c\x0e", "\xa0", "<x>", "a\x00"] + [f"w{k}" for k in range(12)]
    rows = []
    for _ in range(texts):
        text = "".join(pick.choice(words) + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(pick.randrange(60)))
        rows.append((pick.choice(["en", "en", None, "und", "a\tb", "x\n9", ""]), text + ("New York City hall " * pick.randrange(3))))
    return [*rows, (None, None), ("en", None), ("en", ""), ("en", " ,. "), rows[0], rows[0]]


@pytest.mark.parametrize("part", [1 << 30, 2000])
def test_equal_to_counting_every_phrase(spark, monkeypatch, part):
    rows = made(part)
    monkeypatch.setattr(phrases, "PART_BYTES", part)
    monkeypatch.setattr(phrases, "SAMPLED", 0.9)
    assert found(frame(spark, rows), least=4, most=25) == expected(rows, 4, 25)


def test_windows_cut_no_phrase(monkeypatch):
    pick = random.Random(3)
    texts = ["".join(pick.choice("abc") + pick.choice([" ", " ", ".", "\t"]) for _ in range(300)) for _ in range(5)] + ["x" * 500, "", "y"]
    rows = [("en", t) for t in texts]
    monkeypatch.setattr(phrases, "WINDOW", 64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array(texts)], names=["lang", "text"])
    got = Counter()
    for keys, counts in phrases._suffixes(batch, 4):
        for key, n in zip(keys.to_pylist(), counts.tolist(), strict=True):
            words = key.split("\t")[1:]
            for k in range(1, len(words) + 1):
                got["en", tuple(words[:k])] += n
    assert got == counts_of(rows)[1]


def test_one_word_in_a_third_of_all_places_is_many_parts(spark, monkeypatch):
    """The hot word's suffixes are dealt to several parts, and its count is still whole."""
    pick = random.Random(5)
    rows = [("en", " ".join(x for _ in range(60) for x in ("hot", f"w{pick.randrange(300)}", f"v{pick.randrange(300)}"))) for _ in range(300)]
    monkeypatch.setattr(phrases, "PART_BYTES", 8000)
    monkeypatch.setattr(phrases, "SAMPLED", 0.5)
    df = frame(spark, rows)
    counted = {r.key: r.n for r in phrases.counted_phrases(df, least=20).collect()}
    n, f = counts_of(rows)
    assert counted == {"en": n["en"]} | {"\t".join((lang, *w)): c for (lang, w), c in f.items() if c >= 20}


def test_empty_tables_and_ties(spark):
    df = frame(spark, [("en", "b a. b a. d c. d c")])
    assert phrases.collocations(df.where("false")).count() == 0 and phrases.collocations(df).count() == 0
    assert found(df, least=2, most=1) == [("en", 1, "b a", 2, 2, 2, 8, 1_000_000)]
    assert phrases.counted_phrases(df.select(F.col("n").alias("text2"), F.col("text"), "lang"), least=99).collect()[0].n == 8
