"""The pipeline's near-duplicates against all pairs."""

import itertools
import random

import corpus_pipeline
from tessera.llm import minhash, simhash


def words_of(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def test_the_stage_keeps_one_of_all_pairs_at_a_similarity(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 12):
            other = list(words)
            for k in rng.sample(range(len(words)), edits):
                other[k] = "edited"
            texts.append(" ".join(other))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [words_of(t) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_first(spark, df, "").collect()}
    assert kept == {find(x) for x in range(len(texts))}

    for full in (2, 0):  # ever more keys are left to the prefix join
        assert {r.doc_id for r in minhash.first_of_each(df, full_bucket=full).collect()} == kept


def test_the_prefix_join_misses_no_pair(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(12)]
    texts = []
    for words in base:
        for edits in (0, 1, 2, 3, 20):
            other = list(words)
            for k in rng.sample(range(60), edits):
                other[k] = f"e{rng.randrange(9)}"
            texts.append(" ".join(other))
    sets = {minhash._named(minhash.shingles(t)): minhash.shingles(t) for t in texts}
    full = spark.createDataFrame([(k, len(v)) for k, v in sets.items()], "set long, n long")
    held = spark.createDataFrame([(k, [int(x) for x in v.view("int64")]) for k, v in sets.items()], "set long, hashes array<long>")
    alone = spark.createDataFrame([], "node long, root long")
    found = {tuple(r) for r in minhash._verified(minhash._by_prefix(minhash._ranked(full, held), alone), held).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert found == want


def test_the_stage_links_by_simhash_first(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(9000)}" for _ in range(800)] for _ in range(30)]
    texts = [" ".join(words[:k] + ["edited"] * (k < 800) + words[k + 1 :]) for words in base for k in (800, 300, 500)]
    found, by_simhash = [], minhash._by_simhash

    def spied(sets):
        pairs = by_simhash(sets)
        found.extend(tuple(r) for r in pairs.collect())
        return pairs

    monkeypatch.setattr(minhash, "_by_simhash", spied)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.keep_first(spark, df, "").collect()} == set(range(0, 90, 3))
    sets = [minhash.shingles(t) for t in texts]
    names, fps = [minhash._named(s) for s in sets], [simhash.of_hashes(s) for s in sets]
    near = {(min(names[a], names[b]), max(names[a], names[b])) for a, b in itertools.combinations(range(90), 2) if 0 < (fps[a] ^ fps[b]).bit_count() <= 2 and fps.count(fps[a]) == fps.count(fps[b]) == 1}
    assert near and near <= set(found)


def test_rows_without_an_id_and_odd_texts(spark):
    rows = [(None, "x y z"), (None, "X y  z"), (5, "a b"), (None, "a b"), (2, ""), (1, None), (3, "c"), (3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id for r in corpus_pipeline.keep_first(spark, df, "").collect()), key=str)
    assert kept == [1, 3, 5, None]
    clash = df.selectExpr("doc_id", "text", "1 AS stays_id", "2 AS stays_digest", "3 AS digest", "'x' AS set", "4 AS _stays")
    assert sorted((r.doc_id for r in corpus_pipeline.keep_first(spark, clash, "").collect()), key=str) == kept
    assert corpus_pipeline.keep_first(spark, clash, "").columns == clash.columns
    same_id = spark.createDataFrame([(1, "a b c d e f"), (1, "p q r s t u"), (1, "a b c d e f"), (2, "p q r s t u")], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.keep_first(spark, same_id, "").collect()) == [(1, "a b c d e f"), (1, "p q r s t u")]
    assert corpus_pipeline.keep_first(spark, df.where("false"), "").count() == 0
