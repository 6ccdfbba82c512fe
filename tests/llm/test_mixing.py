"""Soft-membership mixing against plain least squares and held-out labels."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from tessera.llm import mixing, queries
from tessera.llm.common import stored

TEXTS = {"a": "the quick brown fox and the lazy dog ", "b": "der schnelle braune fuchs und der faule hund "}


def documents(spark, n=60):
    rows = [(i, TEXTS["ab"[i % 3 == 0]] * (1 + i % 5), "ab"[i % 3 == 0], "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string")


def test_rates_meet_the_targets(spark):
    df = documents(spark)
    model = mixing.fitted(df, df, domain_col="lang")
    scored = stored(mixing.score(df, model))
    steps = mixing.solved(scored, model.domains, {"a": 0.5, "b": 0.5})
    rows = mixing.with_rates(scored, steps).collect()
    tokens, shares, rates = np.array([r.n_tokens for r in rows]), np.array([r.shares for r in rows]), np.array([r.rate for r in rows])
    assert (rates >= 0).all() and tokens.sum() == sum(len(r.text.split()) for r in df.collect())
    totals = (rates * tokens) @ shares
    assert np.abs(totals / tokens.sum() - 0.5).max() < 1e-3


def test_least_squares_where_targets_are_out_of_reach(spark):
    df = documents(spark)
    model = mixing.fitted(df, df, domain_col="lang")
    scored = stored(mixing.score(df, model))
    steps = mixing.solved(scored, model.domains, {"a": 1.0})
    rows = mixing.with_rates(scored, steps).collect()
    # brute force: many plain projected gradient steps on dense arrays
    tokens, shares = np.array([float(r.n_tokens) for r in rows]), np.array([r.shares for r in rows])
    measure, rate = np.linalg.inv((shares * tokens[:, None]).T @ shares), np.ones(len(rows))
    off = lambda r: (r * tokens) @ shares - np.array([tokens.sum(), 0])
    for _ in range(5000):
        rate = np.maximum(0, rate - shares @ (measure @ off(rate)))
    loss = lambda r: float(off(r) @ measure @ off(r))
    assert loss(np.array([r.rate for r in rows])) <= loss(rate) * 1.05 + 1e-2
    with pytest.raises(ArithmeticError):
        mixing.solved(scored, model.domains, {"a": 0.5, "b": 0.5}, most_steps=0)


def test_classifier_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 100")
    model = mixing.fitted(docs, docs.where("doc_id % 2 = 0"), domain_col="lang")
    best = mixing.score(docs.where("doc_id % 2 = 1"), model, keep=("lang",)).collect()
    assert np.mean([model.domains[int(np.argmax(r.shares))] == r.row.lang for r in best]) > 0.95


def test_mixed_rows_and_odd_cases(spark):
    df = documents(spark).unionByName(spark.createDataFrame([(None, None, None, None), (7, "", "a", "y"), (7, "", "a", "y")], documents(spark, 1).schema))
    model = mixing.fitted(df, df, domain_col="lang")
    out = mixing.mixed(df, model, {"a": 0.3, "b": 0.7}, least=1.0)
    assert out.columns == df.columns
    assert out.distinct().count() == df.distinct().count()
    tokens = {r[0]: r[1] for r in out.groupBy("lang").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert abs(tokens["b"] / (tokens["a"] + tokens["b"]) - 0.7) < 0.1
    assert mixing.mixed(df.where("false"), model, {"a": 1.0}).count() == 0
    assert mixing.fitted(df, df.where("false"), domain_col="lang") is None
    assert mixing.fitted(df, df.withColumn("lang", F.lit(None).cast("string")), domain_col="lang") is None
    clash = df.withColumn("rated", F.lit(3)).withColumn("row", F.lit("r"))
    assert mixing.mixed(clash, model, {"a": 0.3, "b": 0.7}, least=1.0).columns == clash.columns
    assert mixing.mixed(df, None, {"a": 1.0}).count() == df.count()


def test_words_and_long_texts():
    text = "ab \t c\n" * 400_000
    found, n = mixing.features(text)
    assert n == len(text.encode().split()) and abs((found**2).sum() - 1) < 1e-9
    assert mixing.features(None)[1] == 0 and mixing.features(" ")[1] == 0


def test_labelled_domains_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    domains = queries.domains_of(labels)
    model = mixing.fitted(docs, domains.where("doc_id % 4 <> 0"))
    held = {r.doc_id: r.domain for r in domains.where("doc_id % 4 = 0").collect()}
    best = {r.row.doc_id: model.domains[int(np.argmax(r.shares))] for r in mixing.score(docs.where("doc_id % 4 = 0"), model).collect()}
    assert np.mean([best[d] == x for d, x in held.items()]) > 0.87


def test_query(spark, sf):
    found = queries.op9_mixing(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = found.collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    for domain, share in queries.TARGET_WEIGHTS.items():
        got = sum(r.rate * r.n_tokens * r[f"p_{domain}"] for r in rows) / sum(r.n_tokens for r in rows)
        assert abs(got - share) < 0.01
