"""The pipeline's stages, each against plain Python, and rows that no stage may stumble over."""

import base64
import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from tessera.llm import pii, queries
from tessera.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = " ".join(f"word{i}" for i in range(60_000))
GOOD = " ".join(f"plain{i} words{i} of a{i} text{i} that{i} stays" for i in range(20))


def odd(spark, sf):
    """The documents with nulls, empty, long and repeated rows, and columns whose names operators use themselves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    more = [(None, GOOD + " a", None, None, None), (90_001, None, "en", "x", 0), (90_002, "", "en", "x", 0), (90_003, LONG, "en", "x", len(LONG)), (90_004, GOOD + " mail a@b.com", "en", "x", 5), (90_004, GOOD + " mail a@b.com", "en", "x", 5), (90_005, None, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(more, docs.schema))
    return rows.selectExpr("*", "1 AS _stays", "'r' AS row", "2 AS text2", "3 AS rated", "'d' AS digest", "4 AS kept", "5 AS base", "6 AS found")


def test_stages_one_by_one(spark, sf):
    docs = stored(odd(spark, sf))
    columns = docs.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, sf))
        assert docs.columns == columns, name
        counts[name] = docs.count()
        assert stage(spark, before.where("false"), sf).count() == 0, name
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            assert {None, 90_003, 90_004} <= kept and not {90_001, 90_002, 90_005} & kept
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            long = {r.doc_id for r in before.where("size(split(text, ' ')) >= 60").collect()}
            assert all(d in kept for d, q in labels.items() if q == 1 and d in long)
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.collect()]
            assert ids.count(90_004) == 1 and len(set(ids)) == len(ids)
        if name == "pii":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert texts[90_004].endswith("mail [EMAIL]") and texts[90_003] == LONG
            email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
            assert not any(email.search(t) for t in texts.values())
            plain = {r.doc_id: r.text for r in before.collect()}
            looked = stored(pii.looked_at(before))
            untouched = {r[0] for r in pii.decided(looked, pii.trained(looked)).where("size(found) = 0").select("row.doc_id").collect()}
            assert all(texts[d] == plain[d] for d in untouched)
        if name == "mix":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(encoded) == counts["mix"]
    for r in encoded:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stages_rows(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = {r.doc_id for r in found.select("doc_id").collect()}
    assert 0 < len(ids) < docs.count() and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
