"""The other training-data operators against brute force on the smallest tables and on odd rows."""

import base64
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import tiktoken
import xxhash

from tessera.llm import bpe, htmltext, quality, queries, simhash, topk, toxicity, urlfilter
from tessera.operators.entries import components

ODD = [(1, ""), (2, None), (None, "x y z"), (3, "héé  日本 \n\t 😀" * 50), (4, "a" * 100_000), (1, "")]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ODD], "doc_id long, text string, ids string, row int")


def test_byte_bpe_equals_the_other_library(spark, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op1_byte_bpe(spark, sf).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_inside_characters == sum((own.decode_single_token_bytes(i)[0] & 0xC0) == 0x80 for i in ids)
    assert bpe.round_trip(odd(spark).where("false"), queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0
    long = "ab\x1c!\x1c! \x85 é\n\n  x " * 9000  # over the bound of a short text, with what only some call white space
    r = bpe.encode(spark.createDataFrame([(1, long)], "doc_id long, text string"), queries.VOCABULARY, public_tokenizers.PATTERN).first()
    assert list(r.ids) == own.encode_ordinary(long)
    for r in bpe.round_trip(odd(spark), queries.VOCABULARY, public_tokenizers.PATTERN).collect():
        assert bytes(r.bytes).decode() in {t or "" for _, t in ODD}


def test_offsets_and_split_characters(spark):
    df = spark.createDataFrame([(1, "a 日本😀")], "doc_id long, text string")
    r = bpe.encode(df, queries.VOCABULARY, public_tokenizers.PATTERN, offsets=True).first()
    assert len(r.ids) == len(r.starts) == len(r.ends) and r.ends[-1] == 5
    cut = spark.createDataFrame([(1, r.ids[:-1])], "doc_id long, ids array<int>")
    assert bpe.decode(cut, queries.VOCABULARY, public_tokenizers.PATTERN).first().text.endswith("�")


def test_simhash_components_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    flips = [0, *(1 << int(b) for b in rng.integers(0, 63, 30)), *((1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (30, 2)))]
    fps = sorted({int(b) ^ f for b in base for f in flips})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[max(find(a), find(b))] = min(find(a), find(b))
    for full in (64, 3):
        found = dict(components(simhash.links(df, full_bucket=full)).collect())
        assert all(found.get(f, f) == find(f) for f in fps)


def test_simhash_never_broadcasts_the_index(spark, monkeypatch):
    built, write = [], simhash.stored

    def walk(node):
        yield node
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    def spied(df):
        for node in walk(df._jdf.queryExecution().sparkPlan()):
            if node.nodeName() == "BroadcastHashJoin":
                built.append((node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).toString())
        return write(df)

    monkeypatch.setattr(simhash, "stored", spied)
    fps = [k << 20 | b for k in range(0, 3000, 3) for b in (0, 1, 3)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = []
    for bound in (100_000, 0):
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", bound, raising=False)
        found.append({tuple(r) for r in simhash.links(df).collect()})
        assert built and not any("explode(array(" in plan for plan in built)
    assert found[0] == found[1] >= {(f & ~3, f & ~3 | 1) for f in fps}


def test_fingerprints_bit_by_bit():
    for text in ("", "A b", "a B c", "one Two three four five", "x y z " * 40, "é ü\u00a0 b\tc\x0bd \x1c e"):
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\x0b", " ").replace("\n", " ").split(" ") if w]
        parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_odd_rows(spark):
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd(spark)).collect()}
    assert found[1, 0] == 1 and found[2, 0] == 1
    assert simhash.near_duplicates(odd(spark).where("false")).count() == 0


def test_top_k_with_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 5.0]), (3, [0.5, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(df.where("vec_id = 0"), df, 2).orderBy("rank").collect()] == [(1, 65536), (2, 65536)]
    assert topk.search(df.where("false"), df, 2).count() == 0


def test_top_k_over_rounds_and_many_partitions(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(7, [float(x) for x in vectors[7]]), (9, [float(x) for x in vectors[8]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(70)
    asked = df.where("vec_id % 4 = 0")
    found = topk.search(asked, df, 3, queries_a_round=30).collect()
    whole = {i: np.floor(256 * np.array(v)) for i, (_, v) in enumerate(rows)}
    for q in range(0, 300, 4):
        best = sorted(((-int(whole[q] @ whole[i]), k) for i, (k, _) in enumerate(rows) if k != q))[:3]
        assert sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q) == [(n + 1, k, -score) for n, (score, k) in enumerate(best)]


def test_url_rules_and_the_join_beyond_the_file(spark):
    rows = [("https://A.Example.org/es/x?q",), ("http://example.org/en/12",), ("x://shop.com/de/",), ("no url",), (None,), ("http://spam.net/a",), ("http://com/fr/",)]
    df = spark.createDataFrame(rows, "url string")
    rules = spark.createDataFrame(queries.URL_RULES, "entry string, verdict string")
    blocked = spark.createDataFrame([("spam.net/",)], "entry string")
    want = ["block", "block", "block", "allow", "allow", "block", "allow"]
    for most in (1 << 20, 0):
        found = {r.row.url: r.verdict for r in urlfilter.judge(df, rules, blocked, most_bytes=most).collect()}
        assert [found[u] for (u,) in rows] == want
        assert urlfilter.judge(df.where("false"), rules, blocked, most_bytes=most).count() == 0
        assert urlfilter.judge(df, rules.where("false"), blocked.where("false"), most_bytes=most).where("verdict = 'allow'").count() == len(rows)
    again = spark.createDataFrame([("http://" + "a." * 120 + "spam.net/b", 1)] * 3, "url string, rule int")
    assert urlfilter.judge(again, rules, blocked).where("verdict = 'block'").count() == 3


def test_keys_that_collide_change_nothing(monkeypatch):
    monkeypatch.setattr(urlfilter, "keys_of", lambda texts: np.array([len(t) % 3 for t in texts], np.uint64))
    entries = [f"host{i}.net/" + "p" * (i % 7) for i in range(60)]
    array = urlfilter.DigestArray(np.frombuffer(urlfilter.digest_file(entries), np.uint8))
    asked = [*entries, "host1.net/", "other.net/", "host8.net/p"]
    assert [p >= 0 for p in array.places(urlfilter.keys_of(asked), asked)] == [a in entries for a in asked]


def test_the_list_of_blocked_hosts(spark, sf):
    listed = [r.entry for r in queries.blocked_hosts(spark).collect()]
    assert len(set(listed)) == len(listed) == 60_000 and "casino-win-7.example.com/" in listed and "free-bets.example.com/" in listed
    hosts = {e[:-1] for e in listed}
    for r in queries.op3_url_filter(spark, sf).collect():
        ends = r.host.split(".")
        assert r.rule or (r.verdict == "block") == any(".".join(ends[k:]) in hosts for k in range(len(ends)))


def slow_counts(text):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text or "") if w]
    lines = (text or "").split("\n")
    repeated = sum(bool(line.strip(" \t\x0b\x0c\r")) and line in lines[:i] for i, line in enumerate(lines))
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    held = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if held[w] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), repeated, len(covered)


def test_quality_counts_are_those_of_plain_python(spark, sf):
    assert quality.base_counts("one two three one two three\nsame line\nsame line\n# $") == (12, 40, 2, 1, 6)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_quality(spark, sf).collect():
        counts = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
    for text in ("", None, "a\x1cb \u00a0 c", "x " * 100_000, "é|\n\n \né|\n"):
        assert quality.base_counts(text) == slow_counts(text)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fitted(docs, labels.where("doc_id % 2 = 0"))
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in quality.judge(docs, field).collect() if r.row.doc_id in held and not r.base_failed]
    assert np.mean([r.kept for r in rows if held[r.row.doc_id] == 1]) > 0.98
    assert np.mean([not r.kept for r in rows if held[r.row.doc_id] == 0]) > 0.9
    assert quality.judge(odd(spark), field, keep=("doc_id", "row")).where("kept").count() == 0
    assert quality.judge(odd(spark).where("false"), field).count() == 0
    assert np.array_equal(quality.fitted(docs, labels.where("false")).weights, quality.Field().weights)
    twice = quality.fitted(docs.unionByName(docs), labels.where("doc_id % 2 = 0"))
    assert np.allclose(twice.weights, field.weights) and twice.least == field.least


def test_quality_learns_from_every_labelled_document(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    at_once = quality.fitted(docs, labels)
    one, two = (quality.fitted(docs.unionByName(docs), labels, most_docs=most) for most in (30, 150))
    assert np.allclose(one.weights, two.weights, atol=0.03) and one.least == two.least == at_once.least  # where the passes start decides nothing
    assert np.allclose(one.weights, at_once.weights, atol=0.3)
    unknown = spark.range(10**6, 10**6 + 5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    assert np.allclose(quality.fitted(docs, labels.select("doc_id", "quality").unionByName(unknown)).weights, at_once.weights)
    good = quality.fitted(docs, labels.where("quality = 1"), most_docs=30)
    assert np.array_equal(good.weights, quality.Field().weights) and good.least == quality.LEAST_CONTENT
    few = labels.where("quality = 1 or doc_id % 40 = 1")  # a sample of 2 has no bad document
    assert np.allclose(quality.fitted(docs, few, most_docs=2).weights, quality.fitted(docs, few, most_docs=150).weights, atol=0.03)


def test_marks_change_within_a_text():
    prose, junk = b"the quick brown fox runs over the lazy dog in the yard", b"BUY!! NOW!! BUY!! NOW!! $$$ ### BUY!!"
    notice = b"This text is licensed to all."
    rows = []
    for i in range(60):
        lines = [prose + b" %d" % i, notice, prose + b" x%d" % i] if i % 2 else [prose + b" %d" % i, junk, junk + b" %d" % i]
        digests = np.array([xxhash.xxh64_intdigest(line) for line in lines], np.uint64)
        rows.append((i % 2, quality.line_features(lines).astype(np.float32).tobytes(), digests.tobytes(), np.array([len(x) for x in lines], np.int32).tobytes()))
    field = quality.learnt(quality.Field(), rows)
    assert list(field.decode(quality.line_features([prose, prose + b" a", junk, junk, prose + b" b"]))) == [0, 0, 1, 1, 0]
    shared = quality.shared_lines([np.frombuffer(r[2], np.uint64) for r in rows])
    assert [x.tolist() for x in shared[:2]] == [[False, True, False], [False, True, False]]
    same = [np.array([1, 2, 3], np.uint64)] * 9
    assert not any(x.any() for x in quality.shared_lines(same))  # copies share their surroundings too


def test_viterbi_and_marginals_are_those_of_all_sequences():
    field = quality.Field()
    x = np.random.default_rng(1).normal(size=(12, len(quality.FEATURES)))
    starts = np.zeros(12, bool)
    starts[[0, 5]] = True

    def total(m, a, b):
        return sum((x[a:b] @ field.weights)[i] * v for i, v in enumerate(m)) + sum(field.pairs[p, q] for p, q in itertools.pairwise(m))

    marks = field.decode(x[:5])
    assert abs(total(marks, 0, 5) - max(total(m, 0, 5) for m in itertools.product((0, 1), repeat=5))) < 1e-9
    one, two = field.marginals(x, starts)
    for a, b in ((0, 5), (5, 12)):
        ways = list(itertools.product((0, 1), repeat=b - a))
        weight = np.exp([total(m, a, b) for m in ways])
        weight /= weight.sum()
        assert np.allclose(one[a:b], weight @ np.array(ways))
        assert np.allclose(two[a + 1 : b, 0, 1], [sum(w for w, m in zip(weight, ways, strict=True) if m[i] == 0 and m[i + 1] == 1) for i in range(b - a - 1)])
        assert not two[a].any()


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fitted(docs, labels.where("doc_id % 3 <> 0"))
    found = {r.doc_id: r["toxic"] for r in toxicity.score(docs, chain).collect()}
    held = labels.where("doc_id % 3 = 0").collect()
    assert np.mean([found[r.doc_id] >= 0.5 for r in held if r.toxic == 1]) >= 0.9
    assert np.mean([found[r.doc_id] < 0.5 for r in held if r.toxic == 0]) >= 0.98
    empty = toxicity.fitted(docs, labels.where("false"))
    assert {r["toxic"] < 1e-6 for r in toxicity.score(odd(spark), empty).collect()} == {True}
    assert toxicity.score(odd(spark), chain).count() == len(ODD) and toxicity.score(odd(spark).where("false"), chain).count() == 0
    assert toxicity.fitted(docs, labels.where("doc_id < 20")).names == ["kind1", "kind2", "kind3", "toxic"]


def test_a_batch_scores_as_each_model_says():
    texts = [f"word{i} some {'nasty' if i % 3 == 0 else 'kind'} words" for i in range(60)] + [""]
    found = [toxicity.features(t) for t in texts]
    rows = toxicity.Rows(np.concatenate(found), np.array([len(f) for f in found]))
    label = np.array([float("nasty" in t) for t in texts])
    chain = toxicity.learnt(rows, label, np.arange(len(texts)) % 3)
    batch, earlier = chain.probabilities(texts), np.zeros((len(texts), 0))
    for k, model in enumerate(chain.models):
        assert np.allclose(batch[:, k], model.of(rows, earlier))
        earlier = batch[:, : k + 1]
    assert ((batch[:, -1] >= 0.5) == (label > 0)).all()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text_of_small_pages(spark):
    page = "<html><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two</p><script>x</script></article><footer>f</footer></body></html>"
    frame = "<body><div>{}</div><p>shared line</p><p>own {}</p></body>"
    df = pages(spark, [(1, "http://h/a", page), (2, None, None), (3, "http://k/a/1", frame.format("x", 1)), (4, "http://k/a/2", frame.format("y", 2)), (None, None, ""), (2, None, None)])
    found = [(r.page_id, r.text) for r in htmltext.main_text(df.withColumn("lines", F.lit(1)).withColumn("part", F.lit("z"))).collect()]
    assert sorted(found, key=str) == sorted([(1, "A & B one two"), (2, ""), (2, ""), (3, "x own 1"), (4, "y own 2"), (None, "")], key=str)
    assert htmltext.main_text(df.where("false")).count() == 0


def test_common_lines_in_bounded_memory(monkeypatch):
    """Alignments in blocks are as long as those of a whole table, and long pages take little memory."""
    pick = random.Random(4)
    monkeypatch.setattr(htmltext, "BLOCK", 16)
    for _ in range(60):
        a, b = ([pick.randrange(pick.choice([2, 9, 60])) for _ in range(pick.randrange(70))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = htmltext.shared(a, b)
        rest = iter(b)
        assert len(places) == best[-1][-1] and places == sorted(set(places)) and all(a[i] in rest for i in places)
        assert htmltext._lengths(a, b).tolist() == best[-1]
    monkeypatch.undo()
    tracemalloc.start()
    n = 60_000
    a, b = [k for k in range(n)], [k ^ 1 for k in range(n)]
    assert len(htmltext._lengths(a, b)) == n + 1
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_articles_keep_their_own_text(spark):
    """Headlines and paragraphs of an article that its neighbours' articles have at the same place stay, and so does a paragraph that neighbours have in their menus."""
    page = "<body>{}<article><h1>{}</h1><p>the same words</p><p>own {}</p></article></body>"
    rows = [(k, f"http://h/a/{k}", page.format("<nav>x</nav>" * k, "Same head", k)) for k in range(1, 6)]
    rows += [(k, f"http://m/a/{k}", f"<body><nav>News</nav><div>Menu {k}</div><article><h1>H {k}</h1><p>t {k}</p></article></body>") for k in range(6, 9)]
    rows += [(9, "http://m/a/9", "<body><article><p>News</p><p>t 9</p></article></body>")]
    found = {r.page_id: r.text for r in htmltext.main_text(pages(spark, rows)).collect()}
    assert found == {k: f"Same head the same words own {k}" for k in range(1, 6)} | {k: f"H {k} t {k}" for k in range(6, 9)} | {9: "News t 9"}


def test_main_text_aligns_all_lines(spark):
    page = "<body>{}<article><div>Read on this site</div><p>quoted passage</p><p>own {}</p></article></body>"
    rows = [
        (1, "http://h/a/1", page.format("<nav>Start</nav>", 1)),  # inside an article what a neighbour shares goes, but not running text
        (2, "http://h/a/2", page.format("<nav>Other</nav>", 2)),
        (3, "http://k/a/1", "<body><nav>Our site</nav><p>x</p></body>"),  # a menu here is a frame there
        (4, "http://k/a/2", "<body><div>Our site</div><p>y</p></body>"),
        (5, "http://l/a/1", "<article>one<br>two</article>"),
        (6, "http://l/a/2", "<article>one<br>two</article>"),
    ]
    found = {r.page_id: r.text for r in htmltext.main_text(pages(spark, rows)).collect()}
    assert found == {1: "quoted passage own 1", 2: "quoted passage own 2", 3: "x", 4: "y", 5: "one two", 6: "one two"}


def test_frames_without_names_and_copies(spark):
    plain = "<body><p>Welcome to our site</p><p>text {0} alpha</p><p>text {0} beta</p><p>Share this</p></body>"
    rows = [(i, f"http://h/a/{i}", plain.format(i)) for i in range(9)]
    rows += [(20 + i, f"http://c/a/{i}", plain.format(77)) for i in range(5)]  # copies of each other empty no page
    teaser = "<article><p>By our editors</p><p>story {0} one</p><p>story {0} two</p></article>"
    rows += [(40 + i, f"http://t/a/{i}", teaser.format(i)) for i in range(5)]  # running text at the same place of other articles is a frame
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = {r.page_id: r.text for r in htmltext.main_text(pages(spark, rows)).collect()}
        assert all(found[i] == f"text {i} alpha text {i} beta" for i in range(9))
        assert all(found[20 + i] == "Welcome to our site text 77 alpha text 77 beta Share this" for i in range(5))
        assert all(found[40 + i] == f"story {i} one story {i} two" for i in range(5))
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_pairing_and_alignment_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        host = rng.choice(["big.org"] * 4 + ["a.net", "b.net"])
        lines = [f"<p>frame {host} {k}</p>" for k in range(rng.randint(0, 3))] + [f"<p>own {i} {k}</p>" for k in range(rng.randint(0, 4))] + [f"<div>end {host}</div>"] * rng.randint(0, 1)
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{rng.randint(0, 99)}?{i}", "<body>" + "".join(lines) + "</body>"))

    held = sorted((htmltext.Page(i, u, u.split("/")[2], "/" + u.split("/", 3)[3].split("?")[0], [htmltext.digest(t) for _, t in htmltext.lines_of(h)], bytes(r for r, _ in htmltext.lines_of(h)), zlib.compress("\n".join(t for _, t in htmltext.lines_of(h)).encode())) for i, u, h in rows), key=lambda p: (p.host, p.path, p.url, p.page_id))
    want = {p.page_id: " ".join(htmltext.main_lines(p, [held[k + d] if 0 <= k + d < len(held) else None for d in (-1, 1, -2, 2)])) for k, p in enumerate(held)}
    for parts in (1, 5, 60):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = {r.page_id: r.text for r in htmltext.main_text(pages(spark, rows)).collect()}
        assert found == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        found = htmltext.shared(a, b)
        assert len(found) == table[-1, -1] and found == sorted(set(found))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in found)
