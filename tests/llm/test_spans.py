"""Base spans of personal data and secrets against Python's expressions, and the decisions of both methods."""

import hashlib
import random
import re

import pyspark.sql.functions as F
from pyspark.sql import Window

from tessera.llm import pii, queries, secrets, spans
from tessera.llm.common import stored

NAMES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
SECRETS = [("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def keeps(kind, match):
    text, digits = match[0], re.sub("[^0-9]", "", match[0])
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
        "assign": lambda: len(match[1]) >= 6,
        "access": lambda: len(text) >= 20,
        "hex": lambda: len(text) >= 24,
    }[kind]()


def brute(text, kinds):
    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, p) in enumerate(kinds) for m in re.finditer(p, text or "") if keeps(kind, m)]
    return ",".join(s for _, _, s in sorted(found))


def odd_texts(seed, n=1500):
    rng = random.Random(seed)
    parts = ["a", "é", "😀", ".", "..", "@", "-", "+", " ", "  ", "0", "1", "12", "255", "256", "00", "4111111111111111", "4111 1111 1111 1111", "+1 (269) 555-3296", "x@y.com", "a@b", "10.0.0.1", "(", ")", "_", "%", "\n",
             "password", "Token", "api_key", "APIKEY", "secret", "=", ":", '"', "'", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "f", "/", "="]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 24))) for _ in range(n)]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_equal_pythons(spark):
    texts = [None, "", *odd_texts(1), "1" * 50_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "+1" + "(" * 20_000 + "1", "1.2." * 20_000, "0 1-" * 20_000]
    for module, kinds in ((pii, NAMES), (secrets, SECRETS)):
        found = {r[0]: r[1] for r in rows(spark, texts).select("doc_id", spans.written(module.base_spans(F.coalesce("text", F.lit(""))))).collect()}
        for i, text in enumerate(texts):
            assert found[i] == brute(text, kinds), text[:300]


def test_queries_equal_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for query, kinds in ((queries.op2_pii, NAMES), (queries.op10_secrets, SECRETS)):
        found = query(spark, sf).collect()
        assert len(found) == len(texts)
        for r in found:
            base = brute(texts[r.doc_id], kinds)
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert [r[f"n_{k}"] for k, _ in kinds] == [base.count(f"{k}:") for k, _ in kinds]
            assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def found_by(module, fit, df):
    """What the method says of each text, and its base spans."""
    looked = stored(module.looked_at(df))
    found = module.decided(looked, fit(looked)).select("row.doc_id", spans.written(F.col("found")), spans.written(F.col("base")))
    return {r[0]: (r[1], r[2]) for r in found.collect()}


def with_check_digit(rng, n):
    digits = "".join(str(rng.randint(0, 9)) for _ in range(n - 1))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def account(rng, country):
    digits = "".join(str(rng.randint(0, 9)) for _ in range(pii.IBAN_LENGTHS[country] - 4))
    return f"{country}{98 - int(''.join(str(int(c, 36)) for c in digits + country + '00')) % 97:02d}{digits}"


def test_the_methods_own_personal_data(spark):
    rng = random.Random(11)
    private, plain = [], []
    for i in range(120):
        a, b, c, name = rng.randint(201, 989), rng.randint(200, 999), rng.randint(1000, 9999), rng.choice(pii.GIVEN_NAMES)
        private += [
            f"Please call ({a}) {b}-{c} after noon.",
            f"Write to {name.lower()} [at] example [dot] {rng.choice(['com', 'org', 'de'])} soon",
            f"SSN: {rng.randint(1, 664):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d} on file.",
            f"Pay to account {account(rng, rng.choice(['FR', 'GB', 'ES']))}.",
            f"The patient, Dr. {name} {rng.choice(['Schmidt', 'Miller', 'Lopez'])}, was seen.",
            f"phone +1 ({a}) {b}-{c} {with_check_digit(rng, 16)} now",
        ]
        plain += [
            f"isbn 978316{rng.randint(10**7, 10**8 - 1)} of the book",
            f"version ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{c} build",
            f"Serial {rng.randint(1, 999):03d}-00-{rng.randint(1, 9999):04d} of part",
            f"ref AB12 {c} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} page",
            f"mail a{i}@b.com and 10.0.0.{i}",
            "nothing to see here",
        ]
    found = found_by(pii, pii.trained, rows(spark, [*private, *plain]))
    own = [found[i][0] != found[i][1] for i in range(len(found))]
    base = [bool(found[i][1]) for i in range(len(found))]
    assert sum(own[: len(private)]) / sum(not x for x in base[: len(private)]) >= 0.9
    assert sum(own[len(private) :]) <= 0.02 * len(plain)
    assert all(found[i][1] == brute(t, NAMES) for i, t in enumerate([*private, *plain]))


def test_account_checksums(spark):
    df = spark.createDataFrame([("DE89 3704 0044 0532 0130 00",), ("GB29NWBK60161331926819",), ("DE88370400440532013000",), ("XX89370400440532013000",), ("DE8937040044053201300",)], "t string")
    assert [bool(r[0]) for r in df.select(pii.checks_out(F.col("t"))).collect()] == [True, True, False, False, False]


ORDINARY = "configuration server report week path user value list file image module handler service request response factory builder context provider adapter total index order table customer status update".split()


def ordinary_runs(rng, n):
    for _ in range(n):
        words = [rng.choice(ORDINARY) for _ in range(rng.randint(2, 6))]
        yield rng.choice(["/".join(words) + str(rng.randint(1, 999)), "".join(w.title() for w in words) + str(rng.randint(0, 99)), "-".join(words) + "-2024-11-27", "_".join(words).upper() + "_1", "_".join(words) + "_v2", "".join(words)])


def test_random_strings_by_encoding_and_length(spark):
    rng = random.Random(3)
    drawn = [(name, n, "".join(rng.choice(secrets.ALPHABETS[name]) for _ in range(n))) for name in ("base62", "base64", "base64url", "hex", "base36") for n in (16, 20, 32, 40, 64) for _ in range(30)]
    fixed = ["http/server/path/to/file2", "aaaaaaaaaaaaaaaaaaaaaaaa1", "internationalization2024edition", "abcdefghijklmnopqrstuvwxyz012345", "2024-11-27-report-of-the-week", "ABABABABABABABABAB12"]
    plain = [*(x for x in ordinary_runs(rng, 1500) if len(x) >= 16), *fixed * 5]
    found = found_by(secrets, secrets.fitted, rows(spark, [f"x {t} y" for t in [*(t for _, _, t in drawn), *plain]]))
    hit = {}
    for i, (name, n, t) in enumerate(drawn):
        hit.setdefault((name, n), []).append(f"random:2:{2 + len(t)}" in found[i][0] or f"hex:2:{2 + len(t)}" in found[i][0])
    for name in ("base62", "base64", "base64url", "hex"):
        assert sum(map(sum, (v for (k, n), v in hit.items() if k == name and n >= 32))) >= 0.9 * 90, name
    assert sum(hit["base62", 20]) >= 0.8 * 30
    false = [t for i, t in enumerate(plain) if "random" in found[len(drawn) + i][0]]
    assert len(false) <= 0.01 * len(plain), false


def test_random_values_after_a_name_are_secrets(spark):
    rng = random.Random(5)
    forms = ["client_id={}", "https://h.example/a?b=1&sig={}&c=2", "SIG={}==", 'x="{}"', "sig: {}"]
    drawn = [form.format("".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(40))) for form in forms for _ in range(20)]
    plain = ["path=http/server/path/to/file2", "pad=aaaaaaaaaaaaaaaaaaaaaaaa1", "configuration_value_number_2=report-of-the-week-2024-11-27"] * 20
    found = found_by(secrets, secrets.fitted, rows(spark, [*drawn, *plain]))
    for k, (form, length) in enumerate(zip(forms, (40, 40, 42, 40, 40), strict=True)):
        start = form.index("{")
        assert sum(f"random:{start}:{start + length}" in found[20 * k + i][0] for i in range(20)) >= 17, form
    assert not any("random" in found[len(drawn) + i][0] for i in range(len(plain)))


def test_step_up_rule():
    counts = {("base62 32", 50): 10, ("base62 32", 20): 5, ("base62 32", -10): 985, ("hex 16", 25): 3}
    assert secrets.thresholds(counts) == {"base62 32": 50, "hex 16": 25}
    assert secrets.thresholds({("base62 32", 10): 50}) == {}


def test_masked_text_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "é mail a@b.com, ip 10.0.0.1.", "z"), (None, None, None), (3, "", "w"), (1, "é mail a@b.com, ip 10.0.0.1.", "z")], "doc_id long, text string, base string")
    got = sorted((tuple(r) for r in pii.redact(df).collect()), key=str)
    assert got == sorted([(1, "é mail [EMAIL], ip [IP].", "z"), (None, None, None), (3, "", "w"), (1, "é mail [EMAIL], ip [IP].", "z")], key=str)
    assert pii.redact(df.where("false")).count() == 0
    secret = spark.createDataFrame([(1, 'a token = "0123456789abcdef0123456789" b')], "doc_id long, text string")
    assert secrets.redact(secret).first().text == 'a [ASSIGN]" b'
    overlap = spark.createDataFrame([("abcdefghij",)], "text string").withColumn("found", F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(0).alias("rank"), F.lit(k).alias("kind"), F.lit("").alias("match")) for s, e, k in ((1, 4, "a"), (3, 6, "b"), (8, 9, "c")))))
    assert spans.masked(overlap, "text", "found").first().masked == "a[A]gh[C]j"


def test_texts_of_many_matches(spark):
    """200,000 matches in one text are found, told apart and masked in seconds, as each is told alone."""
    n = 200_000
    text = "é1.2.3.4 " * n
    df = spark.createDataFrame([(text,)], "text string")
    found = df.select(pii.base_spans(F.col("text")).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last"), F.sum(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.start)).over(Window.partitionBy()).alias("sum")).first()
    assert (found.n, found["last"].start, found["last"].end, found["sum"]) == (n, 9 * (n - 1) + 1, 9 * (n - 1) + 8, sum(9 * i + 1 for i in range(n)))
    span = lambda i, a, b: F.struct((i * 9 + a).cast("int").alias("start"), (i * 9 + b).cast("int").alias("end"), F.lit(0).alias("rank"), F.lit("ip").alias("kind"), F.lit("").alias("match"))
    rows = df.withColumn("some", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: span(i, 1, 8))).withColumn("others", F.transform(F.sequence(F.lit(0), F.lit(n - 1), F.lit(3)), lambda i: span(i, 7, 9)))
    assert rows.select(F.size(spans.outside(F.col("some"), F.col("others")))).first()[0] == n - (n + 2) // 3
    assert spans.masked(rows, "text", "some").select(F.col("masked") == F.lit("é[IP] " * n)).first()[0]


def test_running_values_cuts_and_overlaps(spark):
    pick = random.Random(8)
    text = "".join(pick.choice("aé日😀 \n") for _ in range(5000))
    rows = []
    for _ in range(60):
        some, others = ([(s, s + pick.randrange(1, 9)) for s in sorted(pick.sample(range(200), pick.randrange(12)))] for _ in range(2))
        rows.append((text, some, others, sorted(pick.sample(range(len(text) + 1), 2))))
    df = spark.createDataFrame(rows, "text string, some array<struct<start:int,end:int>>, others array<struct<start:int,end:int>>, places array<int>")
    full = lambda c: F.transform(c, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(0).alias("rank"), F.lit("k").alias("kind"), F.lit("m").alias("match")))
    starts = F.transform("some", lambda s: s.start)
    found = df.select(
        "some", "others", "places", spans.cut(spans.chunks(F.col("text")), F.col("places")[0], F.col("places")[1]).alias("cut"), spans.outside(full("some"), full("others")).alias("free"),
        spans.running(starts, lambda a, b: a + b, F.lit(0)).alias("sums"), spans.running(starts, lambda a, b: F.greatest(a, b), F.lit(0)).alias("most"),
    ).collect()
    for r in found:
        assert r.cut == text[r.places[0] : r.places[1]]
        assert [(s.start, s.end) for s in r.free] == [(s.start, s.end) for s in r.some if not any(s.start < o.end and o.start < s.end for o in r.others)]
        values = [s.start for s in r.some]
        assert r.sums == [sum(values[: i + 1]) for i in range(len(values))] and r.most == [max(values[: i + 1]) for i in range(len(values))]
