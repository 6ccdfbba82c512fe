"""Personal data by weak supervision, with Spark's own functions only.

Base spans come from fixed expressions and stay as they are. The method looks at further candidates,
such as numbers that a base expression misses because it runs on into a neighbouring number, disguised addresses, account numbers and names after a title. Five
labelers vote on each candidate, and on the base spans: its format (checksums, counts of digits), gazetteers (card issuers,
dialling codes, countries, top-level domains, given names), cue words before it, its shape, and base spans in the same text.
Expectation-maximisation over the counts of vote patterns, begun at the majority's vote, estimates how reliable each
labeler is on private and on other spans. Its posteriors are the truth that the final span classifier is trained on: a logistic model of the kind, the votes and
features of the span and of what stands beside it, so it can tell spans apart on which the labelers agree.

The counts have a row for each kind, vote pattern and set of features that occur, of which there are boundedly many, so the driver fits
on a small table however large the corpus is. The expressions use possessive repetition: time is linear
in a text's length and no long run overflows the stack.

Cases: a null text counts as empty and has no spans. Candidates that overlap a base span, or a
candidate of an earlier kind, are dropped. Without candidates nothing is added. Repeated rows give a row each. Only
the named columns take part.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from . import spans
from .common import stored

#: Base kinds in the order in which they are written.
BASE = ("email", "ip", "card", "phone")
#: All kinds: what the method adds comes after the base kinds of the same name.
KINDS = (*BASE, "ssn", "iban", "name")
#: Posterior from which a candidate is personal data.
LEAST_POSTERIOR = 0.9
#: Characters before and after a candidate that are its context.
CONTEXT = 32

_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])"

#: Expressions of the method's candidates, by kind.
CANDIDATES: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,24}+)++",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{14,19}+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}+[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme)\.? \p{Lu}\p{Ll}++(?:[ -]\p{Lu}\p{Ll}++){0,2}+(?![\p{L}])",
}

#: Without one of these a text has no candidate of the kind.
CANDIDATE_SIGNS: dict[str, tuple[str, ...]] = {"email": ("[at]", "(at)"), "phone": ("(",), "name": ("Mr", "Ms", "Dr", "Prof", "Herr ", "Frau ", "Señor", "Sr", "Monsieur ", "Madame ", "Mme")}

#: Gazetteers and cue words; fixed values. First digits of card issuers, with the digits that their numbers have.
ISSUERS = "^(?:4[0-9]{15}|5[1-5][0-9]{14}|2(?:2[2-9]|[3-6][0-9]|7[01])[0-9]{13}|3[47][0-9]{13}|3(?:0[0-5]|6[0-9]|8[0-9])[0-9]{11}|(?:6011|65[0-9]{2}|35[0-9]{2})[0-9]{12})$"
#: Country calling codes.
DIALLING_CODES = (
    r"^\+(?:1|7|20|21[1-368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|27|29[01789]|30|31|32|33|34|35[0-9]|36|37[0-8]|38[0-35-79]|39|40|41|42[013]|43|44|45|46|47|48|49|50[0-9]|51|52|53|54|55|56|57|58|59[0-9]|60|61|62|63|64|65|66|67[02-9]|68[0-35-9]|69[0-2]"
    r"|81|82|84|85[02356]|86|88[06]|90|91|92|93|94|95|96[0-8]|97[0-79]|98|99[2-68])"
)
#: Length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
TOP_DOMAINS = "(?i)(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|io|co|me|tv|ai|eu|uk|de|fr|es|it|nl|be|at|ch|dk|se|no|fi|pl|cz|pt|ie|gr|ru|ua|tr|us|ca|mx|br|ar|cl|au|nz|jp|kr|cn|in|za|example)$"
GIVEN_NAMES = (
    "Ana Anna Anne Antonio Barbara Carlos Carmen Catherine Charles Christine Claire Claude Daniel David Diego Elena Elizabeth Emma Eva François Franz Friedrich Georg Hans Heinrich Helen Inés Isabel Jacques James Jane Jean Jennifer John José Joseph Juan Julia "
    "Karl Katharina Klaus Laura Linda Lucas Luis Manuel Maria María Marie Mark Martin Mary Michael Monika Nicolas Olivier Pablo Patricia Paul Pedro Peter Philippe Pierre Richard Robert Sabine Sarah Sofia Sophie Stefan Susan Thomas Ursula William Wolfgang"
).split()
PRIVATE_CUES = r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|card|visa|mastercard|credit|ssn|social security|iban|account|bank|e-?mail|mail|contact|reach|write|name|signed|patient|customer|telefon|konto|rufen|cuenta|teléfono|compte|téléphone)\b"
OTHER_CUES = r"(?i)\b(?:order|invoice|isbn|version|serial|part|sku|ref|reference|model|page|figure|table|equation|total|sum|build|ticket|batch|lot|case|chapter)\b"

LABELERS = ("format", "gazetteer", "context", "shape", "company")
#: Features of a span and what stands beside it, each with its number of values.
FEATURES = {"grouped": 2, "labelled": 2, "ended": 2, "dense": 2, "capital": 2, "length": 4}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether a number's digits pass the Luhn check."""
    doubled = F.array(*(F.lit(2 * d - 9 * (d > 4)) for d in range(10)))
    numbers = F.transform(F.split(F.reverse(_digits(match)), ""), lambda c: c.try_cast("int"))
    summed = F.aggregate(F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.element_at(doubled, d + 1)).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return summed % 10 == 0


def base_spans(text: Column) -> Column:
    """The base spans of a text that isn't null."""
    def found(sign: str, pattern: str, kind: str) -> Column:
        there = F.contains(text, F.lit(sign)) if sign else F.lit(True)
        return F.when(there, spans.find(text, pattern, kind, BASE.index(kind))).otherwise(F.array().cast(f"array<{spans.SPAN}>"))

    parts = rf"^{_PART}(?:\.{_PART}){{3}}$"
    return F.concat(
        found("@", _EMAIL, "email"),
        F.filter(found(".", _IP, "ip"), lambda s: s.match.rlike(parts)),
        F.filter(found("", _CARD, "card"), lambda s: luhn(s.match)),
        found("+", _PHONE, "phone"),
    )


def with_candidates(rows: DataFrame) -> DataFrame:
    """`rows` with `more`, what the method's expressions find in `text` outside the spans of `base` and of earlier kinds."""
    none = F.array().cast(f"array<{spans.SPAN}>")
    rows = rows.withColumn("more", none)
    for kind, pattern in CANDIDATES.items():
        there = F.lit(False)
        for sign in CANDIDATE_SIGNS.get(kind, ("",)):
            there = there | F.contains("text", F.lit(sign))
        rows = rows.withColumn("new", F.when(there, spans.find(F.col("text"), pattern, kind, KINDS.index(kind))).otherwise(none))
        free = spans.outside(F.col("new"), F.concat("base", "more"))
        rows = rows.withColumn("more", F.when(F.size("new") > 0, F.concat("more", free)).otherwise(F.col("more")))
    return rows.drop("new")


def _vote(yes: Column, no: Column) -> Column:
    """1, -1 or, where neither or both hold, 0."""
    return F.coalesce(yes, F.lit(False)).cast("int") - F.coalesce(no, F.lit(False)).cast("int")


def checks_out(match: Column) -> Column:
    """Whether an account number has its country's length and the checksum 1 modulo 97."""
    body = F.replace(match, F.lit(" "), F.lit(""))
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    turned = F.split(F.concat(F.substring(body, 5, 64), F.substring(body, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(turned, F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))
    return (F.length(body) == F.try_element_at(lengths, F.substring(body, 1, 2))) & (rest == 1)


def beside(chunks: Column, span: Column) -> tuple[Column, Column]:
    """What stands before and after a span of a text in chunks, `CONTEXT` characters at most."""
    return spans.cut(chunks, F.greatest(span.start - CONTEXT, F.lit(0)), span.start), spans.cut(chunks, span.end, span.end + CONTEXT)


def votes(chunks: Column, span: Column, base: Column) -> Column:
    """The labelers' votes on a span, each -1, 0 or 1."""
    kind, match, digits = span.kind, span.match, _digits(span.match)
    of = lambda k, c: (kind == k) & c
    n = F.length(digits)
    fits = of("card", luhn(match)) | of("phone", (n >= 9) & (n <= 15) & ~match.rlike(r"\([01]")) | of("email", match.rlike(r"[A-Za-z]{2,}$")) | of("ip", F.lit(True))
    fits = fits | of("ssn", match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")) | of("iban", checks_out(match)) | of("name", match.rlike(r" \p{Lu}\p{Ll}+[ -]\p{Lu}"))
    known = of("card", digits.rlike(ISSUERS)) | of("phone", match.rlike(DIALLING_CODES)) | of("email", match.rlike(TOP_DOMAINS)) | of("iban", F.substring(match, 1, 2).isin(*IBAN_LENGTHS))
    known = known | of("name", match.rlike(rf" (?:{'|'.join(GIVEN_NAMES)})\b"))
    unknown = (of("card", F.lit(True)) | of("iban", F.lit(True)) | of("email", F.lit(True))) & ~known
    before, _ = beside(chunks, span)
    plain = F.size(F.array_distinct(F.split(digits, ""))) <= 2
    near = F.exists(base, lambda b: (b.start != span.start) | (b.end != span.end))
    return F.struct(
        _vote(fits, ~fits & (kind != "name")).alias("format"),
        _vote(known, unknown).alias("gazetteer"),
        _vote(before.rlike(PRIVATE_CUES), before.rlike(OTHER_CUES)).alias("context"),
        _vote(kind.isin("email", "name"), (n >= 7) & plain).alias("shape"),
        _vote(near, F.lit(False)).alias("company"),
    )


def features(chunks: Column, span: Column) -> Column:
    """Small numbers that say how a span is written and what stands beside it."""
    before, after = beside(chunks, span)
    n = F.length(span.match)
    return F.struct(
        span.match.rlike(r"[0-9][ .()-]+[0-9]").cast("int").alias("grouped"),
        before.rlike(r"[:=#] ?$").cast("int").alias("labelled"),
        after.rlike(r"^(?:$|[\s.,;:!?)\]\"'])").cast("int").alias("ended"),
        F.concat(F.regexp_replace(before, "[^0-9]", ""), F.regexp_replace(after, "[^0-9]", "")).rlike("[0-9]{6}").cast("int").alias("dense"),
        before.rlike(r"\p{Lu}[\p{L}]*\W{1,3}$").cast("int").alias("capital"),
        F.when(n < 12, 0).when(n < 17, 1).when(n < 25, 2).otherwise(3).alias("length"),
    )


def looked_at(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of `df` as `row`, with arrays `base` of the base spans, `more` of the candidates and `ballots` of kind, votes and features of all of them. Store them before `trained` and `decided`, which both read them."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = with_candidates(rows)
    rows = rows.withColumn("chunks", F.when(F.size("base") + F.size("more") > 0, spans.chunks(F.col("text"))))
    every = F.transform(F.concat("base", "more"), lambda s: F.struct(s.kind.alias("kind"), votes(F.col("chunks"), s, F.col("base")).alias("votes"), features(F.col("chunks"), s).alias("features")))
    return rows.withColumn("ballots", F.when(F.size("base") + F.size("more") > 0, every).otherwise(F.slice(every, 1, 0)))


#: How often a kind got a vote pattern and a set of features.
Counts = Mapping[tuple[str, tuple[int, ...], tuple[int, ...]], int]


def counted(ballots: DataFrame) -> dict[tuple[str, tuple[int, ...], tuple[int, ...]], int]:
    """The counts of a corpus: a row for each combination that occurs, one aggregation."""
    each = ballots.select(F.explode("ballots").alias("b")).groupBy("b.kind", *(F.col(f"b.votes.{v}").alias(v) for v in LABELERS), *(F.col(f"b.features.{f}").alias(f) for f in FEATURES)).count()
    return {(r["kind"], tuple(r[v] for v in LABELERS), tuple(r[f] for f in FEATURES)): r["count"] for r in each.collect()}


def posteriors(counts: Counts, rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability that a vote pattern is private, by expectation-maximisation with a reliability for each labeler, class and vote; it begins at the majority's vote."""
    patterns: dict[tuple[int, ...], int] = {}
    for (_, pattern, _), n in counts.items():
        patterns[pattern] = patterns.get(pattern, 0) + n
    belief = {p: (1 + sum(v > 0 for v in p)) / (2 + sum(v != 0 for v in p)) for p in patterns}
    for _ in range(rounds):
        weight = [1.0, 1.0]
        table = [[{-1: (2.0, 0.4)[c], 0: 1.0, 1: (0.4, 2.0)[c]} for _ in LABELERS] for c in (0, 1)]
        for p, n in patterns.items():
            for c in (0, 1):
                share = n * (belief[p] if c else 1 - belief[p])
                weight[c] += share
                for k, v in enumerate(p):
                    table[c][k][v] += share
        for p in patterns:
            logs = [math.log(weight[c] / sum(weight)) + sum(math.log(table[c][k][v] / sum(table[c][k].values())) for k, v in enumerate(p)) for c in (0, 1)]
            belief[p] = 1 / (1 + math.exp(max(-60.0, min(60.0, logs[0] - logs[1]))))
    return belief


class Classifier:
    """A logistic model of kinds, votes and features."""

    def __init__(self, weights: Mapping[tuple[str, object], float] | None = None):
        self.weights = dict(weights or {})

    @staticmethod
    def parts(kind: str, pattern: Sequence[int], values: Sequence[int]) -> list[tuple[str, object]]:
        """What a span's score sums the weights of."""
        return [("bias", 0), ("kind", kind), *zip(LABELERS, pattern, strict=True), *zip(FEATURES, values, strict=True)]

    @classmethod
    def fit(cls, counts: Counts, belief: Mapping[tuple[int, ...], float], steps: int = 400, rate: float = 2.0, ridge: float = 0.005) -> Classifier:
        total = sum(math.log1p(n) for n in counts.values())  # frequent patterns count more, but not alone
        rows = [(cls.parts(*key), math.log1p(n) / total, belief[key[1]]) for key, n in counts.items()]
        model = cls()
        for _ in range(steps if counts else 0):
            move: dict[tuple[str, object], float] = {}
            for parts, share, truth in rows:
                error = share * (truth - model.probability(parts))
                for p in parts:
                    move[p] = move.get(p, 0.0) + error
            model = cls({p: model.weights.get(p, 0.0) * (1 - rate * ridge * (p[0] != "bias")) + rate * m for p, m in move.items()})
        return model

    def probability(self, parts: Sequence[tuple[str, object]]) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(self.weights.get(p, 0.0) for p in parts)))))

    def accepts(self, ballot: Column, least: float) -> Column:
        """Whether a ballot's probability reaches `least`, as an expression of literal weights."""
        weight = lambda *p: F.lit(float(self.weights.get(p, 0.0)))
        kinds = F.create_map(*(x for k in KINDS for x in (F.lit(k), weight("kind", k))))
        score = weight("bias", 0) + F.element_at(kinds, ballot.kind)
        for name in LABELERS:
            score = score + F.element_at(F.array(*(weight(name, v) for v in (-1, 0, 1))), ballot.votes[name] + 2)
        for name, n in FEATURES.items():
            score = score + F.element_at(F.array(*(weight(name, v) for v in range(n))), ballot.features[name] + 1)
        return score >= math.log(least / (1 - least))


def trained(ballots: DataFrame) -> Classifier:
    """The classifier of a corpus: one aggregation, then sums over its small table."""
    counts = counted(ballots)
    return Classifier.fit(counts, posteriors(counts))


def decided(rows: DataFrame, classifier: Classifier, *, least: float = LEAST_POSTERIOR) -> DataFrame:
    """`row`, `base` and `found`, the base spans and the candidates that the classifier accepts."""
    own = F.slice("ballots", F.size("base") + 1, F.size("ballots"))
    accepted = F.transform(F.filter(F.arrays_zip(F.col("more").alias("span"), own.alias("ballot")), lambda x: classifier.accepts(x.ballot, least)), lambda x: x.span)
    return rows.withColumn("found", F.when(F.size("more") > 0, F.concat("base", accepted)).otherwise(F.col("base")))


def redact(df: DataFrame, *, text_col: str = "text", least: float = LEAST_POSTERIOR) -> DataFrame:
    """`df` with every span of personal data in its text replaced by its kind; a null text stays null. All other columns stay."""
    rows = stored(looked_at(df, text_col=text_col).select("row", "base", "more", "ballots"))
    found = decided(rows, trained(rows), least=least).withColumn("text", F.coalesce(F.col("row")[text_col], F.lit("")))
    found = spans.masked(found, "text", "found")
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("masked"))
    return found.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))
