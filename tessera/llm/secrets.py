"""Secrets by expressions and a battery of randomness tests, with Spark's own functions only.

Base spans come from fixed expressions and stay as they are. The method adds strings that look drawn at random:
every run of 16 or more characters of the usual encodings is a candidate. Its encoding is inferred from its characters, and three
statistics are taken in that encoding: the symbols' coincidences (chi-squared uniformity over the alphabet), runs of
small letters, capitals, digits and signs, and the serial correlation of neighbouring symbols' values.

Each is tested twice. Against the hypothesis of a random string: a candidate that fails the three together isn't random. And against
the hypothesis of ordinary writing - words, names, paths, numbers - whose coincidences, changes between the kinds of characters and correlation follow from
letter frequencies: here the three z-scores, weighed by how far apart the two hypotheses lie in that encoding and length, combine to one p-value, which falls with the
length as short strings tell less. Within each encoding and class of lengths the step-up rule keeps the false discoveries among all candidates of the corpus
below `FALSE_DISCOVERIES`. The rule needs only how many candidates have which z-score, in tenths: a table of bounded size.

Cases: a null text counts as empty and has no spans. Candidates that overlap a base span are dropped.
Repeated rows give a row each. Only the named columns take part.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from . import spans
from .common import stored

#: Base kinds in the order in which they are written, then the method's.
KINDS = ("assign", "access", "hex", "random")
FALSE_DISCOVERIES = 0.01
#: Sum of three squared z-scores beyond which a string isn't random (chi-squared of three, a thousandth).
NOT_RANDOM = 16.27
#: Lower ends of the classes of length.
LENGTHS = (16, 20, 24, 32, 48, 96)

_ASSIGN = r"""(?:(?i)password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?+([A-Za-z0-9+/_.=-]++)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}+"
_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
_CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])"

#: Alphabets of the encodings, tried in this order; the value of a symbol is its place.
ALPHABETS: dict[str, str] = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


#: Letter frequencies of ordinary writing, in hundredths of a percent; fixed values.
LETTERS = {
    "a": 817, "b": 149, "c": 278, "d": 425, "e": 1270, "f": 223, "g": 202, "h": 609, "i": 697, "j": 15, "k": 77, "l": 403, "m": 241,
    "n": 675, "o": 751, "p": 193, "q": 10, "r": 599, "s": 633, "t": 906, "u": 276, "v": 98, "w": 236, "x": 15, "y": 197, "z": 7,
}
#: Of ordinary writing that an encoding's characters can spell: the shares of digits, capitals beside small letters and signs, and of places where the kind of character changes.
ORDINARY = {"hex": (0.6, 0.0, 0.0, 0.3), "base32": (0.1, 0.0, 0.0, 0.2), "base36": (0.1, 0.0, 0.0, 0.2), "base62": (0.1, 0.1, 0.0, 0.25), "base64url": (0.1, 0.1, 0.1, 0.4), "base64": (0.1, 0.1, 0.1, 0.4)}


def _kind(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "."


def ordinary(name: str) -> dict[str, float]:
    """What the statistics are in ordinary writing and in random strings of an encoding: symbols' coincidences of two and three, changes, and the correlation of neighbours."""
    alphabet, (digits, capitals, signs, changes) = ALPHABETS[name], ORDINARY[name]
    both = "a" in alphabet and "A" in alphabet
    rest = 1 - digits - signs
    of_kind = {"0": digits, ".": signs, "A": rest * capitals if both else rest, "a": rest * (1 - capitals) if both else rest}
    total = {k: sum(LETTERS[c.lower()] if k in "aA" else 1 for c in alphabet if _kind(c) == k) for k in of_kind}
    share = [of_kind[_kind(c)] * (LETTERS[c.lower()] if c.isalpha() else 1) / total[_kind(c)] for c in alphabet]
    k, middle = len(alphabet), (len(alphabet) - 1) / 2
    there = {x: sum(q for c, q in zip(alphabet, share, strict=True) if _kind(c) == x) for x in set(map(_kind, alphabet))}
    mean = {x: sum(q * (v - middle) for v, (c, q) in enumerate(zip(alphabet, share, strict=True)) if _kind(c) == x) / there[x] for x in there if there[x]}
    same = sum(there[x] * mean[x] ** 2 for x in mean)
    apart = sum(there[x] * there[y] * mean[x] * mean[y] for x in mean for y in mean if x != y) / max(1e-9, 1 - sum(p * p for p in there.values()))
    counts = [sum(_kind(c) == x for c in alphabet) / k for x in there]
    return {
        "k": float(k), "two": sum(q**2 for q in share), "three": sum(q**3 for q in share), "changes": changes, "random_changes": 1 - sum(c * c for c in counts),
        "correlation": ((1 - changes) * same + changes * apart) / ((k * k - 1) / 12),
    }


def base_spans(text: Column) -> Column:
    """The base spans of a text that isn't null."""
    none = F.array().cast(f"array<{spans.SPAN}>")
    assign = spans.find(text, _ASSIGN, "assign", 0, group=1)
    return F.concat(
        spans.plain(F.filter(assign, lambda s: F.length(s.part) >= 6)),
        F.when(F.contains(text, F.lit("AKIA")), spans.find(text, _ACCESS, "access", 1)).otherwise(none),
        spans.find(text, _HEX, "hex", 2),
    )


def candidates(text: Column, base: Column) -> Column:
    """Spans of the method's candidates outside the base spans."""
    new = spans.find(text, _CANDIDATE, "random", 3)
    return F.when(F.size(new) > 0, spans.outside(new, base)).otherwise(new)


def encoding(match: Column) -> Column:
    """The first encoding whose alphabet has every character, less padding; hexadecimal and base 36 in one case only."""
    body = F.rtrim(match, F.lit("="))
    chosen = F.lit("base64")
    for name, expression in reversed([("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$"), ("base32", "^[A-Z2-7]+$"), ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$"), ("base62", "^[0-9A-Za-z]+$"), ("base64url", "^[0-9A-Za-z_-]+$")]):
        chosen = F.when(body.rlike(expression), name).otherwise(chosen)
    return chosen


def tests(match: Column) -> Column:
    """`kind`, the encoding, `n`, squared z-scores against a random string summed as `against_random`, and `z`, the combined score against ordinary writing."""
    body, kind = F.rtrim(match, F.lit("=")), encoding(match)
    one_case = F.when(kind == "base32", body).when(kind.isin("hex", "base36"), F.lower(body)).otherwise(body)
    alphabet = F.element_at(F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair)), kind)
    known = F.element_at(F.create_map(*(x for name in ALPHABETS for x in (F.lit(name), F.struct(*(F.lit(float(v)).alias(f) for f, v in ordinary(name).items()))))), kind)

    def measured(s: Column) -> Column:
        n, o = F.size(s.symbols).cast("double"), s.ordinary
        k, pairs, triples = o.k, n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
        squares = F.aggregate(F.array_distinct(s.symbols), F.lit(0.0), lambda a, c: a + F.pow((F.length(s.text) - F.length(F.replace(s.text, c))).cast("double"), F.lit(2.0)))
        coincidences = (squares - n) / 2
        changes = F.length(F.regexp_replace(s.kinds, r"(.)\1*+", "x")).cast("double") - 1
        middle, spread = (k - 1) / 2, (k * k - 1) / 12
        neighbours = F.zip_with(F.slice(s.values, 1, F.size(s.values) - 1), F.slice(s.values, 2, F.size(s.values)), lambda a, b: (a - middle) * (b - middle))
        correlation = F.aggregate(neighbours, F.lit(0.0), lambda t, p: t + p) / spread / (n - 1)

        uniform = (k * squares / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        runs = (changes - (n - 1) * o.random_changes) / F.sqrt((n - 1) * o.random_changes * (1 - o.random_changes))
        against = F.pow(F.greatest(uniform, F.lit(0.0)), F.lit(2.0)) + F.pow(runs, F.lit(2.0)) + F.pow(correlation * F.sqrt(n - 1), F.lit(2.0))

        deviations = F.array(
            F.sqrt(pairs * o.two * (1 - o.two) + 6 * triples * F.greatest(o.three - o.two * o.two, F.lit(0.0))) / pairs,
            F.sqrt(o.changes * (1 - o.changes) / (n - 1)),
            1 / F.sqrt(n - 1),
        )
        seen = F.array(o.two - coincidences / pairs, changes / (n - 1) - o.changes, o.correlation - correlation)
        expected = F.array(o.two - 1 / k, o.random_changes - o.changes, o.correlation)
        weights = F.zip_with(expected, deviations, lambda e, d: F.greatest(e / d, F.lit(0.0)))
        scores = F.zip_with(weights, F.zip_with(seen, deviations, lambda x, d: x / d), lambda w, x: w * x)
        length = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda t, w: t + w * w))
        z = F.aggregate(scores, F.lit(0.0), lambda t, x: t + x) / F.greatest(length, F.lit(1e-9))
        return F.struct(s.kind.alias("kind"), n.cast("int").alias("n"), against.alias("against_random"), z.alias("z"))

    symbols = F.split(one_case, "")
    values = F.transform(symbols, lambda c: F.position(c, alphabet).cast("double") - 1)
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "+/_-", "....")
    one = F.array(F.struct(one_case.alias("text"), symbols.alias("symbols"), values.alias("values"), known.alias("ordinary"), kind.alias("kind"), classes.alias("kinds")))
    return F.element_at(F.transform(one, measured), 1)


def length_class(n: Column) -> Column:
    """The lower end of the class of a length."""
    chosen = F.lit(LENGTHS[0])
    for low in LENGTHS[1:]:
        chosen = F.when(n >= low, low).otherwise(chosen)
    return chosen


def looked_at(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of `df` as `row`, with arrays `base` of the base spans, `more` of the candidates and `tests` of the candidates' measures. Store them before `fitted` and `decided`, which both read them."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("more", candidates(F.col("text"), F.col("base")))
    return rows.withColumn("tests", F.transform("more", lambda s: tests(s.match)))


def group(test: Column) -> Column:
    """The encoding and class of length in which false discoveries are controlled."""
    return F.concat(test.kind, F.lit(" "), length_class(test.n).cast("string"))


def tenths(test: Column) -> Column:
    """The z-score in whole tenths, rounded down, from -100 to 400."""
    return F.floor(F.least(F.greatest(test.z, F.lit(-10.0)), F.lit(40.0)) * 10).cast("int")


def thresholds(counts: Mapping[tuple[str, int], int], most: float = FALSE_DISCOVERIES) -> dict[str, int]:
    """The least z-score, in tenths, by group: the step-up rule on the p-values of the normal tail.

    counts: by group and z-score in tenths. A tenth counts with its largest p-value,
    so at most the stated share is false. Groups without a discovery are left out.
    """
    found: dict[str, int] = {}
    for name in {g for g, _ in counts}:
        own = sorted(((z, n) for (g, z), n in counts.items() if g == name), reverse=True)
        total, passed = sum(n for _, n in own), 0
        for z, n in own:
            passed += n
            if 0.5 * math.erfc(z / 10 / math.sqrt(2)) <= most * passed / total:
                found[name] = z
    return found


def fitted(rows: DataFrame, *, most: float = FALSE_DISCOVERIES) -> dict[str, int]:
    """The thresholds of a corpus: one aggregation to a row for each group and tenth."""
    each = rows.select(F.explode("tests").alias("t")).groupBy(group(F.col("t")).alias("name"), tenths(F.col("t")).alias("z")).count()
    return thresholds({(r["name"], r["z"]): r["count"] for r in each.collect()}, most)


def decided(rows: DataFrame, least: Mapping[str, int]) -> DataFrame:
    """`row`, `base` and `found`, the base spans and the candidates that pass the battery and the threshold of their encoding and length."""
    limits = F.create_map(*(F.lit(x) for pair in (dict(least) or {"": 0}).items() for x in pair))
    passes = lambda t: (t.against_random <= NOT_RANDOM) & F.coalesce(tenths(t) >= F.try_element_at(limits, group(t)), F.lit(False))
    accepted = F.transform(F.filter(F.arrays_zip(F.col("more").alias("span"), F.col("tests").alias("test")), lambda x: passes(x.test)), lambda x: x.span)
    return rows.withColumn("found", F.when(F.size("more") > 0, F.concat("base", accepted)).otherwise(F.col("base")))


def redact(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`df` with every secret in its text replaced by its kind; a null text stays null. All other columns stay."""
    rows = stored(looked_at(df, text_col=text_col).select("row", "base", "more", "tests"))
    found = decided(rows, fitted(rows)).withColumn("text", F.coalesce(F.col("row")[text_col], F.lit("")))
    found = spans.masked(found, "text", "found")
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("masked"))
    return found.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))
