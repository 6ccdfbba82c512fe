"""The registered queries of this subpackage: each applies one operator to its whole table and derives the columns agreed on."""

from __future__ import annotations

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, htmltext, mixing, negatives, phrases, pii, quality, secrets, simhash, spans, topk, toxicity, urlfilter
from .common import stored, table

#: Rules of op3: entry `host/path` and verdict.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The list of hosts that op3 blocks where no rule fits, by rule: two words joined by a hyphen, bare or with the number of a mirror, under each domain.
BLOCKED_FIRST = ("adult", "ads", "bet", "best", "casino", "cheap", "click", "fast", "free", "hot", "loan", "lucky", "mega", "pop", "prize", "quick", "spam", "super", "top", "win")
BLOCKED_SECOND = ("bank", "bets", "bonus", "cash", "chat", "clicks", "deals", "farm", "games", "gifts", "loans", "mail", "pills", "play", "pop", "prize", "shop", "slots", "spins", "store", "track", "video", "win", "x", "zone")
BLOCKED_DOMAINS, BLOCKED_MIRRORS = ("example.com", "example.net", "example.org"), 40

#: op9's domains, as the labelled table gives them, and their target weights.
DOMAIN = "CASE WHEN toxic > 0 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN quality > 0 THEN 'good' END"
TARGET_WEIGHTS = {"good": 0.84, "poor": 0.03, "toxic": 0.13}

#: What both turns of op11's conversation -7 say.
CONTROL_TEXT = r"\### Assistant: </turn> ok"

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        F.col("n_inside").alias("n_inside_characters"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and places of personal data."""
    rows = pii.looked_at(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = stored(rows.select(F.struct("row.doc_id").alias("row"), "base", "more", "ballots"))
    found = pii.decided(rows, pii.trained(rows))
    return found.select(
        "row.doc_id",
        *(spans.count(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE),
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        spans.written(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
    )


def blocked_hosts(spark: SparkSession) -> DataFrame:
    """The list of op3 as a table: `entry`."""
    words = spark.range(1).select(*(F.explode(F.array(*map(F.lit, values))).alias(c) for c, values in (("first", BLOCKED_FIRST),)))
    words = words.withColumn("second", F.explode(F.array(*map(F.lit, BLOCKED_SECOND)))).withColumn("domain", F.explode(F.array(*map(F.lit, BLOCKED_DOMAINS))))
    number = words.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(BLOCKED_MIRRORS - 1))))
    mirror = F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
    return number.select(F.concat("first", F.lit("-"), "second", mirror, F.lit("."), "domain", F.lit("/")).alias("entry"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    rules = spark.createDataFrame(URL_RULES, "entry string, verdict string")
    found = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, blocked_hosts(spark))
    return found.select("row.page_id", "host", "path", "rule", "verdict")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and whether it stays."""
    documents = table(spark, sf_dir, "documents")
    field = quality.fitted(documents, table(spark, sf_dir, "labels"))
    found = quality.judge(documents, field)
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's category probabilities and whether it is toxic."""
    documents = table(spark, sf_dir, "documents")
    chain = toxicity.fitted(documents, table(spark, sf_dir, "labels"))
    names = {n: f"p_{n}" for n in chain.names}
    return toxicity.score(documents, chain).withColumnsRenamed(names).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id of its component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return htmltext.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def domains_of(labels: DataFrame) -> DataFrame:
    """`doc_id, domain` of a labelled table."""
    return labels.select("doc_id", F.expr(DOMAIN).alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, domain probabilities and rate."""
    documents = table(spark, sf_dir, "documents")
    model = mixing.fitted(documents, domains_of(table(spark, sf_dir, "labels")))
    domains = model.domains if model else []
    scored = stored(mixing.score(documents, model))
    found = mixing.with_rates(scored, mixing.solved(scored, domains, TARGET_WEIGHTS))
    return found.select("row.doc_id", "n_tokens", *(F.col("shares")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and places of secrets."""
    rows = secrets.looked_at(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = stored(rows.select(F.struct("row.doc_id").alias("row"), "base", "more", "tests"))
    found = secrets.decided(rows, secrets.fitted(rows))
    return found.select(
        "row.doc_id",
        *(spans.count(F.col("base"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]),
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        spans.written(F.col("found")).alias("spans"),
    )


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns and learnt texts, read back from the template."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    odd = spark.range(1).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.to_json(F.struct(F.lit(CONTROL_TEXT).alias("prompt"), F.lit(CONTROL_TEXT).alias("response"))).alias("record"))
    return chat.digests(chat.formatted(chat.turns(rows.unionByName(odd)))).withColumnRenamed("id", "conv_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of other labels for each of the 5 positives of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return negatives.mine(vectors.where("vec_id % 100 = 0"), vectors, 5)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two to four words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_pii, op3_url_filter, op4_quality, op5_toxicity, op6_simhash, op7_top_k, op8_main_text, op9_mixing, op10_secrets, op11_chat, op12_hard_negatives, op13_phrases)}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{e}', '{v}')" for e, v in URL_RULES)}) r(entry, verdict)),
blocked AS (SELECT a || '-' || b || CASE WHEN n = 0 THEN '' ELSE '-' || n END || '.' || d AS host FROM unnest({list(BLOCKED_FIRST)}) x(a), unnest({list(BLOCKED_SECOND)}) y(b), unnest({list(BLOCKED_DOMAINS)}) z(d), range({BLOCKED_MIRRORS}) r(n)),
ends AS (SELECT page_id, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS suffix, path FROM parts),
listed AS (SELECT DISTINCT page_id FROM ends JOIN blocked ON suffix = host AND starts_with(path, '/')),
fits AS (
  SELECT p.page_id, p.host, p.path,
    (SELECT arg_max(entry, length(entry)) FROM rules r
     WHERE ('.' || p.host) LIKE '%.' || split_part(entry, '/', 1) AND starts_with(p.path, substr(entry, strpos(entry, '/')))) AS rule
  FROM parts p)
SELECT f.page_id, host, path, f.rule, coalesce(r.verdict, CASE WHEN l.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM fits f LEFT JOIN rules r ON f.rule = r.entry LEFT JOIN listed l ON f.page_id = l.page_id""",
    "op7_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 5""",
    "op11_chat": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
said AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') || ': ' || replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') || '</turn>' || chr(10) AS said FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, said)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, said) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(said))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS anchor_id, q.label AS own, c.vec_id, c.label, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id) WHERE s.label <> p.own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM words)
  GROUP BY lang, g HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, 2000000 * c.f::HUGEINT // (l.f + r.f) AS score
  FROM grams c, range(1, len(c.g)) t(k) JOIN grams l ON l.lang = c.lang AND l.g = c.g[:k] JOIN grams r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, sub, max(f) AS most FROM (
    SELECT lang, f, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) AS sub FROM grams WHERE len(g) > 2)
  GROUP BY lang, sub)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT c.lang, array_to_string(c.g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, array_to_string(c.g, ' ')) AS rank
  FROM lowest c LEFT JOIN inner_parts i ON i.lang = c.lang AND i.sub = c.g WHERE most IS NULL OR 100 * most < 80 * a) o
JOIN totals t ON t.lang = o.lang WHERE rank <= 2000""",
}
