"""Queries of the pipeline operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, embed_dedup, langid, licenses, packing, pii, simhash, token_counts, warc
from tidemark.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# --- what SQL can tell of operators that it cannot express as a whole -----------------------------------------------


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op1_pii."""
    return op1_pii(spark, sf_dir).drop("spans")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10_licenses."""
    return op10_licenses(spark, sf_dir).drop("labels", "score")


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document what op9_packing packed, and how many faults its bins have: too full, two pieces of one source,
    two pieces of one document, overlapping pieces, a wrong sum of words."""
    plan = op9_packing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    bins = plan.groupBy("bin_id").agg(F.sum("n_words").alias("words"), F.max("bin_words").alias("said"), F.count("source").alias("n"), F.countDistinct("source").alias("sources"), F.count("*").alias("pieces"), F.countDistinct("doc_id").alias("docs"), F.max(F.col("start") + F.col("n_words")).alias("last"))
    wrong = bins.select("bin_id", sum(c.cast("int") for c in (F.col("words") > packing.CAPACITY, F.col("words") != F.col("said"), F.col("last") != F.col("words"), F.col("n") != F.col("sources"), F.col("pieces") != F.col("docs"))).alias("wrong"))
    return plan.join(wrong, "bin_id").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("pieces"), F.sum("wrong").alias("faults"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_warc, op3_embedding_dedup, op4_ann, op5_language, op6_simhash, op7_bpe, op8_token_counts, op9_packing, op10_licenses, pipeline, pii_base, license_base, packing_totals)}

def _kind(name: str, pattern: str, test: str) -> str:
    """Matches of a pattern with their places: the parts between them and their own lengths add up. Gaps are cut at
    a zero character put in place of each match; texts hold none."""
    return f"""SELECT doc_id, '{name}' AS kind, m, start, start + length(m) AS stop FROM (
        SELECT doc_id, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS start FROM (
          SELECT doc_id, unnest(ms) AS m, unnest(gs[1 : len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split(regexp_replace(t, '{pattern}', chr(1), 'g'), chr(1)) AS gs FROM d))) WHERE {test}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN {_DIGITS}[-1 - i]::INT ELSE 2 * {_DIGITS}[-1 - i]::INT - CASE WHEN {_DIGITS}[-1 - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_SPANS = {
    "email": _kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": _kind("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255"),
    "card": _kind("card", r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": _kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
_PHRASES = {phrase.replace(" ", "', '"): label for phrase, label in licenses.PHRASES.items()}

ORACLE = {
    # SHA-1 in base32: 32 groups of five bits of the digest's 160.
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS top FROM p),
        b AS (SELECT *, list_transform(range(160), lambda i: (instr('0123456789abcdef', hex[i // 4 + 1]) - 1) >> (3 - i % 4) & 1) AS bits FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[bits[5*k+1]*16 + bits[5*k+2]*8 + bits[5*k+3]*4 + bits[5*k+4]*2 + bits[5*k+5] + 1]), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
        FROM b
    """,
    # A hash join on label keeps the products within labels; components by repeated minimum.
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.vec_id),
        c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
    """,
    "pii_base": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(_SPANS.values())}),
        o AS (SELECT *, kind || ':' || start || ':' || stop AS said, list_position(['email', 'ip', 'card', 'phone'], kind) AS k FROM s)
        SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
               sha256(coalesce(string_agg(said, ',' ORDER BY start, k), '')) AS base_sha256
        FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id
    """,
    "license_base": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p AS ({" UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + {phrase.count(',') + 1}] = ['{phrase}'])) AS pos, '{label}' AS label FROM w" for phrase, label in _PHRASES.items())}),
        a AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id)
        SELECT w.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN a USING (doc_id)
    """,
    "packing_totals": f"""
        WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS n_words FROM documents)
        SELECT doc_id, n_words, greatest(1, ceil(n_words / {packing.CAPACITY}.0))::BIGINT AS pieces, 0::BIGINT AS faults FROM n
    """,
}
