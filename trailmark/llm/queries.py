"""Registered queries of the operators over whole tables, with the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import (
    bpe, collocations, embedding_dedup, language_id, license_scan, line_dedup, lm_scoring, mixing, quality_rules, secret_scan,
    simhash_dedup, spelling_variants, toxicity,
)
from trailmark.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classes(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(documents(spark, sf_dir)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.classes(documents(spark, sf_dir))
    return found.select(
        "doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.vocabulary(documents(spark, sf_dir), slip=spelling_variants.SLIP)
    return spelling_variants.group(words)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(documents(spark, sf_dir), table(spark, sf_dir, "labels")).withColumn(
        "n_clauses", F.size("clauses")
    ).drop("clauses")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_secret_scan, op3_source_mixing, op4_license_scan, op5_line_dedup, op6_bpe, op7_language_id, op8_simhash_dedup, op9_quality_rules, op10_lm_scoring, op11_spelling_variants, op12_collocations, op13_toxicity)
}

_PHRASES = " UNION ALL ".join(
    f"SELECT lang, list_slice(w, i, i + {k - 1}) AS words FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces)"
    for k in range(1, 5)
)
_CUTS = " UNION ALL ".join(
    f"SELECT lang, words, f AS a, {k} AS k, list_slice(words, 1, {k}) AS x, list_slice(words, {k + 1}, len(words)) AS y "
    f"FROM candidates WHERE len(words) > {k}"
    for k in range(1, 4)
)
_PARTS = " UNION ALL ".join(
    f"SELECT lang, f AS longer, list_slice(words, {i}, {i + k - 1}) AS words FROM candidates WHERE len(words) = {n}"
    for n in (3, 4) for k in range(2, n) for i in range(1, n - k + 2)
)
ORACLES: dict[str, str] = {
    "op12_collocations": f"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
pieces AS (
    SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
    FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts)),
totals AS (SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, words, count(*) AS f FROM ({_PHRASES}) GROUP BY lang, words HAVING count(*) >= 30),
candidates AS (SELECT * FROM counts WHERE len(words) >= 2),
longest AS (SELECT lang, words, max(longer) AS longer FROM ({_PARTS}) GROUP BY lang, words),
kept AS (
    SELECT c.* FROM candidates c LEFT JOIN longest m ON c.lang = m.lang AND c.words = m.words
    WHERE m.longer IS NULL OR 100 * m.longer < 80 * c.f),
cuts AS (
    SELECT u.lang, u.words, u.a, u.k, p.f AS l, q.f AS r,
           cast((2000000 * cast(u.a AS HUGEINT)) // (p.f + q.f) AS BIGINT) AS score
    FROM ({_CUTS}) u
    JOIN kept USING (lang, words)
    JOIN counts p ON p.lang = u.lang AND p.words = u.x
    JOIN counts q ON q.lang = u.lang AND q.words = u.y),
lowest AS (
    SELECT *, array_to_string(words, ' ') AS phrase FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
""",
}
