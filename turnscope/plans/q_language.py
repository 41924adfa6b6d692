"""Queries on languages told by fitted profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions.language import BUCKETS, FIT_ROWS, WORD, fit_profiles, language_of

from .views import table

Q, S = {}, {}

#: A quarter of the documents, by the digest of their number, never fits a profile.
_APART = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3')"


def _sql(texts: str, keys: str) -> str:
    grams = lambda source, keep: f"SELECT {keep}, unnest(flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}{{1,{WORD}}}'), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 1), lambda i: (unicode(substr(' ' || w || ' ', CAST(i AS INTEGER), 1)) * 10007 + unicode(substr(' ' || w || ' ', CAST(i AS INTEGER) + 1, 1)) * 101 + unicode(substr(' ' || w || ' ', CAST(i AS INTEGER) + 2, 1))) % {BUCKETS})))) AS k FROM {source}"
    return f"""
WITH d AS ({texts}), fitted AS (SELECT DISTINCT lang, text FROM documents WHERE NOT {_APART} AND text IS NOT NULL AND lang IS NOT NULL ORDER BY md5(text), lang LIMIT {FIT_ROWS}),
n AS (SELECT lang, k, count(*) AS n FROM ({grams("fitted", "lang")}) GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
g AS (SELECT rid, k, count(*) AS times FROM ({grams("d", "rid")}) GROUP BY ALL),
s AS (SELECT rid, t.lang AS guess, sum(times * CAST(round(ln((coalesce(n.n, 0) + 0.5) / (total + 0.5 * {BUCKETS})) * 1000) AS BIGINT)) AS score FROM g CROSS JOIN t LEFT JOIN n ON n.lang = t.lang AND n.k = g.k GROUP BY ALL),
b AS (SELECT rid, guess FROM s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, guess) = 1)
SELECT {keys}, coalesce(guess, '') AS guess, count(*) AS n FROM d LEFT JOIN b USING (rid) GROUP BY ALL"""


def _profiles(spark, d):
    apart = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin(*"0123")
    return fit_profiles(table(spark, d, "documents").filter(~apart)), apart


def language_profiles(spark, d):
    """Languages of all documents against their labels, those that fitted no profile apart."""
    profiles, apart = _profiles(spark, d)
    return table(spark, d, "documents").select("lang", apart.alias("held_out"), language_of(F.col("text"), profiles).alias("guess")).groupBy("lang", "held_out", "guess").agg(F.count("*").alias("n"))


def prompt_languages(spark, d):
    """E14 on short texts: languages of all messages, by role."""
    profiles, _ = _profiles(spark, d)
    return table(spark, d, "conversations").select("role", language_of(F.col("text"), profiles).alias("guess")).groupBy("role", "guess").agg(F.count("*").alias("n"))


Q["language_profiles"] = language_profiles
S["language_profiles"] = _sql(f"SELECT row_number() OVER () AS rid, lang, {_APART} AS held_out, text FROM documents", "d.lang, held_out")
Q["prompt_languages"] = prompt_languages
S["prompt_languages"] = _sql("SELECT row_number() OVER () AS rid, role, text FROM conversations", "role")
