"""Column functions on texts: terms, sentences, markers, overlaps."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Citation markers are private-use characters around turn and reference numbers.
OPEN, CLOSE, SEP = "\ue200", "\ue201", "\ue202"
MARKER = OPEN + "[^" + CLOSE + "]*" + CLOSE
CITING_MARKER = OPEN + "(?=[^" + CLOSE + "]*" + SEP + "[A-Za-z]+[0-9]+[A-Za-z]+[0-9]+(?:" + SEP + "|" + CLOSE + "))[^" + CLOSE + "]*" + CLOSE
REF = SEP + "[A-Za-z]+([0-9]+)[A-Za-z]+([0-9]+)(?=" + SEP + "|" + CLOSE + ")"
SENTENCE_END = r"(?<=[.!?])\s+(?=[`'*_\"(\[]*[A-Z0-9])"
MIN_SENTENCE = 8
STOPWORDS = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"),
    "fr": ("au", "avec", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"),
    "de": ("als", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"),
    "es": ("al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una"),
}


def terms(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def term_count(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    t = terms(text)
    return F.size(F.filter(t, lambda x: ~F.lower(x).isin(*stopwords)) if stopwords else t).cast("long")


def word_tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def content_tokens(text: Column, lang: str = "en") -> Column:
    """Tokens without stopwords; a lemma or stem hook may map them further."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS.get(lang, ())]).cast("array<string>")
    return F.filter(word_tokens(text), lambda t: ~F.array_contains(stop, t))


def _among(words):
    return lambda t: t.isin(*words)


def guess_language(text: Column) -> Column:
    """The language with most stopword hits, in code order on ties; empty without any."""
    w = word_tokens(text)
    hits = F.array(*[F.struct(F.size(F.filter(w, _among(s))).alias("n"), F.lit(k).alias("lang")) for k, s in sorted(STOPWORDS.items())])
    best = F.array_max(F.transform(hits, lambda h: h["n"]))
    return F.when(best > 0, F.filter(hits, lambda h: h["n"] == best)[0]["lang"]).otherwise("")


def sentences(text: Column) -> Column:
    """Sentences of at least eight characters with a letter, stripped of bullets."""
    parts = F.split(F.coalesce(text, F.lit("")), SENTENCE_END)
    clean = F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \-*\t\n]+|[ \-*\t\n]+$", ""))
    return F.filter(clean, lambda s: (F.length(s) >= MIN_SENTENCE) & s.rlike("[A-Za-z]"))


def citation_refs(marker: Column) -> Column:
    """(turn_index, ref_index) pairs of a marker."""
    m = F.coalesce(marker, F.lit(""))
    one, two = (F.regexp_extract_all(m, F.lit(REF), F.lit(i)) for i in (1, 2))
    return F.zip_with(one, two, lambda a, b: F.struct(a.cast("int").alias("turn_index"), b.cast("int").alias("ref_index")))


def clean_claims(claims: Column) -> Column:
    t = F.transform(claims, lambda c: F.trim(c))
    return F.array_distinct(F.filter(t, lambda c: c.isNotNull() & (F.length(c) >= MIN_SENTENCE) & c.rlike("[A-Za-z]")))


def claim_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunks_between_markers(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), MARKER), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(text)))


def match_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the multisets of [a-z0-9]+ tokens of two texts."""
    x, y = (F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)) for c in (a, b))
    both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(x, lambda u: u == t)), F.size(F.filter(y, lambda u: u == t))))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n_precision(candidate: Column, reference: Column, n: int) -> Column:
    """Share of the candidate's n-grams that the reference holds, counted with multiplicity."""
    x, y = (ngrams(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), n) for c in (candidate, reference))
    both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(x, lambda u: u == t)), F.size(F.filter(y, lambda u: u == t))))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(x)), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def rouge_l_precision(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """Longest common subsequence of tokens over the candidate's length."""
    import re

    def one(a, b):
        x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (a, b))
        if not x or not y:
            return 0.0
        number = {w: i for i, w in enumerate(dict.fromkeys(y))}
        yy = np.array([number[w] for w in y])
        row = np.zeros(len(y) + 1, np.int64)
        for w in x:
            hit = yy == number.get(w, -1)
            row[1:] = np.maximum.accumulate(np.maximum(np.where(hit, row[:-1] + 1, 0), row[1:]))
        return float(row[-1]) / len(x)

    return pd.Series([one(a, b) for a, b in zip(candidate, reference)], dtype="float64")


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """A model's answer as JSON: the whole of it, else its first object of balanced braces that reads as JSON or as a Python literal; null if there is none."""
    import ast

    def read(t, *how):
        for f in how:
            try:
                return json.dumps(f(t), ensure_ascii=False, default=list)
            except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
                continue
        return None

    def one(t):
        t = (t or "").strip()
        if not t or (got := read(t, json.loads)) is not None:
            return got if t else None
        at = t.find("{")
        while at >= 0:
            depth, end = 0, -1
            for i in range(at, len(t)):
                depth += (t[i] == "{") - (t[i] == "}")
                if not depth:
                    end = i + 1
                    break
            if end > 0 and (got := read(t[at:end], json.loads, ast.literal_eval)) is not None:
                return got
            at = t.find("{", at + 1)
        return None

    return pd.Series([one(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def literal_json(text: pd.Series) -> pd.Series:
    """A Python literal as JSON, null if it isn't one."""
    import ast

    def one(t):
        try:
            return json.dumps(ast.literal_eval(t), ensure_ascii=False, default=list)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            return None

    return pd.Series([None if t is None else one(t) for t in text], dtype=object)


#: Fixed value: a summary of fewer characters gives way to all visible text.
MIN_ARTICLE = 200


def article_text(html: Column, summary: Column | None = None) -> Column:
    """Text of a page's summary (markup, as a readability hook gives it), or, if that is short, all visible text of the page."""
    whole = html_to_text(html)
    if summary is None:
        return whole
    short = html_to_text(F.coalesce(summary, html))
    return F.when(F.length(short) < MIN_ARTICLE, whole).otherwise(short)


def html_to_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, common entities are resolved, blanks collapse."""
    t = F.coalesce(html, F.lit(""))
    for pattern, by in ((r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", " ")):
        t = F.regexp_replace(t, pattern, by)
    for name, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(by))
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" *\n[ \n]*", "\n"), F.lit(" \n"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3).cast("long")


def trim_to_tokens(text: Column, budget: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, 3 * budget)
