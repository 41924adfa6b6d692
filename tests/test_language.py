"""Languages by fitted profiles: brute force, defined cases, held-out accuracy on whole and short texts."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from turnscope.functions import language, text

SMALL = "/root/testdata/sf0.01"


def slow_trigrams(t):
    out = []
    for w in re.findall(r"[^\W\d_]{1,32}", (t or "").lower()):
        p = [ord(c) for c in f" {w} "]
        out += [(p[i] * 10_007 + p[i + 1] * 101 + p[i + 2]) % language.BUCKETS for i in range(len(p) - 2)]
    return out


def test_profiles_and_scores_against_plain_loops(spark):
    rnd = random.Random(3)
    words = {"de": ["schön", "und", "straße", "nicht"], "fr": ["été", "être", "le", "pas"], "en": ["the", "which", "and", "not"]}
    rows = [(lang, " ".join(rnd.choice(ws) for _ in range(rnd.randrange(1, 9)))) for lang, ws in words.items() for _ in range(20)] + [(None, "the"), ("en", None)]
    profiles = language.fit_profiles(spark.createDataFrame(rows, "lang string, text string"))
    want = {}
    for lang in sorted(words):
        n = {}
        for own, t in set(rows):
            if own == lang and t is not None:
                for k in slow_trigrams(t):
                    n[k] = n.get(k, 0) + 1
        total = sum(n.values())
        want[lang] = [round(math.log((n.get(k, 0) + 0.5) / (total + 0.5 * language.BUCKETS)) * 1000) for k in range(language.BUCKETS)]
    assert profiles == want
    texts = ["The straße", "été", "x1y2", "", None, "123 !!", "und the", "Z" * 5_000, "nicht être  pas", "\U0001f600 le"]
    got = {r.t: r.g for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", language.language_of(F.col("t"), profiles).alias("g")).collect()}
    for t in texts:
        ks = slow_trigrams(t)
        assert got[t] == (max(sorted(want), key=lambda x: sum(want[x][k] for k in ks)) if ks else ""), t


def test_sample_of_a_fit(spark, monkeypatch):
    """The same rows whether or not only small digests are ordered; copies count once and can't fill the sample."""
    rows = [("en", f"text number {i} " + "abcdefghij"[i % 10]) for i in range(400)] + [("de", "immer gleich")] * 300
    d = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(language, "SPARE", 1 << 20)
    want = language.fit_profiles(d, rows=40)
    monkeypatch.setattr(language, "SPARE", 4)
    assert language.fit_profiles(d, rows=40) == want
    monkeypatch.setattr(language, "SPARE", 0.5)  # too few: all are ordered
    assert language.fit_profiles(d, rows=40) == want
    assert set(language.fit_profiles(d)) == {"de", "en"}


def test_no_labels_and_ties(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert language.fit_profiles(none) == {}
    d = spark.createDataFrame([("b", "same"), ("a", "same")], "lang string, text string")
    assert d.limit(1).select(language.language_of(F.col("text"), {}).alias("g")).first().g == ""
    assert {r.g for r in d.select(language.language_of(F.col("text"), language.fit_profiles(d)).alias("g")).collect()} == {"a"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_held_out_accuracy_of_whole_and_short_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    profiles = language.fit_profiles(docs.filter(~apart))
    short = F.array_join(F.slice(F.split("text", r"\s+"), 4, 3), " ")
    by = lambda t: (language.language_of(t, profiles) == F.col("lang")).cast("int")
    plain = lambda t: (text.guess_language(t) == F.col("lang")).cast("int")
    r = docs.filter(apart).filter(F.size(F.split("text", r"\s+")) > 8).agg(F.avg(by(F.col("text"))).alias("whole"), F.avg(by(short)).alias("short"), F.avg(plain(F.col("text"))).alias("plain"), F.avg(plain(short)).alias("plain_short")).first()
    assert r.whole >= 0.98 and r.whole >= r.plain and r.short >= 0.85 and r.short > r.plain_short + 0.2
