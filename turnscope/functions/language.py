"""Language of a text from profiles of letter trigrams, fitted on labelled texts.

A text's words, padded with blanks, are cut into trigrams; a trigram is a number below BUCKETS, from its code
points. A profile holds a smoothed log-probability for each number, in whole thousandths, so scores are exact
sums and ties are ties. Scoring is a sum of looked-up weights on the row, without a join or shuffle: words are
found by an expression, their weights are summed over Arrow batches, a text at a time.

Defined cases: null texts and texts without letters have no language (empty); ties go to the language first
in code order; of a word of more than WORD letters each stretch of WORD counts as a word, so time is linear in any text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, WORD = 8_192, 32
#: Labelled rows a fit reads at most, in the order of their texts' digests.
FIT_ROWS = 4_000
#: Rows of small digests that a fit looks through, as a multiple of those it wants.
SPARE = 8


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\p{{L}}{{1,{WORD}}}"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Numbers of all letter trigrams of text, repeats included, word by word."""
    points = F.transform(_words(text), lambda w: F.transform(F.split(F.concat(F.lit(" "), w, F.lit(" ")), ""), lambda c: F.ascii(c).cast("long")))
    number = lambda p, i: (F.get(p, i) * 10_007 + F.get(p, i + 1) * 101 + F.get(p, i + 2)) % BUCKETS
    return F.flatten(F.transform(points, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: number(p, i).cast("int"))))


def fit_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> dict[str, list[int]]:
    """Weights by language, from at most `rows` labelled rows; what reaches the driver is BUCKETS numbers a language.

    Trigrams never seen in a language count as half a time. Rows without text or language are passed over, repeated ones count once.
    Only rows of small digests are ordered; where these are too few, as among copies, all are.
    """
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    share = SPARE * rows / max(1, known.count())
    known = known.filter("text is not null").withColumn("digest", F.md5(F.col("text").cast("binary")))

    def first(some: DataFrame) -> DataFrame:
        return some.distinct().orderBy("digest", "lang").limit(rows)

    sample = first(known)
    if share < 1:
        few = known.filter(F.col("digest") < F.lit(f"{int(share * 2**32):08x}"))
        if first(few.select("digest", "lang")).count() == rows:
            sample = first(few)
    sample = sample.repartition("digest")
    counts = sample.select("lang", F.explode(trigrams(F.col("text"))).alias("k")).groupBy("lang", "k").agg(F.count("*").alias("n"))
    log = lambda n, total: F.round(F.log((n + 0.5) / (total + 0.5 * BUCKETS)) * 1000).cast("int")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.collect_list(F.struct("k", "n")).alias("seen"))
    weights = totals.select("lang", F.transform("seen", lambda s: F.struct(s["k"].alias("k"), log(s["n"], F.col("total")).alias("w"))).alias("seen"), log(F.lit(0), F.col("total")).alias("unseen"))
    out = {}
    for r in weights.collect():
        out[r["lang"]] = [r["unseen"]] * BUCKETS
        for k, w in r["seen"]:
            out[r["lang"]][k] = w
    return dict(sorted(out.items()))


def language_of(text: Column, profiles: dict[str, list[int]]) -> Column:
    """The language whose profile gives text's trigrams the greatest sum."""
    if not profiles:
        return F.lit("")
    names = np.array(["", *sorted(profiles)], dtype=object)
    weights = np.array([profiles[n] for n in names[1:]], np.int64)

    @F.pandas_udf(T.StringType())
    def best(joined: pd.Series) -> pd.Series:
        out = np.zeros(len(joined), np.int64)
        for i, t in enumerate(joined):
            if t:
                p = np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32).astype(np.int64)
                k = (p[:-2] * 10_007 + p[1:-1] * 101 + p[2:]) % BUCKETS
                times = np.bincount(k[p[1:-1] != 32], minlength=BUCKETS)  # a blank in the middle lies between words
                out[i] = 1 + (weights @ times).argmax()
        return pd.Series(names[out], dtype=object)

    return best(F.array_join(_words(text), " "))
