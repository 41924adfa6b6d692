"""Toxic passages by maximum-scoring segments.

Tokens score by their log-odds between toxic and other labelled documents (a text counts a token
once, and equal texts once, so that repetition proves nothing), with an informative Dirichlet
prior taken from both together; tokens whose z-score passes MIN_Z either way carry their own, positive or negative, and
all others, of which nothing is known, score a small negative constant. A word without a score of its own backs off to
that of its first letters (inflected words are rare one by one). The linear-time scan for all maximal scoring
subsequences (each candidate is passed over, merged or kept once) gives every passage of a document.
Extreme-value statistics calibrate the segments: for the background distribution of scores,
lambda solves sum p exp(lambda s) = 1, K is estimated from clean documents, and a segment of score
S in n tokens is expected K n exp(-lambda S) times by chance; segments expected at most once in
MAX_EXPECTED documents are significant. The evidence of all significant segments of a document,
sum of -log E, is mapped to a probability by a logistic fit.

Fitting reads at most FIT_ROWS labelled documents (whole texts), in hash order, never the held
out ones; tokens are counted on the executors. Scoring is one pass over all documents without a
shuffle, in slices of a few MB.

Defined cases: a text of any length is scanned whole, in time linear in its tokens. Null and empty texts hold no token and get the score of a document without a
segment. Repeated rows each get a row. Null labels and ids teach nothing; with no labels, or of one
kind, no token carries a score. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, logistic_fit, materialize, release, slices, table

FIT_ROWS = 16_000
CUT = 0.3
MIN_Z = 3.5
#: Strength of the prior, as a share of all counts.
PRIOR = 0.1
MAX_EXPECTED = 0.01
STEM = 5
#: Words whose scores a task remembers.
MEMO = 500_000
TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def stem(word: str) -> str:
    """Back-off token of a longer word: its first STEM letters and a star, which no word holds."""
    return word[:STEM] + "*" if len(word) > STEM else ""


def log_odds(counts: list[tuple[str, float, float]], toxic_total: float, clean_total: float) -> dict[str, float]:
    """Log-odds of tokens with a significant surplus in toxic or in clean texts; counts are (token, toxic, clean), in texts that hold it."""
    out = {}
    strength = PRIOR * (toxic_total + clean_total)
    for w, a, b in counts:
        prior = PRIOR * (a + b)
        x = math.log((a + prior) / (toxic_total + strength - a - prior)) - math.log((b + prior) / (clean_total + strength - b - prior))
        z = x / math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if abs(z) >= MIN_Z:
            out[w] = x
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences of token scores as (first, past the last, score).

    Only positive tokens are looked at one by one; what lies between them is in the running totals. Each candidate keeps the place of the
    nearest one before it whose left total is smaller, so a search jumps along these places: a candidate that
    was passed over is behind the new one's place from then on, or merged into it, and time is linear in the tokens.
    """
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.nonzero(scores > 0)[0]
    lefts, rights, firsts, ends, nearest = [], [], [], [], []  # totals left of and to the end of each candidate, its positions, the place of a smaller left total
    for first, left, total in zip(places.tolist(), totals[places].tolist(), totals[places + 1].tolist()):
        at = first + 1
        j = len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = nearest[j]
            if j < 0 or rights[j] >= total:
                break
            left, first = lefts[j], firsts[j]
            for column in (lefts, rights, firsts, ends):
                del column[j:]
            j = nearest[j]
            del nearest[len(lefts) :]
        lefts.append(left)
        rights.append(total)
        firsts.append(first)
        ends.append(at)
        nearest.append(j)
    return [(f, e, r - s) for f, e, r, s in zip(firsts, ends, rights, lefts)]


class _Scores(dict):
    """Scores of words as they come up, the back-off included."""

    def __init__(self, terms: dict[str, float], other: float):
        super().__init__()
        self.terms, self.other = terms, other

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO:
            self.clear()
        self[word] = out = self.terms.get(word) or self.terms.get(word[:STEM] + "*") or self.other
        return out


class ToxicityModel:
    """Scores by token, the calibration of segments and the map from evidence to probability."""

    def __init__(self, terms: dict[str, float], share: dict[str, float] | None = None):
        self.terms = terms
        share = share or {}
        mean = sum(self.terms[w] * p for w, p in share.items())
        #: Every other token scores so little that the background's mean is below zero.
        self.gap = max(0.05, 2 * mean)
        self.lam = self._lambda(share)
        self.k = 1.0
        self.memo = None
        self.map = np.array([0.0, 0.0, 0.0])

    def _lambda(self, share: dict[str, float]) -> float:
        rest = 1 - sum(share.values())

        def f(x):
            return sum(p * math.exp(x * self.terms[w]) for w, p in share.items()) + rest * math.exp(-x * self.gap) - 1

        low, high = 1e-3, 1e-3
        if not any(self.terms[w] > 0 and p > 0 for w, p in share.items()):
            return 1.0
        while f(high) < 0 and high < 50:
            low, high = high, high * 1.5
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        return (low + high) / 2

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """(maximal segments in tokens, number of tokens)."""
        words = tokens(text)
        if self.memo is None:
            self.memo = _Scores(self.terms, -self.gap)
        return maximal_segments(np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words))), len(words)

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def significant(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Segments with their -log E, of those expected at most MAX_EXPECTED times in such a text."""
        found, n = self.segments(text)
        out = []
        for a, b, s in found:
            e = self.lam * s - math.log(self.k * max(n, 1))
            if e >= -math.log(MAX_EXPECTED):
                out.append((a, b, e))
        return out, n

    def evidence(self, text: str | None) -> tuple[float, float]:
        """(log of 1 + the summed evidence, share of tokens in significant segments)."""
        sig, n = self.significant(text)
        return math.log1p(sum(e for _, _, e in sig)), sum(b - a for a, b, _ in sig) / max(n, 1)

    def scores(self, texts) -> np.ndarray:
        x = np.array([self.evidence(t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-(x @ self.map[:2] + self.map[2])))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> ToxicityModel:
    sample = materialize(labelled_sample(docs, labels, label, rows), "tox-sample")

    def count(batches):
        for b in batches:
            seen: dict[tuple[str, float], int] = {}
            for t, y in zip(b.column(1), b.column(2)):
                y = y.as_py()
                own = set(tokens(t.as_py()))
                for w in own | {x for x in map(stem, own) if x}:
                    seen[w, y] = seen.get((w, y), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([float(v) if k[1] else 0.0 for k, v in seen.items()], pa.float64()), pa.array([0.0 if k[1] else float(v) for k, v in seen.items()], pa.float64())], names=["w", "a", "b"])

    counts = materialize(sample.dropDuplicates(["text", "y"]).select("doc_id", "text", "y").mapInArrow(count, "w string, a double, b double").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "tox-counts")
    total = counts.agg(F.sum("a"), F.sum("b")).first()
    toxic, clean = total[0] or 0.0, total[1] or 0.0
    terms, share = {}, {}
    if toxic and clean:
        # the same test as in log_odds(), so that only tokens that pass it leave the executors; the bounded fit sample bounds them
        strength = PRIOR * (toxic + clean)
        prior = PRIOR * (F.col("a") + F.col("b"))
        x = F.log((F.col("a") + prior) / (toxic + strength - F.col("a") - prior)) - F.log((F.col("b") + prior) / (clean + strength - F.col("b") - prior))
        z = x / F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior))
        rows_ = counts.filter(F.abs(z) >= MIN_Z - 1e-6).orderBy("w").collect()
        terms = log_odds([(r["w"], r["a"], r["b"]) for r in rows_], toxic, clean)
        share = {r["w"]: (r["b"] + PRIOR * (r["a"] + r["b"])) / (clean + PRIOR * (toxic + clean)) for r in rows_ if r["w"] in terms}
    model = ToxicityModel(terms, share)

    def best(batches):
        for b in batches:
            got = [model.segments(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([max((s for _, _, s in g), default=0.0) for g, _ in got], pa.float64()), pa.array([float(n) for _, n in got], pa.float64())], names=["y", "s", "n"])

    tops = sample.mapInArrow(best, "y double, s double, n double")
    # K from clean documents: the expected number of segments of score S in n tokens is K n exp(-lambda S), and half of the clean documents that have a segment have a better one than their median
    clean_tops = [(r["s"], r["n"]) for r in tops.filter("y = 0 and n > 0").collect()]
    with_one = sorted(s for s, _ in clean_tops if s > 0)
    if with_one:
        s = with_one[len(with_one) // 2]
        over = sum(x >= s for x, _ in clean_tops)
        model.k = max(over, 1) / sum(n * math.exp(-model.lam * s) for _, n in clean_tops)

    def features(batches):
        for b in batches:
            x = np.array([model.evidence(t.as_py()) for t in b.column(1)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "e", "f"])

    got = sorted(sample.mapInArrow(features, "y double, e double, f double").collect())
    x = np.array([(r["e"], r["f"]) for r in got]).reshape(-1, 2)
    model.map = logistic_fit(x, np.array([r["y"] for r in got]))
    release(sample, counts)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of docs."""

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def toxic_passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, start, end, evidence, passage): every significant segment, positions in tokens of the whole text."""

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                ids, out = part.column(0).to_pylist(), []
                for i, t in zip(ids, part.column(1).to_pylist()):
                    found, _ = model.significant(t)
                    marks = [(m.start(), m.end()) for m in TOKEN.finditer((t or "").lower())] if found else []
                    out += [(i, a, e, x, (t or "").lower()[marks[a][0] : marks[e - 1][1]]) for a, e, x in found]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.column(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string())], names=["doc_id", "start", "end", "evidence", "passage"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, start long, end long, evidence double, passage string")


def op4_toxicity_segments(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
