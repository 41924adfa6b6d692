"""Document quality by a linear-chain conditional random field over lines.

Every line gets surface features (length, shares of upper case, symbols, digits, separators,
repeated words, whether it repeats an earlier line ...), with those of its two neighbours beside
its own. A two-state chain, good and bad, is trained on documents whose lines all take the
document's label; forward-backward gives each line's probability of being good, the mean of
which, weighted by line length, is the document's evidence. A logistic map learnt on the same
documents turns it into a probability.

Fitting reads at most FIT_ROWS labelled documents (whole texts) and, of these, as many in hash order as
FIT_LINES lines allow, so that what the driver holds is bounded; never the held out ones. Scoring is one pass over all documents without a shuffle; texts go through in slices
of a few MB, so that memory is bounded by the longest text.

Defined cases: a long text is scored whole, in memory linear in it. Null and empty texts are one empty line and get a score like any other. Repeated
rows each get a row. Labels without a document, null labels and null ids teach nothing; with no
labels, or labels of one kind, every score is near that kind's rate. Extra columns of any type and name are
kept; where quality_score is taken, the score's name has underscores in front. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, logistic_fit, materialize, packed, release, slices, table

FIT_ROWS, FIT_LINES = 4_000, 400_000
#: A text of more than this share of FIT_LINES isn't fitted on, so that none crowds out the others.
MOST_OF_FIT = 0.01
CUT = 0.7
STEPS, STEP_SIZE, RIDGE = 120, 0.15, 1e-3
#: Byte classes of the features, in order.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"#$%&*@^~", b"|<>{}[]\\=_", b"!", b".,;:?'\"()-")
OWN = 17


def _class_table() -> np.ndarray:
    of = np.full(256, len(CLASSES), dtype=np.uint8)  # the last class: bytes of other scripts and the rest
    for k, members in enumerate(CLASSES):
        of[list(members)] = k
    return of


OF = _class_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line with the neighbours', bytes by line, lines by text)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    lines = [d.split(b"\n") for d in data]
    per_doc = np.array([len(x) for x in lines], dtype=np.int64)
    flat = [x for doc in lines for x in doc]
    n = len(flat)
    size = np.fromiter(map(len, flat), dtype=np.int64, count=n)
    buf = np.frombuffer(b"\n".join(data), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    kinds = OF[buf] if len(buf) else np.zeros(1, np.uint8)
    counts = np.zeros((n, len(CLASSES) + 1))
    full = np.nonzero(size > 0)[0]
    if len(full):
        # a line's reduceat runs on to the next full line's start; newlines between are of the last class
        for k in range(len(CLASSES)):
            counts[full, k] = np.add.reduceat(kinds == k, starts[full], dtype=np.int32)
        counts[full, -1] = size[full] - counts[full, :-1].sum(axis=1)
    words = np.ones(n)
    fresh = np.ones(n)
    twice = np.zeros(n)
    i = 0
    for doc in lines:
        seen = set()
        for x in doc:
            w = x.split()
            if w:
                words[i] = len(w)
                fresh[i] = len(set(w)) / len(w)
            if len(x) > 20 and x in seen:
                twice[i] = 1
            seen.add(x)
            i += 1
    some = np.maximum(size, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    own = np.column_stack([
        np.log1p(size) / 5, counts[:, 0] / letters, counts[:, :] / some[:, None], np.minimum(size / words / 10, 3), fresh, twice,
        np.log1p(words) / 4, 1 - np.minimum(fresh * words, 20) / 20, counts[:, 4] > words / 2,
    ])
    doc = np.repeat(np.arange(len(texts)), per_doc)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    first = np.ones(n)
    first[1:] = doc[1:] != doc[:-1]
    return np.column_stack([own, before, after, first, np.ones(n)]), size, per_doc


class Chain:
    """The random field: scores of the good state by line, and of moves between states."""

    def __init__(self, width: int):
        self.w = np.zeros(width)
        self.move = np.zeros((2, 2))

    def marginals(self, x: np.ndarray, per_doc: np.ndarray):
        """(probability of good by line, expected moves summed over documents, log partition by document)."""
        node = np.column_stack([np.zeros(len(x)), x @ self.w])
        order = np.argsort(-per_doc, kind="stable")
        sizes = per_doc[order]
        at = (np.cumsum(per_doc) - per_doc)[order]
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        fwd, back = np.zeros_like(node), np.zeros_like(node)
        for t, k in enumerate(active):
            rows = at[:k] + t
            a = node[rows]
            if t:
                before = fwd[rows - 1]
                a = a + np.logaddexp(before[:, :1] + self.move[0], before[:, 1:] + self.move[1])
            fwd[rows] = a
        for t in range(len(active) - 2, -1, -1):
            rows = at[: active[t + 1]] + t
            nxt = node[rows + 1] + back[rows + 1]
            back[rows] = np.logaddexp(nxt[:, :1] + self.move[:, 0], nxt[:, 1:] + self.move[:, 1])
        ends = np.cumsum(per_doc) - 1
        z = np.logaddexp(fwd[ends, 0], fwd[ends, 1])
        zl = np.repeat(z, per_doc)
        good = np.exp(np.minimum(fwd[:, 1] + back[:, 1] - zl, 0.0))
        moves = np.zeros((2, 2))
        inner = np.ones(len(x), bool)
        inner[ends] = False
        rows = np.nonzero(inner)[0]
        for a in (0, 1):
            for b in (0, 1):
                moves[a, b] = np.exp(fwd[rows, a] + self.move[a, b] + node[rows + 1, b] + back[rows + 1, b] - zl[rows]).sum()
        return good, moves, z

    def fit(self, x, per_doc, y):
        """Adam on the regularised conditional likelihood; a document's lines share its weight of log2(1 + lines)."""
        line_y = np.repeat(y, per_doc)
        inner = np.maximum(per_doc - 1, 0)
        want = np.array([[(inner * (y == 0)).sum(), 0], [0, (inner * (y == 1)).sum()]], dtype=float)
        m = v = np.zeros(len(self.w) + 4)
        for step in range(1, STEPS + 1):
            good, moves, _ = self.marginals(x, per_doc)
            g = np.concatenate([x.T @ (line_y - good), (want - moves).ravel()]) / max(len(x), 1)
            g -= RIDGE * np.concatenate([self.w, self.move.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            d = STEP_SIZE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w, self.move = self.w + d[:-4], np.clip(self.move + d[-4:].reshape(2, 2), -4, 4)
        return self


class QualityModel:
    def __init__(self, chain: Chain, map_: np.ndarray):
        self.chain, self.map = chain, map_

    def evidence(self, x, size, per_doc) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, as log odds."""
        good, _, _ = self.chain.marginals(x, per_doc)
        weight = size + 1.0
        first = np.cumsum(per_doc) - per_doc
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        e = self.evidence(*line_features(texts))
        return 1 / (1 + np.exp(-(e * self.map[0] + self.map[1])))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, lines: int = FIT_LINES) -> QualityModel:
    """A model of at most `rows` labelled texts of at most `lines` lines together, in hash order.

    Texts of more than MOST_OF_FIT of those lines are left out. Without labels every text scores 0.5; labels whose texts are all left out are an error.
    """

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                x, size, per_doc = line_features([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum(per_doc)
                xs, ss = np.split(x.astype(np.float32), ends[:-1]), np.split(size, ends[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([a.tobytes() for a in xs], pa.binary()), pa.array([a.tobytes() for a in ss], pa.binary())], names=["doc_id", "y", "x", "size"])

    sample = labelled_sample(docs, labels, label, rows)
    sample = materialize(sample.withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))), F.lit(0)) + 1), "quality-sample")
    so_far = F.sum("n_lines").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    short = sample.filter(F.col("n_lines") <= max(1, int(MOST_OF_FIT * lines)))
    fits = short.select("doc_id", so_far.alias("lines")).filter(F.col("lines") <= lines).select("doc_id")  # FIT_ROWS rows of numbers at most
    picked = sample.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "y")
    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sorted(picked.mapInArrow(run, f"doc_id {kind}, y double, x binary, size binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    if not got and not sample.isEmpty():
        raise ValueError(f"every labelled text has more than {max(1, int(MOST_OF_FIT * lines))} lines: raise the bound of lines to fit on")
    release(sample)
    width = 3 * OWN + 2
    if not got:
        return QualityModel(Chain(width), np.array([0.0, 0.0]))
    size = [np.frombuffer(r["size"], np.int64) for r in got]
    per_doc = np.array([len(s) for s in size])
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in got]).astype(np.float64)
    y = np.array([r["y"] for r in got])
    model = QualityModel(Chain(width).fit(x, per_doc, y), np.array([1.0, 0.0]))
    model.map = logistic_fit(model.evidence(x, np.concatenate(size), per_doc)[:, None], y)
    return model


def score_name(names: list[str]) -> str:
    """quality_score, with underscores in front as long as docs has such a column."""
    name = "quality_score"
    while name.lower() in {c.lower() for c in names}:
        name = "_" + name
    return name


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with a last column quality_score (see score_name()); rows and other columns as they are."""
    name, whole = score_name(docs.columns), docs.select(packed(docs).alias("row"), F.col("text"))

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                s = model.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    out = whole.mapInArrow(run, T.StructType([whole.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.select("row.*", F.col("score").alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score reaches cut."""
    scored, name = score_quality(docs, fit_quality(docs, labels)), score_name(docs.columns)
    return scored.filter(F.col(f"`{name}`") >= cut).drop(name)


def label_lines(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, line_no from 0, good, label): every line's probability of being good, and its label, good or bad."""
    kept = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                x, _, per_doc = line_features([t or "" for t in part.column(1).to_pylist()])
                good = model.chain.marginals(x, per_doc)[0] if len(per_doc) else np.zeros(0)
                first = np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(per_doc)), per_doc)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(x)) - first, pa.int64()), pa.array(good, pa.float64()), pa.array(np.where(good >= 0.5, "good", "bad"), pa.string())], names=["doc_id", "line_no", "good", "label"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, line_no long, good double, label string")


def op5_quality_crf(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
