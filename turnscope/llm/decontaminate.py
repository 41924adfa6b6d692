"""Benchmark decontamination: a BM25 inverted index of test items searched with block-max WAND.

Terms are word three-grams of case-folded text, hashed words being too common to tell passages
apart. Items are the indexed documents: idf over all items, length-normalised term frequencies,
postings by item in blocks with their maximum impact. Impacts are divided by the item's score
against itself, so one threshold serves all items. Every document is cut into passages of
2 L words at every L words, L being the longest item, so each occurrence of an item lies whole in a
passage; each passage is a query, and WAND with block maxima returns all items at or above the
threshold, skipping the rest by upper bounds. Hits are verified on word five-grams: the share
of the question's (the item but for its last sentence) and of the answer's (its last sentence)
that the passage holds; an item of one sentence is both. A hit counts if the whole item reaches
MIN_OVERLAP (0.8), or the question does that has QUESTION_WORDS (8) words or more; an answer alone doesn't.
Such questions are entries of the index beside their items, so that WAND finds them whatever the
answer's length; the score is the item's where that reaches MIN_SCORE, else the question's.

The index goes to the executors by broadcast; its size is bounded, as items are dealt in order to shards of
at most SHARD_BYTES of text (a larger item has one of its own) and each shard is one pass. The corpus is never shuffled.

Defined cases: null and empty documents and items match nothing; texts of any length are searched whole, passage by
passage. Items shorter than three (five)
words are one term (one gram) of all their words, looked up like others in sorted tables. Equal items are reported each; equal documents
each get their rows; ids may be null and stay so. Extra columns are ignored by search() and kept
by drop_contaminated(). Without items, or without documents, the result is empty.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, packed, release, slices, table

TERM, GRAM = 3, 5
MIN_SCORE, MIN_OVERLAP = 0.5, 0.8
#: A question of fewer words is too common to be a leak alone.
QUESTION_WORDS = 8
K1, B = 1.2, 0.75
BLOCK = 64
SHARD_BYTES = 8 << 20


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def grams(words: list[str], n: int) -> list[tuple[str, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] or [tuple(words)]


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence, and of the last one; the same if there is one only."""
    words = words_of(text)
    ends = [i for i, w in enumerate(words[:-1]) if w[-1] in ".?!:"]
    return (words[: ends[-1] + 1], words[ends[-1] + 1 :]) if ends else (words, words)


class Short(dict):
    """The n-grams of a passage by n, made when first asked for."""

    def __init__(self, words: list[str]):
        super().__init__()
        self.words = words

    def __missing__(self, n: int) -> set[tuple[str, ...]]:
        self[n] = {tuple(self.words[i : i + n]) for i in range(len(self.words) - n + 1)}
        return self[n]


class ItemIndex:
    """Inverted index of items: per term, postings by item with block maxima of normalised impacts."""

    def __init__(self, items: list[tuple[object, str]], df: dict | None = None, n_items: int | None = None, mean_length: float | None = None):
        self.items = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if w]
        self.parts = [question_answer(" ".join(w)) for _, w in self.items]
        counts = [Counter(grams(w, TERM)) for _, w in self.items]
        n = n_items if n_items is not None else len(counts)
        if df is None:
            df = Counter(t for c in counts for t in c)
        mean = mean_length or (sum(sum(c.values()) for c in counts) / max(len(counts), 1)) or 1.0
        self.longest = max((len(w) for _, w in self.items), default=1)
        #: word numbers; 0 is any other word
        self.word = {w: k for k, w in enumerate(sorted({x for _, ws in self.items for x in ws}), 1)}
        #: entries of the index: whole items by their number, then long questions
        self.asks = [len(q) >= QUESTION_WORDS and len(q) < len(w) for (_, w), (q, _) in zip(self.items, self.parts)]
        self.entry = [*range(len(self.items)), *(d for d, ask in enumerate(self.asks) if ask)]
        counts += [Counter(grams(q, TERM)) for (q, _), ask in zip(self.parts, self.asks) if ask]
        impact = []
        for c in counts:
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            one = {t: math.log(1 + (n - df.get(t, 1) + 0.5) / (df.get(t, 1) + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(one.values())
            impact.append({t: v / own for t, v in one.items()})
        posts: dict = {}
        for d, one in enumerate(impact):
            for t, v in one.items():
                posts.setdefault(t, []).append((d, v))
        self.terms = sorted(posts)
        self.number = {t: k for k, t in enumerate(self.terms)}
        self.docs = [[d for d, _ in posts[t]] for t in self.terms]
        self.impacts = [[v for _, v in posts[t]] for t in self.terms]
        self.top = [max(v) for v in self.impacts]
        #: (last item of the block, largest impact in it)
        self.blocks = [[(d[min(i + BLOCK, len(d)) - 1], max(v[i : i + BLOCK])) for i in range(0, len(d), BLOCK)] for d, v in zip(self.docs, self.impacts)]
        self.gram_sets = [(frozenset(grams(w, GRAM)), frozenset(grams(q, GRAM)), frozenset(grams(a, GRAM))) for (_, w), (q, a) in zip(self.items, self.parts)]
        self._keys()

    def _keys(self):
        """Terms as sorted integers by length: numbers of words, of (pair of words), of (pair, word), so that any number of words fits."""
        self.base = len(self.word) + 1
        numbered = [(tuple(self.word[w] for w in t), k) for t, k in self.number.items()]
        self.pairs = np.unique(np.array([t[0] * self.base + t[1] for t, _ in numbered if len(t) > 1], dtype=np.int64))
        self.tables = []
        for size in (1, 2, 3):
            own = [(t, k) for t, k in numbered if len(t) == size]
            head = np.array([t[0] for t, _ in own], dtype=np.int64)
            if size > 1:
                head = np.searchsorted(self.pairs, head * self.base + np.array([t[1] for t, _ in own], dtype=np.int64))
            key = head * self.base + np.array([t[2] for t, _ in own], dtype=np.int64) if size == 3 else head
            order = np.argsort(key)
            self.tables.append((key[order], np.array([k for _, k in own], dtype=np.int64)[order]))

    @staticmethod
    def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in wanted that keys hold, places in keys)."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        ok = np.nonzero(keys[k] == wanted)[0]
        return ok, k[ok]

    def term_hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(positions, terms) of the index terms in a document."""
        get = self.word.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        one, two, three = self.tables
        at, k = self._look_up(one[0], ids)
        found = [(at, one[1][k])]
        start = np.nonzero((ids[:-1] > 0) & (ids[1:] > 0))[0]
        ok, pair = self._look_up(self.pairs, ids[start] * self.base + ids[start + 1])
        start = start[ok]
        ok, k = self._look_up(two[0], pair)
        found.append((start[ok], two[1][k]))
        ends = np.append(ids, 0)[start + 2]
        known = ends > 0
        start, pair = start[known], pair[known]
        ok, k = self._look_up(three[0], pair * self.base + ends[known])
        found.append((start[ok], three[1][k]))
        at, terms = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(at, kind="stable")
        return at[order], terms[order]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose normalised score reaches threshold, by block-max WAND."""
        lists = [[self.docs[t], self.impacts[t], self.top[t], self.blocks[t], 0, 0] for t in set(terms)]
        eps, found = 1e-9, []
        while True:
            lists = [x for x in lists if x[4] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[2]
                if bound >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == doc:
                pivot += 1
            bound, until = 0.0, None
            for x in lists[: pivot + 1]:
                b = x[5]
                while b < len(x[3]) and x[3][b][0] < doc:
                    b += 1
                x[5] = b
                if b < len(x[3]):
                    bound += x[3][b][1]
                    until = x[3][b][0] if until is None else min(until, x[3][b][0])
            if bound < threshold - eps:  # no item up to the end of the nearest block can reach it
                to = until + 1 if until is not None else doc + 1
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0][lists[pivot + 1][4]])
                to = max(to, doc + 1)
                for x in lists[: pivot + 1]:
                    x[4] = bisect_left(x[0], to, x[4])
                continue
            if lists[0][0][lists[0][4]] == doc:
                score = 0.0
                for x in lists[: pivot + 1]:
                    if x[4] < len(x[0]) and x[0][x[4]] == doc:
                        score += x[1][x[4]]
                        x[4] += 1
                if score >= threshold - eps:
                    found.append((doc, score))
            else:
                for x in lists[: pivot + 1]:
                    x[4] = bisect_left(x[0], doc, x[4])

    def matches(self, text: str | None) -> list[tuple[object, float, float, float, float]]:
        """(item id, score, whole, question and answer overlap): the best passage of each verified item."""
        words = words_of(text)
        if not words or not self.items:
            return []
        at, terms = self.term_hits(words)
        if not len(at):
            return []
        step = self.longest
        best: dict[int, tuple] = {}
        rank: dict[int, tuple] = {}
        last = max(0, -(-len(words) // step) - 2)
        lows = {min(max(int(p) // step - back, 0), last) for p in at for back in (0, 1)}
        for k in sorted(lows):
            start, end = k * step, k * step + 2 * step
            lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
            if lo == hi:
                continue
            passage = None
            for e, score in self.search(terms[lo:hi].tolist(), MIN_SCORE):
                d = self.entry[e]
                if passage is None:
                    passage = set(grams(words[start:end], GRAM))
                    short = Short(words[start:end])
                over = tuple(self._share(g, passage, short) for g in self.gram_sets[d])
                if (over[0] >= MIN_OVERLAP or self.asks[d] and over[1] >= MIN_OVERLAP) and (d not in best or (over[0], e == d, score) > rank[d]):
                    best[d], rank[d] = (score, *over), (over[0], e == d, score)
        return [(self.items[d][0], *v) for d, v in sorted(best.items())]

    @staticmethod
    def _share(wanted: frozenset, passage: set, short: Short) -> float:
        hit = sum(g in (passage if len(g) == GRAM else short[len(g)]) for g in wanted)
        return hit / len(wanted) if wanted else 0.0


def shards(items: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> Iterator[ItemIndex]:
    """Indexes of bounded size over all items, one at a time; idf and mean length come from all of them."""
    kept = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    in_order = lambda rows: sorted(((r["id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    if size <= shard_bytes:
        yield ItemIndex(in_order(kept.collect()))
        return
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    ws = kept.select("id", "text", words.alias("w")).filter(F.size("w") > 0)
    three = ws.select("id", "text", F.when(F.size("w") < TERM, F.array(F.concat_ws(" ", "w"))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - TERM + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("w", i, TERM)))).alias("g"))
    whole = three.agg(F.count("*").alias("n"), F.avg(F.size("g")).alias("mean")).first()
    df = materialize(three.select(F.explode(F.array_distinct("g")).alias("g")).groupBy("g").agg(F.count("*").alias("df")), "items-df")
    # items are dealt to shards of half the bytes by hash; what a shard then holds too much is cut by its running sum
    n = -(-2 * size // shard_bytes)
    dealt = three.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    before = W.partitionBy("shard").orderBy(F.xxhash64("text"), "id").rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.withColumn("part", F.floor(F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)) / F.lit(shard_bytes)))
    dealt = materialize(dealt, "items-dealt")
    for r in dealt.select("shard", "part").distinct().orderBy("shard", "part").collect():
        own = dealt.filter((F.col("shard") == r["shard"]) & (F.col("part") == r["part"]))
        dfs = own.select(F.explode("g").alias("g")).distinct().join(df, "g").collect()
        yield ItemIndex(in_order(own.select("id", "text").collect()), {tuple(r["g"].split(" ")): r["df"] for r in dfs}, whole["n"], whole["mean"])
    release(df, dealt)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, score, overlap, question_overlap, answer_overlap): the verified items of every row of docs."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = kept.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = None
    for index in shards(items, item_id, item_text):
        box = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, box=box):
            index = box.value
            for b in batches:
                for part in slices(b, 1):
                    rows = [(i, *m) for i, t in zip(part.column(0).to_pylist(), part.column(1)) for m in index.matches(t.as_py())]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("id", to_arrow_type(kept.schema["id"].dataType)), ("item", to_arrow_type(items.schema[item_id].dataType)), *[(c, pa.float64()) for c in ("score", "overlap", "question_overlap", "answer_overlap")]])
        got = kept.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, score double, overlap double, question_overlap double, answer_overlap double")
        out = got if out is None else out.unionByName(got)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item; decided row by row, columns unchanged. Each shard of items after the first reads what the one before kept."""
    out = docs.select(packed(docs).alias("row"), F.col("text"))
    shape = out.schema
    for k, index in enumerate(shards(items, "item_id", "text")):
        if k:  # an executor holds one index at a time
            before, out = out, materialize(out, "clean")
            release(before)
        box = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, box=box):
            for b in batches:
                for part in slices(b, 1):
                    clean = [not box.value.matches(t.as_py()) for t in part.column(1)]
                    yield part.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, shape)
    return out.select("row.*")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id and item_id of every verified overlap, with its score and shares."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "overlap", "question_overlap", "answer_overlap")
