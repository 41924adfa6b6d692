"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's;
the longest fitting rule decides. Urls that a rule decides are the labelled urls: the trees are
fitted on a bounded, hash-ordered sample of distinct labelled urls (FIT_URLS) and judge the
urls that no rule fits. Suffix statistics (how often labelled hosts under a suffix are blocked)
are counted over all labelled urls, every key of them; they are read from host suffixes below the rules' own, so
that they say something about urls without a rule.

The table of these rates is broadcast while its keys take at most BROADCAST_BYTES, and all else after
fitting is one pass; beyond that the pages are joined to it by key, in a join whose hot partitions
adaptive execution can split. Features are taken from whole columns of urls at once, of any length. Defined cases: a null url or one without '://' has empty host and path,
no rule, and the trees' verdict on an empty url. Hosts are lower-cased A-Z only and keep port
and user. Repeated rows each get a row. Extra columns are ignored. Without any labelled url the
trees say 'allow'. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FIT_URLS = 20_000
#: Smoothed rates by key are broadcast up to this many bytes of keys, joined by key beyond.
BROADCAST_BYTES = 4 << 20
#: Rows' worth of the mean that a key's rate starts from.
SMOOTH = 5
ROUNDS, DEPTH, RATE, BINS, LEAST, SHRINK = 40, 3, 0.3, 32, 10, 1.0
#: A url is blocked from this probability on.
CUT = 0.5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "fragment", "https", "vowel_ratio", "longest_label", "suffix_rate", "first_segment_rate")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    out_rule, out_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out_rule = F.when(fits, F.lit(h + p)).otherwise(out_rule)
        out_verdict = F.when(fits, F.lit(verdict)).otherwise(out_verdict)
    return out_rule, out_verdict


def suffix_of(host: Column) -> Column:
    """The registered part below the top-level label: 'a.b.example.com' gives 'b.example'."""
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) >= 3, F.concat_ws(".", F.element_at(parts, -3), F.element_at(parts, -2))).otherwise(host)


def first_segment(path: Column) -> Column:
    return F.regexp_extract(path, r"^/([^/]*)", 1)


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code point, row) of every character, and lengths by row."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.repeat(np.arange(len(texts)), sizes), sizes


def lexical(urls, hosts, paths, suffix_rates, segment_rates) -> np.ndarray:
    """FEATURES of every url, one row each, from whole columns at once. Letters are a-z and what isn't ASCII, digits 0-9."""
    urls = ["" if u is None else u for u in urls]
    n = len(urls)
    if not n:
        return np.zeros((0, len(FEATURES)))
    u, row, size = _characters(urls)
    h, hrow, hsize = _characters(list(hosts))
    p, prow, psize = _characters(list(paths))
    per = lambda mask, at: np.bincount(at[mask], minlength=n).astype(np.float64)
    ratio = lambda x, y: np.divide(x, y, out=np.zeros(n), where=y > 0)
    begins = lambda at: np.append(True, at[1:] != at[:-1])[: len(at)]
    # segments of the path begin at a character other than a slash, after a slash or at the start
    solid = p != ord("/")
    depth = per(solid & (begins(prow) | np.append(True, ~solid[:-1])[: len(p)]), prow)
    # the query runs from the first question mark to the next fragment
    within = lambda mask: np.cumsum(mask) - np.append(0, np.cumsum(mask))[np.cumsum(size) - size][row]
    marks = within(u == ord("?")) - (u == ord("?"))
    query = (marks > 0) & (within((u == ord("#")) & (marks > 0)) == 0)
    solid = query & (u != ord("&")) & (u != ord(";"))
    params = per(solid & ~np.append(False, solid[:-1] & ~begins(row)[1:])[: len(u)], row)
    kinds, counts = np.unique(row << 21 | u, return_counts=True)
    share = counts / size[kinds >> 21]
    entropy = -np.bincount(kinds >> 21, share * np.log2(share), minlength=n)
    dots = h == ord(".")
    label = np.cumsum(dots) + hrow
    labels = per(dots, hrow) + 1
    first = np.append(0, np.cumsum(labels)[:-1]).astype(np.int64)
    longest = np.maximum.reduceat(np.bincount(label[~dots], minlength=int(labels.sum())), first)
    letters = ((h >= ord("a")) & (h <= ord("z"))) | (h > 127)
    vowels = np.isin(h, [ord(c) for c in "aeiou"])
    return np.column_stack([
        size, hsize, psize, depth, labels, ratio(per((u >= ord("0")) & (u <= ord("9")), row), size), per(u == ord("-"), row), np.abs(entropy), params, per(u == ord("#"), row) > 0,
        [x[:6].lower() == "https:" for x in urls], ratio(per(vowels, hrow), per(letters, hrow)), longest, suffix_rates, segment_rates,
    ]).astype(np.float64)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, with histogram splits."""

    def __init__(self, base=0.0, trees=()):
        self.base, self.trees = base, list(trees)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        if not len(y) or y.min() == y.max():
            return cls(math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -1.0)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        self = cls(math.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = cls._tree(binned, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            f += leaf
        return self

    @staticmethod
    def _tree(binned, cuts, g, h):
        nodes: list[tuple] = []
        out = np.zeros(len(g))

        def grow(rows, depth):
            at = len(nodes)
            nodes.append(())
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-9, -1, 0)
            if depth < DEPTH and len(rows) >= 2 * LEAST:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + SHRINK) + (gs - gl) ** 2 / (hs - hl + SHRINK) - gs**2 / (hs + SHRINK)
                    gain = np.where((nl >= LEAST) & (len(rows) - nl >= LEAST), gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] < 0:
                v = -RATE * gs / (hs + SHRINK)
                nodes[at] = (-1, 0.0, 0, 0, v)
                out[rows] = v
                return at
            _, j, k = best
            left = binned[rows, j] <= k
            nodes[at] = (j, float(cuts[j][k]), grow(rows[left], depth + 1), grow(rows[~left], depth + 1), 0.0)
            return at

        grow(np.arange(len(g)), 0)
        return nodes, out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for nodes in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            feature, cut, left, right, value = (np.array(c) for c in zip(*nodes))
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            f += value[at]
        return 1 / (1 + np.exp(-f))


def _rates(labelled: DataFrame, key: str, name: str, mean: float) -> tuple[DataFrame, bool]:
    """(stored table: key, smoothed share of blocked rows of every key, over all labelled rows; whether its keys are few enough to broadcast)."""
    counts = labelled.groupBy(key).agg(F.count("*").alias("n"), F.sum("y").alias("blocked"))
    rates = materialize(counts.select(key, ((F.col("blocked") + SMOOTH * mean) / (F.col("n") + SMOOTH)).alias(name)), "url-rates")
    size = rates.agg(F.sum(F.octet_length(key) + 16)).first()[0] or 0
    return rates, size <= BROADCAST_BYTES


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, fit_urls: int = FIT_URLS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the trees' probability of a block, for every url."""
    host, path = host_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), verdict.alias("ruled"), suffix_of(F.col("host")).alias("suffix"), first_segment(F.col("path")).alias("segment"))
    labelled = p.filter("ruled is not null").withColumn("y", (F.col("ruled") == "block").cast("double"))
    mean = labelled.agg(F.avg("y")).first()[0] or 0.0
    keyed = [(key, name, *_rates(labelled, key, name, mean)) for key, name in (("suffix", "suffix_rate"), ("segment", "segment_rate"))]

    def rated(rows: DataFrame) -> DataFrame:
        for key, name, rates, small in keyed:
            rows = rows.join(F.broadcast(rates) if small else rates, key, "left").withColumn(name, F.coalesce(name, F.lit(mean)))
        return rows

    def features(pdf) -> np.ndarray:
        return lexical(pdf["url"], pdf["host"], pdf["path"], pdf["suffix_rate"], pdf["segment_rate"])

    sample = labelled.select("url", "host", "path", "suffix", "segment", "y").distinct().orderBy(F.xxhash64("url"), "url").limit(fit_urls)
    fit = rated(sample).toPandas().sort_values("url", kind="stable")
    model = Boosted.fit(features(fit), fit["y"].to_numpy())

    def run(batches):
        for b in batches:
            score = model.score(features(b.select(["url", "host", "path", "suffix_rate", "segment_rate"]).to_pandas()))
            verdict = pc.coalesce(b.column("ruled"), pa.array(np.where(score >= CUT, "block", "allow")))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), verdict, pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = p.schema["page_id"].dataType.simpleString()
    return rated(p).select("page_id", "url", "host", "path", "rule", "ruled", "suffix_rate", "segment_rate").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of every page."""
    return judge(table(spark, sf_dir, "pages"))
