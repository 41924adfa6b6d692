"""Defined cases of every operator and pipeline stage: nulls, empty and very long texts, ties, repeats, empty tables, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnscope.llm import common, decontaminate, embeddings, mixing, quality, queries, secrets, simhash, suffix, toxicity, urlfilter, warc

SMALL = "/root/testdata/sf0.001"
#: Columns under names that operators use themselves, one of them a map.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, quality_score double, _quality_score string, id string, fp long, component string, key string, score map<string,int>, raw binary, size long, target int, rate int, drawn int, _mix_rate int, _pipe_id int, node int, `a.b` int, `text.x` string, signature string, row int"
ROWS = [(1, None, "a"), (2, "", None), (None, "some words are here now", "a"), (3, "some words are here now", "b"), (3, "some words are here now", "b"), (4, " \t\n", "b"), (None, None, None)]


def wide(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 0.5, "x", "y", 1, "z", "k", {"a": 1, "b": None}, b"r", 1, 2, 3, 4, 5, 6, 7, 8, "d", "g", 9) for i, t, s in rows], EXTRA)


def long_text(n=5 << 20):
    """Lines of words that hardly repeat, with hits of every kind among them."""
    rnd = random.Random(1)
    out, size = [], 0
    while size < n:
        out.append(" ".join(rnd.choice(["vile", "token:", "\u00e9t\u00e9", "deadbeef" * 4, f"{rnd.getrandbits(40):x}", f"{rnd.getrandbits(40):x}", f"{rnd.getrandbits(40):x}"]) for _ in range(40)))
        size += len(out[-1]) + 1
    return "\n".join(out)


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, SMALL, "labels")


@pytest.fixture(scope="module")
def models(spark, labels):
    docs = common.table(spark, SMALL, "documents")
    return quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)


def operators(spark, models):
    """Each operator on documents, as a function of docs that gives a DataFrame."""
    items = common.table(spark, SMALL, "benchmark")
    return {
        "1": simhash.near_duplicates, "1, Jaccard": simhash.similar_documents, "2": suffix.remove_repeats,
        "3": lambda d: decontaminate.search(d, items), "3, drop": lambda d: decontaminate.drop_contaminated(d, items),
        "4": lambda d: toxicity.score_toxicity(d, models[1]), "4, passages": lambda d: toxicity.toxic_passages(d, models[1]),
        "5": lambda d: quality.score_quality(d, models[0]), "5, lines": lambda d: quality.label_lines(d, models[0]),
        "6": mixing.plan_mix, "6, emit": mixing.emit, "8": secrets.scan, "8, redact": secrets.redact,
    }


NAMES = ["1", "1, Jaccard", "2", "3", "3, drop", "4", "4, passages", "5", "5, lines", "6", "6, emit", "8", "8, redact"]
PER_ROW = {"1", "1, Jaccard", "2", "3, drop", "4", "5", "6", "8", "8, redact"}


@pytest.mark.parametrize("name", NAMES)
def test_documents_with_clashing_names(spark, models, name):
    op = operators(spark, models)[name]
    docs = wide(spark, ROWS)
    got = op(docs)
    rows = got.collect()
    if name in PER_ROW:
        assert len(rows) == len(ROWS)
    if name in ("3, drop", "6, emit", "8, redact"):
        assert got.columns == docs.columns
    assert op(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_a_very_long_text(spark, models, name):
    text = long_text()
    docs = wide(spark, [(1, text, "a"), (2, text, "a"), (3, "short", "b")])
    rows = operators(spark, models)[name](docs).collect()
    if name in PER_ROW:
        assert len(rows) == 3
    if name in ("1", "1, Jaccard"):
        assert {r.id: r.component for r in rows} == {1: 1, 2: 1, 3: 3}
    if name == "2":
        assert {r.id: r.n_bytes - len(r.kept) for r in rows}[2] == len(text.encode())
    if name == "6":
        assert {r.doc_id: r.size for r in rows} == {1: len(text.split()), 2: len(text.split()), 3: 1}


def test_repeats_and_ties_get_rows_of_their_own(spark, models):
    docs = wide(spark, [(5, "a tie of words here", "a")] * 4 + [(6, "a tie of words here", "a")] * 2)
    for name, op in operators(spark, models).items():
        if name in PER_ROW:
            assert op(docs).count() == 6, name
    assert {r.component for r in simhash.near_duplicates(docs).collect()} == {5}


def test_line_labels(spark, models):
    docs = wide(spark, [(1, "First line of prose, which goes on for a while and ends well.\n$$$ <<< !!! 000 ###\n", "a"), (2, None, "a")])
    got = quality.label_lines(docs, models[0]).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line_no) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert all(r.label == ("good" if r.good >= 0.5 else "bad") for r in got)
    x, size, per = quality.line_features([docs.first().text])
    assert [r.good for r in got[:3]] == pytest.approx(models[0].chain.marginals(x, per)[0].tolist())


def test_scores_by_plain_loops(spark, models):
    """Toxicity and quality of the query's documents, recomputed one by one from the fitted models."""
    docs = common.table(spark, SMALL, "documents").filter("length(text) < 3000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    q, t = models
    for r in toxicity.score_toxicity(docs, t).collect():
        words = toxicity.TOKEN.findall(texts[r.doc_id].lower())
        s = [t.terms.get(w) or t.terms.get(w[:5] + "*") or -t.gap for w in words]
        segments, at = [], 0

        def best(lo, hi):
            top, end = (0.0, lo, lo), lo
            total, start = 0.0, lo
            for k in range(lo, hi):
                if total <= 0:
                    total, start = 0.0, k
                total += s[k]
                if total > top[0] + 1e-12:
                    top = (total, start, k + 1)
            if top[0] > 0:
                best(lo, top[1])
                segments.append(top)
                best(top[2], hi)

        best(0, len(s))
        sums = [t.lam * x - np.log(t.k * max(len(s), 1)) for x, _, _ in segments]
        keep = [k for k, e in enumerate(sums) if e >= -np.log(toxicity.MAX_EXPECTED)]
        x = np.log1p(sum(sums[k] for k in keep)) * t.map[0] + sum(segments[k][2] - segments[k][1] for k in keep) / max(len(s), 1) * t.map[1] + t.map[2]
        assert r.score == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9), r.doc_id
    for r in quality.score_quality(docs.select("doc_id", "text"), q).collect():
        x, size, per = quality.line_features([texts[r.doc_id] or ""])
        w, move = q.chain.w, q.chain.move
        fwd = [np.array([0.0, x[0] @ w])]
        for row in x[1:]:
            fwd.append(np.array([np.logaddexp(fwd[-1][0] + move[0, b], fwd[-1][1] + move[1, b]) + (row @ w if b else 0.0) for b in (0, 1)]))
        back = [np.zeros(2)]
        for row in x[:0:-1]:
            back.append(np.array([np.logaddexp(move[a, 0] + back[-1][0], move[a, 1] + row @ w + back[-1][1]) for a in (0, 1)]))
        good = np.array([np.exp(f[1] + b[1] - np.logaddexp(*fwd[-1])) for f, b in zip(fwd, back[::-1])])
        mean = min(max(float((good * (size + 1)).sum() / (size + 1).sum()), 1e-4), 1 - 1e-4)
        e = np.log(mean / (1 - mean))
        assert r.quality_score == pytest.approx(1 / (1 + np.exp(-(e * q.map[0] + q.map[1]))), abs=1e-6), r.doc_id


def test_trees_judge_urls_that_no_rule_labels(spark):
    """Labels of the rules follow the words of the url here; held-out urls without a rule are judged by them."""
    rnd = random.Random(3)
    word = lambda k: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(k))
    bad = lambda tld: f"http://{word(2)}-{rnd.randrange(10**9)}-{rnd.randrange(10**9)}.{tld}/{word(1)}/?a={rnd.randrange(99)}&b=1&c={rnd.randrange(10**6)}"
    good = lambda tld: f"https://{word(3)}.{tld}/{word(2)}/{word(4)}"
    urls = [(bad("net"), None) for _ in range(300)] + [(good("org") .replace(".org/", ".org/fr/"), None) for _ in range(300)] + [(bad("info"), "block") for _ in range(200)] + [(good("info"), "allow") for _ in range(200)]
    d = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(d).collect()}
    asked = [i for i, (_, y) in enumerate(urls) if y]
    assert all(got[i].rule is None for i in asked)
    pos, neg = ([got[i].score for i in asked if urls[i][1] == y] for y in ("block", "allow"))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95


def test_urls_with_clashing_names_and_a_long_one(spark):
    rows = [(1, None), (1, "http://a.net/x"), (None, "http://a.org/fr/"), (2, "https://b.info/" + "x" * (1 << 20)), (2, "https://b.info/" + "x" * (1 << 20))]
    d = spark.createDataFrame([(i, u, "h", "p", "r", 1.0, "s", 0) for i, u in rows], "page_id long, url string, host string, path string, rule string, score double, suffix string, y int")
    assert urlfilter.judge(d).count() == 5 and urlfilter.judge(d.limit(0)).count() == 0


def test_vectors_with_clashing_names(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], 0, "n"), (1, [1.0, 0.0], 0, "n"), (None, [1.0, 0.01], 0, "n"), (4, None, 0, "n")], "vec_id long, embedding array<double>, node int, packed string")
    got = sorted((str(r.id), r.n_links, str(r.component), r.kept) for r in embeddings.near_duplicates(d).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("4", 0, "4", True), ("None", 2, "1", False)]


def test_as_of_with_clashing_names(spark):
    left = spark.createDataFrame([(1, "k", 5, "old", 1)], "id long, _asof_key string, _asof_ts long, original string, _asof_bucket int")
    right = spark.createDataFrame([("k", 3, "p", 1), ("k", 5, "q", 2), (None, 1, "r", 3)], "_asof_key string, _asof_ts long, original string, tie long")
    got = warc.as_of(left, right, "_asof_key", "_asof_ts", "original", "tie").collect()
    assert [r.asDict() for r in got] == [{"id": 1, "_asof_key": "k", "_asof_ts": 5, "_asof_bucket": 1, "original": "p"}]


@pytest.mark.parametrize("k", range(5))
def test_stages_of_the_pipeline(spark, k):
    import corpus_pipeline as p

    name, stage = p.STAGES[k]
    docs = wide(spark, ROWS)
    out = stage(spark, docs, SMALL)
    assert out.columns == docs.columns, name
    rows = out.collect()
    assert all(r.score == {"a": 1, "b": None} for r in rows)
    if name == "SimHash near-dedup":
        assert sorted((str(r.doc_id), str(r.text)) for r in rows) == [("1", "None"), ("3", "some words are here now")] or len(rows) >= 2
    if name in ("benchmark decontamination", "secret scans"):
        assert len(rows) == len(ROWS)
    assert stage(spark, docs.limit(0), SMALL).count() == 0
    text = long_text(1 << 20)
    more = stage(spark, wide(spark, [(1, text, "a"), (2, text, "a"), (2, text, "a")]), SMALL)
    assert more.columns == docs.columns and (name != "SimHash near-dedup" or more.count() == 1)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import pyarrow.parquet as pq

    import corpus_pipeline as p

    for t in ("documents", "labels", "benchmark"):
        pq.write_table(common.table(spark, SMALL, t).limit(0).toArrow(), tmp_path / f"{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_tables(spark, tmp_path, name):
    import pyarrow.parquet as pq

    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        pq.write_table(common.table(spark, SMALL, t).limit(0).toArrow(), tmp_path / f"{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())



def test_an_oversize_text_does_not_empty_the_fit(spark, labels):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    usable = labels.filter(~common.held_out(labels.doc_id)).select("doc_id").orderBy(F.xxhash64("doc_id")).first()[0]
    text = "line\n" * 1_100  # over a hundredth of the bound, first in hash order
    swapped = docs.withColumn("text", F.when(F.col("doc_id") == usable, text).otherwise(F.col("text")))
    model = quality.fit_quality(swapped, labels, lines=100_000)
    base = quality.fit_quality(docs, labels.filter(F.col("doc_id") != usable), lines=100_000)
    want = {r.doc_id: r.quality_score for r in quality.score_quality(docs, base).collect()}
    got = {r.doc_id: r.quality_score for r in quality.score_quality(docs, model).collect()}
    assert got == pytest.approx(want) and sum(s >= quality.CUT for s in got.values()) > 100
    with pytest.raises(ValueError, match="lines"):
        quality.fit_quality(docs.withColumn("text", F.lit("a\nb\nc\n")), labels, lines=200)


def test_pages_of_one_template_do_not_grow_together(spark):
    """Pairs at a Jaccard similarity of about 0.4 share band keys by chance; compared where they meet, none is a candidate."""
    rnd = random.Random(8)
    frame = [f"f{i}" for i in range(120)]
    rows = [(i, " ".join(frame + [f"w{rnd.getrandbits(40)}" for _ in range(80)])) for i in range(1_500)]
    near = rows[7][1].split()
    near[150] = "other"
    rows.append((9_999, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash._sketches(docs, "doc_id", "text", simhash.WORDS)
    shared = nodes.select(F.explode("keys").alias("k")).groupBy("k").count().filter("count > 1").agg(F.sum("count")).first()[0]
    assert shared > 1_000  # each joined its key's others before
    comps = simhash._candidates(nodes.select("node", F.col("id").alias("low"), "fp", "keys", "signature"))
    assert comps.groupBy("root").count().agg(F.max("count")).first()[0] == 2
    assert {r.id for r in simhash.similar_documents(docs).filter("component <> id").collect()} == {9_999}
