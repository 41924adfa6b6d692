"""Hand-made rows on which near definitions of a measure differ, and the hooks for models and the network."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnscope.functions import hooks, stats, urls
from turnscope.operators import formulation, grounding, replay

SOURCES = "platform string, month string, conv_id string, turn_id long, kind string, url string, domain string, pos long"


def sources(spark, rows):
    return spark.createDataFrame([("p", "2024-01-01", c, t, k, u, d, i) for i, (c, t, k, u, d) in enumerate(rows)], SOURCES)


def test_provenance_shares_are_of_the_union(spark):
    """A token as prompt and as parametric in one turn counts once in what the shares are of."""
    rows = [("c", 1, "t", "prompt"), ("c", 1, "t", "parametric"), ("c", 1, "u", "source"), ("c", 1, "u", "source")]
    got = formulation.provenance_rates(spark.createDataFrame(rows, "conv string, turn int, token string, origin string"), ["conv"], ["turn"]).first()
    assert (got.turns, got.context, got.own, got.source_share) == (1, 0.5, 0.5, 0.5)


def test_citation_and_grounding_rates(spark):
    s = sources(spark, [
        ("c", 1, "retrieved", "https://a.com/1", "a.com"), ("c", 1, "retrieved", "https://b.com/1", "b.com"), ("c", 1, "cited", "https://a.com/9", "a.com"), ("c", 1, "cited", "https://x.com", "x.com"), ("c", 1, "cited", "https://y.com", "y.com"),
        ("c", 2, "cited", "https://b.com/2", "b.com"), ("c", 3, "retrieved", "https://q.com", "q.com"),
    ])
    turn, conv = (grounding.mean_of_ratios(s, ["month"], level).first() for level in ("turn", "conversation"))
    assert (turn.turns, turn.retrieved, turn.cited, turn.cited_retrieved) == (3, 3, 4, 1)
    assert turn.citation_rate == pytest.approx((1 / 2) / 3) and turn.grounding_rate == pytest.approx((1 / 3) / 3)  # not cited per retrieved: (3 / 2) / 3
    assert conv.cited_retrieved == 2 and conv.grounding_rate == pytest.approx((1 / 3 + 1) / 3)


def test_sources_meet_by_folded_domains_and_blank_ones_dont_count(spark):
    s = sources(spark, [("c", 1, "retrieved", "https://EN.Wikipedia.org/wiki/A", "EN.Wikipedia.org"), ("c", 1, "cited", "https://de.wikipedia.org/wiki/B?utm_source=openai", "de.wikipedia.org"), ("c", 1, "cited", "", ""), ("c", 1, "cited", None, None), ("c", 1, "cited", "https://WWW.b.com./", "WWW.b.com."), ("c", 1, "retrieved", "https://b.com/x", "b.com")])
    m = grounding.matchable(s)
    assert sorted(r.domain for r in m.collect()) == ["b.com", "b.com", "wikipedia.org", "wikipedia.org"]
    r = grounding.grounding_rates(m, ["platform"]).first()
    assert (r.cited, r.external, r.internal) == (2, 2, 0)
    top = {(x.kind, x.domain): x.n for x in grounding.top_domains(s, 5).collect()}
    assert top == {("cited", "wikipedia.org"): 1, ("cited", "b.com"): 1, ("retrieved", "wikipedia.org"): 1, ("retrieved", "b.com"): 1}


TEXT = "Alpha is the first letter. Beta is the second letter. [a](https://a.com/?utm_source=openai) [b](https://b.com/) Gamma comes third. [c](https://c.com) And the tail has none."


@pytest.mark.parametrize(("mode", "want"), [
    ("all", [("Alpha is the first letter.", ["https://a.com/?utm_source=openai"[:13]]), ("Beta is the second letter.", ["https://a.com", "https://b.com"]), ("Gamma comes third.", ["https://c.com"]), ("And the tail has none.", [])]),
    ("latest", [("Beta is the second letter.", ["https://a.com", "https://b.com"]), ("Gamma comes third.", ["https://c.com"]), ("And the tail has none.", [])]),
])
def test_links_belong_to_the_claims_before_them(spark, mode, want):
    """A second link without a claim of its own adds to the last claim, not to all before."""
    d = spark.createDataFrame([(1, TEXT), (2, "[x](https://x.com) "), (3, None), (4, "No link here at all. The second one."), (5, "Same words here. Same words here. [z](https://z.com)"), (6, "Claim with a\nbreak in it [not\na link](https://n.com) done.")], "id int, t string")
    rows = replay.link_claims(d, ["id"], "t", mode).orderBy("id", "claim_idx").collect()
    assert [(r.claim, r.urls) for r in rows if r.id == 1] == want
    texts = {r.id: r.t for r in d.collect()}
    assert all(texts[r.id][r.start : r.end] == r.claim for r in rows if r.start is not None) and [r.claim_idx for r in rows if r.id == 1] == list(range(len(want)))
    assert [r.claim for r in rows if r.id == 4] == ["No link here at all.", "The second one."]
    again = [r.start for r in rows if r.id == 5]
    assert again == ([0, 17] if mode == "all" else [17]) and all(r.urls == [] for r in rows if r.id == 6) and not [r for r in rows if r.id == 3]


def test_blocks_become_linked_text(spark):
    d = spark.createDataFrame([(1, [("One claim is here.", [("https://a.com/",), ("",)]), ("", []), (" Another claim follows.", None)])], "id int, b array<struct<text:string,citations:array<struct<url:string>>>>")
    t = d.select("id", replay.linked_text(F.col("b")).alias("t"))
    assert t.first().t == "One claim is here. [Cited](https://a.com) Another claim follows."
    assert [(r.claim, r.urls) for r in replay.link_claims(t, ["id"], "t").orderBy("claim_idx").collect()] == [("One claim is here.", ["https://a.com"]), ("Another claim follows.", [])]


def test_group_intervals_draw_responses_once(spark):
    """The same responses are drawn for all groups, as a plain loop over concatenated responses does."""
    rnd = np.random.default_rng(1)
    rows = [("p", int(r), "ab"[int(g)], float(s)) for r, g, s in zip(rnd.integers(0, 12, 80), rnd.integers(0, 2, 80), rnd.integers(1, 6, 80))]
    d = spark.createDataFrame(rows, "platform string, response int, grp string, score double")
    pdf = pd.DataFrame(rows, columns=["platform", "response", "grp", "score"])
    keys = sorted(pdf.response.unique())
    means, shares, rng = [], [], np.random.default_rng(42)
    for _ in range(100):
        boot = pd.concat([pdf[pdf.response == keys[i]] for i in rng.integers(0, len(keys), size=len(keys))])
        means.append([boot[boot.grp == g].score.mean() for g in "ab"])
        shares.append([(boot.grp == g).mean() for g in "ab"])
    for value, plain in (("score", means), (None, shares)):
        got = {r.grp: r for r in stats.exact_group_ci(d, ["platform"], ["response"], "grp", ["a", "b"], value, n_bootstrap=100).collect()}
        for k, g in enumerate("ab"):
            low, high = np.percentile([m[k] for m in plain], [2.5, 97.5])
            assert (got[g].ci_low, got[g].ci_high) == pytest.approx((low, high)) and got[g].n_responses == len(keys)
        wide = {r.grp: r for r in stats.poisson_group_ci(d, ["platform"], ["response"], "grp", ["a", "b"], value, replicates=400).collect()}
        for g in "ab":
            assert wide[g].estimate == pytest.approx(got[g].estimate) and wide[g].n == got[g].n
            assert abs(wide[g].ci_low - got[g].ci_low) < 0.5 and wide[g].ci_low <= wide[g].estimate <= wide[g].ci_high


@pytest.mark.parametrize("dealt", [{}, {"chunk": 7, "stretch": 1, "ranges": 3}, {"chunk": 5, "stretch": 700, "ranges": 500}])
def test_group_intervals_however_dealt(spark, dealt):
    """Draws are numpy's to the last bit when no task holds a group's responses whole; keys of two columns, nulls last, a group without claims."""
    rnd = np.random.default_rng(2)
    rows = [("pq"[int(x > 1)], None if r == 3 else int(r), int(t), "ab"[int(g)]) for x, r, t, g in zip(rnd.integers(0, 6, 400), rnd.integers(0, 9, 400), rnd.integers(0, 11, 400), rnd.integers(0, 2, 400))]
    d = spark.createDataFrame(rows, "platform string, conv int, turn int, grp string").repartition(5)
    got = {(r.platform, r.grp): r for r in stats.exact_group_ci(d, ["platform"], ["conv", "turn"], "grp", ["a", "b", "c"], n_bootstrap=40, **dealt).collect()}
    assert len(got) == 6
    for p in "pq":
        counts = {}
        for x, r, t, g in rows:
            if x == p:
                counts.setdefault((99 if r is None else r, t), np.zeros(3))["abc".index(g)] += 1
        v, rng = np.array([counts[k] for k in sorted(counts)]), np.random.default_rng(42)
        shares = np.array([v[i].sum(axis=0) / v[i].sum() for i in (rng.integers(0, len(v), size=len(v)) for _ in range(40))])
        for k, g in enumerate("abc"):
            r = got[p, g]
            assert (r.n, r.n_responses, r.estimate) == (v[:, k].sum(), len(v), v[:, k].sum() / v.sum())
            assert (r.ci_low, r.ci_high) == tuple(np.quantile(shares[:, k], [0.025, 0.975]))


def test_ranges_of_replicates_continue_the_generator():
    from turnscope.functions import seeded

    n, rng = 2 * seeded.DRAWS + 12_345, np.random.default_rng(7)
    numbers, vectors = (np.arange(n) % 5).astype(np.uint8), np.arange(10.0).reshape(5, 2)
    want = [(np.bincount(numbers[i], minlength=5) @ vectors, np.bincount(numbers[i[i >= n - 900]], minlength=5) @ vectors) for i in (rng.integers(0, n, size=n) for _ in range(4))]
    for low, high, state in seeded._starts(n, 4, 3, 7):
        whole, tail = seeded._drawn(state, high - low, n, 0, numbers, vectors), seeded._drawn(state, high - low, n, n - 900, numbers[n - 900 :], vectors)
        for k in range(low, high):
            assert (whole[k - low] == want[k][0]).all() and (tail[k - low] == want[k][1]).all()


def test_wikipedia_history(spark):
    d = spark.createDataFrame([("https://de.wikipedia.org/wiki/X_(y)?a#b",), ("https://de.wikipedia.org/",), ("https://example.org/wiki/X",), (None,)], "u string")
    got = [r[0] for r in d.select(urls.wikipedia_history(F.col("u"))).collect()]
    assert got == ["https://de.wikipedia.org/w/index.php?title=X_(y)&action=history", None, None, None]


def test_hooks(spark):
    """Batch functions as columns and tables: judging, embedding, fetching once per key."""
    d = spark.createDataFrame([(1, "Some Text"), (2, None), (3, "other")], "id long, t string")
    upper, vectors = hooks.text_hook(lambda xs: [x.upper() for x in xs]), hooks.embedding_hook(lambda xs: [[len(x), 1] for x in xs])
    assert [(r.u, r.v) for r in d.select(upper("t").alias("u"), vectors("t").alias("v")).collect()] == [("SOME TEXT", [9.0, 1.0]), ("", [0.0, 1.0]), ("OTHER", [5.0, 1.0])]
    verdicts = hooks.judge(d, lambda rows: [{"id": r["id"], "label": "entails" if r["t"] else "neutral", "score": 0.5} for r in rows], "id long, label string, score double")
    assert sorted((r.id, r.label) for r in verdicts.collect()) == [(1, "entails"), (2, "neutral"), (3, "entails")]
    asked = []

    def fetch(keys):
        asked.append(sorted(r.id for r in keys.collect()))
        return keys.select("id", F.lit("fresh").alias("answer"))

    cache = spark.createDataFrame([(1, "cached"), (9, "unused")], "id long, answer string")
    got = hooks.memoized(d.unionByName(d), cache, ["id"], fetch)
    assert sorted((r.id, r.answer) for r in got.collect()) == [(1, "cached"), (2, "fresh"), (3, "fresh")] and asked == [[2, 3]]
    assert hooks.memoized(d, None, ["id"], fetch).count() == 3


def test_answers_of_judges(spark):
    from turnscope.functions import text

    said = ['{"a": 1}', "[1, 2]", 'Sure {as asked}: {"a": {"b": "c"}} and {"z": 1}', "```{'a': True, 'b': None}```", "no object", "", None, "{{} {", '{"open": "}"}x']
    d = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").repartition(1).sortWithinPartitions("i")
    assert [r[0] for r in d.select(text.first_json_object("t")).collect()] == ['{"a": 1}', "[1, 2]", '{"a": {"b": "c"}}', '{"a": true, "b": null}', None, None, None, "{}", None]


def test_short_summaries_give_way_to_the_page(spark):
    from turnscope.functions import text

    page = "<html><script>x</script><p>" + "word " * 60 + "</p><p>more</p></html>"
    d = spark.createDataFrame([(page, "<p>short</p>"), (page, "<p>" + "long " * 50 + "</p>"), (page, None)], "html string, summary string")
    got = [r[0] for r in d.select(text.article_text(F.col("html"), F.col("summary"))).collect()]
    assert got[0].endswith("more") and got[1].startswith("long") and "more" not in got[1] and got[2] == got[0]


def test_replay_files_and_caches(spark, tmp_path):
    from turnscope.sources import tables

    (tmp_path / "a.json").write_text('{"k1": {"x": 1}, "k2": "text"}')
    (tmp_path / "b.json").write_text("{'k3': {'y': True, 'z': None}}")
    (tmp_path / "cache.json").write_text('{"https://a.com": "body", "https://b.com": 5, "https://c.com": null, "https://d.com": {"x": 1}}')
    assert {r.result_key: r.payload for r in tables.read_replays(spark, str(tmp_path / "a.json")).collect()} == {"k1": '{"x":1}', "k2": "text"}
    assert {r.result_key: r.payload for r in tables.read_replays(spark, str(tmp_path / "b.json")).collect()} == {"k3": '{"y":true,"z":null}'}
    assert {r.url: r.text for r in tables.url_texts(spark, str(tmp_path / "cache.json")).collect()} == {"https://a.com": "body", "https://b.com": "", "https://c.com": "", "https://d.com": ""}


def test_later_stages_from_the_command_line(spark, tmp_path):
    import json

    from turnscope.__main__ import main
    from turnscope.functions.text import CLOSE, OPEN, SEP
    from turnscope.operators.citations import SOURCE

    out = str(tmp_path / "out")
    mark = f"{OPEN}cite{SEP}turn0search1{CLOSE}"
    src = lambda url, ref: (url, "d", None, None, ref, None, None, None, None, None, None)
    shape = f"platform string, month string, user_id int, conv_id string, turn_id string, assistant_response string, srcs_retrieved array<{SOURCE}>, srcs_safe_urls array<{SOURCE}>, srcs_cited array<{SOURCE}>"
    spark.createDataFrame([("p", "2024-01-01", 0, "c", "t", f"One claim is here. {mark} Another is there.", [src("https://a.com/1", 1)], [], [src("https://a.com/2", 2), src("https://x.org", 3)])], shape).write.parquet(str(tmp_path / "responses"))
    main(["claims", "--input", str(tmp_path / "responses"), "--output", out])
    got = spark.read.parquet(f"{out}/candidates").orderBy("claim_idx", "pos").collect()
    assert [(r.claim_idx, r.url, r.priority) for r in got][:3] == [(0, "https://a.com/2", 2), (0, "https://x.org", 2), (0, "https://a.com/1", 3)] and len(got) == 6
    long = [("p", "2024-01-01", "c", 1, "retrieved", "https://a.com/1", "a.com", 0), ("p", "2024-01-01", "c", 1, "cited", "https://a.com/2", "a.com", 0), ("p", "2024-01-01", "c", 1, "cited", "https://x.org", "x.org", 1)]
    spark.createDataFrame(long, SOURCES).write.parquet(str(tmp_path / "sources"))
    spark.createDataFrame([("https://x.org", "404"), ("https://a.com/2", "200")], "url string, status string").write.parquet(str(tmp_path / "status"))
    spark.createDataFrame([("https://x.org", "hallucinated")], "url string, archive_class string").write.parquet(str(tmp_path / "archive"))
    main(["links", "--input", str(tmp_path / "sources"), "--output", out, "--status", str(tmp_path / "status"), "--archive", str(tmp_path / "archive")])
    assert {r.grp: (r.valid, r.hallucinated) for r in spark.read.parquet(f"{out}/link_rates").collect()} == {"cited_and_retrieved": (1, 0), "cited_not_retrieved": (0, 1)}
    (tmp_path / "replays.json").write_text(json.dumps({"k": {"content": [{"type": "text", "text": "A claim that is linked. [a](https://a.com/)"}]}}))
    main(["replays", "--input", str(tmp_path / "replays.json"), "--output", out])
    assert [(r.claim, r.urls) for r in spark.read.parquet(f"{out}/replay_claims").collect()] == [("A claim that is linked.", ["https://a.com"])]
