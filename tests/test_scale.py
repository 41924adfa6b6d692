"""Forms that hold at any size, against plain Python: tree walks, ranks, histories, threshold joins, split draws."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions import bootstrap, ranks, stats
from turnscope.operators import histories, matching, trees
from turnscope.sources import tables
from turnscope.sources.stored import stored

# --- trees ---------------------------------------------------------------------------------


def plain_walk(nodes, last, by_parent):
    """nodes: [(node, parent, children)] in the order of the map."""
    known = {n: c for n, _, c in nodes}
    first = {}
    for n, p, _ in nodes:
        first.setdefault(p, n)
    loose = [n for n, p, _ in nodes if p is None or p not in known or (not last and p == "root")]
    at, out = (loose[-1 if last else 0] if loose else None), []
    while at in known and at not in out:
        out.append(at)
        at = known[at][0] if known[at] else first.get(at) if by_parent else None
    return out


def random_tree(rnd, n):
    names = ["root", *(f"n{i}" for i in range(n))]
    rnd.shuffle(names)
    parent = {names[0]: None} | {names[i]: names[rnd.randrange(max(0, i - 3), i)] for i in range(1, len(names))}
    if rnd.random() < 0.3:
        parent[rnd.choice(names)] = "gone"
    if rnd.random() < 0.2:
        parent[rnd.choice(names)] = None
    kids = {x: [c for c in names if parent[c] == x] for x in names}
    for x in names:
        rnd.shuffle(kids[x])
        if rnd.random() < 0.25:
            kids[x] = []
        if rnd.random() < 0.03:
            kids[x] = ["missing"]
        if rnd.random() < 0.03:
            kids[x] = [rnd.choice(names)]  # may lead round
    rnd.shuffle(names)
    return [(x, parent[x], kids[x]) for x in names]


@pytest.mark.parametrize(("root", "by_parent"), [("last", True), ("first", False)])
def test_walks_of_random_trees(spark, root, by_parent):
    rnd = random.Random(5)
    made = [random_tree(rnd, rnd.choice([0, 1, 2, 5, 12, 40])) for _ in range(60)]
    made.append([(f"c{i}", f"c{i - 1}" if i else None, [f"c{i + 1}"] if i < 300 else []) for i in range(301)])
    made.append([])
    rows = [(t, i, n, p, c[0] if c else None) for t, tree in enumerate(made) for i, (n, p, c) in enumerate(tree)]
    nodes = stored(spark.createDataFrame(rows, "tree long, idx int, node string, parent string, child string"), "test")
    got = {}
    for r in trees.walk_order(nodes, root, by_parent).orderBy("tree", "place").collect():
        got.setdefault(r.tree, []).append(r.node)
    assert got == {t: w for t, tree in enumerate(made) if (w := plain_walk(tree, root == "last", by_parent))}


def test_a_tree_is_rows(spark):
    convs = spark.createDataFrame([(1, {"a": (None, ["b"]), "b": ("a", [])}), (1, {"a": (None, None)}), (2, None)], "id int, mapping map<string,struct<parent:string,children:array<string>>>")
    rows = trees.tree_nodes(convs, "id")
    assert {(r.id, r.idx, r.node, r.parent, r.child) for r in rows.collect()} == {(1, 0, "a", None, "b"), (1, 0, "a", None, None), (1, 1, "b", "a", None)}
    assert rows.select("tree").distinct().count() == 2


# --- ranks and totals ----------------------------------------------------------------------


@pytest.mark.parametrize("tasks", [1, 7, 50])
def test_places_and_totals_in_one_order(spark, tasks):
    rnd = random.Random(tasks)
    rows = [(rnd.choice("abc"), rnd.randrange(50), i, rnd.randrange(5)) for i in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        df = spark.createDataFrame(rows, "g string, x int, i int, n int").repartition(tasks)
        got = {r.i: r.place for r in ranks.global_places(df, "g", "x", "i").collect()}
        totals = {r.i: r.before for r in ranks.running_totals(df, F.col("n"), "g", "x", "i").collect()}
        e = {r.i: r.ecdf for r in stats.ecdf(df, "x", ["g"], ["i"]).collect()}
        whole = {r.i: r.ecdf for r in stats.ecdf(df, "x", [], ["g", "i"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows)
    assert got == {r[2]: k for k, r in enumerate(order)}
    assert totals == {r[2]: sum(q[3] for q in order[:k]) for k, r in enumerate(order)}
    for r in rows:
        mine = sorted((q[1], q[2]) for q in rows if q[0] == r[0])
        assert e[r[2]] == (mine.index((r[1], r[2])) + 1) / len(mine)
    assert whole == {r[2]: (k + 1) / 500 for k, r in enumerate(sorted(rows, key=lambda q: (q[1], q[0], q[2])))}
    assert ranks.global_places(df.limit(0), "g").count() == 0


def test_no_window_spans_a_group(spark):
    plan = stats.ecdf(spark.range(1000).withColumn("x", F.col("id") % 3), "x", [], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Scan")[0] or "_part" in plan


# --- histories -----------------------------------------------------------------------------


def test_histories_are_read_back(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(c, t, [f"{c}-{t}-{i}" for i in range(rnd.randrange(4))] if rnd.random() < 0.9 else None) for c in (1, 2, None) for t in range(300 if c == 1 else 4)]
    parts = histories.history_parts(spark.createDataFrame(rows, "c int, t int, said array<string>"), ["c"], "t", "said")
    assert parts.agg(F.sum(F.size("parts"))).first()[0] == sum(len(r[2] or []) for r in rows)
    full = {(c, t): [x for d, u, s in rows if d == c and u <= t for x in s or []] for c, t, _ in rows}
    monkeypatch.setattr(histories, "WIDTH", 16)
    named = parts.filter("c is not null")
    got = {(r.c, r.t): r.history for r in histories.histories_at(named, named, ["c"], "t").collect()}
    assert got == {k: v for k, v in full.items() if k[0] is not None}
    tails = {(r.c, r.t): r.history for r in histories.histories_at(named, named, ["c"], "t", last=5).collect()}
    assert tails == {k: v[-5:] for k, v in full.items() if k[0] is not None}
    wanted = spark.createDataFrame([(1, 3, 3), (1, 7, 40), (1, 0, 9_999), (9, 0, 5)], "c int, low long, high long")
    said = full[1, 299]
    assert {(r.c, r.low, r.high): r.history for r in histories.history_range(parts, wanted, ["c"]).collect()} == {(1, 3, 3): [], (1, 7, 40): said[7:40], (1, 0, 9_999): said, (9, 0, 5): []}


# --- best blocks ---------------------------------------------------------------------------


def flat(t):
    return re.sub(r"\s+", " ", t or "").strip(" ").lower()


def plain_f1(a, b):
    x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (a, b))
    both = sum((Counter(x) & Counter(y)).values())
    return round(2 * both / (len(x) + len(y)), 9) if both else 0.0


def plain_best(chunk, urls, blocks, least):
    if not flat(chunk):
        return None
    for i, b, _ in blocks:
        if flat(chunk) in flat(b):
            return i, 3
    f1 = {i: plain_f1(chunk, b) for i, b, _ in blocks}
    if blocks and max(f1.values()) >= least:
        return min(i for i in f1 if f1[i] == max(f1.values())), 2
    shared = [(-len(set(urls) & set(u)), -f1[i], i) for i, _, u in blocks if set(urls) & set(u)]
    return (min(shared)[2], 1) if shared else None


@pytest.mark.parametrize("least", [0.45, 0.8, 0.2])
def test_best_blocks_equal_brute_force(spark, least):
    rnd = random.Random(int(least * 100))
    word = lambda: rnd.choice(["a", "b", "b", "The", "x1", "yy", "zed", "É", "q-r", "S."] + [f"w{rnd.randrange(40)}" for _ in range(6)])
    blocks, chunks = [], []
    for k in range(6):
        for i in range(25):
            text = rnd.choice([None, "", "  "]) if rnd.random() < 0.05 else blocks[-1][2] if blocks and rnd.random() < 0.1 else "  ".join(word() for _ in range(rnd.randrange(1, 14)))
            blocks.append((k, i, text, rnd.sample("uvwxyz", rnd.randrange(3))))
        for i in range(40):
            base = rnd.choice([b for b in blocks if b[0] == k])[2] or ""
            ws = base.split()
            text = rnd.choice([base.upper(), base[1:-1], " ".join(ws[::-1]), " ".join(ws[: len(ws) // 2] + [word() for _ in range(4)]), "zz9 " + word(), "", None, word()])
            chunks.append((k, i, text, rnd.sample("uvwxyz", rnd.randrange(3))))
    c, b = spark.createDataFrame(chunks, "k int, chunk_idx int, chunk string, urls array<string>"), spark.createDataFrame(blocks, "k int, block_idx int, block string, block_urls array<string>")
    got = {(r.k, r.chunk_idx): (r.block_idx, r.tier) for r in matching.best_block(c, b, ["k"], least).collect()}
    want = {(k, i): plain_best(t, u, [(j, x, v) for q, j, x, v in blocks if q == k], least) for k, i, t, u in chunks}
    assert got == {k: v for k, v in want.items() if v}
    assert matching.best_block(c.limit(0), b, ["k"]).count() == 0


def test_few_pairs_meet(spark):
    rnd = random.Random(1)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(15)) for _ in range(300)]
    e = matching.token_elements(spark.createDataFrame(list(enumerate(texts)), "a_id int, t string").withColumn("k", F.lit(1)), ["k", "a_id"], "t")
    a, b = matching.rarest_first(e, e.withColumnRenamed("a_id", "b_id"), ["k"])
    pairs = matching.close_pairs(a, b, ["k"], 0.7)
    near = {(r.a_id, r.b_id) for r in matching.pair_f1(pairs, a, b, ["k"]).filter("f1 >= 0.7").collect()}
    assert near == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if plain_f1(x, y) >= 0.7}
    assert len(near) <= pairs.count() < 0.25 * 300 * 300


# --- split draws ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 5, 1024, 1025, 5000])
def test_every_replicate_draws_all(n):
    d = bootstrap.Draws(n, 40, 3)
    blocks = -(-n // bootstrap.BLOCK)
    counts = [d.sums(b, np.eye(bootstrap._rows(b, b + 1, n))) for b in range(blocks)]
    drawn = np.concatenate(counts, axis=1)
    assert drawn.shape == (40, n) and (drawn.sum(axis=1) == n).all()
    late = bootstrap.Draws(n, 40, 3)
    assert (late.sums(blocks - 1, np.eye(bootstrap._rows(blocks - 1, blocks, n))) == counts[-1]).all()  # without the blocks before
    if n >= 1000:
        assert abs(drawn.var() - 1) < 0.05 and abs((drawn == 0).mean() - np.exp(-1)) < 0.01


def test_intervals_do_not_depend_on_parallelism(spark):
    rnd = np.random.default_rng(1)
    rows = [(g, int(i), int(rnd.integers(0, 4)), int(rnd.integers(0, 6))) for g in ["a", "b", None] for i in range(3000 if g == "a" else 50)]
    df = spark.createDataFrame(rows, "g string, c int, p int, q int")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for tasks in (1, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        got.append(sorted(map(str, bootstrap.split_ratio_ci(df.repartition(tasks), ["g"], "c", "p", "q", n_bootstrap=200, seed=5).collect())))
        whole = bootstrap.split_ratio_ci(df.filter("g = 'a'").repartition(tasks), [], "c", "p", "q", n_bootstrap=200, seed=5).collect()
        got[-1].append(str(whole))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 4
    p, q = (np.array([r[k] for r in rows if r[0] == "a"], float) for k in (2, 3))
    _, ratio, low, high = stats.ratio_ci(p, q, n_bootstrap=2000)
    assert whole[0].ratio == ratio and abs((whole[0].ci_high - whole[0].ci_low) / (high - low) - 1) < 0.25


def test_intervals_cover(spark):
    """95 intervals of 100 should hold the truth; 300 groups of 40 clusters each, so between 250 and 299 do."""
    rnd = np.random.default_rng(7)
    rows = [(g, i, float(rnd.normal(2, 1)), 1.0) for g in range(300) for i in range(40)]
    got = bootstrap.split_ratio_ci(spark.createDataFrame(rows, "g int, c int, p double, q double"), ["g"], "c", "p", "q", n_bootstrap=400, seed=1).collect()
    assert 250 <= sum(r.ci_low <= 2 <= r.ci_high for r in got) <= 299


# --- tables --------------------------------------------------------------------------------


def test_an_append_is_whole_or_nothing(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.range(10).withColumn("x", F.col("id") * 2)
    assert tables.append_new(spark, rows, out, ["id"]) == 10
    broken = spark.range(5, 30, numPartitions=5).withColumn("x", F.when(F.col("id") == 28, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        tables.append_new(spark, broken, out, ["id"])
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.endswith(".crc")) == ["batch=000000001"]
    assert tables.append_new(spark, spark.range(5, 30).withColumn("x", F.col("id")), out, ["id"]) == 20
    assert tables.append_new(spark, spark.range(30).withColumn("x", F.col("id")), out, ["id"]) == 0
    got = tables.read_batches(spark, out)
    assert got.columns == ["id", "x"] and {r.id: r.x for r in got.collect()} == {i: 2 * i if i < 10 else i for i in range(30)}
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["batch=000000001", "batch=000000002"]


def test_an_append_reads_what_lies_there(spark, tmp_path):
    out = str(tmp_path / "t")
    spark.range(3).write.parquet(out)
    assert tables.append_new(spark, spark.range(5), out, ["id"]) == 2
    assert sorted(r.id for r in tables.read_batches(spark, out).collect()) == [0, 1, 2, 3, 4]


def test_bucketed_stages_do_not_shuffle(spark, tmp_path):
    turns = spark.range(500).select((F.col("id") % 40).alias("conv_id"), (F.col("id") / 40).cast("int").alias("turn_id"))
    sources = spark.range(2_000).select((F.col("id") % 40).alias("conv_id"), (F.col("id") % 12).cast("int").alias("turn_id"), F.concat(F.lit("d"), F.col("id") % 7).alias("domain"))
    claims = spark.range(900).select((F.col("id") % 40).alias("conv_id"), (F.col("id") % 12).cast("int").alias("turn_id"), F.col("id").alias("claim"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in (("b_turns", turns), ("b_sources", sources), ("b_claims", claims)):
            tables.save_bucketed(df, name, ["conv_id"], 6, ["turn_id"], str(tmp_path / name))
        t, s, c = (spark.table(n) for n in ("b_turns", "b_sources", "b_claims"))
        first = F.min("turn_id").over(W.partitionBy("conv_id", "domain"))
        per_turn = s.withColumn("first", first).groupBy("conv_id").agg(F.count_if(F.col("first") < F.col("turn_id")).alias("late"))
        out = t.groupBy("conv_id").agg(F.count("*").alias("turns")).join(per_turn, "conv_id").join(c.groupBy("conv_id").agg(F.count("*").alias("claims")), "conv_id")
        rows = {r.conv_id: (r.turns, r.claims) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("b_turns", "b_sources", "b_claims"):
            spark.sql(f"drop table if exists {name}")
    assert len(rows) == 40 and all(n in (12, 13) and k in (22, 23) for n, k in rows.values())
    assert plan.count("SortMergeJoin") >= 2 and "Window" in plan and "Exchange" not in plan.replace("AQEShuffleRead", "")
