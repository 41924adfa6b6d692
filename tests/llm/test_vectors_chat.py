"""Centroid clustering, vector codes and chat formatting against brute force, SQL and their defined cases."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnscope.llm import chat, clusters, codes, integers

# --- integer vectors -----------------------------------------------------------------------


@pytest.mark.parametrize("size", [30, 1 << 27])
def test_squared_distances_are_exact(size):
    rnd = np.random.default_rng(1)
    x, c = rnd.integers(-size, size + 1, (50, 64)), rnd.integers(-size, size + 1, (7, 64))
    exact = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
    assert integers.squared(x, c).tolist() == exact


def plain_lloyd(q, start, rounds):
    """Centroids and assignments by comparing everything with everything."""
    cents = [list(map(int, c)) for c in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for v in q]
        for i in range(len(cents)):
            mine = [v for v, o in zip(q, own) if o == i]
            if mine:
                cents[i] = [sum(col) // len(mine) for col in zip(*mine)]
    return cents, [nearest(v) for v in q]


@pytest.mark.parametrize(("size", "dim", "k"), [(2, 2, 5), (3, 4, 16), (40, 64, 16), (1, 1, 3), (500, 2, 33), (9, 3, 1)])
def test_exponion_keeps_ties_and_sees_less(size, dim, k):
    rnd = np.random.default_rng(size)
    x = rnd.integers(-size, size + 1, (600, dim))
    start = x[:k].copy()
    cents, before = start.copy(), None
    a, u, low, seen = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x)), 0
    for _ in range(12):
        if before is not None:
            p, other = clusters.moved(before, cents)
            u, low = u + p[a], low - other[a]
        a, u, low, n = clusters.exponion(x, a, u, low, clusters.Centres(cents))
        seen += n
        sq = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
        assert (a == sq.argmin(axis=1)).all()
        rest = np.where(np.arange(k) == a[:, None], np.inf, np.sqrt(sq))
        assert (u >= np.sqrt(sq[np.arange(len(x)), a]) - 1e-6).all() and (low <= rest.min(axis=1) + 1e-6).all()
        before, cents = cents, np.array([x[a == i].sum(axis=0) // (a == i).sum() if (a == i).any() else cents[i] for i in range(k)])
    if k > 30:
        assert seen < 0.5 * 12 * len(x) * k


VECTORS = "vec_id long, embedding array<float>, label int, `a.b` int, q string, id string, cluster string, codes int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", "y", "z", 2) for i, v, lab in rows], VECTORS)


def odd_rows(n=60, seed=3):
    rnd = random.Random(seed)
    rows = [(i, [round(rnd.uniform(-0.05, 0.05), 2) for _ in range(64)], rnd.choice([0, 1, None])) for i in range(n)]
    hot = rows[5][1]
    rows += [(100 + i, hot, 7) for i in range(n)]  # many copies of one vector
    rows += [rows[3], (3, rows[8][1], 1), (None, rows[9][1], None)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * 63 + [None], 1), (203, [float("nan")] * 64, 1), (204, [float("inf")] + [0.0] * 63, 1), (206, [3e38] * 64, 0), (207, [-3e38] * 64, 0)]
    return rows


def duck(rows, sql):
    df = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "embedding": pd.Series([r[1] for r in rows], dtype=object), "label": pd.array([r[2] for r in rows], "Int32")})
    con = duckdb.connect()
    con.register("given", df)
    con.execute("create view embeddings as select vec_id, embedding::FLOAT[] as embedding, label from given")
    return sorted(map(str, con.execute(sql).fetchall()))


def in_memory(monkeypatch, module, df):
    monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: df)


@pytest.mark.parametrize("parts", [1, 5])
def test_clusters_of_odd_vectors(spark, monkeypatch, parts):
    rows = [*odd_rows(), (205, [0.5] * 8, 2)]
    in_memory(monkeypatch, clusters, vectors(spark, rows).repartition(parts))
    got = clusters.op11_centroid_clusters(spark, "").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == duck(rows, clusters.OP11_SQL)
    in_memory(monkeypatch, clusters, vectors(spark, rows).limit(0))
    assert clusters.op11_centroid_clusters(spark, "").count() == 0


def test_clusters_by_definition(spark):
    rows = odd_rows()[:40]
    state, cents = clusters.cluster(vectors(spark, rows), k=5, rounds=4, scale=100, seed=9)
    q = [[int(np.floor(np.float64(np.float32(x)) * 100)) for x in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"9:{rows[i][0]}".encode()).hexdigest())
    want, own = plain_lloyd(q, [q[i] for i in order[:5]], 4)
    assert cents.tolist() == want
    assert {r.id: (r.sq, r.cluster) for r in state.collect()} == {r[0]: o for r, o in zip(rows, own)}


@pytest.mark.parametrize(("size", "entries"), [(2, 4), (30, 16), (1, 3), (5, 1)])
def test_heaps_hold_what_drift_has_not_reached(size, entries):
    rnd = np.random.default_rng(size)
    parts, width, n = 3, 2, 400
    x = rnd.integers(-size, size + 1, (n, parts, width))
    books = x[:entries].transpose(1, 0, 2).copy()
    assigned, drift = np.full((n, parts), -1), np.zeros((parts, entries))
    heaps, counts, sums, popped = codes.new_heaps(n, parts, entries), 0, 0, []
    for _ in range(10):
        items = len(heaps.items)
        probe = codes.Heaps(heaps.keys.copy(), heaps.items.copy(), heaps.at.copy())
        popped.append(len(probe.pop(drift.ravel())))
        c, s = codes.rescan(x, assigned, heaps, books, drift.ravel())
        counts, sums = counts + c, sums + s
        assert len(heaps.items) == items == n * parts and sorted(heaps.items) == list(range(n * parts))
        for g, (lo, hi) in enumerate(itertools.pairwise(heaps.at)):
            assert heaps.keys[lo:hi].tolist() == sorted(heaps.keys[lo:hi])
            assert (assigned[heaps.items[lo:hi] // parts, heaps.items[lo:hi] % parts] == g % entries).all()
        for p in range(parts):
            sq = ((x[:, p, None] - books[p][None]) ** 2).sum(axis=2)
            assert (assigned[:, p] == sq.argmin(axis=1)).all()
            assert counts[p].tolist() == np.bincount(assigned[:, p], minlength=entries).tolist()
        old = books.copy()
        for p in range(parts):
            for e in range(entries):
                if counts[p, e]:
                    books[p, e] = sums[p, e] // counts[p, e]
        step = np.sqrt(((books - old) ** 2).sum(axis=2))
        if entries > 1:
            other = np.array([[np.delete(step[p], e).max() for e in range(entries)] for p in range(parts)])
            drift = drift + step + other
    if size == 30:
        assert popped[0] == n * parts and popped[-1] < n * parts / 2


@pytest.mark.parametrize("parts", [1, 5])
def test_codes_of_odd_vectors(spark, monkeypatch, parts):
    rows = [r for r in odd_rows() if r[1] != []]
    in_memory(monkeypatch, codes, vectors(spark, rows).repartition(parts))
    got = codes.op12_vector_codes(spark, "").select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == duck(rows, codes.OP12_SQL)
    in_memory(monkeypatch, codes, vectors(spark, rows).limit(0))
    assert codes.op12_vector_codes(spark, "").count() == 0


def test_vectors_of_other_length_have_no_code(spark):
    rows = [(1, [0.1] * 64, 0), (2, [0.2] * 64, None), (3, [], 0), (4, [0.5] * 16, 5), (5, None, 0)]
    coded, books = codes.compress(vectors(spark, rows), parts=8)
    got = {r.id: (r.codes, r.label_error) for r in codes.with_label_errors(coded).collect()}
    assert got == {1: ([0] * 8, 0), 2: ([1] * 8, 0), 3: (None, 0), 4: (None, None)} and books.shape == (8, 2, 8)
    coded, books = codes.compress(vectors(spark, [(1, [0.1] * 3, 0)]), parts=8)
    assert [tuple(r) for r in coded.collect()] == [(1, 0, None, None)] and books is None


# --- chat ----------------------------------------------------------------------------------

PIECES = ["<", "[", "\\", "/", "s>", "INST]", "<s>", "</s>", "[/INST]", "<<SYS>>", "<|turn|>", "<|end|>\n", "|end|>", "a", "\n", "é", "<\\s>"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not chat._PLAIN.search(out.replace("\\", "\x00")) and chat.TURN not in out and chat.END not in out and "</s>" not in out


TREE = "tree string, node long, parent long, role string, text string, points double, `a.b` int, key string, leaf int, up map<string,int>, place int, score string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, {"a": 1}, 3, "s") for r in rows], TREE)


def brute_paths(rows, best):
    """Best branches of each tree as (score, node list), by walking up from every leaf."""
    out = {}
    for tree in {r[0] for r in rows}:
        mine = {}
        for r in rows:
            if r[0] == tree and r[1] is not None:
                mine.setdefault(r[1], []).append(r)
        parent = {n: min((r[2] for r in rs if r[2] is not None), default=None) for n, rs in mine.items()}
        points = {n: max((r[5] for r in rs if r[5] is not None), default=0.0) for n, rs in mine.items()}
        found = []
        for n in mine:
            if n in parent.values():
                continue
            path, at = [], n
            while at is not None and at in mine and at not in path:
                path.append(at)
                at = parent[at]
            if at is None or at not in mine:
                found.append((-sum(points[p] for p in path), -len(path), n, path[::-1]))
        out[tree] = sorted(found)[:best]
    return out


@pytest.mark.parametrize("best", [1, 3])
def test_best_branches_of_random_trees(spark, best):
    rnd = random.Random(best)
    rows = []
    for t in ["a", "b", "c", None]:
        for n in range(40):
            rows.append((t, n, None if n == 0 else rnd.randrange(max(0, n - 6), n), rnd.choice(["user", "assistant", "system", None]), f"{t} {n} </s>", rnd.choice([0.0, 1.0, 2.0, None])))
    rows += [("chain", n, n - 1 if n else None, "user", f"m{n}", 1.0) for n in range(77)]
    rows += [("loop", 1, 2, "user", "x", 1.0), ("loop", 2, 1, "user", "x", 1.0), ("loop", 3, 2, "user", "x", 1.0), ("loop", 9, 8, "user", "lone", 1.0)]
    rows += [("twice", 1, None, "user", "q", 1.0), ("twice", 1, None, "user", "q", 1.0), ("twice", 2, 1, "assistant", "", 1.0), ("none", None, None, "user", "x", 1.0)]
    got = {}
    for r in chat.format_trees(messages(spark, rows), score="points", best=best).orderBy("part").collect():
        turns, loss, length = got.setdefault((r.tree, r.rank), ([], [], r.length))
        turns += chat.read_turns(r.text)
        loss += [chat.unescape(r.text[s.start : s.end]) for s in r.loss]
        assert r.whole
    want = {}
    for tree, branches in brute_paths(rows, best).items():
        for k, (_, _, _, path) in enumerate(branches):
            said = [(r[3] or "", r[4] or "") for n in path for r in sorted((r for r in rows if r[0] == tree and r[1] == n), key=lambda r: (r[3] or "", r[4] or ""))]
            want[tree, k + 1] = (said, [t for w, t in said if w == "assistant"], len(path))
    assert got == want
    assert chat.format_trees(messages(spark, rows).limit(0)).count() == 0


def test_a_long_conversation_is_parts(spark, monkeypatch):
    n = 2_000
    rows = [(5, i, ["user", "assistant"][i % 2], f"<s>{i}" * 40 if i % 7 else None) for i in range(n)] + [(6, 0, "assistant", "x" * 3_000_000), (6, 1, "assistant", "y"), (None, None, None, None), (5, 3, "user", "again"), (5, 3, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    monkeypatch.setattr(chat, "table", lambda *a: df)
    parts = []
    real = chat.digests
    monkeypatch.setattr(chat, "digests", lambda p: parts.append(p.groupBy("tree").count().collect()) or real(p))
    got = sorted(str(tuple(r)) for r in chat.op13_chat_format(spark, "").collect())
    assert {r["tree"]: r["count"] for r in parts[0]}[5] > 3 and {r["tree"]: r["count"] for r in parts[0]}[6] == 2
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("create view conversations as select * from given")
    assert got == sorted(map(str, con.execute(chat.OP13_SQL).fetchall()))
