"""Centroid clustering of integer vectors by exponion search.

Lloyd's rounds with exact results: every vector carries its centroid, an upper bound of the distance to it and a lower
bound of the distance to any other. After an update the bounds give way by how far the centroids moved. A vector whose
upper bound stays below its lower bound, or below half the way from its centroid to the nearest other one, keeps its
centroid unseen. For the others the upper bound is made exact, and if that doesn't do, they scan the centroids in a ball of
radius 2u + s around their centroid (u: that distance, s: the distance from their centroid to the nearest other one), which
holds their two nearest centroids. The ball is a prefix of the centroid's list of all centroids by distance, rounded up to a power of two
in length; its radius is inclusive and bounds are compared with a margin, so a tie is always scanned and the smaller number wins.

State (vector, centroid, bounds) is one stored table a round. A round is one pass of independent tasks and one aggregate of sums by
centroid, combined on the map side; the driver sees k x dim numbers. No rows are grouped, so hot centroids or copies of one vector
cost nothing extra.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out. Components
beyond 2^27 after scaling count as 2^27. Fewer vectors than k start as many centroids. Rows that repeat an id are
vectors of their own, ordered by their components where hashes tie; a null id starts a centroid only if there are too few others. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table
from .integers import CELLS, finite, floors, matrix, squared, two_nearest

K, DIM, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
#: Bounds are compared with this margin, relative to them: far above what rounding does to them.
MARGIN = 1e-9


class Centres:
    """Centroids with the distances between them, each one's list of all sorted by distance."""

    def __init__(self, c: np.ndarray):
        self.c = c
        d = np.sqrt(squared(c, c).astype(np.float64))
        self.order = np.argsort(d, axis=1, kind="stable")
        self.dist = np.take_along_axis(d, self.order, 1)
        self.apart = self.dist[:, 1] if len(c) > 1 else np.full(len(c), np.inf)


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how far each centroid moved, how far any other one moved at most)."""
    p = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
    if len(p) < 2:
        return p, np.zeros(len(p))
    top = np.argsort(-p, kind="stable")
    return p, np.where(np.arange(len(p)) == top[0], p[top[1]], p[top[0]])


def exponion(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, cents: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(centroid, upper, lower bound of every row of x; distances computed), from valid bounds; the arrays given are changed in place."""
    k, n_seen = len(cents.c), 0
    enough = np.maximum(cents.apart[a] / 2, low)
    open_ = np.nonzero(u * (1 + MARGIN) + MARGIN >= enough)[0]
    known = np.isfinite(u[open_])
    for own in np.unique(a[open_[known]]):  # make upper bounds exact
        mine = open_[known][a[open_[known]] == own]
        u[mine] = np.sqrt(squared(x[mine], cents.c[own : own + 1])[:, 0])
        n_seen += len(mine)
    open_ = open_[u[open_] * (1 + MARGIN) + MARGIN >= enough[open_]]
    owners = a[open_]
    for own in np.unique(owners):
        mine = open_[owners == own]
        ball = (2 * u[mine] + cents.apart[own]) * (1 + MARGIN) + MARGIN
        inside = np.searchsorted(cents.dist[own], ball, side="right")
        width = np.minimum(k, 1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(int))
        for w in np.unique(width):
            some = mine[width == w]
            near = np.sort(cents.order[own][:w])  # by number, so that the first of equals is the smallest
            step = max(1, CELLS // w)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                best, least, second = two_nearest(squared(x[part], cents.c[near]))
                a[part], u[part], low[part] = near[best], np.sqrt(least), np.sqrt(second)
                n_seen += len(part) * int(w)
    return a, u, low, n_seen


def assign(state: DataFrame, cents: np.ndarray, before: np.ndarray | None, dim: int) -> DataFrame:
    """State after one assignment to `cents`; `before` are the centroids its bounds hold for. sq is the exact squared distance."""
    p, other = moved(before, cents) if before is not None else (np.zeros(len(cents)), np.zeros(len(cents)))

    def run(batches):
        lists = Centres(cents)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), dim)
            a = b.column(2).to_numpy().astype(np.int64)
            u, low = b.column(3).to_numpy() + p[a], b.column(4).to_numpy() - other[a]
            a, u, low, _ = exponion(x, a, u, low, lists)
            away = x - cents[a]
            sq = np.einsum("nd,nd->n", away, away)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a, pa.int32()), pa.array(u), pa.array(low), pa.array(sq)], names=["id", "q", "cluster", "upper", "lower", "sq"])

    kind = state.schema["id"].dataType.simpleString()
    return state.select("id", "q", "cluster", "upper", "lower").mapInArrow(run, f"id {kind}, q array<int>, cluster int, upper double, lower double, sq long")


def first_centroids(state: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest SHA-256 of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = state.select("q", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def updated(state: DataFrame, cents: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors becomes the floor of their mean."""
    out = cents.copy()
    sums = [F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(cents.shape[1])]
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(cents.shape[1])]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dim: int = DIM, scale: float = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, q, cluster, upper, lower, sq), stored; centroids): q is the integer vector, sq its squared distance to its centroid."""
    v = F.col(f"`{vec_col}`")
    q = floors(v, scale, finite(v) & (F.size(v) == dim))
    start = vectors.select(F.col(f"`{id_col}`").alias("id"), q.alias("q")).filter("q is not null")
    inf = F.lit(float("inf"))
    state = materialize(start.select("id", "q", F.lit(0).alias("cluster"), inf.alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("sq")), "cluster-state")
    cents, before = first_centroids(state, k, seed), None
    if not len(cents):
        return state, cents
    for r in range(rounds + 1):
        new = materialize(assign(state, cents, before, dim), "cluster-state")
        release(state)
        state = new
        if r < rounds:
            before, cents = cents, updated(state, cents)
    return state, cents


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of 64 finite components."""
    state, cents = cluster(table(spark, sf_dir, "embeddings"))
    sums = state.groupBy("cluster").agg(F.sum("sq").alias("inertia")).collect()
    held = {r["cluster"]: r["inertia"] for r in sums}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in cents]
    by_cluster = spark.createDataFrame([(c, held.get(c, 0), sum(held.values()), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most K rows
    return state.join(F.broadcast(by_cluster), "cluster").select(F.col("id").alias("vec_id"), "cluster", F.col("sq").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql() -> str:
    big = f"{2.0**27:.1f}"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, list_transform(embedding, lambda x: floor(greatest(-{big}, least({big}, 64 * x::DOUBLE)))::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, q) - 1)::INTEGER AS c, q AS m FROM v QUALIFY c < {K})",
    ]
    dist = "list_sum(list_transform(list_zip(v.q, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := {dist}, c := c.c)) AS b FROM v, c{r} c GROUP BY rid)")
        if r < ROUNDS:
            mean = f"""SELECT b.c AS c, list(m ORDER BY i) AS m FROM (SELECT b, i, (s - ((s % n) + n) % n) // n AS m FROM
  (SELECT a.b.c AS b, i, sum(v.q[i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v USING (rid), range(1, {DIM + 1}) t(i) GROUP BY 1, 2)) b GROUP BY 1"""
            parts.append(f"m{r} AS MATERIALIZED ({mean.replace('b.c AS c', 'b AS c')})")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.m, c.m) AS m FROM c{r} c LEFT JOIN m{r} m USING (c))")
    return f"""WITH {", ".join(parts)},
i AS (SELECT b.c AS c, sum(b.d)::BIGINT AS s FROM a{ROUNDS} GROUP BY 1)
SELECT v.vec_id, a.b.c AS cluster, a.b.d AS distance, i.s AS cluster_inertia, (SELECT sum(s) FROM i)::BIGINT AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (rid) JOIN i ON i.c = a.b.c JOIN c{ROUNDS} c ON c.c = a.b.c"""


OP11_SQL = _op11_sql()
