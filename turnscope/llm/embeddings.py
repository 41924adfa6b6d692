"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors are one node with a multiplicity. Nodes are dealt to the overlap(k) nearest of k
centroids (OVERLAP of up to 64, one more for each further factor of four, since more centroids part more
close pairs), so shards overlap. Centroids come from k-means on a bounded sample, PER_FIT nodes for each; those
closer to each other than the range are one, so that a dense region has one and isn't parted. Beyond MAX_CENTROIDS the
cells of the first centroids have centroids of their own, fitted in a task per cell, and a node takes the nearest
of those of its nearest cells.

In each shard a flat graph is built: nearest and random candidates of every node pruned by the robust
rule (drop what an accepted neighbour is clearly nearer to). The lists of a node from all its shards are united, up
to UNITED of the nearest, beside its own one in the shard; edges go both ways. Every node is searched for by a greedy
beam from the nearest medoids of the shard along the united lists, and from what the beam holds
within the range, everything within the range is expanded until no new node is. A search reads the lists as far as they stay in its shard, where
the vectors are. What is found is verified by cosine in double precision. A pair met in several shards counts
in the smallest only, so links are counted without listing pairs; what leaves a shard are counts and spanning links.

Nodes within half the range of their centroid (its core) are all linked with each other: they are counted by one
aggregate and never compared. A shard of more than SHARD nodes for each OVERLAP of overlap(k) is dealt as pairs of its
blocks, core nodes apart, each pair a task of bounded size that counts the pairs between its blocks; two blocks of core
nodes need none. So none is lost, and a large group of near copies costs what its nodes outside the core do.

An audit compares some nodes in hash order with all nodes by brute force, nodes with few links apart from nodes of
groups. If its recall is below LEAST_RECALL, all is dealt again with a larger overlap; after TRIES tries all pairs of
blocks of the nodes are compared instead, which loses nothing and grows with their square. The output has
the recall, null where the audit met too few nodes with links to tell.

Defined cases: vectors that are null, zero or hold null or non-finite components link with
nothing (n_links 0, their own component). Vectors are scaled by a power of two before their norm is taken, so any
finite ones have one. Vectors of different length are never compared. Equal vectors, repeated rows
too, link with each other. A null id never names a component unless no other id is in it.
Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, release, roots, table

MIN_COSINE = 0.9
#: OVERLAP holds up to FEW_CENTROIDS.
FEW_CENTROIDS = 64
OVERLAP, SHARD, PER_CENTROID, MAX_CENTROIDS = 3, 2_400, 350, 2_048
#: Centroids are fitted on so many nodes each; on small tables on CENTROID_SAMPLE.
PER_FIT, CENTROID_SAMPLE = 4, 8_192
#: Numbers (similarities, or components of gathered vectors) held at once, per task.
CELLS = 1 << 22
NEAREST, RANDOM, DEGREE, ALPHA, BEAM, UNITED = 32, 8, 16, 1.2, 6, 96
#: Neighbours looked at together when a node of the beam is expanded; longer lists take several turns.
WIDTH = 32
#: Queries whose range is expanded together.
TOGETHER = 64
#: The search in single precision goes this far beyond the range, the check in double decides.
SLACK = 2e-3
LEAST_RECALL, TRIES = 0.9, 3
#: Nodes the audit asks at first and at most, nodes with links that it wants among them, links from which a node is one of a group.
AUDIT, AUDIT_MOST, AUDIT_LINKED, GROUP = 1_000, 8_000, 50, 16
#: Rows of a cell that meet its centroids in one task.
CELL_ROWS = 50_000


def overlap(k: int) -> int:
    """Nearest centroids, of k, that a node is dealt to."""
    more = 0
    while FEW_CENTROIDS * 4**more < k:
        more += 1
    return OVERLAP + more


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm one, in double precision; components are scaled by a power of two first, which is exact."""
    x = np.asarray(x, np.float64)
    if not x.size:
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _vectors(column, kind) -> np.ndarray:
    """Unit vectors of a column of packed ones of equal length."""
    a = _whole(column)
    if not len(a):
        return np.zeros((0, 1))
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1]
    return unit(np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view(kind).reshape(len(a), -1))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every entry of a column of lists of longs; a null list has none."""
    a = _whole(column)
    at = np.asarray(a.offsets).astype(np.int64)
    sizes = np.diff(at)
    return np.repeat(np.arange(len(a)), sizes), np.asarray(a.values)[at[0] : at[-1]] if len(a) else np.zeros(0, np.int64)


def _padded(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Lists by row as an array, -1 where one ends."""
    first = np.searchsorted(rows, np.arange(n + 1))
    out = np.full((n, int(np.diff(first).max(initial=0))), -1, np.int64)
    out[rows, np.arange(len(rows)) - first[rows]] = values
    return out


def _list_array(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of longs by row; rows ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values, pa.int64()))


def build_graph(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(node, neighbour) of the robust-pruned lists of the rows of x (unit vectors, single precision): nodes ascend, neighbours by distance."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = min(NEAREST, n - 1)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    step = max(1, CELLS // n)
    near = np.concatenate([np.argpartition(-sims[i : i + step], c - 1, axis=1)[:, :c] for i in range(0, n, step)])
    far = np.random.default_rng(seed).integers(0, n, (n, RANDOM))
    cand = np.concatenate([near, far], axis=1)
    rows = np.arange(n)[:, None]
    dist = np.sqrt(np.maximum(2 - 2 * sims[rows, cand], 0))
    dist[cand == rows] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    alive = np.isfinite(dist)
    heads, tails = [], []
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        who = np.nonzero(alive[np.arange(n), first])[0]
        if not len(who):
            break
        p = cand[who, first[who]]
        heads.append(who)
        tails.append(p)
        between = np.sqrt(np.maximum(2 - 2 * sims[p[:, None], cand[who]], 0))
        between[cand[who] == p[:, None]] = 0
        alive[who] &= ALPHA * between > dist[who]
    h, t = np.concatenate(heads), np.concatenate(tails)
    order = np.argsort(h, kind="stable")
    return h[order], t[order]


class Graph:
    """Vectors with edges both ways, each node's as a slice of tails."""

    def __init__(self, x: np.ndarray, heads: np.ndarray, tails: np.ndarray):
        n = len(x)
        both = np.unique(np.concatenate([heads, tails]) * n + np.concatenate([tails, heads]))
        h, self.tails = both // n, both % n
        keep = h != self.tails
        h, self.tails = h[keep], self.tails[keep]
        self.x, self.n = x, n
        self.at = np.searchsorted(h, np.arange(n + 1))

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        sizes = self.at[nodes + 1] - self.at[nodes]
        return self.tails[np.repeat(self.at[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def medoids(self, seed: int = 5) -> np.ndarray:
        """The nodes nearest to the means of about sqrt(n) groups."""
        m = math.isqrt(self.n - 1) + 1
        seeds = self.x[np.random.default_rng(seed).permutation(self.n)[:m]]
        step = max(1, CELLS // m)
        own = np.concatenate([(self.x[i : i + step] @ seeds.T).argmax(axis=1) for i in range(0, self.n, step)])
        order = np.argsort(own, kind="stable")
        return np.array([g[(self.x[g] @ self.x[g].mean(axis=0)).argmax()] for g in np.split(order, np.nonzero(np.diff(own[order]))[0] + 1)])

    def beam_search(self, queries: np.ndarray, entries: np.ndarray, beam: int = BEAM, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the beams that greedy search from each query's entries ends with; a node -1 is none."""
        q, e = len(queries), entries.shape[1]
        xq = self.x[queries]
        own = np.arange(q)
        seen = np.zeros((q, self.n), bool)
        seen[own[:, None], entries] = True
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -2.0, np.float32)
        done = np.ones((q, beam), bool)
        ids[:, :e], done[:, :e] = entries, False
        sims[:, :e] = np.einsum("qed,qd->qe", self.x[entries], xq)
        for _ in range(rounds):
            open_ = np.where(done, -3.0, sims)
            at = open_.argmax(axis=1)
            act = np.nonzero(open_[own, at] > -2)[0]
            if not len(act):
                break
            done[act, at[act]] = True
            node = ids[act, at[act]]
            lo, hi = self.at[node], self.at[node + 1]
            while len(act):  # a long list in several turns, so that memory doesn't follow the longest
                place = lo[:, None] + np.arange(WIDTH)
                fresh = place < hi[:, None]
                nb = self.tails[np.where(fresh, place, 0)]
                fresh &= ~seen[act[:, None], nb]
                s = np.einsum("qrd,qd->qr", self.x[nb], xq[act], optimize=True)
                s[~fresh] = -2
                seen[np.broadcast_to(act[:, None], nb.shape)[fresh], nb[fresh]] = True
                all_s = np.concatenate([sims[act], s], axis=1)
                keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
                sims[act] = np.take_along_axis(all_s, keep, 1)
                ids[act] = np.take_along_axis(np.concatenate([ids[act], np.where(fresh, nb, -1)], axis=1), keep, 1)
                done[act] = np.take_along_axis(np.concatenate([done[act], ~fresh], axis=1), keep, 1)
                lo = lo + WIDTH
                more = lo < hi
                act, lo, hi = act[more], lo[more], hi[more]
        return ids, sims

    def range_search(self, low: float):
        """Arrays (query, found) of everything found within the range of every node, some queries at a time."""
        if self.n < 2:
            return
        medoids = self.medoids()
        step = max(1, min(self.n, CELLS // max(WIDTH * self.x.shape[1], len(medoids))))
        starts, entry = [], np.empty(self.n, np.int64)
        for i in range(0, self.n, step):
            queries = np.arange(i, min(i + step, self.n))
            order = np.argsort(-(self.x[queries] @ self.x[medoids].T), axis=1, kind="stable")[:, :2]
            entry[queries] = order[:, 0]
            ids, sims = self.beam_search(queries, medoids[order])
            near = (sims >= low) & (ids >= 0) & (ids != queries[:, None])
            k, at = np.nonzero(near)
            starts.append(np.stack([queries[k], ids[k, at]]))
        # a node's own list holds what is nearest to it
        heads = np.repeat(np.arange(self.n), np.diff(self.at))
        step = max(1, CELLS // self.x.shape[1])
        for i in range(0, len(heads), step):
            h, t = heads[i : i + step], self.tails[i : i + step]
            near = np.einsum("ed,ed->e", self.x[h], self.x[t]) >= low
            starts.append(np.stack([h[near], t[near]]))
        who, first = np.concatenate(starts, axis=1)
        order = np.argsort(entry[who] * self.n + who, kind="stable")
        who, first = who[order], first[order]
        queries, begin = np.unique(entry[who] * self.n + who, return_index=True)
        queries, begin = queries % self.n, np.append(begin, len(who))
        for i in range(0, len(queries), TOGETHER):
            some = queries[i : i + TOGETHER]
            front = np.unique(np.concatenate([some, first[begin[i] : begin[min(i + TOGETHER, len(queries))]]]))
            seen = np.zeros(self.n, bool)
            seen[front] = True
            while len(front):
                hit = self.x[some] @ self.x[front].T >= low
                q, f = np.nonzero(hit)
                yield some[q], front[f]
                front = np.unique(self.neighbours(front[hit.any(axis=0)]))
                front = front[~seen[front]]
                seen[front] = True


def _nodes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, type]:
    """(rows: id and packed vector or null; nodes: node, packed, dim, low, mult; type of the packed components)."""
    single = isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64
    v = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    kept = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))

    def pack(batches):
        for b in batches:
            a = b.column(1)
            at = np.asarray(a.offsets).astype(np.int64)
            values = np.asarray(a.values.fill_null(0.0)).astype(kind) + kind(0)  # no negative zeros
            raw = [values[p:q].tobytes() if ok else None for p, q, ok in zip(at[:-1].tolist(), at[1:].tolist(), np.asarray(a.is_valid()).tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "packed"])

    rows = materialize(kept.mapInArrow(pack, f"id {kept.schema['id'].dataType.simpleString()}, packed binary"), "emb-rows")
    nodes = rows.filter("packed is not null").groupBy("packed").agg(F.min("id").alias("low"), F.count("*").alias("mult"))
    size = np.dtype(kind).itemsize
    return rows, materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "packed", (F.octet_length("packed") / size).cast("int").alias("dim"), "low", "mult"), "emb-nodes"), kind


def k_means(x: np.ndarray, k: int, apart: float, rounds: int = 4) -> np.ndarray:
    """Spherical k-means from the first k rows; centroids of a cosine of `apart` or more become one."""
    c = x[:k].copy()
    for r in range(rounds + 1):
        if r == rounds:
            keep: list[int] = []
            for i in range(len(c)):
                if not keep or (c[keep] @ c[i]).max() < apart:
                    keep.append(i)
            if len(keep) == len(c):
                break
            c = c[keep]
        step = max(1, CELLS // len(c))
        own = np.concatenate([(x[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(x), step)])
        order = np.argsort(own, kind="stable")
        for mine in np.split(order, np.nonzero(np.diff(own[order]))[0] + 1):
            total = x[mine].sum(axis=0)
            if (s := np.linalg.norm(total)) > 0:
                c[own[mine[0]]] = total / s
    return c


def centroids(nodes: DataFrame, n: int, kind, apart: float = MIN_COSINE) -> np.ndarray:
    """Up to MAX_CENTROIDS, fitted on a bounded sample in hash order."""
    wanted = min(MAX_CENTROIDS, max(1, -(-n // PER_CENTROID)))
    rows = max(CENTROID_SAMPLE, PER_FIT * wanted)
    raw = [r["packed"] for r in nodes.orderBy(F.xxhash64("packed"), "node").limit(rows).select("packed").collect()]
    x = _vectors(pa.array(raw, pa.binary()), kind)
    return k_means(x, min(wanted, len(x)), apart)


def _nearest(x: np.ndarray, cents: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, cosine) of the m nearest centroids of every row, nearest first."""
    step = max(1, CELLS // len(cents))
    tops, cosines = [], []
    for i in range(0, len(x), step):
        s = x[i : i + step] @ cents.T
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        own = np.take_along_axis(s, top, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        tops.append(np.take_along_axis(top, order, 1))
        cosines.append(np.take_along_axis(own, order, 1))
    return np.concatenate(tops), np.concatenate(cosines)


def _core_from(min_cosine: float) -> float:
    """Two vectors this near to a third are certainly within the range of each other."""
    return math.cos(math.acos(min_cosine) / 2) + 1e-9


def _assign(nodes: DataFrame, n: int, kind, min_cosine: float, more: int) -> tuple[DataFrame, int]:
    """((node, packed, mult, shards, core), stored; shards a node): core is the centroid within half the range, or -1."""
    cents = centroids(nodes, n, kind, min_cosine)
    core_from = _core_from(min_cosine)
    if n <= MAX_CENTROIDS * PER_CENTROID:
        m = min(overlap(len(cents)) + more, len(cents))

        def near(batches):
            for b in batches:
                if b.num_rows:
                    top, cos = _nearest(_vectors(b.column(1), kind), cents, m)
                    core = np.where(cos[:, 0] >= core_from, top[:, 0], -1)
                    shards = pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1, dtype=np.int32) * m), pa.array(np.sort(top, axis=1).ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*b.columns, shards, pa.array(core, pa.int64())], names=["node", "packed", "mult", "shards", "core"])

        return materialize(nodes.select("node", "packed", "mult").mapInArrow(near, "node long, packed binary, mult long, shards array<long>, core long"), "emb-near"), m

    wide = min(overlap(len(cents)) + more, len(cents))

    def cells(batches):
        for b in batches:
            if b.num_rows:
                top, _ = _nearest(_vectors(b.column(1), kind), cents, wide)
                picked = np.repeat(np.arange(len(top)), wide)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(picked)), b.column(1).take(pa.array(picked)), pa.array(top.ravel(), pa.int64()), pa.array(np.tile(np.arange(wide) == 0, len(top)))], names=["node", "packed", "cell", "own"])

    dealt = materialize(nodes.select("node", "packed").mapInArrow(cells, "node long, packed binary, cell long, own boolean"), "emb-cells")

    def fit(t: pa.Table) -> pa.Table:
        x = _vectors(t.column("packed"), kind)
        c = k_means(x, -(-len(x) // PER_FIT), min_cosine)
        return pa.table({"cell": t.column("cell").slice(0, 1), "cents": pa.array([c.tobytes()], pa.binary()), "k": pa.array([len(c)], pa.int64())})

    sample = dealt.filter(F.col("own") & (F.pmod(F.xxhash64("packed"), F.lit(PER_CENTROID)) < PER_FIT))
    fitted = materialize(sample.groupBy("cell").applyInArrow(fit, "cell long, cents binary, k long"), "emb-cents")
    total = fitted.agg(F.sum("k")).first()[0] or 1
    m = overlap(total) + more
    salts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias("salts"))
    # at most MAX_CENTROIDS rows of numbers
    left = dealt.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    right = salts.join(fitted, "cell").select(F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"), "cents")
    dim = cents.shape[1]

    def inner(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        none = pa.table({"node": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        if not l.num_rows:
            return none
        cell = l.column("cell")[0].as_py()
        own = np.frombuffer(r.column("cents")[0].as_py(), np.float64).reshape(-1, dim) if r.num_rows else cents[cell : cell + 1]  # a cell that no sampled node is nearest to
        few = min(m, len(own))
        top, cos = _nearest(_vectors(l.column("packed"), kind), own, few)
        return pa.table({"node": np.repeat(l.column("node").to_numpy(), few), "shard": (cell << 32) + top.ravel(), "cos": cos.ravel()})

    met = left.groupBy("cell", "salt").cogroup(right.groupBy("of", "part")).applyInArrow(inner, "node long, shard long, cos double")
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("cos", "shard")), asc=False), 1, m).alias("best"))
    core = F.when(F.col("best")[0]["cos"] >= core_from, F.col("best")[0]["shard"]).otherwise(F.lit(-1).cast("long"))
    out = nodes.select("node", "packed", "mult").join(best, "node").select("node", "packed", "mult", F.array_sort(F.transform("best", lambda b: b["shard"])).alias("shards"), core.alias("core"))
    out = materialize(out, "emb-near")
    release(dealt, fitted)
    return out, m


def _dealt(near: DataFrame, m: int) -> DataFrame:
    """(shard, a, b, block, node, packed, mult, shards, core): blocks a and b of a shard meet in one task; shards: all of the node's."""
    limit = SHARD * m // OVERLAP
    rows = near.select("node", "packed", "mult", "shards", "core", F.explode("shards").alias("shard")).withColumn("inner", F.col("core") == F.col("shard"))
    half = max(1, limit // 2)
    sizes = near.select(F.explode("shards").alias("shard"), "core").groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("core") == F.col("shard")).alias("c"))
    sizes = sizes.select("shard", F.when(F.col("n") <= limit, 0).otherwise(F.ceil(F.col("c") / half)).cast("int").alias("cores"), F.when(F.col("n") <= limit, 1).otherwise(F.ceil((F.col("n") - F.col("c")) / half)).cast("int").alias("rests"))
    rows = rows.join(sizes, "shard")
    spread = F.col("inner") & (F.col("cores") > 0)
    rows = rows.withColumn("block", F.when(spread, F.pmod(F.xxhash64("node"), F.col("cores"))).otherwise(F.col("cores") + F.pmod(F.xxhash64("node"), F.greatest("rests", F.lit(1)))).cast("int"))
    # blocks of core nodes meet only those of the rest
    others = F.when(F.col("rests") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.when(spread, F.col("cores")).otherwise(0), F.col("cores") + F.col("rests") - 1))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("shard", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "packed", "mult", "shards", "core")


_DEALT = "shard long, a int, b int, block int, node long, packed binary, mult long, shards array<long>, core long"


def find_links(nodes: DataFrame, n: int, kind, min_cosine: float = MIN_COSINE, more: int = 0) -> tuple[DataFrame, DataFrame]:
    """(counts: node, n; links: a, b), stored: links met by nodes, weighted by multiplicity, and links that span components."""
    near, m = _assign(nodes, n, kind, min_cosine, more)

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_numpy()
        h, nb = build_graph(_vectors(t.column("packed"), kind).astype(np.float32))
        return t.append_column("nb", _list_array(h, ids[nb], len(ids)))

    key = ["shard", "a", "b"]
    graph = materialize(_dealt(near, m).groupBy(*key).applyInArrow(build, _DEALT + ", nb array<long>"), "emb-graph")
    # nearest first: the k-th neighbours of all shards before the next ones
    ranked = F.array_sort(F.flatten(F.collect_list(F.transform("nb", lambda e, k: F.struct(k.alias("k"), e.alias("other"))))))
    united = graph.groupBy("node").agg(F.slice(F.array_distinct(F.transform(ranked, lambda e: e["other"])), 1, UNITED).alias("united"))

    def search(t: pa.Table) -> pa.Table:
        ids, block, mult, core = (t.column(c).to_numpy() for c in ("node", "block", "mult", "core"))
        shard, cross, n = t.column("shard")[0].as_py(), t.column("a")[0].as_py() != t.column("b")[0].as_py(), len(t)
        shards = _padded(*_lists(t.column("shards")), n)
        exact = _vectors(t.column("packed"), kind)
        order = np.argsort(ids)
        heads, tails = [], []
        for c in ("nb", "united"):
            h, v = _lists(t.column(c))
            at = np.minimum(np.searchsorted(ids[order], v), n - 1)
            here = ids[order][at] == v
            heads.append(h[here])
            tails.append(order[at[here]])
        graph = Graph(exact.astype(np.float32), np.concatenate(heads), np.concatenate(tails))
        seen, held = [np.zeros(0, np.int64)], 0
        step = max(1, CELLS // max(exact.shape[1], shards.shape[1] ** 2))
        for qs, hits in graph.range_search(min_cosine - SLACK):
            for at in range(0, len(qs), step):
                i, j = qs[at : at + step], hits[at : at + step]
                ok = (i != j) & ((core[i] < 0) | (core[i] != core[j]))  # a core's nodes are counted elsewhere
                if cross:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                ok = np.einsum("pd,pd->p", exact[i], exact[j]) >= min_cosine
                i, j = i[ok], j[ok]
                common = (shards[i][:, :, None] == shards[j][:, None, :]).any(axis=2) & (shards[i] >= 0)
                ok = np.where(common, shards[i], np.iinfo(np.int64).max).min(axis=1) == shard
                # both directions count, whichever search found the pair
                seen.append(np.minimum(i, j)[ok] * n + np.maximum(i, j)[ok])
                held += len(seen[-1])
            if held > CELLS:
                seen = [np.unique(np.concatenate(seen))]
                held = 0
        pairs = np.unique(np.concatenate(seen))
        i, j = pairs // n, pairs % n
        met = np.bincount(i, mult[j], n) + np.bincount(j, mult[i], n)
        return pa.table({"node": ids, "n": met.astype(np.int64), "root": ids[roots(n, i, j)]})

    found = graph.join(united, "node", "left").groupBy(*key).applyInArrow(search, "node long, n long, root long")
    found = materialize(found.filter("n > 0"), "emb-found")
    inner = near.filter("core >= 0")
    cores = inner.groupBy("core").agg(F.sum("mult").alias("total"), F.min("node").alias("head"))
    held = materialize(inner.select("node", "mult", "core").join(cores, "core").select("node", (F.col("total") - F.col("mult")).alias("n"), F.col("head").alias("root")), "emb-cores")
    all_ = found.unionByName(held)
    counts = materialize(all_.groupBy("node").agg(F.sum("n").alias("n")), "emb-counts")
    links = materialize(all_.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "emb-links")
    release(near, graph, found, held)
    return counts, links


def exact_links(nodes: DataFrame, min_cosine: float, kind) -> tuple[DataFrame, DataFrame]:
    """find_links() by comparing all pairs of blocks of the nodes, without a graph: whole, but it grows with the square."""
    near = nodes.select("node", "packed", "mult", F.array(F.lit(0).cast("long")).alias("shards"), F.lit(-1).cast("long").alias("core"))

    def compare(t: pa.Table) -> pa.Table:
        ids, block, mult = (t.column(c).to_numpy() for c in ("node", "block", "mult"))
        cross, n = t.column("a")[0].as_py() != t.column("b")[0].as_py(), len(t)
        x = _vectors(t.column("packed"), kind)
        met, low = np.zeros(n, np.int64), np.arange(n)
        step = max(1, CELLS // n)
        for at in range(0, n, step):
            here = np.arange(at, min(at + step, n))
            hit = x[here] @ x.T >= min_cosine
            hit[np.arange(len(here)), here] = False
            if cross:
                hit &= block[here][:, None] != block
            met[here] = hit @ mult
            i, j = np.nonzero(hit)
            low = roots(n, np.concatenate([np.arange(n), here[i]]), np.concatenate([low, j]))
        return pa.table({"node": ids, "n": met, "root": ids[low]})

    found = materialize(_dealt(near, OVERLAP).groupBy("shard", "a", "b").applyInArrow(compare, "node long, n long, root long").filter("n > 0"), "emb-found")
    counts = materialize(found.groupBy("node").agg(F.sum("n").alias("n")), "emb-counts")
    links = materialize(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "emb-links")
    release(found)
    return counts, links


def audit(nodes: DataFrame, counts: DataFrame, kind, min_cosine: float = MIN_COSINE) -> float | None:
    """How well counts.n agrees with brute force, a mean over nodes (of one length) that have links; None where too few of them were met.

    Nodes found to have few links and nodes of groups are judged apart, and the worse mean counts, so that a
    dense group can't hide lost pairs. Of either kind AUDIT nodes in hash order meet all nodes; where fewer than
    AUDIT_LINKED of them have links, AUDIT_MOST do. A node's share is the smaller count by the larger one, so links
    too many lower it as much as links too few. A kind all of whose nodes were asked is measured, however few have links.
    """
    known = materialize(nodes.join(counts, "node", "left").select("node", "packed", "mult", F.coalesce("n", F.lit(0)).alias("got")), "emb-audit")

    def agreement(some: DataFrame) -> float | None:
        asked = some.orderBy(F.xxhash64(F.lit(3), "packed"), "node").limit(AUDIT_MOST).collect()
        shares, at = [], 0
        while at < len(asked) and len(shares) < AUDIT_LINKED:
            part = asked[at : AUDIT if at == 0 else None]
            at += len(part)
            q = _vectors(pa.array([r["packed"] for r in part], pa.binary()), kind)
            true = brute(q)
            pairs = [(true[k] - r["mult"], r["got"]) for k, r in enumerate(part)]
            shares += [min(p) / max(p) for p in pairs if max(p) > 0]
        if len(shares) < AUDIT_LINKED and (at < len(asked) or len(asked) == AUDIT_MOST):
            return None
        return sum(shares) / len(shares) if shares else 1.0

    def brute(q: np.ndarray) -> list[int]:
        def count(batches):
            n = np.zeros(len(q), np.int64)
            for b in batches:
                if b.num_rows:
                    x, mult = _vectors(b.column(0), kind), b.column(1).to_numpy()
                    step = max(1, CELLS // len(q))
                    for i in range(0, len(x), step):
                        n += mult[i : i + step] @ (x[i : i + step] @ q.T >= min_cosine)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(q)), pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

        met = known.select("packed", "mult").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        return [n for _, n in sorted(met)]

    both = [agreement(known.filter(F.col("got") < GROUP)), agreement(known.filter(F.col("got") >= GROUP))]
    release(known)
    measured = min((r for r in both if r is not None), default=None)
    return measured if None not in both or (measured is not None and measured < LEAST_RECALL) else None


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, n_links, component, kept, recall), one row per row of vectors; recall is what the audit measured, of the worst length, or null where it could not."""
    rows, nodes, kind = _nodes(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    counts = spark.createDataFrame([], "node long, n long")
    links = spark.createDataFrame([], "a long, b long")
    measured, stored = [], []
    for r in nodes.groupBy("dim").count().orderBy("dim").collect():  # vectors of different length never meet
        own = nodes.filter(F.col("dim") == r["dim"])
        for more in range(0, 2 * TRIES, 2):
            c, e = find_links(own, r["count"], kind, min_cosine, more)
            recall = audit(own, c, kind, min_cosine)
            if recall is None or recall >= LEAST_RECALL:
                break
            release(c, e)
        else:
            warnings.warn(f"recall of near-duplicates was {recall:.3f} after {TRIES} tries: all blocks are compared", stacklevel=2)
            c, e = exact_links(own, min_cosine, kind)
            recall = 1.0
        measured.append(recall)
        stored += [c, e]
        counts, links = counts.unionByName(c), links.unionByName(e)
    worst = None if None in measured else min(measured, default=1.0)
    comps = connected_components(links)
    known = materialize(nodes.join(counts, "node", "left").join(comps, "node", "left").select("packed", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "emb-known")
    lows = materialize(known.groupBy("root").agg(F.min("low").alias("component")), "emb-lows")
    named = materialize(known.join(lows, "root").select("packed", "n_links", "component"), "emb-named")
    release(nodes, comps, known, lows, *stored)
    linked = rows.filter("packed is not null").join(named, "packed").select("id", "n_links", "component")
    alone = rows.filter("packed is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False))).withColumn("recall", F.lit(worst).cast("double"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, and the recall that the audit measured."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept", "recall")
