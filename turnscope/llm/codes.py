"""Vector code compression: product codes whose codebooks are fitted by Heap Lloyd.

Integer vectors are cut into equal parts; each part position has a codebook, refined by Lloyd's rounds with exact results.
Vectors live in chunks of bounded size, a row each, cut where they are read, without a shuffle. A chunk holds a heap for every entry of every
codebook, of the parts assigned to it, keyed by slack: how much farther the second nearest entry is than the own one (lower minus
upper bound), plus the entry's cumulative drift when the part was pushed. Drift grows each round by how far the entry moved and how far any other of
its codebook moved at most. While that is below a part's key, its entry is still the nearest, and it isn't looked at: only parts whose key the drift
has reached (ties included, with a margin for rounding) are popped, measured against all entries exactly, and pushed with a new key. Heaps are arrays in
ascending order, so what is popped is a prefix, and pushes are merged in.

What a round changes are sums of entries by the parts that moved, so chunks emit differences only, and the driver keeps
parts x entries x width sums. Codebooks, drifts and sums do not grow with the rows. Copies and hot labels cost nothing extra: no rows are grouped until the errors
are summed by label, combined on the map side.

Defined cases: rows whose vector is null or holds null or non-finite components are left out. All others have the length of the vector
with the smallest id; one of another length, and all if that isn't a multiple of the parts or is zero, get a null code and error. Scaled components beyond 2^27 count
as 2^27. Codebooks start from the smallest distinct ids (of rows that repeat an id the smallest vector); a null id starts one only if there are
too few others; fewer ids make smaller codebooks. Labels that are null are summed together; a label without any code has a null error. An empty table
gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table
from .integers import finite, floors, matrix, squared, two_nearest

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk.
CHUNK_ROWS = 8_192
#: A table of labels up to this many rows is broadcast; a larger one is joined by key.
BROADCAST_LABELS = 5_000
MARGIN, TINY = 1e-9, 1e-6


class Heaps:
    """Parts by (position, entry) in ascending order of their keys; `items` numbers a part row * parts + position."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, at: np.ndarray):
        self.keys, self.items, self.at = keys, items, at

    @classmethod
    def of(cls, group: np.ndarray, keys: np.ndarray, items: np.ndarray, n: int) -> Heaps:
        order = np.lexsort((keys, group))
        return cls(keys[order], items[order], np.searchsorted(group[order], np.arange(n + 1)))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Takes out the parts whose keys the drifts of their entries have reached."""
        n = len(self.at) - 1
        reach = drift * (1 + MARGIN) + TINY
        ends = np.array([lo + np.searchsorted(self.keys[lo:hi], reach[g], side="right") for g, (lo, hi) in enumerate(zip(self.at[:-1], self.at[1:]))], np.int64)
        out = np.zeros(len(self.items), bool)
        for lo, end in zip(self.at[:-1], ends):
            out[lo:end] = True
        gone, sizes = self.items[out], np.diff(self.at) - (ends - self.at[:-1])
        self.keys, self.items, self.at = self.keys[~out], self.items[~out], np.concatenate([[0], np.cumsum(sizes)])[: n + 1]
        return gone

    def push(self, group: np.ndarray, keys: np.ndarray, items: np.ndarray) -> None:
        """Merges parts into their heaps."""
        old = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        merged = Heaps.of(np.concatenate([old, group]), np.concatenate([self.keys, keys]), np.concatenate([self.items, items]), len(self.at) - 1)
        self.keys, self.items, self.at = merged.keys, merged.items, merged.at


def rescan(x: np.ndarray, codes: np.ndarray, heaps: Heaps, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(difference of counts, of sums by position and entry) of a round; codes and heaps are changed. x: (rows, parts, width); drift: cumulative, flat."""
    parts, entries = books.shape[:2]
    popped = heaps.pop(drift)
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    groups, keys = np.empty(len(popped), np.int64), np.empty(len(popped))
    position = popped % parts
    for p in range(parts):
        mine = np.nonzero(position == p)[0]
        if not len(mine):
            continue
        rows = popped[mine] // parts
        best, least, second = two_nearest(squared(x[rows, p], books[p]))
        groups[mine] = p * entries + best
        keys[mine] = np.sqrt(second) - np.sqrt(least)
        was = codes[rows, p]
        go = was != best
        np.add.at(counts[p], best[go], 1)
        np.add.at(sums[p], best[go], x[rows[go], p])
        left = go & (was >= 0)
        np.add.at(counts[p], was[left], -1)
        np.add.at(sums[p], was[left], -x[rows[left], p])
        codes[rows, p] = best
    heaps.push(groups, keys + drift[groups], popped)
    return counts, sums


def new_heaps(rows: int, parts: int, entries: int) -> Heaps:
    """Every part in the heap of its position's first entry, to be popped at once."""
    items = np.arange(rows * parts)
    return Heaps.of((items % parts) * entries, np.full(len(items), -np.inf), items, parts * entries)


_STATE = "n int, x binary, codes binary, keys binary, items binary, at binary, change binary"


def _chunks(rows: DataFrame, width: int, parts: int, entries: int) -> DataFrame:
    """A row a chunk: ids and labels as lists, vectors packed, every part unassigned."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK_ROWS):
                t = b.slice(at, CHUNK_ROWS)
                n, x = t.num_rows, matrix(t.column(2), width).astype(np.int32)
                heaps = new_heaps(n, parts, entries)
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t.column(c)) for c in (0, 1)]
                packed = [x.tobytes(), np.full((n, parts), -1, np.int16).tobytes(), heaps.keys.tobytes(), heaps.items.astype(np.int32).tobytes(), heaps.at.astype(np.int32).tobytes(), b""]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([n], pa.int32()), *(pa.array([v], pa.binary()) for v in packed)], names=["ids", "labels", "n", "x", "codes", "keys", "items", "at", "change"])

    return rows.select("id", "label", "q").mapInArrow(run, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, {_STATE}")


def _read(b: pa.RecordBatch, i: int, parts: int):
    n = b.column(2)[i].as_py()
    raw = [b.column(c)[i].as_py() for c in range(3, 8)]
    x = np.frombuffer(raw[0], np.int32).reshape(n, parts, -1).astype(np.int64)
    heaps = Heaps(np.frombuffer(raw[2], np.float64), np.frombuffer(raw[3], np.int32).astype(np.int64), np.frombuffer(raw[4], np.int32).astype(np.int64))
    return x, np.frombuffer(raw[1], np.int16).reshape(n, parts).astype(np.int64), heaps


def _round(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """State after one assignment; change holds what it did to counts and sums."""
    parts = len(books)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                x, codes, heaps = _read(b, i, parts)
                counts, sums = rescan(x, codes, heaps, books, drift.ravel())
                change = np.concatenate([counts.ravel(), sums.ravel()])
                packed = [codes.astype(np.int16).tobytes(), heaps.keys.tobytes(), heaps.items.astype(np.int32).tobytes(), heaps.at.astype(np.int32).tobytes(), change.tobytes()]
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:4], *(pa.array([v], pa.binary()) for v in packed)], names=b.schema.names)

    return state.mapInArrow(run, state.schema)


def _changes(state: DataFrame, size: int) -> list[int]:
    """What all chunks changed, summed exactly: a row a task, added up by position."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = [0] * size
    for r in state.select("change").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # a row a sum
        out[r["k"]] = int(r["v"])
    return out


def first_books(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width) from the smallest distinct ids, ascending."""
    first = rows.groupBy("id").agg(F.min("q").alias("q")).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    return np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """((id, label, codes array<int>, error), one row per vector kept; codebooks (parts, entries, width))."""
    v = F.col(f"`{vec_col}`")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("string")
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), floors(v, scale, finite(v)).alias("q")).filter("q is not null")
    first = kept.groupBy("id").agg(F.min("q").alias("q")).orderBy(F.col("id").asc_nulls_last()).select(F.size("q").alias("n")).limit(1).collect()
    width = first[0]["n"] if first else 0
    odd = kept if width == 0 or width % parts else kept.filter(F.size("q") != width)
    odd = odd.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    if width == 0 or width % parts:
        return odd, None
    rows = kept.filter(F.size("q") == width)
    books = first_books(rows, width, parts, entries)
    k, inner = books.shape[1], width // parts
    counts, sums = np.zeros((parts, k), object), np.zeros((parts, k, inner), object)
    drift = np.zeros((parts, k))
    state = materialize(_chunks(rows, width, parts, k), "codes-state")
    for r in range(rounds + 1):
        new = materialize(_round(state, books, drift), "codes-state")
        release(state)
        state = new
        if r == rounds:
            break
        change = np.array(_changes(state.select("change"), parts * k * (1 + inner)), object)
        counts, sums = counts + change[: parts * k].reshape(parts, k), sums + change[parts * k :].reshape(parts, k, inner)
        old, books = books, books.copy()
        for p, e in zip(*np.nonzero(counts)):
            books[p, e] = [s // counts[p, e] for s in sums[p, e]]
        step = np.sqrt(((books - old).astype(np.float64) ** 2).sum(axis=2))
        if k > 1:
            top = np.sort(step, axis=1)
            drift = drift + step + np.where(step == top[:, -1:], np.where((step == top[:, -1:]).sum(axis=1, keepdims=True) > 1, top[:, -1:], top[:, -2:-1]), top[:, -1:])

    def out(batches):
        for b in batches:
            for i in range(b.num_rows):
                x, codes, _ = _read(b, i, parts)
                away = x - books[np.arange(parts)[None, :], codes]
                error = (away * away).sum(axis=(1, 2))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.ravel(), pa.int32()))
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column(0).flatten(), one.column(1).flatten(), lists, pa.array(error)], names=["id", "label", "codes", "error"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    coded = materialize(state.mapInArrow(out, f"id {kinds[0]}, label {kinds[1]}, codes array<int>, error long"), "codes-out")
    release(state)
    return coded.unionByName(odd), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over equal labels; coded should be stored, as it is read twice."""
    sums = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    few = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(few, coded["label"].eqNullSafe(few["_label"])).drop("_label")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of finite components."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op12_sql() -> str:
    big, inner = f"{2.0**27:.1f}", 64 // PARTS
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(greatest(-{big}, least({big}, {SCALE} * x::DOUBLE)))::BIGINT) AS q
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"x AS MATERIALIZED (SELECT rid, p, q[{inner} * p + 1 : {inner} * p + {inner}] AS q FROM v, range({PARTS}) t(p) WHERE len(q) = {PARTS * inner})",
        f"f AS MATERIALIZED (SELECT min(q) AS q, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM v WHERE len(q) = {PARTS * inner} GROUP BY vec_id QUALIFY e < {ENTRIES})",
        f"c0 AS MATERIALIZED (SELECT p, e, q[{inner} * p + 1 : {inner} * p + {inner}] AS m FROM f, range({PARTS}) t(p))",
    ]
    dist = "list_sum(list_transform(list_zip(x.q, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, p, min(struct_pack(d := {dist}, e := c.e)) AS b FROM x JOIN c{r} c USING (p) GROUP BY rid, p)")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM
  (SELECT p, a.b.e AS e, i, sum(x.q[i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN x USING (rid, p), range(1, {inner + 1}) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.m, c.m) AS m FROM c{r} c LEFT JOIN m{r} m USING (p, e))")
    return f"""WITH {", ".join(steps)},
o AS (SELECT rid, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT v.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, (SELECT sha256(coalesce(string_agg(array_to_string(m, ','), ',' ORDER BY p, e), '')) FROM c{ROUNDS}) AS codebooks_sha256
FROM v LEFT JOIN o USING (rid)"""


OP12_SQL = _op12_sql()
