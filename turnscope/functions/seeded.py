"""numpy's seeded bootstrap, draw for draw, with its replicates and its rows dealt to tasks.

Replicate after replicate, default_rng(seed) draws n places of n. Where a range of replicates begins in that stream is found by
drawing alone, which needs n and no rows; a task then draws its own replicates from there. Rows are kept as numbers into their
distinct vectors, packed in chunks of places, so counts of a few groups take four bytes a row on the way and one or two in the task. Chunks of a group of rows over STRETCH
bytes are dealt to more tasks, each of which repeats the draws and counts those that fall to its places: memory stays bounded, and time
grows with the square of what lies beyond one stretch.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions.ranks import global_places
from turnscope.sources.stored import stored

#: Rows of a chunk, bytes of chunks that a task holds, draws at a time, and ranges of replicates.
CHUNK, STRETCH, DRAWS, RANGES = 1 << 18, 1 << 26, 1 << 18, 20
#: Tables of groups up to this many rows are broadcast.
BROADCAST_GROUPS = 10_000


def _pack(rows: np.ndarray) -> tuple[bytes, bytes]:
    """(numbers, vectors): each row's number among the distinct rows, and these one after the other."""
    width = rows.shape[1] * 8
    found = pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).dictionary_encode()
    return found.indices.to_numpy().astype(np.uint32).tobytes(), b"".join(found.dictionary.to_pylist())


def _unpack(numbers: list[bytes], vectors: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """One array of numbers for chunks in a row, in the smallest type that holds them, and the distinct vectors."""
    each = [np.frombuffer(v).reshape(-1, width) for v in vectors]
    distinct, to = np.unique(np.concatenate(each), axis=0, return_inverse=True)
    to, kind = to.reshape(-1), np.min_scalar_type(len(distinct) - 1)
    out, at, start = np.empty(sum(len(x) for x in numbers) // 4, kind), 0, 0
    for x, v in zip(numbers, each):
        own = np.frombuffer(x, np.uint32)
        out[at : at + len(own)] = to[start : start + len(v)].astype(kind)[own]
        at, start = at + len(own), start + len(v)
    return out, distinct


def _starts(n: int, replicates: int, ranges: int, seed: int) -> list[tuple[int, int, str]]:
    """(first, behind the last, state of the generator) for ranges of replicates; draws are made and dropped."""
    rng, cuts, out = np.random.default_rng(seed), [replicates * i // ranges for i in range(ranges + 1)], []
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            out.append((low, high, json.dumps(rng.bit_generator.state)))
        for _ in range(high - low if high < replicates else 0):
            for at in range(0, n, DRAWS):
                rng.integers(0, n, size=min(DRAWS, n - at))
    return out


def _drawn(state: str, replicates: int, n: int, first: int, numbers: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(replicates, columns): sums over the draws that fall to the places from first on which numbers has."""
    rng, whole, step = np.random.default_rng(), len(numbers) == n, max(DRAWS, len(vectors))
    rng.bit_generator.state = json.loads(state)
    out = np.empty((replicates, vectors.shape[1]))
    for k in range(replicates):
        counts = np.zeros(len(vectors), np.int64)
        for at in range(0, n, step):
            i = rng.integers(0, n, size=min(step, n - at))
            if not whole:
                i = i[(i >= first) & (i < first + len(numbers))] - first
            counts += np.bincount(numbers[i], minlength=len(vectors))
        out[k] = counts @ vectors
    return out


def seeded_sums(sums: DataFrame, by: list[str], order: list[str], values: str, width: int, replicates: int, seed: int, chunk: int = CHUNK, stretch: int = STRETCH, ranges: int = RANGES) -> DataFrame:
    """(by, n, rep, sums): what default_rng(seed).integers(0, n, size=n) draws in each replicate from each group's n rows in order, summed over the array `values` of `width` doubles.

    sums is read twice: give a stored table. Nulls come last in the order. Sums of whole numbers are the same to the last bit however rows are dealt.
    """
    placed = global_places(sums.select(*by, *order, values), *by, *[F.col(c).asc_nulls_last() for c in order], name="_place")
    sizes = stored(placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_place").alias("_first"), F.count("*").alias("_n")), "sizes")
    groups = sizes.count()
    few = F.broadcast if groups <= BROADCAST_GROUPS else lambda x: x
    inside = F.col("_place") - F.col("_first")  # a group's first place is its number from here on
    rows = placed.join(few(sizes), [placed[c].eqNullSafe(sizes[f"_{c}"]) for c in by]).select("_first", F.floor(inside / chunk).alias("_chunk"), inside.alias("_at"), values)
    dealt = rows.repartition("_first", "_chunk").sortWithinPartitions("_first", "_chunk", "_at")

    def pack(batches):
        own, held = None, []

        def out():
            numbers, vectors = _pack(np.concatenate(held))
            return pa.RecordBatch.from_pydict({"_first": [own[0]], "_chunk": [own[1]], "_bytes": [len(numbers) + len(vectors)], "_numbers": [numbers], "_vectors": [vectors]})

        for b in batches:
            keys = np.column_stack([np.asarray(b.column(0)), np.asarray(b.column(1))])
            table = np.asarray(b.column(3).flatten()).reshape(-1, width)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    if held and tuple(keys[low].tolist()) != own:
                        yield out()
                        held = []
                    own = tuple(keys[low].tolist())
                    held.append(table[low:high])
        if held:
            yield out()

    chunks = stored(dealt.mapInArrow(pack, "_first long, _chunk long, _bytes long, _numbers binary, _vectors binary"), "chunks")
    # a row of lengths for each CHUNK rows: windows and what is broadcast are as small
    upto = F.sum("_bytes").over(W.partitionBy("_first").orderBy("_chunk"))
    spans = chunks.select("_first", "_chunk", F.floor((upto - 1) / stretch).alias("_stretch"))

    def starts(parts):
        for pdf in parts:
            yield from (pd.DataFrame([[first, n, *s] for s in _starts(n, replicates, ranges, seed)], columns=["_first", "_n", "_low", "_high", "_state"]) for first, n in pdf.itertuples(index=False))

    # dealt by number, which adaptive execution leaves alone: small rows, long work
    each = sizes.select("_first", "_n").repartition(max(1, min(groups, 200)))
    begun = stored(each.mapInPandas(starts, "_first long, _n long, _low int, _high int, _state string"), "starts")
    jobs = chunks.join(few(spans), ["_first", "_chunk"]).join(few(begun), "_first")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        first, n, low, high, at = (int(pdf[c].iloc[0]) for c in ("_first", "_n", "_low", "_high", "_chunk"))
        numbers, vectors = _unpack(pdf["_numbers"].tolist(), pdf["_vectors"].tolist(), width)
        drawn = _drawn(pdf["_state"].iloc[0], high - low, n, at * chunk, numbers, vectors)
        return pd.DataFrame([[first, low + k, list(v)] for k, v in enumerate(drawn)], columns=["_first", "rep", "sums"])

    parts = jobs.groupBy("_first", "_stretch", "_low").applyInPandas(draw, "_first long, rep int, sums array<double>")
    full = parts.groupBy("_first", "rep").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    return full.join(few(sizes), "_first").select(*[F.col(f"_{c}").alias(c) for c in by], F.col("_n").alias("n"), "rep", "sums")
