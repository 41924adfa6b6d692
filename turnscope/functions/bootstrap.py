"""Cluster bootstraps with seeded draws that do not depend on how the rows are dealt, for any number of clusters.

A replicate draws n clusters of n with replacement: a multinomial over their places in the order of their keys. It is split without a list of draws:
the number that falls to the lower half of the places is a binomial, and so on for each half down to blocks of places; inside a
block the draws are a multinomial. Every split and every block has a counter-based generator of its own, keyed by seed and position, so a task that holds
a block finds its draws by the few splits above it, and any other dealing of the rows draws the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.functions.ranks import global_places

#: Places of a block, and numbers of draws held at once.
BLOCK, CELLS = 1_024, 1 << 21
#: A table of groups up to this many rows is broadcast.
BROADCAST_GROUPS = 10_000


def _generator(seed: int, kind: int, low: int, high: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), kind], counter=[0, 0, low, high]))


def _rows(low: int, high: int, n: int) -> int:
    return min(high * BLOCK, n) - low * BLOCK


class Draws:
    """How many of n draws fall to each place, for all replicates; blocks are asked for in ascending order, so the splits on the way are kept."""

    def __init__(self, n: int, replicates: int, seed: int):
        self.n, self.replicates, self.seed = n, replicates, seed
        self.path = [(0, -(-n // BLOCK), np.full(replicates, n, np.int64))]

    def _total(self, block: int) -> np.ndarray:
        while not self.path[-1][0] <= block < self.path[-1][1]:
            self.path.pop()
        low, high, total = self.path[-1]
        while high - low > 1:
            mid = (low + high) // 2
            left = _generator(self.seed, 1, low, high).binomial(total, _rows(low, mid, self.n) / _rows(low, high, self.n))
            low, high, total = (low, mid, left) if block < mid else (mid, high, total - left)
            self.path.append((low, high, total))
        return total

    def sums(self, block: int, values: np.ndarray) -> np.ndarray:
        """(replicates, columns): each replicate's sum over the draws of a block, of values (places, columns)."""
        total, k = self._total(block), _rows(block, block + 1, self.n)
        rng, step = _generator(self.seed, 2, block, block + 1), max(1, CELLS // k)
        even = np.full(k, 1 / k)
        return np.concatenate([rng.multinomial(total[i : i + step], even) @ values for i in range(0, self.replicates, step)])


def replicate_sums(sums: DataFrame, by: list[str], cluster: list[str], columns: list[str], replicates: int, seed: int) -> DataFrame:
    """(by, rep, columns): the sums of columns over the clusters that each replicate draws.

    sums: by, cluster, columns (doubles), one row per cluster and group. Sums of whole numbers are the same at any parallelism to the last bit.
    """
    placed = global_places(sums, *by, *cluster)
    sizes = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("place").alias("_first"), F.count("*").alias("_all"))
    few = F.broadcast(sizes) if not by or sizes.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else sizes
    rows = placed.join(few, [placed[c].eqNullSafe(few[f"_{c}"]) for c in by]) if by else placed.crossJoin(few)  # one row
    inside = F.col("place") - F.col("_first")
    rows = rows.select(*by, F.floor(inside / BLOCK).alias("_block"), inside.alias("_place"), "_all", *[F.col(c).cast("double").alias(c) for c in columns])
    dealt = rows.repartition(*by, "_block").sortWithinPartitions(*by, "_block", "_place")
    nb, nc = len(by), len(columns)

    def run(batches):
        own, draws, total, block, held = None, None, None, None, []

        def close():
            nonlocal held
            if held:
                total[:] += draws.sums(block, np.array(held))
            held = []

        def out():
            cols = [pa.array([v] * replicates, t) for v, t in zip(own, kinds)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(total[:, c]) for c in range(nc))], names=[*by, "rep", *columns])

        for b in batches:
            kinds = [b.column(i).type for i in range(nb)]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(nb)))) if nb else [()] * b.num_rows
            blocks, alls = b.column(nb).to_pylist(), b.column(nb + 2).to_pylist()
            values = np.column_stack([np.asarray(b.column(nb + 3 + c).fill_null(0.0)) for c in range(nc)]) if b.num_rows else np.zeros((0, nc))
            for i, key in enumerate(keys):
                if key != own or blocks[i] != block:
                    if own is not None:
                        close()
                    if key != own:
                        if own is not None:
                            yield out()
                        own, draws, total = key, Draws(alls[i], replicates, seed), np.zeros((replicates, nc))
                    block = blocks[i]
                held.append(values[i])
        if own is not None:
            close()
            yield out()

    kinds = "".join(f"{c} {sums.schema[c].dataType.simpleString()}, " for c in by)
    parts = dealt.mapInArrow(run, f"{kinds}rep int, {', '.join(f'{c} double' for c in columns)}")
    return parts.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in columns])


def split_ratio_ci(df: DataFrame, by: list[str], cluster: str, numerator: str, denominator: str, n_bootstrap: int = 10_000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """(by, n_clusters, ratio, ci_low, ci_high): percentile interval of a ratio of sums, clusters drawn whole; replicates without a denominator don't count."""
    sums = df.filter(F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.sum(numerator).cast("double").alias("_p"), F.sum(denominator).cast("double").alias("_q"))
    reps = replicate_sums(sums, by, [cluster], ["_p", "_q"], n_bootstrap, seed)
    drawn = reps.withColumn("_r", F.when(F.col("_q") > 0, F.col("_p") / F.col("_q")))
    a = 1 - confidence
    ci = drawn.groupBy(*by).agg(F.percentile("_r", F.lit(a / 2)).alias("ci_low"), F.percentile("_r", F.lit(1 - a / 2)).alias("ci_high"))
    point = sums.groupBy(*by).agg(F.count("*").alias("n_clusters"), F.when(F.sum("_q") > 0, F.sum("_p") / F.sum("_q")).alias("ratio"))
    return point.join(ci, [point[c].eqNullSafe(ci[c]) for c in by]).select(*[point[c] for c in by], "n_clusters", "ratio", "ci_low", "ci_high") if by else point.crossJoin(ci)  # a row each
