"""Helpers shared by the training-data operators: tables, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}

#: Labels may be learnt only from rows whose crc32(doc_id) leaves another remainder than this.
HELD_OUT_MOD, HELD_OUT_REST = 4, 2
#: Edges whose components a task finds by itself.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only where all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="turnscope-")
    return _FALLBACK["dir"]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that names of any kind pass through a task; select("name.*") gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def release(*frames: DataFrame | None) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column) -> Column:
    rest = F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD
    return F.coalesce(rest == HELD_OUT_REST, F.lit(False))


def roots(n: int, i, j):
    """Smallest of n numbered nodes in the component of each, given links (i, j) as arrays: labels sink along links and are shortened."""
    import numpy as np

    low = np.arange(n)
    while len(i):
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        open_ = low[i] != low[j]
        if not open_.any():
            break
        # a link between labels is as good as the link itself
        i, j = low[i[open_]], low[j[open_]]
    while (low != low[low]).any():
        low = low[low]
    return low


def _contract(edges: DataFrame, tasks: int) -> DataFrame:
    """(u, v): the edges of each of some parts as links of its nodes to the smallest one reachable there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(held):
            u, v = (np.concatenate(c) for c in zip(*held))
            ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            low = ends[roots(len(ends), at[: len(u)], at[len(u) :])]
            far = low != ends
            return pa.RecordBatch.from_arrays([pa.array(ends[far]), pa.array(low[far])], names=["u", "v"])

        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= 2 * CHUNK:
                yield links(held)
                held, size = [], 0
        if size:
            yield links(held)

    return edges.select("u", "v").repartition(tasks).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60, chunk: int | None = None) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) of longs; root is the smallest node reachable.

    Edges are contracted in parts of about CHUNK, a task each; a graph of one part is done then. Alternating large-star and
    small-star rounds join what is left: each connects a node's neighbours to its
    smallest neighbour, so paths shorten geometrically and every step is an aggregate and an
    equi-join. The minima are stored apart, so that a hot hub's edges meet them in a plain join
    whose partitions adaptive execution can split. Self-links and null ends are ignored;
    repeated and reversed edges count once. The result reads a stored table: release() it when it has been read.
    """
    e = materialize(
        edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(),
        "cc-edges",
    )
    tasks = -(-e.count() // (chunk or CHUNK))
    if tasks:
        joined = _contract(e, tasks)
        new = materialize(joined.distinct() if tasks > 1 else joined, "cc-edges")
        release(e)
        e = new
    for _ in range(max_rounds):
        if tasks <= 1:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = materialize(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), "cc-edges")
        # both hold no edge twice, so equal counts and no new edge mean the same edges
        settled = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        release(e, low, large, least)
        e = new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)
    out._stored_at = e._stored_at
    return out


def slices(batch, text_col: int, most: int = 4 << 20):
    """Parts of an Arrow batch whose texts hold about `most` bytes, a longer single text alone; none is dropped."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int = 7) -> DataFrame:
    """(doc_id, text, y): the texts of at most `rows` labelled ids outside the held-out part, in hash order.

    The bound is a parameter of the operators that fit a model; it also bounds what is broadcast.
    Rows that repeat an id count once, with the smallest of their texts.
    """
    picked = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def logistic_fit(x, y, rounds: int = 50, ridge: float = 1e-3):
    """Weights of a logistic regression (Newton steps); the last one is the intercept."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
