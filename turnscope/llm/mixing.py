"""Mixing sources to target weights, with DataFrame functions only.

Sources, in code point order with null last, weigh 5, 2, 1, 5, 2, 1 ... and share all words of
the corpus by weight. A target stops at three times its source's size; what it cannot take is
reshared by weight among the others until none is above. That fixpoint is a water level L with
target = min(cap, L x weight): with sources sorted by cap / weight, the first k that lie below
the level are capped, and L = (total - caps of those k) / (weights of the rest).
A document is then emitted floor(rate) times, rate = target / size of its source, and once more
if a hash of its id and text, seeded, falls below the fraction of the rate. The hash depends on nothing
but these, so reruns, retries and other partitionings agree.

Defined cases: null and empty texts have size 0 and are emitted like others of their source. A
source whose texts are all empty has target and rate 0. Rows with equal doc_id draw by their texts, as do
those without one; only rows that repeat both share a draw. Texts of any length count whole. A null source is a source of its own. Extra columns
ride along in emit() and are dropped by the rates; sizes are kept under names of their own.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release, table

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: A table of sources up to this many rows is broadcast (names are short); a larger one is joined by key.
BROADCAST_SOURCES = 5_000
SEED = 42


def word_count(text: Column) -> Column:
    """Number of runs of other characters than 20 and 09-0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed, id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target): sized has columns source and size. One row per source, so small beside the corpus."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", pick).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.select(
        "*",
        F.row_number().over(by_ratio).alias("place"),
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    level = F.try_divide((F.col("total") - F.col("caps_before")).cast("double"), F.col("weight_left"))
    # the level is that of the first source in this order which its cap does not stop
    w = w.withColumn("own_level", level).withColumn("open", F.col("own_level") * F.col("weight") <= F.col("cap"))
    w = w.withColumn("level", F.min_by("own_level", F.when(F.col("open"), F.col("place"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return w.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def with_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with source_size, target and rate; targets must be stored, as it is counted first."""
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    joined = sized.join(t, sized["source"].eqNullSafe(t["_source"])).drop("_source")
    return joined.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))


def copies(rate: Column, drawn: Column) -> Column:
    """floor(rate), and one more if the number drawn is below the fraction."""
    whole = F.floor(rate)
    return (whole + (drawn < rate - whole).cast("long")).cast("long")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, n_copies), one row per row of docs."""
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col), seed).alias("drawn")), "mix-sizes")
    rated = with_rates(sized, materialize(source_targets(sized), "mix-targets"))
    return rated.withColumn("n_copies", copies(F.col("rate"), F.col("drawn"))).drop("drawn")


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """docs with every row as often as the mix takes it; columns unchanged."""
    names = docs.columns
    sized = materialize(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    stored = materialize(source_targets(sized), "mix-targets")
    release(sized)
    targets = stored.select(F.col("source").alias("_mix_source"), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("_mix_rate"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_mix_row")
    packed = docs.select(row, F.col(source_col).alias("_mix_of"), draw(F.col(id_col), F.col(text_col), seed).alias("_mix_drawn"))
    joined = packed.join(targets, F.col("_mix_of").eqNullSafe(F.col("_mix_source")))
    n = copies(F.col("_mix_rate"), F.col("_mix_drawn"))
    return joined.withColumn("_mix_copy", F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))).select("_mix_row.*")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
    (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM sized GROUP BY source),
sums AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER b, 0) AS caps_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left
  FROM sizes WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT CAST(total - caps_before AS DOUBLE) / weight_left AS level FROM sums
  WHERE CAST(total - caps_before AS DOUBLE) / weight_left * weight <= cap ORDER BY cap / weight, source ASC NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM lev) * weight, CAST(cap AS DOUBLE))) AS target FROM sums),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
    CAST(('0x' || substr(md5('42:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':' || s.digest), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rated
"""
