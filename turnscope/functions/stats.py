"""Statistical aggregates: spines, standard errors, distribution functions, bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions.ranks import global_places
from turnscope.functions.seeded import seeded_sums
from turnscope.sources.stored import stored


def sem(x: Column | str) -> Column:
    """Standard error of the mean, null for a single value."""
    return F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x)))


def on_spine(df: DataFrame, spine: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """df extended to every row of spine, missing values filled."""
    return spine.join(df, keys, "left").na.fill(fill)


def month_spine(spark, first: str, last: str, name: str = "month") -> DataFrame:
    months = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("m")).select(F.date_format("m", "yyyy-MM-dd").alias(name))


#: A table of groups up to this many rows is broadcast.
BROADCAST_GROUPS = 10_000


def ecdf(df: DataFrame, value: str, by: list[str], tie: list[str]) -> DataFrame:
    """df with column ecdf: rank of the row within its group over the size of the group. Rows without a value have none and go.

    Rows are placed in the order of group, value and tie by range partitions, so neither a group nor a value that fills the
    table is one window; a group's first place makes ranks of places. The result reads a stored table.
    """
    placed = global_places(df.filter(F.col(value).isNotNull()), *by, value, *tie, name="_place")
    groups = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_place").alias("_first"), F.count("*").alias("_all"))
    if not by:
        joined = placed.crossJoin(groups)  # one row
    else:
        few = F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups
        joined = placed.join(few, [placed[c].eqNullSafe(few[f"_{c}"]) for c in by])
    out = joined.withColumn("ecdf", (F.col("_place") - F.col("_first") + 1) / F.col("_all")).select(*df.columns, "ecdf")
    out._stored_at = placed._stored_at
    return out


def mean_ci(values: np.ndarray, confidence: float = 0.95, n_bootstrap: int = 10_000, seed: int = 0) -> tuple[int, float, float, float]:
    """(n, mean, low, high) of a percentile bootstrap; draws go in blocks, so memory is bounded, and match one draw of all."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return 0, np.nan, np.nan, np.nan
    if len(x) == 1:
        return 1, float(x[0]), float(x[0]), float(x[0])
    rng, means, step = np.random.default_rng(seed), np.empty(n_bootstrap), max(1, 4_000_000 // len(x))
    for at in range(0, n_bootstrap, step):
        k = min(step, n_bootstrap - at)
        means[at : at + k] = x[rng.integers(0, len(x), size=(k, len(x)))].mean(axis=1)
    a = 1 - confidence
    return len(x), float(x.mean()), float(np.quantile(means, a / 2)), float(np.quantile(means, 1 - a / 2))


def ratio_ci(numerator: np.ndarray, denominator: np.ndarray, confidence: float = 0.95, n_bootstrap: int = 10_000, seed: int = 0) -> tuple[int, float, float, float]:
    """(n, ratio of sums, low, high) over clusters, given each cluster's sums in the order of its key."""
    p, q = np.asarray(numerator, float), np.asarray(denominator, float)
    if not len(p):
        return 0, np.nan, np.nan, np.nan
    rng, out, step = np.random.default_rng(seed), [], max(1, 4_000_000 // len(p))
    for at in range(0, n_bootstrap, step):
        i = rng.integers(0, len(p), size=(min(step, n_bootstrap - at), len(p)))
        a, b = p[i].sum(axis=1), q[i].sum(axis=1)
        out.append(a[b > 0] / b[b > 0])
    r = np.concatenate(out)
    point = float(p.sum() / q.sum()) if q.sum() > 0 else np.nan
    if not len(r):
        return len(p), point, np.nan, np.nan
    a = 1 - confidence
    return len(p), point, float(np.quantile(r, a / 2)), float(np.quantile(r, 1 - a / 2))


def exact_mean_ci(df: DataFrame, by: list[str], value: str, order: list[str], **how) -> DataFrame:
    """Bootstrap per group with the seeded generator, value by value: for groups that fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m, lo, hi = mean_ci(pdf.sort_values(order)[value].to_numpy(), **how)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), n, m, lo, hi]], columns=[*by, "n", "mean", "ci_low", "ci_high"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(run, f"{kinds}, n long, mean double, ci_low double, ci_high double")


def exact_ratio_ci(df: DataFrame, by: list[str], cluster: str, numerator: str, denominator: str, **how) -> DataFrame:
    """Cluster bootstrap of a ratio of sums per group; clusters are summed by Spark first."""
    sums = df.filter(F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.sum(numerator).cast("double").alias("_p"), F.sum(denominator).cast("double").alias("_q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        n, m, lo, hi = ratio_ci(pdf["_p"].to_numpy(), pdf["_q"].to_numpy(), **how)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), n, m, lo, hi]], columns=[*by, "n_clusters", "ratio", "ci_low", "ci_high"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return sums.groupBy(*by).applyInPandas(run, f"{kinds}, n_clusters long, ratio double, ci_low double, ci_high double")


def _by_response(df: DataFrame, response: list[str], group: str, groups: list[str], by: list[str], value: str | None) -> DataFrame:
    """Per response an array of numerators and one of denominators by group: sums and counts of value, or claims of the group and all claims."""
    cell = lambda x: F.array(*[F.coalesce(F.sum(F.when(F.col(group) == g, x)), F.lit(0)).cast("double") for g in groups])
    p = cell(F.lit(1) if value is None else F.col(value).cast("double"))
    q = F.array(*[F.count("*").cast("double")] * len(groups)) if value is None else cell(F.col(value).isNotNull().cast("int"))
    return df.groupBy(*by, *response).agg(p.alias("_p"), q.alias("_q"))


def exact_group_ci(df: DataFrame, by: list[str], response: list[str], group: str, groups: list[str], value: str | None = None, n_bootstrap: int = 1_000, seed: int = 42, confidence: float = 0.95, **dealt) -> DataFrame:
    """Seeded bootstrap by response, the same draws for all groups: means of value, or shares of claims where value is None.

    Responses are summed by Spark first and drawn in the order of their keys, replicates and responses dealt to tasks by seeded_sums(), which takes `dealt`.
    The draws are numpy's and as many as responses times n_bootstrap; poisson_group_ci() draws fewer.
    """
    if not by:
        whole = exact_group_ci(df.withColumn("_one", F.lit(1)), ["_one"], response, group, groups, value, n_bootstrap, seed, confidence, **dealt)
        return whole.drop("_one")
    k = len(groups)
    sums = stored(_by_response(df, response, group, groups, by, value).select(*by, *response, F.concat("_p", "_q").alias("_v")), "responses")
    reps = seeded_sums(sums, by, response, "_v", 2 * k, n_bootstrap, seed, **dealt)
    total = sums.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.array(*[F.sum(F.col("_v")[i]) for i in range(2 * k)]).alias("_total"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # a row per replicate
        head, drawn, rows = pdf.iloc[0], np.stack(pdf["sums"].to_list()), []
        for i, g in enumerate(groups):
            q = drawn[:, k + i]
            ratios = np.divide(drawn[:, i], q, out=np.full(len(q), np.nan), where=q > 0)
            ratios = ratios[np.isfinite(ratios)]
            ends = np.quantile(ratios, [(1 - confidence) / 2, (1 + confidence) / 2]) if len(ratios) else (np.nan, np.nan)
            p_all, q_all = head["_total"][i], head["_total"][k + i]
            rows.append([*(head[c] for c in by), g, int(p_all if value is None else q_all), int(head["n"]), p_all / q_all if q_all > 0 else np.nan, *ends])
        return pd.DataFrame(rows, columns=[*by, group, "n", "n_responses", "estimate", "ci_low", "ci_high"])

    kinds = "".join(f"{c} {sums.schema[c].dataType.simpleString()}, " for c in by)
    full = reps.join(total, [reps[c].eqNullSafe(total[f"_{c}"]) for c in by]).select(*by, "n", "sums", "_total")
    return full.groupBy(*by).applyInPandas(run, f"{kinds}{group} string, n long, n_responses long, estimate double, ci_low double, ci_high double")


def poisson_group_ci(df: DataFrame, by: list[str], response: list[str], group: str, groups: list[str], value: str | None = None, replicates: int = 200, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """The same estimates and intervals at any size, by Poisson weights of responses from hashes."""
    sums = _by_response(df, response, group, groups, by, value).withColumn("_response", F.xxhash64(*response))
    cells = sums.select(*by, "_response", F.posexplode(F.arrays_zip("_p", "_q")).alias("_g", "_c")).select(*by, "_response", F.element_at(F.array(*[F.lit(g) for g in groups]), F.col("_g") + 1).alias(group), "_c._p", "_c._q")
    n = cells.groupBy(*by, group).agg(F.sum("_p" if value is None else "_q").cast("long").alias("n"))
    ci = poisson_ratio_ci(cells, [*by, group], "_response", "_p", "_q", replicates, seed, confidence)
    return ci.join(n, [*by, group]).select(*by, group, "n", F.col("n_clusters").alias("n_responses"), F.col("ratio").alias("estimate"), "ci_low", "ci_high")


def poisson_ratio_ci(df: DataFrame, by: list[str], cluster: str, numerator: str, denominator: str, replicates: int = 200, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """The same for any size: each cluster takes part in each replicate a Poisson(1) number of times, drawn from a hash.

    Replicates are aggregated map-side, so what is shuffled grows with groups times replicates only.
    """
    sums = df.filter(F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.sum(numerator).cast("double").alias("_p"), F.sum(denominator).cast("double").alias("_q"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("_rep"), F.col(cluster)), F.lit(1 << 40)) / float(1 << 40)
    steps, total, term = [], 0.0, np.exp(-1.0)
    for k in range(10):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum((u >= s).cast("int") for s in steps)
    reps = sums.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight)
    per = reps.groupBy(*by, "_rep").agg((F.try_divide(F.sum(F.col("_w") * F.col("_p")), F.sum(F.col("_w") * F.col("_q")))).alias("_r"))
    a = 1 - confidence
    ci = per.groupBy(*by).agg(F.percentile("_r", F.lit(a / 2)).alias("ci_low"), F.percentile("_r", F.lit(1 - a / 2)).alias("ci_high"))
    point = sums.groupBy(*by).agg(F.count("*").alias("n_clusters"), F.try_divide(F.sum("_p"), F.sum("_q")).alias("ratio"))
    return point.join(ci, by) if by else point.crossJoin(ci)
