"""How queries are formulated: rounds, fan-out, terms, languages, token provenance, specificity.

A rounds table has one row per query: turn keys, round (from 1) and the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions.values import bucket


def per_turn(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Per turn: number of rounds, widest round, all queries."""
    by_round = rounds.groupBy(*keys, "round").agg(F.count("*").alias("n"))
    return by_round.groupBy(*keys).agg(F.count("*").alias("n_hops"), F.max("n").alias("widest"), F.sum("n").cast("long").alias("queries"))


def hops_by_fanout(turns: DataFrame) -> DataFrame:
    """Percent of turns by number of rounds (1, 2, 3+) and widest round (1, 2, 3+), all nine cells."""
    b = turns.select(bucket(F.col("n_hops"), 3).alias("hops"), bucket(F.col("widest"), 3).alias("fanout"))
    g = b.groupBy("hops", "fanout").agg(F.count("*").alias("n"))
    cells = turns.sparkSession.createDataFrame([(a, c) for a in ("1", "2", "3+") for c in ("1", "2", "3+")], "hops string, fanout string")
    full = cells.join(g, ["hops", "fanout"], "left").na.fill({"n": 0})
    return full.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def over_time(turns: DataFrame) -> DataFrame:
    """Per month: turns, mean rounds, mean widest round, mean queries."""
    return turns.groupBy("month").agg(F.count("*").alias("turns"), F.avg("n_hops").alias("mean_hops"), F.avg("widest").alias("mean_widest"), F.avg("queries").alias("mean_queries"))


def term_metrics(q: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and median of terms."""
    return q.groupBy(*by).agg(F.count("*").alias("n"), F.avg("terms").alias("mean_terms"), F.median("terms").alias("median_terms"))


def retrieved_per_query(t: DataFrame, by: list[str]) -> DataFrame:
    """Retrieved sources per query, each turn weighted by its queries; turns without queries don't count."""
    some = t.filter("queries > 0")
    return some.groupBy(*by).agg(F.sum("queries").cast("long").alias("queries"), (F.sum("retrieved") / F.sum("queries")).alias("retrieved_per_query"))


def language_rows(prompts: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per user prompt (text_id i) and query (text_id i.j)."""
    a = prompts.select("sample", F.lit("user").alias("kind"), F.col("i").cast("string").alias("text_id"), "lang")
    b = queries.select("sample", F.lit("query").alias("kind"), F.concat_ws(".", "i", "j").alias("text_id"), "lang")
    return a.unionByName(b)


def language_diversity(rows: DataFrame) -> DataFrame:
    """Samples by kind and number of languages (1 .. 4+)."""
    n = rows.groupBy("kind", "sample").agg(F.count_distinct("lang").alias("n"))
    return n.groupBy("kind", bucket(F.col("n"), 4).alias("languages")).agg(F.count("*").alias("samples"))


def language_pairs(rows: DataFrame, top: int) -> DataFrame:
    """Most frequent pairs of the dominant languages of prompts and queries; percent of all pairs."""
    g = rows.groupBy("kind", "sample", "lang").agg(F.count("*").alias("n"))
    main = g.withColumn("_r", F.row_number().over(W.partitionBy("kind", "sample").orderBy(F.desc("n"), "lang"))).filter("_r = 1")
    u, q = (main.filter(F.col("kind") == k).select("sample", F.col("lang").alias(f"{k}_lang")) for k in ("user", "query"))
    pairs = u.join(q, "sample").groupBy("user_lang", "query_lang").agg(F.count("*").alias("n"))
    return pairs.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy())).orderBy(F.desc("n"), "user_lang", "query_lang").limit(top)


def token_sources(token: Column, prompt: Column, history: Column, memories: Column, sources: Column) -> Column:
    """Where a query token comes from, by priority; the last four are arrays of tokens."""
    has = lambda a: F.coalesce(F.array_contains(a, token), F.lit(False))
    return F.when(has(prompt), "prompt").when(has(history), "history").when(has(memories), "memory").when(has(sources), "source").otherwise("parametric")


def token_origins(turns: DataFrame, keys: list[str], query: Column, prompt: Column, history: Column, memories: Column, sources: Column) -> DataFrame:
    """(keys, token, origin): each different token of a turn's queries, by the first of prompt, history, memory and source that holds it, else parametric.

    All are arrays of tokens. They are laid out as rows and met by one aggregate per turn and token, so a long turn costs no more than its tokens.
    """
    ranks = lambda c, k: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), F.lit(k).alias("rank")))
    ranked = [ranks(c, k) for k, c in enumerate((prompt, history, memories, sources, query), 1)]
    rows = turns.select(*keys, F.explode(F.concat(*ranked)).alias("x")).select(*keys, "x.*")
    g = rows.groupBy(*keys, "token").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter("last = 5")
    return g.select(*keys, "token", F.element_at(F.array(*[F.lit(n) for n in ("prompt", "history", "memory", "source", "parametric")]), F.col("first")).alias("origin"))


def provenance_sets(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tokens per turn and source, as counts; tokens has columns token and origin.

    A token of several origins in a turn (rounds differ) counts in each.
    """
    once = tokens.select(*keys, "token", "origin").distinct()
    return once.groupBy(*keys).pivot("origin", ["prompt", "history", "memory", "source", "parametric"]).count().na.fill(0)


def provenance_rates(tokens: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean shares of the different tokens of a turn's queries that the conversation, the model and the sources gave.

    tokens has columns token and origin. Prompt and history are the conversation, memory and parametric the model; a token
    of several origins counts in each share and once in what they are shares of.
    """
    given = lambda *names: F.max(F.col("origin").isin(*names).cast("int"))
    once = tokens.groupBy(*keys, *by, "token").agg(given("prompt", "history").alias("context"), given("parametric", "memory").alias("own"), given("source").alias("source_share"))
    names = ("context", "own", "source_share")
    per = once.groupBy(*keys, *by).agg(*[(F.sum(n) / F.count("*")).alias(n) for n in names])
    return per.groupBy(*by).agg(F.count("*").alias("turns"), *[F.round(F.avg(n), 9).alias(n) for n in names])


def score_distribution(scores: DataFrame, dims: list[str], stages: list[str]) -> DataFrame:
    """Count, total and rate of each score 1..5 by stage and dimension, all listed."""
    spark = scores.sparkSession
    spine = spark.createDataFrame([(s, x, v) for s in stages for x in dims for v in range(1, 6)], "stage string, dimension string, score long")
    g = scores.groupBy("stage", "dimension", "score").agg(F.count("*").alias("n"))
    full = spine.join(g, ["stage", "dimension", "score"], "left").na.fill({"n": 0})
    full = full.withColumn("total", F.sum("n").over(W.partitionBy("stage", "dimension")))
    return full.withColumn("rate", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)))


def direction(user: Column, query: Column) -> Column:
    """1 if any shared dimension's score rises, 0 if all stay, else -1; null without a shared one. Maps of dimension to score."""
    shared = F.array_intersect(F.map_keys(user), F.map_keys(query))
    deltas = F.transform(shared, lambda k: F.try_element_at(query, k) - F.try_element_at(user, k))
    return F.when(F.size(shared) == 0, None).when(F.exists(deltas, lambda x: x > 0), 1).when(F.forall(deltas, lambda x: x == 0), 0).otherwise(-1)


def dimension_direction(user: Column, query: Column) -> Column:
    """1 if the score rises, else 0; never negative. Null if either is missing."""
    return F.when(user.isNull() | query.isNull(), None).when(query > user, 1).otherwise(0)
