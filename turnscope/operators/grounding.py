"""What is retrieved and cited: counts, grounding of citations, domains, ranks.

A sources table has one row per source: platform, month, model, conv_id, turn_id, pos, kind
('retrieved' or 'cited'), url, domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions.stats import sem
from turnscope.functions.urls import domain_of, fold_domain, match_key


def matchable(s: DataFrame) -> DataFrame:
    """Sources that have a url, with the domain under which cited and retrieved ones meet: folded, from the url without tracking."""
    return s.filter(F.trim(F.coalesce("url", F.lit(""))) != "").withColumn("domain", domain_of(match_key(F.col("url"))))


def per_turn_counts(s: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Retrieved and cited urls per turn, raw or distinct."""
    if unique:  # one plain aggregate more instead of rows multiplied for each distinct count
        s = s.select(*keys, "kind", "url").distinct()
    count = lambda k: F.count_if((F.col("kind") == k) & (F.col("url").isNotNull() if unique else F.lit(True)))
    return s.groupBy(*keys).agg(count("retrieved").alias("retrieved"), count("cited").alias("cited"))


def with_any(counts: DataFrame, by: list[str]) -> DataFrame:
    """Responses with at least one retrieved, cited, and both."""
    return counts.groupBy(*by).agg(F.count("*").alias("responses"), F.count_if(F.col("retrieved") > 0).alias("with_retrieved"), F.count_if(F.col("cited") > 0).alias("with_cited"), F.count_if((F.col("retrieved") > 0) & (F.col("cited") > 0)).alias("with_both"))


def grounding(s: DataFrame, level: str = "turn", order: str = "turn_id", match: str = "domain") -> DataFrame:
    """Cited sources with external: whether their domain (or url) was retrieved in the turn, or up to it in the conversation.

    The first time each conversation retrieved a domain is one aggregate; a citation is then external if that
    time isn't after its own. No sets are carried from turn to turn.
    """
    scope = ["conv_id", "turn_id"] if level == "turn" else ["conv_id"]
    first = s.filter("kind = 'retrieved'").groupBy(*scope, match).agg(F.min(order).alias("_first"))
    cited = s.filter("kind = 'cited'").join(first, [*scope, match], "left")
    return cited.withColumn("external", F.coalesce(F.col("_first") <= F.col(order), F.lit(False))).drop("_first")


def grounding_rates(s: DataFrame, by: list[str], level: str = "turn") -> DataFrame:
    """Sums of retrieved, cited, external and internal sources and their ratios (of sums)."""
    keys = list(dict.fromkeys([*by, "conv_id", "turn_id"]))
    counts = per_turn_counts(s, keys)
    g = grounding(s, level).groupBy(*by).agg(F.count_if("external").alias("external"), F.count_if(~F.col("external")).alias("internal"))
    sums = counts.groupBy(*by).agg(F.sum("retrieved").cast("long").alias("retrieved"), F.sum("cited").cast("long").alias("cited"))
    out = sums.join(g, by, "left").na.fill({"external": 0, "internal": 0})
    return out.withColumn("external_per_retrieved", F.try_divide("external", "retrieved")).withColumn("external_per_cited", F.try_divide("external", "cited"))


def mean_of_ratios(s: DataFrame, by: list[str], level: str = "turn") -> DataFrame:
    """Means over turns, not ratios of sums: sources cited and retrieved per retrieved (citation_rate) and per cited (grounding_rate), 0 where there are none; and the sums."""
    keys = list(dict.fromkeys([*by, "conv_id", "turn_id"]))
    both = grounding(s, level).groupBy(*keys).agg(F.count_if("external").alias("cited_retrieved"))
    c = per_turn_counts(s, keys).join(both, keys, "left").na.fill({"cited_retrieved": 0})
    rate = lambda of: F.round(F.avg(F.coalesce(F.try_divide("cited_retrieved", of), F.lit(0.0))), 9)
    return c.groupBy(*by).agg(
        F.count("*").alias("turns"), *[F.avg(n).alias(f"mean_{n}") for n in ("retrieved", "cited", "cited_retrieved")], *[F.sum(n).cast("long").alias(n) for n in ("retrieved", "cited", "cited_retrieved")],
        rate("retrieved").alias("citation_rate"), rate("cited").alias("grounding_rate"),
    )


def both_kinds(s: DataFrame) -> DataFrame:
    """Sources of turns that have retrieved and cited ones."""
    keys = ["conv_id", "turn_id"]
    full = s.groupBy(*keys).agg(F.count_if(F.col("kind") == "retrieved").alias("r"), F.count_if(F.col("kind") == "cited").alias("c")).filter("r > 0 and c > 0").select(*keys)
    return s.join(full, keys, "left_semi")


def top_domains(s: DataFrame, k: int, by: str = "kind") -> DataFrame:
    """The k most frequent domains of each kind, folded; sources without one don't count."""
    named = both_kinds(s).withColumn("domain", fold_domain(F.col("domain"))).filter("domain <> ''")
    g = named.groupBy(by, "domain").agg(F.count("*").alias("n"))
    return g.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "domain")).cast("long")).filter(F.col("position") <= k)


def cited_domain_split(s: DataFrame, level: str = "turn", match: str = "domain") -> DataFrame:
    """External, internal and all citations by domain."""
    g = grounding(s, level, match=match).groupBy("domain").agg(F.count_if("external").alias("external"), F.count("*").alias("total"))
    return g.withColumn("internal", F.col("total") - F.col("external"))


def unique_domains(s: DataFrame, top: int | None = None) -> DataFrame:
    """Domains that one platform has and no other; within each platform's most frequent `top` only, if given."""
    g = s.groupBy("platform", "domain").agg(F.count("*").alias("n"))
    if top:
        g = g.withColumn("_r", F.row_number().over(W.partitionBy("platform").orderBy(F.desc("n"), "domain"))).filter(F.col("_r") <= top).drop("_r")
    alone = g.groupBy("domain").agg(F.count("*").alias("_p")).filter("_p = 1").select("domain")
    return g.join(alone, "domain", "left_semi")


def pairwise_unique_domains(s: DataFrame) -> DataFrame:
    """For each ordered pair of platforms, how many domains the first has and the second has not."""
    d = s.select("platform", "domain").distinct()
    names = d.select("platform").distinct()
    # platforms are few; the spine is their square, joined by key with the domains
    pairs = names.crossJoin(F.broadcast(names.withColumnRenamed("platform", "other"))).filter("platform <> other")
    own = d.join(F.broadcast(pairs), "platform")
    left = own.join(d.withColumnRenamed("platform", "other"), ["other", "domain"], "left_anti")
    g = left.groupBy("platform", "other").agg(F.count("*").alias("only_first"))
    return pairs.join(g, ["platform", "other"], "left").na.fill({"only_first": 0})


def monthly_counts(s: DataFrame, by: list[str]) -> DataFrame:
    """Mean and standard error per month of retrieved, cited, external and internal distinct urls."""
    keys = list(dict.fromkeys([*by, "conv_id", "turn_id"]))
    counts = per_turn_counts(s, keys, unique=True)
    once = grounding(s).filter("url is not null").select(*keys, "url", "external").distinct()
    ext = once.groupBy(*keys).agg(F.count_if("external").alias("external"), F.count_if(~F.col("external")).alias("internal"))
    full = counts.join(ext, keys, "left").na.fill({"external": 0, "internal": 0})
    aggs = [f(c) for c in ("retrieved", "cited", "external", "internal") for f in (lambda c: F.avg(c).alias(f"{c}_mean"), lambda c: F.round(sem(c), 9).alias(f"{c}_sem"))]
    return full.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def monthly_by_model(s: DataFrame) -> DataFrame:
    """Retrieved per turn by month and model, models in order of their turns."""
    counts = per_turn_counts(s, ["month", "model", "conv_id", "turn_id"])
    g = counts.groupBy("month", "model").agg(F.count("*").alias("n"), F.avg("retrieved").alias("mean"), F.round(sem("retrieved"), 9).alias("sem"))
    totals = counts.groupBy("model").agg(F.count("*").alias("_n"))
    ranked = totals.select("model", F.row_number().over(W.orderBy(F.desc("_n"), "model")).cast("long").alias("model_order"))
    return g.join(ranked, "model")


def rank_scatter(s: DataFrame, group: str, index: str, rank: str) -> DataFrame:
    return s.groupBy(group, index, rank).agg(F.count("*").alias("n"))


def best_ranks(ranks: DataFrame) -> DataFrame:
    """Best rank per domain of a popularity list."""
    return ranks.groupBy("domain").agg(F.min("rank").alias("rank"))


def with_rank(s: DataFrame, ranks: DataFrame) -> DataFrame:
    """s with the popularity rank of its domain, -1 where it has none."""
    return s.join(best_ranks(ranks), "domain", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))


def mean_ranks(s: DataFrame, ranks: DataFrame, by: list[str], level: str = "conversation") -> DataFrame:
    """Per group and series (retrieved, external, internal): responses, mean over responses of their mean valid rank, and its range."""
    keys = list(dict.fromkeys([*by, "conv_id", "turn_id"]))
    cited = grounding(s, level).select(*keys, "domain", F.when(F.col("external"), "external").otherwise("internal").alias("series"))
    all_ = s.filter("kind = 'retrieved'").select(*keys, "domain", F.lit("retrieved").alias("series")).unionByName(cited)
    per = with_rank(all_, ranks).filter("rank > 0").groupBy(*keys, "series").agg(F.avg("rank").alias("r"))
    return per.groupBy(*by, "series").agg(F.count("*").alias("responses"), F.round(F.avg("r"), 6).alias("mean_rank"), F.round(F.min("r"), 6).alias("min_rank"), F.round(F.max("r"), 6).alias("max_rank"))


def exclusive_types(s: DataFrame, keys: list[str], order=("cited", "safe", "retrieved")) -> DataFrame:
    """Rows of each url's highest type only; repeats within that type stay."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("kind"))
    return s.withColumn("_p", rank).withColumn("_top", F.min("_p").over(W.partitionBy(*keys, "url"))).filter("_p = _top").drop("_p", "_top")


def label_rates(s: DataFrame, keys: list[str], label: str, labels: list[str]) -> DataFrame:
    """Share of each label per key."""
    return s.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg((F.col(label) == x).cast("double")).alias(f"{x}_rate") for x in labels])
