"""When assistants search the web: rates by month, topic, platform and model.

Inputs are turn tables with platform, month, topic, model, web_call and tool_used (booleans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions.stats import on_spine
from turnscope.functions.values import bucket


def rate(flag: Column | str) -> Column:
    return F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("double"))


def monthly_rates(t: DataFrame) -> DataFrame:
    """Per month: shares of turns with any tool, with a web call, with tools other than the web."""
    return t.groupBy("month").agg(F.count("*").alias("turns"), rate("tool_used").alias("tool_rate"), rate("web_call").alias("web_rate"), rate(F.col("tool_used") & ~F.col("web_call")).alias("other_tool_rate"))


def platform_web_rates(t: DataFrame, since: str) -> DataFrame:
    """Per platform and month from `since` on, and per platform over all months (month null), in one pass by grouping sets."""
    kept = t.filter(F.col("month") >= since)
    g = kept.groupingSets([["platform", "month"], ["platform"]], "platform", "month")
    return g.agg(F.count("*").alias("turns"), F.count_if("web_call").alias("web_turns"), rate("web_call").alias("web_rate"))


def topic_shares(t: DataFrame, without: tuple[str, ...] = ("Other",)) -> DataFrame:
    """Share of each topic among web turns."""
    g = t.filter(F.col("web_call") & ~F.col("topic").isin(*without)).groupBy("topic").agg(F.count("*").alias("web_turns"))
    return g.withColumn("share", F.col("web_turns") / F.sum("web_turns").over(W.partitionBy()))


def topic_web_rates(t: DataFrame, taxonomy: DataFrame, without: tuple[str, ...] = ("Other", "Misc")) -> DataFrame:
    """Web rate of every topic of the taxonomy, 0 for topics without turns."""
    g = t.filter(~F.col("topic").isin(*without)).groupBy("topic").agg(F.count("*").alias("turns"), rate("web_call").alias("web_rate"))
    return on_spine(g, taxonomy.filter(~F.col("topic").isin(*without)), ["topic"], {"turns": 0, "web_rate": 0.0})


def topics_over_time(t: DataFrame, k: int) -> DataFrame:
    """Months of the topics that lead by rate or by web turns: prompts, rate, month total, share; months without prompts are 0."""
    g = t.groupBy("topic").agg(rate("web_call").alias("r"), F.count_if("web_call").alias("n"))
    by_rate = g.orderBy(F.desc("r"), "topic").limit(k).select("topic")
    by_count = g.orderBy(F.desc("n"), "topic").limit(k).select("topic")
    chosen = by_rate.union(by_count).distinct()
    totals = t.groupBy("month").agg(F.count("*").alias("month_total"))
    per = t.groupBy("month", "topic").agg(F.count("*").alias("prompts"), rate("web_call").alias("web_rate"))
    # months times a handful of topics
    full = totals.crossJoin(F.broadcast(chosen)).join(per, ["month", "topic"], "left").na.fill({"prompts": 0, "web_rate": 0.0})
    return full.withColumn("share", F.col("prompts") / F.col("month_total"))


def topic_platform_pivot(t: DataFrame, platforms: list[str], lead: str) -> DataFrame:
    """Web rate in percent by topic and platform, 0 where a platform lacks the topic; position orders by the leading platform's rate."""
    p = t.groupBy("topic").pivot("platform", platforms).agg(rate("web_call") * 100).na.fill(0.0)
    names = {x: x.lower().replace(" ", "_") for x in platforms}
    p = p.select("topic", *[F.col(f"`{x}`").alias(n) for x, n in names.items()])
    return p.withColumn("position", F.row_number().over(W.orderBy(F.desc(names[lead]), "topic")).cast("long"))


def label_distribution(t: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Counts and shares of a fixed list of labels, all of them listed."""
    spine = t.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], f"{label} string, position long")
    g = t.groupBy(label).agg(F.count("*").alias("n"))
    full = spine.join(g, label, "left").na.fill({"n": 0})
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())), F.lit(0.0)))


def model_mentions(t: DataFrame, models: str = "models") -> DataFrame:
    """How many turns name a model at all, and for how many it is the primary, that is last, one."""
    last = F.coalesce(F.try_element_at(F.filter(models, lambda m: m.isNotNull() & (m != "")), F.lit(-1)), F.lit("Unknown"))
    named = t.select(F.explode(F.array_distinct(models)).alias("model")).filter("model is not null and model <> ''").groupBy("model").agg(F.count("*").alias("mentions"))
    primary = t.groupBy(last.alias("model")).agg(F.count("*").alias("primary_turns"))
    return named.join(primary, "model", "full").na.fill({"mentions": 0, "primary_turns": 0})


def preference(metrics: list[str], none: str = "none_{}_score", required: str = "required_{}_score") -> tuple[Column, Column, Column]:
    """(metrics that prefer no call, that prefer a call, ties); metrics without both scores don't count."""
    pairs = [(F.col(none.format(m)).try_cast("double"), F.col(required.format(m)).try_cast("double")) for m in metrics]
    count = lambda test: sum((F.coalesce(test(a, b), F.lit(False)).cast("int") for a, b in pairs), F.lit(0))
    return count(lambda a, b: a > b), count(lambda a, b: b > a), count(lambda a, b: a == b)


def call_outcome(used_web: Column, prefer_none: Column, prefer_required: Column, n_metrics: int) -> Column:
    """Right, Over or Under Call: a call is over if only its absence is preferred anywhere, an absence under if a call is preferred everywhere. An unknown decision is an absence."""
    used_web = F.coalesce(used_web, F.lit(False))
    return (
        F.when(used_web & (prefer_required == 0) & (prefer_none >= 1), "Over Call")
        .when(~used_web & (prefer_none == 0) & (prefer_required == n_metrics) & F.lit(n_metrics > 0), "Under Call")
        .otherwise("Right Call")
    )


def before_first(msgs: DataFrame, keys: list[str], pos: str, signal: str) -> DataFrame:
    """Messages up to the first one with the signal, itself included; all where none has it."""
    w = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    return msgs.withColumn("_seen", F.coalesce(F.max(F.col(signal).cast("int")).over(w), F.lit(0))).filter("_seen = 0").drop("_seen")


def bucketed_month_shares(t: DataFrame, value: str, cap: int) -> DataFrame:
    """Share of each bucket 1 .. cap+ among a month's rows, every bucket listed for every month."""
    b = t.select("month", bucket(F.col(value), cap).alias("bucket"))
    g = b.groupBy("month", "bucket").agg(F.count("*").alias("n"))
    names = t.sparkSession.createDataFrame([(str(i) if i < cap else f"{cap}+",) for i in range(1, cap + 1)], "bucket string")
    full = g.select("month").distinct().crossJoin(F.broadcast(names)).join(g, ["month", "bucket"], "left").na.fill({"n": 0})
    return full.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("month")))
