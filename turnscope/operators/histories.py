"""Histories of conversations, stored as what each turn adds.

A history up to a turn is the parts of all turns so far. Written out for every turn it grows as the square of a conversation; here a turn keeps
its own parts and the offset at which they begin, so storage is linear, and a history or a stretch of one is read back by a range of offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.functions.ranks import running_totals

#: Parts of a conversation that meet a request in one task.
WIDTH = 1_024


def history_parts(turns: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """(keys, order, offset, n, parts): the parts each turn adds, and how many there are before it in its conversation.

    Offsets are running totals in the order of all conversations at once, less those at a conversation's start, so a long one isn't one window.
    The result reads a stored table.
    """
    own = turns.select(*keys, order, F.coalesce(F.col(column), F.array().cast(turns.schema[column].dataType)).alias("parts"))
    sized = own.withColumn("n", F.size("parts").cast("long"))
    run = running_totals(sized, F.col("n"), *keys, order, name="_before")
    first = run.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_before").alias("_first"))
    same = [run[k].eqNullSafe(first[f"_{k}"]) for k in keys]
    out = run.join(first, same).select(*keys, order, (F.col("_before") - F.col("_first")).alias("offset"), "n", "parts")
    out._stored_at = run._stored_at
    return out


def history_range(parts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, history): the parts at offsets from low on, below high, of the conversations and ranges asked for.

    wanted: keys, low, high, each range once. Ranges and parts meet by buckets of offsets, so a lookup reads the buckets it covers, not the conversation.
    """
    some = parts.filter("n > 0").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("offset") / WIDTH), F.floor((F.col("offset") + F.col("n") - 1) / WIDTH))))
    asked = wanted.select(*keys, "low", "high").filter("high > low").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("low") / WIDTH), F.floor((F.col("high") - 1) / WIDTH))))
    met = asked.join(some, [*keys, "_bucket"]).filter("offset < high and offset + n > low")
    # a pair that shares several buckets counts in the first
    met = met.filter(F.col("_bucket") == F.floor(F.greatest("offset", "low") / WIDTH))
    start, end = F.greatest("offset", "low"), F.least(F.col("offset") + F.col("n"), F.col("high"))
    cut = F.slice("parts", (start - F.col("offset") + 1).cast("int"), (end - start).cast("int"))
    found = met.groupBy(*keys, "low", "high").agg(F.array_sort(F.collect_list(F.struct("offset", cut.alias("parts")))).alias("found"))
    found = found.select(*keys, "low", "high", F.flatten(F.transform("found", lambda x: x["parts"])).alias("history"))
    empty = F.array().cast(parts.schema["parts"].dataType)
    return wanted.select(*keys, "low", "high").join(found, [*keys, "low", "high"], "left").withColumn("history", F.coalesce("history", empty))


def histories_at(parts: DataFrame, wanted: DataFrame, keys: list[str], order: str, last: int | None = None) -> DataFrame:
    """(keys, order, history): the history up to and with each turn asked for, or only its last parts."""
    at = parts.select(*keys, order, "offset", "n").join(wanted.select(*keys, order).distinct(), [*keys, order])
    high = F.col("offset") + F.col("n")
    at = at.select(*keys, order, (F.lit(0).cast("long") if last is None else F.greatest(F.lit(0), high - last)).alias("low"), high.alias("high"))
    read = history_range(parts, at.select(*keys, "low", "high").distinct(), keys)
    return at.join(read, [*keys, "low", "high"]).select(*keys, order, "history")
