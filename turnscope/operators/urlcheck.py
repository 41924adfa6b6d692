"""Dead and invented links: occurrences of cited urls, and their buckets.

Reachability and archive lookups come as tables (see functions.hooks); nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Status codes of pages that are gone.
DEAD = (404, 410)
ARCHIVE_CLASSES = ("stale", "hallucinated")


def occurrences(cited: DataFrame) -> DataFrame:
    """Cited urls by group: retrieved too or not, with how often, in how many urls and since when. cited has external, url, month."""
    g = F.when(F.col("external"), "cited_and_retrieved").otherwise("cited_not_retrieved")
    per_url = cited.groupBy(g.alias("grp"), "url").agg(F.count("*").alias("n"), F.min("month").alias("first_month"))
    return per_url


def bucketed(urls: DataFrame, status: DataFrame, archive: DataFrame) -> DataFrame:
    """urls with bucket: valid (2xx, 3xx), stale or hallucinated (dead, by the archive), else unknown. Statuses may be labels."""
    j = urls.join(status, "url", "left").join(archive, "url", "left")
    code = F.col("status").try_cast("int")
    b = F.when((code >= 200) & (code < 400), "valid").when(code.isin(*DEAD) & F.col("archive_class").isin(*ARCHIVE_CLASSES), F.col("archive_class")).otherwise("unknown")
    return j.withColumn("bucket", b)


def rates(b: DataFrame, by: list[str], weight: str = "n") -> DataFrame:
    """Occurrences by bucket and the rate of hallucinated ones."""
    total = F.sum(weight)
    cols = [F.sum(F.when(F.col("bucket") == x, F.col(weight)).otherwise(0)).cast("long").alias(x) for x in ("valid", "unknown", "stale", "hallucinated")]
    return b.groupBy(*by).agg(*cols, total.cast("long").alias("total")).withColumn("hallucinated_rate", F.coalesce(F.try_divide("hallucinated", "total"), F.lit(0.0)))
