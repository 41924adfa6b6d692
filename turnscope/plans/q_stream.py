"""Queries that run as streams over the given tables until all is read, and return what the sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.sources.stored import shared_dir
from turnscope.streaming.grounded import stream_grounding

from .views import table

Q, S = {}, {}


def drained(stream: DataFrame) -> DataFrame:
    """All rows a stream appends until its source is read to the end, written to the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


LATE = "2 hours"


def streamed_grounding(spark, d):
    """A26 as a stream: events of a user as a conversation, every third a citation; those the watermark has passed at the end have an answer."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events[.]parquet")  # a pattern, as a stream's path names no single file
    domain = F.concat_ws(":", "event_type", (F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))
    kind = F.when(F.col("event_id") % 3 == 0, "cited").otherwise("retrieved")
    rows = events.select(F.col("user_id").alias("conv_id"), domain.alias("domain"), F.col("event_id").alias("turn_id"), F.lit(0).alias("pos"), F.col("ts").alias("time"), kind.alias("kind"))
    return drained(stream_grounding(rows, LATE)).select("conv_id", "domain", "turn_id", "external")


Q["streamed_grounding"] = streamed_grounding
S["streamed_grounding"] = f"""
WITH e AS (SELECT user_id::VARCHAR AS conv_id, event_type || ':' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS domain, event_id, ts FROM events),
f AS (SELECT conv_id, domain, min(ts) AS first FROM e WHERE event_id % 3 <> 0 GROUP BY ALL)
SELECT e.conv_id, e.domain, event_id::VARCHAR AS turn_id, coalesce(first <= ts, false) AS external FROM e LEFT JOIN f ON f.conv_id = e.conv_id AND f.domain = e.domain
WHERE event_id % 3 = 0 AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM e) - epoch_ms(INTERVAL '{LATE}')"""
