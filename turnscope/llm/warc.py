"""Resolution of not-modified revisits in web captures.

A revisit record says that a page had not changed; its content is that of an earlier full
response. The operator joins each revisit as of its time to the latest earlier full response of
the same canonical url, checks the validators (entity tags by weak comparison, else last-modified
dates), and merges the headers which a 304 answer may update into the response's.

The as-of join works on buckets of (canonical url, time): within a bucket a window finds the
latest response before each revisit; a revisit without one takes the last response of the
nearest earlier bucket, found over one row per bucket. A url with a third of all captures is thus
spread over its buckets, and no payload is shuffled, only ids, validators and headers.

Defined cases: "earlier" is strict; responses of one url at one time tie, and the largest id
wins. A null url, or one without an earlier response, leaves the revisit 'no_original', with its own
permitted headers. A null time sorts before every other and so finds nothing. Records of other
types are ignored, repeated rows each get a row. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Headers that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't tell pages apart.
DROPPED_PARAMS = r"^(utm_[a-z]+|jsessionid|phpsessid|sessionid|sid)(=|$)"
#: Time units to a bucket.
BUCKET = 4_096


def canonical_url(url: Column) -> Column:
    """Host without scheme, www and default port, path without trailing slashes, sorted query without trackers and sessions."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*[?](.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(DROPPED_PARAMS)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, payload: str, tie: str, bucket: int = BUCKET) -> DataFrame:
    """left with payload of the latest right row of the same key and a strictly smaller ts (else null).

    A column of left that has payload's name gives way to it; other names of either side don't matter.
    """
    at = F.floor(F.col(ts) / F.lit(bucket))
    names = [c for c in left.columns if c.lower() != payload.lower()]
    one = right.groupBy(F.col(key).alias("_asof_key"), F.col(ts).alias("_asof_ts")).agg(F.max_by(payload, tie).alias("_asof_payload"))
    one = one.withColumn("_asof_bucket", F.floor(F.col("_asof_ts") / F.lit(bucket)))
    lefts = left.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_asof_row"), F.col(key).alias("_asof_key"), F.col(ts).alias("_asof_ts"), at.alias("_asof_bucket"))
    kind = one.schema["_asof_payload"].dataType
    both = lefts.withColumn("_asof_payload", F.lit(None).cast(kind)).withColumn("_asof_side", F.lit(0)).unionByName(
        one.select(F.lit(None).cast(lefts.schema["_asof_row"].dataType).alias("_asof_row"), "_asof_key", "_asof_ts", "_asof_bucket", "_asof_payload", F.lit(1).alias("_asof_side"))
    )
    local = W.partitionBy("_asof_key", "_asof_bucket").orderBy("_asof_ts", "_asof_side").rowsBetween(W.unboundedPreceding, -1)
    found = both.withColumn("_asof_local", F.last("_asof_payload", ignorenulls=True).over(local)).filter("_asof_side = 0")
    # one row per bucket of the key: its last response, if any, to be carried into later buckets
    ends = one.groupBy("_asof_key", "_asof_bucket").agg(F.max_by("_asof_payload", "_asof_ts").alias("_asof_end"))
    asked = lefts.select("_asof_key", "_asof_bucket").distinct()
    spine = ends.join(asked, ["_asof_key", "_asof_bucket"], "full")
    before = W.partitionBy("_asof_key").orderBy("_asof_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = spine.withColumn("_asof_carry", F.last("_asof_end", ignorenulls=True).over(before)).filter("_asof_carry is not null").select("_asof_key", "_asof_bucket", "_asof_carry")
    out = found.join(carry, ["_asof_key", "_asof_bucket"], "left")
    return out.select("_asof_row.*", F.coalesce("_asof_local", "_asof_carry").alias(payload))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(id, ts, canonical_url, original_id, status, headers): one row per revisit.

    records: id, url, ts (a number), type ('response' or 'revisit'), headers (map of lower-case
    names). status: resolved, mismatch (validators differ: nothing is merged), unchecked (no common
    validator, merged) or no_original.
    """
    r = records.select("id", "ts", "type", "headers", canonical_url(F.col("url")).alias("canonical_url"))
    full = r.filter("type = 'response' and canonical_url is not null and ts is not null")
    full = full.withColumn("original", F.struct(F.col("id").alias("id"), F.col("headers").alias("headers")))
    seen = as_of(r.filter("type = 'revisit'").drop("type"), full, "canonical_url", "ts", "original", "id", bucket)
    old, new = F.col("original.headers"), F.col("headers")
    tags, dates = (_weak(old["etag"]), _weak(new["etag"])), (old["last-modified"], new["last-modified"])
    status = (
        F.when(F.col("original").isNull(), "no_original")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    allowed = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(allowed, k))
    out = seen.withColumn("status", status)
    return out.select("id", "ts", "canonical_url", F.when(F.col("status") != "mismatch", F.col("original.id")).alias("original_id"), "status", F.when(F.col("status") == "mismatch", new).otherwise(F.map_concat(kept, allowed)).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """The pages table as captures: each page is fetched once, and asked for again later with its own validator.

    Time runs by page_id, two ticks a page; the revisit comes some odd number of ticks later, by the length of the page.
    """
    tag, size = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.length(F.coalesce(F.col("html"), F.lit("")))
    base = pages.select(F.col("page_id").alias("id"), "url", tag.alias("tag"), size.cast("long").alias("size"))
    at = F.col("id") * 2
    full = base.select("id", "url", at.alias("ts"), F.lit("response").alias("type"), F.create_map(F.lit("etag"), F.col("tag"), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size").cast("string"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), at.cast("string")).alias("headers"))
    later = at + F.col("size") % 997 * 20 + 1
    again = base.select("id", "url", later.alias("ts"), F.lit("revisit").alias("type"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("tag")), F.lit("date"), later.cast("string"), F.lit("set-cookie"), F.concat(F.lit("v="), F.col("id").cast("string"))).alias("headers"))
    return full.unionByName(again)


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """page_id, canonical_url, original_id, status and merged headers of every page's revisit."""
    got = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return got.select(F.col("id").alias("page_id"), "ts", "canonical_url", "original_id", "status", headers.alias("headers"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id AS id, url, md5(coalesce(html, '')) AS tag, length(coalesce(html, '')) AS size,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's') AS rest FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1, 's'), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|jsessionid|phpsessid|sessionid|sid)(=|$)'))) AS params FROM p),
c AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM q),
r AS (SELECT canonical_url, id * 2 AS ts, max(id) AS id, arg_max(tag, id) AS tag, arg_max(size, id) AS size FROM c WHERE canonical_url IS NOT NULL GROUP BY ALL),
v AS (SELECT id, canonical_url, tag, id * 2 + size % 997 * 20 + 1 AS ts FROM c),
j AS (SELECT v.*, r.id AS rid, r.tag AS rtag, r.size AS rsize FROM v ASOF LEFT JOIN r ON v.canonical_url = r.canonical_url AND v.ts > r.ts)
SELECT id AS page_id, ts, canonical_url, CASE WHEN rtag = tag THEN rid END AS original_id,
  CASE WHEN rid IS NULL THEN 'no_original' WHEN rtag = tag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN rid IS NULL THEN 'date=' || ts || '; etag=W/' || tag
    WHEN rtag = tag THEN 'cache-control=max-age=600; content-length=' || rsize || '; content-type=text/html; date=' || ts || '; etag=W/' || tag
    ELSE 'date=' || ts || '; etag=W/' || tag || '; set-cookie=v=' || id END AS headers
FROM j
"""
