"""The driver's tables as the engine's canonical ones, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions import urls
from turnscope.operators.extract import segment_turns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_turns(spark, sf_dir) -> DataFrame:
    """(conv_id, turn_no, conv_starter, user_text, assistant_text, n_msgs)."""
    msgs = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    msgs = msgs.select("conv_id", F.col("turn").alias("pos"), "role", "text", (F.col("role") == "user").alias("is_user"))
    seg = segment_turns(msgs, ["conv_id"], "pos")
    joined = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "text")))), lambda x: x["text"]), " ")
    turns = seg.groupBy("conv_id", "segment").agg(joined("user").alias("user_text"), joined("assistant").alias("assistant_text"), F.count("*").alias("n_msgs"))
    no = F.row_number().over(W.partitionBy("conv_id").orderBy("segment"))
    return turns.select("conv_id", no.cast("long").alias("turn_no"), (no == 1).cast("int").alias("conv_starter"), "user_text", "assistant_text", "n_msgs")


def turn_log(spark, sf_dir) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return j.select(
        F.col("r_name").alias("platform"), F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn_id"), F.col("o_orderdate").alias("time"),
        F.date_format("o_orderdate", "yyyy-MM-01").alias("month"), F.col("c_mktsegment").alias("topic"), F.col("o_orderstatus").alias("model"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("web_call"), (F.col("o_orderpriority") != "5-LOW").alias("tool_used"),
    )


def line_sources(spark, sf_dir, domain: str = "brand") -> DataFrame:
    """(platform, month, model, conv_id, turn_id, pos, kind, url, domain)."""
    log = turn_log(spark, sf_dir).select("platform", "month", "model", "topic", "conv_id", "turn_id", "time")
    li = table(spark, sf_dir, "lineitem")
    base = li.select(F.col("l_orderkey").alias("turn_id"), F.col("l_linenumber").cast("long").alias("pos"), F.when(F.col("l_returnflag") == "R", "cited").otherwise("retrieved").alias("kind"), F.concat(F.lit("u"), F.col("l_partkey"), F.lit("/"), F.col("l_suppkey")).alias("url"), "l_partkey", "l_suppkey", "l_linestatus", "l_quantity")
    if domain == "brand":
        p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("domain"))
        base = base.join(p, "l_partkey")
    else:
        base = base.withColumn("domain", F.concat(F.lit("s"), F.col("l_suppkey")))
    return base.join(log, "turn_id")


def rounds(spark, sf_dir) -> DataFrame:
    """(turn_user, turn_day, round, query, event_id, score_k): one row per query."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.select("event_id", F.col("user_id").alias("turn_user"), F.date_format("ts", "yyyy-MM-dd").alias("turn_day"), F.date_format("ts", "yyyy-MM-01").alias("month"), F.hour("ts").alias("h"), F.concat_ws(" ", "event_type", k.cast("string")).alias("query"), "event_type", k.alias("k"), "value")
    w = W.partitionBy("turn_user", "turn_day").orderBy("h")
    return e.withColumn("round", F.dense_rank().over(w).cast("long")).drop("h")


def site_pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", "html", urls.domain_of(F.col("url")).alias("domain"), F.regexp_extract(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1), r"^/([a-z]{2})/", 1).alias("platform"))


#: DuckDB definitions of the same views, by name, with the views each one needs.
SQL = {
    "chat_turns": """
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seg) AS turn_no,
    CAST(CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY seg) = 1 THEN 1 ELSE 0 END AS INTEGER) AS conv_starter,
    coalesce(string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn), '') AS user_text,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn), '') AS assistant_text, count(*) AS n_msgs
  FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations WHERE role <> 'system')
  GROUP BY conv_id, seg""",
    "turn_log": """
  SELECT r_name AS platform, o_custkey AS user_id, o_custkey AS conv_id, o_orderkey AS turn_id, o_orderdate AS time, strftime(o_orderdate, '%Y-%m-01') AS month,
    c_mktsegment AS topic, o_orderstatus AS model, o_orderpriority IN ('1-URGENT', '2-HIGH') AS web_call, o_orderpriority <> '5-LOW' AS tool_used
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "line_sources": """
  SELECT platform, month, model, topic, conv_id, turn_id, time, CAST(l_linenumber AS BIGINT) AS pos, CASE WHEN l_returnflag = 'R' THEN 'cited' ELSE 'retrieved' END AS kind,
    'u' || l_partkey || '/' || l_suppkey AS url, l_partkey, l_suppkey, l_linestatus, l_quantity, p_brand AS domain
  FROM lineitem JOIN turn_log ON l_orderkey = turn_id JOIN part ON l_partkey = p_partkey""",
    "line_sources_supp": """
  SELECT platform, month, model, topic, conv_id, turn_id, time, CAST(l_linenumber AS BIGINT) AS pos, CASE WHEN l_returnflag = 'R' THEN 'cited' ELSE 'retrieved' END AS kind,
    'u' || l_partkey || '/' || l_suppkey AS url, 's' || l_suppkey AS domain
  FROM lineitem JOIN turn_log ON l_orderkey = turn_id""",
    "rounds": """
  SELECT event_id, user_id AS turn_user, strftime(ts, '%Y-%m-%d') AS turn_day, strftime(ts, '%Y-%m-01') AS month, event_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ' ' || json_extract_string(props, '$.k') AS query, value,
    dense_rank() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY hour(ts)) AS round
  FROM events""",
    "site_pages": r"""
  SELECT page_id, url, html, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '\.+$', ''), '^www\.', '') AS domain,
    regexp_extract(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '^/([a-z]{2})/', 1) AS platform
  FROM pages""",
}
NEEDS = {"line_sources": ("turn_log",), "line_sources_supp": ("turn_log",)}


def with_views(sql: str, *names: str) -> str:
    """sql with the named views (and what they need) in front."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    heads = ",\n".join(f"{n} AS ({SQL[n]}\n)" for n in order)
    body = sql.strip()
    return f"WITH {heads}" + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
