"""Queries on search decisions, over orders as turns and conversations as chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import stats, text, topics, values
from turnscope.operators import decisions as D

from .views import chat_turns, table, turn_log, with_views

Q, S = {}, {}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Misc", "SPACE TRAVEL")
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
TOPIC_WORDS = {"History": ["the", "was", "that"], "Cooking": ["ing ", "able"], "Travel": ["tion", "aeau"], "Law": ["ung", "heit", "keit"], "Music": ["ción", "mente"]}


def query(name, sql=None, views=()):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = with_views(sql, *views) if views else sql.strip()
        return f

    return add


@query("turn_summary_by_number", """
SELECT turn_no, count(*) AS turns, CAST(sum(conv_starter) AS BIGINT) AS starters, CAST(sum(n_msgs) AS BIGINT) AS messages,
  sum(len(list_filter(regexp_split_to_array(user_text, '\\s+'), lambda x: x <> ''))) / count(*) AS mean_user_terms
FROM chat_turns GROUP BY turn_no""".replace("\\\\", "\\"), ("chat_turns",))
def turn_summary_by_number(spark, d):
    """Turn segmentation (E6), starters, term counts."""
    return chat_turns(spark, d).groupBy("turn_no").agg(F.count("*").alias("turns"), F.sum("conv_starter").cast("long").alias("starters"), F.sum("n_msgs").cast("long").alias("messages"), F.avg(text.term_count(F.col("user_text"))).alias("mean_user_terms"))


@query("cumulative_histories", """
SELECT conv_id, turn_no, len(string_agg(user_text, '|') OVER w) AS history_chars, count(*) OVER w AS history_len, md5(string_agg(user_text, '|') OVER w) AS history_md5
FROM chat_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ("chat_turns",))
def cumulative_histories(spark, d):
    """Histories up to each turn."""
    from turnscope.operators.extract import cumulative

    t = cumulative(chat_turns(spark, d).withColumn("parts", F.array("user_text")), ["conv_id"], "turn_no", "parts", "history")
    joined = F.array_join("history", "|")
    return t.select("conv_id", "turn_no", F.length(joined).cast("long").alias("history_chars"), F.size("history").cast("long").alias("history_len"), F.md5(joined.cast("binary")).alias("history_md5"))


@query("keyword_topics", """
WITH h AS (SELECT conv_id, ' ' || lower(coalesce(text, '')) || ' ' AS t, text FROM conversations WHERE turn = 0 AND role = 'user'),
s AS (SELECT *, """ + ", ".join(f"({' + '.join(f'contains(t, {chr(39)}{k}{chr(39)})::INT' for k in ks)}) AS {n}" for n, ks in TOPIC_WORDS.items()) + """ FROM h),
m AS (SELECT *, greatest(""" + ", ".join(TOPIC_WORDS) + """) AS best FROM s),
c AS (SELECT CASE WHEN best = 0 OR text = '' THEN 'Other' """ + " ".join(f"WHEN {n} = best THEN '{n}'" for n in TOPIC_WORDS) + """ END AS topic FROM m)
SELECT topic, count(*) AS n FROM c GROUP BY topic""")
def keyword_topics(spark, d):
    """Keyword topic classifier."""
    first = table(spark, d, "conversations").filter("turn = 0 and role = 'user'")
    return first.groupBy(topics.classify(F.col("text"), TOPIC_WORDS).alias("topic")).agg(F.count("*").alias("n"))


@query("summary_counters", """
SELECT count(DISTINCT platform || '/' || user_id) AS users, count(DISTINCT platform || '/' || user_id || '/' || conv_id) AS conversations, count(*) AS turns,
  count(*) FILTER (WHERE tool_used) AS turns_with_tools, count(*) * 2 AS messages, CAST(sum(tool_used::INT + web_call::INT) AS BIGINT) AS tool_calls FROM turn_log""", ("turn_log",))
def summary_counters(spark, d):
    """Counters of a run."""
    from turnscope.operators.extract import summary_counters as op

    t = turn_log(spark, d)
    return op(t.withColumn("n_msgs", F.lit(2)).withColumn("tools", F.array_compact(F.array(F.when(F.col("tool_used"), "t"), F.when(F.col("web_call"), "web")))))


@query("monthly_rates", """
SELECT month, count(*) AS turns, avg(tool_used::INT) AS tool_rate, avg(web_call::INT) AS web_rate, avg((tool_used AND NOT web_call)::INT) AS other_tool_rate FROM turn_log GROUP BY month""", ("turn_log",))
def monthly_rates(spark, d):
    """A1."""
    return D.monthly_rates(turn_log(spark, d))


@query("platform_web_rates", """
SELECT platform, month, count(*) AS turns, count(*) FILTER (WHERE web_call) AS web_turns, avg(web_call::INT) AS web_rate FROM turn_log WHERE month >= '1997-01-01'
GROUP BY GROUPING SETS ((platform, month), (platform))""", ("turn_log",))
def platform_web_rates(spark, d):
    """A2."""
    return D.platform_web_rates(turn_log(spark, d), "1997-01-01")


@query("topic_shares", """
SELECT topic, count(*) AS web_turns, count(*) / sum(count(*)) OVER () AS share FROM turn_log WHERE web_call AND topic NOT IN ('MACHINERY') GROUP BY topic""", ("turn_log",))
def topic_shares(spark, d):
    """A3."""
    return D.topic_shares(turn_log(spark, d), ("MACHINERY",))


@query("topic_web_rates", f"""
SELECT topic, coalesce(turns, 0) AS turns, coalesce(web_rate, 0) AS web_rate FROM (SELECT unnest({list(SEGMENTS)}) AS topic)
LEFT JOIN (SELECT topic, count(*) AS turns, avg(web_call::INT) AS web_rate FROM turn_log GROUP BY topic) USING (topic) WHERE topic NOT IN ('Other', 'Misc')""", ("turn_log",))
def topic_web_rates(spark, d):
    """A4, zero-filled to a taxonomy."""
    return D.topic_web_rates(turn_log(spark, d), spark.createDataFrame([(s,) for s in SEGMENTS], "topic string"))


@query("topics_over_time", """
WITH g AS (SELECT topic, avg(web_call::INT) AS r, count(*) FILTER (WHERE web_call) AS n FROM turn_log GROUP BY topic),
c AS ((SELECT topic FROM g ORDER BY r DESC, topic LIMIT 2) UNION (SELECT topic FROM g ORDER BY n DESC, topic LIMIT 2)),
m AS (SELECT month, count(*) AS month_total FROM turn_log GROUP BY month),
p AS (SELECT month, topic, count(*) AS prompts, avg(web_call::INT) AS web_rate FROM turn_log GROUP BY month, topic)
SELECT m.month, c.topic, month_total, coalesce(prompts, 0) AS prompts, coalesce(web_rate, 0) AS web_rate, coalesce(prompts, 0) / month_total AS share
FROM m CROSS JOIN c LEFT JOIN p ON p.month = m.month AND p.topic = c.topic""", ("turn_log",))
def topics_over_time(spark, d):
    """A5."""
    return D.topics_over_time(turn_log(spark, d), 2)


@query("topic_platform_pivot", """
WITH p AS (SELECT topic, """ + ", ".join(f"coalesce(avg(web_call::INT) FILTER (WHERE platform = '{r}'), 0) * 100 AS {r.lower().replace(' ', '_')}" for r in REGIONS) + """ FROM turn_log GROUP BY topic)
SELECT *, row_number() OVER (ORDER BY america DESC, topic) AS position FROM p""", ("turn_log",))
def topic_platform_pivot(spark, d):
    """A6."""
    return D.topic_platform_pivot(turn_log(spark, d), REGIONS, "AMERICA")


@query("tool_intents", """
SELECT l AS intent, pos AS position, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS share
FROM (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('9-NONE', 3)) v(l, pos) LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_orderpriority = l""")
def tool_intents(spark, d):
    """Shares of a fixed list of labels."""
    t = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("intent"))
    return D.label_distribution(t, "intent", ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"])


@query("model_mentions", """
WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS last, list_distinct(list(event_type)) AS ms FROM events GROUP BY user_id),
n AS (SELECT m AS model, count(*) AS mentions FROM (SELECT unnest(ms) AS m FROM s) GROUP BY m), p AS (SELECT last AS model, count(*) AS primary_turns FROM s GROUP BY last)
SELECT coalesce(n.model, p.model) AS model, coalesce(mentions, 0) AS mentions, coalesce(primary_turns, 0) AS primary_turns FROM n FULL JOIN p ON n.model = p.model""")
def model_mentions(spark, d):
    """Explode against last."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("models"))
    return D.model_mentions(e)


@query("call_outcomes", """
WITH s AS (SELECT l_orderkey, CASE WHEN l_partkey % 5 > 0 THEN l_linenumber % 2 = 0 END AS used, (l_quantity % 5 > l_discount * 50)::INT + (l_linenumber > l_tax * 50)::INT AS pn, (l_quantity % 5 < l_discount * 50)::INT + (l_linenumber < l_tax * 50)::INT AS pr FROM lineitem)
SELECT CASE WHEN used AND pr = 0 AND pn >= 1 THEN 'Over Call' WHEN NOT coalesce(used, false) AND pn = 0 AND pr = 2 THEN 'Under Call' ELSE 'Right Call' END AS outcome, pn AS prefer_none, pr AS prefer_required, count(*) AS n FROM s GROUP BY ALL""")
def call_outcomes(spark, d):
    """Preference counts and outcome of the decision."""
    li = table(spark, d, "lineitem")
    s = li.select(F.when(F.col("l_partkey") % 5 > 0, F.col("l_linenumber") % 2 == 0).alias("used"), (F.col("l_quantity") % 5).alias("none_a_score"), (F.col("l_discount") * 50).alias("required_a_score"), F.col("l_linenumber").cast("double").alias("none_b_score"), (F.col("l_tax") * 50).alias("required_b_score"))
    pn, pr, _ = D.preference(["a", "b"])
    s = s.withColumn("prefer_none", pn).withColumn("prefer_required", pr)
    return s.groupBy(D.call_outcome(F.col("used"), F.col("prefer_none"), F.col("prefer_required"), 2).alias("outcome"), "prefer_none", "prefer_required").agg(F.count("*").alias("n"))


@query("before_first_call", """
SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM (
  SELECT *, coalesce(max((event_type = 'purchase' AND value > 50)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events) WHERE seen = 0 GROUP BY user_id""")
def before_first_call(spark, d):
    """A10: messages up to the first web signal."""
    e = table(spark, d, "events").withColumn("signal", (F.col("event_type") == "purchase") & (F.col("value") > 50))
    return D.before_first(e, ["user_id"], "event_id", "signal").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("month_bucket_shares", """
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m-01') AS month, CASE WHEN n >= 5 THEN '5+' ELSE n::VARCHAR END AS bucket FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
g AS (SELECT month, bucket, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT * FROM (SELECT DISTINCT month FROM g) CROSS JOIN (SELECT unnest(['1', '2', '3', '4', '5+']) AS bucket))
SELECT month, bucket, coalesce(n, 0) AS n, 100.0::DOUBLE * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY month) AS pct FROM s LEFT JOIN g USING (month, bucket)""")
def month_bucket_shares(spark, d):
    """Iteration buckets by month on a full spine."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-01").alias("month"))
    return D.bucketed_month_shares(o.join(n, F.col("o_orderkey") == F.col("l_orderkey")), "n", 5)


@query("fanout_month_spine", """
WITH g AS (SELECT strftime(o_orderdate, '%Y-%m-01') AS month, count(*) AS n, sum(o_orderkey % 3) / count(*) AS mean_fanout FROM orders GROUP BY 1)
SELECT strftime(m, '%Y-%m-%d') AS month, coalesce(n, 0) AS n, coalesce(mean_fanout, 0) AS mean_fanout FROM (SELECT unnest(generate_series(DATE '2000-09-01', DATE '2002-01-01', INTERVAL 1 MONTH)) AS m) LEFT JOIN g ON g.month = strftime(m, '%Y-%m-%d')""")
def fanout_month_spine(spark, d):
    """A fixed list of months, zero-filled."""
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("month")).agg(F.count("*").alias("n"), F.avg(F.col("o_orderkey") % 3).alias("mean_fanout"))
    return stats.on_spine(o, stats.month_spine(spark, "2000-09-01", "2002-01-01"), ["month"], {"n": 0, "mean_fanout": 0.0})


@query("evaluation_rows", """
SELECT conv_id, turn_no, len(user_text) AS chars FROM chat_turns WHERE conv_starter = 1 AND user_text <> '' AND regexp_matches(lower(user_text), '(^|[^\\w])the([^\\w]|$)') AND n_msgs <= 2""", ("chat_turns",))
def evaluation_rows(spark, d):
    """Conversation starters in one language with one user message."""
    t = chat_turns(spark, d).filter("conv_starter = 1 and user_text <> '' and n_msgs <= 2").filter(F.lower("user_text").rlike(r"(^|[^\w])the([^\w]|$)"))
    return t.select("conv_id", "turn_no", F.length("user_text").cast("long").alias("chars"))
