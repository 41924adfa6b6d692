"""Queries on exports: the conversations table written as the export of each platform, then read by the scan and extraction operators.

An assistant's message searches k times, k being the length of its text modulo 4; search i finds a page of
one of five sites, pages of odd i are cited, and at k = 3 a page that was never found, too. The SQL works from the conversations themselves.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions import text as T
from turnscope.functions import topics, values
from turnscope.operators import citations, extract, grounding, rounds
from turnscope.sources import exports

from .views import table

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql.strip()
        return f

    return add


# --- exports from the conversations table ----------------------------------------------------


def _messages(spark, d, system: bool):
    m = table(spark, d, "conversations")
    if not system:
        m = m.filter("role <> 'system'")
    w = W.partitionBy("conv_id").orderBy("turn")
    k = F.when(F.col("role") == "assistant", F.length("text") % 4).otherwise(0)
    return m.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role", "text", k.cast("int").alias("k"), F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat(F.lit("n"), F.lag("turn").over(w).cast("string")).alias("before"), F.concat(F.lit("n"), F.lead("turn").over(w).cast("string")).alias("after"),
    )


def _each(f, k=None):
    """f(i) for i in 1 .. k, an empty list for none."""
    k = F.col("k") if k is None else k
    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= k), f)


def _url(i):
    return F.concat(F.lit("https://www.Site"), ((F.col("t") * 3 + i) % 5).cast("string"), F.lit(".com/p"), i.cast("string"))


def _title(i):
    return F.concat(F.lit("T"), i.cast("string"))


def _search(i):
    return F.concat(F.lit("find "), (i % 2).cast("string"), F.lit(" in "), F.col("t").cast("string"))


def _struct(**fields):
    return F.struct(*[v.alias(n) for n, v in fields.items()])


def _odd(f):
    return F.transform(F.filter(_each(lambda i: i), lambda i: i % 2 == 1), f)


def _clock():
    return F.concat(F.lit("2024-01-"), F.lpad((F.col("c") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:"), F.lpad(F.col("t").cast("string"), 2, "0"), F.lit(":00"))


def _gathered(m, item):
    """One list of items per conversation, in order."""
    by_turn = lambda a, b: F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(0)  # noqa: E731  (items may hold maps, which have no order)
    g = m.select("c", "t", item.alias("x")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("t", "x")), by_turn).alias("xs"), F.min("t").alias("first"))
    return g.select("c", "first", F.transform("xs", lambda e: e["x"]).alias("xs"))


def _tree(m, message, **more):
    """Mapping of nodes along their order below a root without a message; every other conversation leaves the children to be found by their parents."""
    children = F.when((F.col("c") % 2 == 0) & F.col("after").isNotNull(), F.array("after")) if not more else F.when(F.col("after").isNotNull(), F.array("after"))
    node = _struct(**more, parent=F.coalesce("before", F.lit("root")), children=F.coalesce(children, F.array().cast("array<string>")), message=message)
    g = _gathered(m, F.struct(F.concat(F.lit("n"), F.col("t").cast("string")).alias("key"), node.alias("value")))
    kind = g.schema["xs"].dataType.elementType["value"].dataType
    root = _struct(**{n: F.lit("root") for n in more}, parent=F.lit(None).cast("string"), children=F.array(F.concat(F.lit("n"), F.col("first").cast("string"))), message=F.lit(None).cast(kind["message"].dataType))
    return g.select(F.col("c").cast("string").alias("id"), F.map_from_entries(F.concat(F.array(F.struct(F.lit("root").alias("key"), root.alias("value"))), F.col("xs"))).alias("mapping"))


def _chatgpt(spark, d):
    m = _messages(spark, d, system=True)
    cited = F.lit("?utm_source=chatgpt.com")
    entry = lambda i: _struct(url=_url(i), title=_title(i), snippet=F.lit("s"), ref_id=_struct(turn_index=F.col("t"), ref_index=i))
    item = lambda i: _struct(url=F.concat(_url(i), cited), title=_title(i), refs=F.array(_struct(turn_index=F.col("t"), ref_index=i)))
    none = F.array().cast("array<struct<url:string,title:string>>")
    meta = _struct(
        model_slug=F.when(F.col("role") == "assistant", F.concat(F.lit("gpt-"), (F.col("c") % 3).cast("string"))),
        search_queries=_each(lambda i: _struct(q=_search(i))), search_model_queries=_struct(queries=F.when(F.col("k") == 3, F.array(F.concat(F.lit("more "), F.col("t").cast("string")))).otherwise(F.array().cast("array<string>"))),
        search_result_groups=F.filter(F.array(_struct(entries=_each(entry))), lambda g: F.size(g["entries"]) > 0), safe_urls=_each(lambda i: F.concat(_url(i), cited), F.least("k", F.lit(1))),
        content_references=F.array(_struct(items=_odd(item), sources=F.when(F.col("k") == 3, F.array(_struct(url=F.concat(F.lit("https://other.org/"), F.col("t").cast("string")), title=F.lit("O")))).otherwise(none))),
    )
    message = _struct(id=F.col("id"), author=_struct(role=F.col("role")), create_time=(1_700_000_000 + F.col("c") * 86_400 + F.col("t")).cast("double"), content=_struct(content_type=F.lit("text"), parts=F.array("text")), metadata=meta)
    return _tree(m, message).select(F.to_json(F.array(F.struct("id", "mapping"))).alias("value"))


def _claude(spark, d):
    m = _messages(spark, d, system=False)
    block = "struct<type:string,text:string,name:string,input:struct<query:string>,citations:array<struct<url:string,title:string,start_index:int,end_index:int,details:struct<url:string>>>,content:array<struct<type:string,url:string,title:string,text:string>>>"
    none = lambda kind: F.lit(None).cast(kind)
    cites = "array<struct<url:string,title:string,start_index:int,end_index:int,details:struct<url:string>>>"
    found = "array<struct<type:string,url:string,title:string,text:string>>"

    def made(kind, text=None, name=None, query=None, citations=None, content=None):
        return _struct(type=F.lit(kind), text=none("string") if text is None else text, name=none("string") if name is None else F.lit(name), input=_struct(query=none("string") if query is None else query), citations=none(cites) if citations is None else citations.cast(cites), content=none(found) if content is None else content.cast(found))

    calls = _each(lambda i: made("tool_use", name="web_search", query=_search(i)))
    results = _each(lambda i: made("tool_result", name="web_search", content=F.array(_struct(type=F.lit("text"), url=_url(i), title=_title(i), text=F.lit("s")))))
    said = made("text", text=F.col("text"), citations=F.concat(_odd(lambda i: _struct(url=F.lit("https://x.org"), title=_title(i), start_index=F.lit(0), end_index=F.lit(2), details=_struct(url=_url(i)))), F.when(F.col("k") == 3, F.array(_struct(url=F.concat(F.lit("https://other.org/"), F.col("t").cast("string")), title=F.lit("O"), start_index=F.lit(0), end_index=F.lit(2), details=_struct(url=F.lit(""))))).otherwise(F.array().cast(cites))))
    kind = f"array<{block}>"
    content = F.when(F.col("role") == "assistant", F.concat(calls.cast(kind), results.cast(kind), F.array(said).cast(kind))).otherwise(F.array().cast(kind))
    message = _struct(uuid=F.col("id"), sender=F.when(F.col("role") == "user", "human").otherwise("assistant"), text=F.when(F.col("role") == "user", F.col("text")).otherwise(""), created_at=F.concat(_clock(), F.lit("Z")), content=content)
    g = _gathered(m, message)
    return g.select(F.to_json(F.array(F.struct(F.col("c").cast("string").alias("uuid"), F.col("xs").alias("chat_messages")))).alias("value"))


def _grok(spark, d):
    m = _messages(spark, d, system=False)
    step = lambda i: _struct(tool_usage_cards=F.array(_struct(tool_usage_card_id=F.concat_ws("-", "t", i.cast("string")), tool=F.create_map(F.lit("WebSearch"), _struct(args=_struct(query=_search(i)))))), tool_usage_results=F.array(_struct(result=_struct(WebSearchResults=F.array(_struct(title=_title(i), url=_url(i), preview=F.lit("s")))))))
    cards = F.concat(_odd(lambda i: F.to_json(_struct(id=F.concat(F.lit("k"), i.cast("string")), cardType=F.lit("citation_card"), url=_url(i), title=_title(i)))), F.when(F.col("k") == 3, F.array(F.lit("no json"), F.to_json(_struct(cardType=F.lit("citation_card"), url=F.concat(F.lit("https://other.org/"), F.col("t").cast("string")), title=F.lit("O"))))).otherwise(F.array().cast("array<string>")))
    ms = (1_700_000_000_000 + F.col("c") * 86_400_000 + F.col("t") * 1_000).cast("string")
    response = _struct(
        _id=F.col("id"), sender=F.when(F.col("role") == "user", "human").when(F.col("c") % 2 == 0, "ASSISTANT").otherwise("assistant"), message=F.col("text"), model=F.when(F.col("role") == "assistant", F.lit("g")).otherwise(""),
        create_time=F.struct(F.struct(ms.alias("$numberLong")).alias("$date")), metadata=_struct(memoryReferences=F.array(_struct(summary=F.concat(F.lit("likes "), F.col("c").cast("string"))))),
        web_search_results=_each(lambda i: _struct(url=_url(i), title=_title(i), preview=F.lit("s"))), card_attachments_json=cards, steps=_each(step),
    )
    g = _gathered(m, _struct(response=response))
    conv = F.struct(F.struct(F.col("c").cast("string").alias("id")).alias("conversation"), F.reverse("xs").alias("responses"))  # out of order: time sorts them
    return g.select(F.to_json(F.struct(F.array(conv).alias("conversations"))).alias("value"))


def _deepseek(spark, d):
    m = _messages(spark, d, system=False)
    fragment = "array<struct<type:string,content:string,results:array<struct<url:string,title:string,snippet:string,cite_index:int,query_indexes:array<int>>>>>"
    none = F.lit(None)
    found = _each(lambda i: _struct(url=_url(i), title=_title(i), snippet=F.lit("s"), cite_index=i - 1, query_indexes=F.array(i)))
    search = F.filter(F.array(_struct(type=F.lit("SEARCH"), content=none.cast("string"), results=found)), lambda f: F.size(f["results"]) > 0)
    said = F.concat(F.col("text"), F.when(F.col("k") > 0, F.lit(" [citation:0] [citation:9] [citation:0]")).otherwise(""))
    talk = F.array(_struct(type=F.when(F.col("role") == "user", "REQUEST").otherwise("RESPONSE"), content=F.when(F.col("role") == "user", F.col("text")).otherwise(said), results=none.cast("array<struct<url:string,title:string,snippet:string,cite_index:int,query_indexes:array<int>>>")))
    message = _struct(model=F.when(F.col("role") == "assistant", F.lit("d")).otherwise(""), inserted_at=F.concat(_clock(), F.lit(".000+08:00")), fragments=F.concat(search.cast(fragment), talk.cast(fragment)))
    return _tree(m, message, id=F.concat(F.lit("n"), F.col("t").cast("string"))).select(F.to_json(F.array(F.struct("id", "mapping"))).alias("value"))


EXPORTS = {"chatgpt": _chatgpt, "claude": _claude, "grok": _grok, "deepseek": _deepseek}


def _turns(spark, d, platform):
    texts = EXPORTS[platform](spark, d).withColumn("user_id", F.lit(0))
    return extract.turns(extract.messages(exports.parse_conversations(texts, platform), platform), platform)


# --- what the operators should find ----------------------------------------------------------

_M = """m AS (SELECT conv_id AS c, turn AS t, role, text, CASE WHEN role = 'assistant' THEN length(text) % 4 ELSE 0 END AS k, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations WHERE role <> 'system'),
g AS (SELECT c, segment, min(t) AS first, max(t) AS last, count(*) AS n_msgs, sum(k)::BIGINT AS k, count(*) FILTER (WHERE k > 0) AS searching, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a,
  arg_max(text, t) AS last_text, arg_min(text, t) FILTER (WHERE role = 'user') AS asked FROM m GROUP BY c, segment)"""
_FOUND = "f AS (SELECT c, segment, t, k, i, 'https://www.Site' || (t * 3 + i) % 5 || '.com/p' || i AS url, 'Site' || (t * 3 + i) % 5 || '.com' AS domain FROM m CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) WHERE i <= k)"
_NODE = {"chatgpt": "c || '-' || first", "claude": "c || '-' || first", "grok": "c || '-' || first", "deepseek": "'n' || first"}
_TOOLS = {"chatgpt": "CASE WHEN searching > 0 THEN 'web_search' ELSE '' END", "claude": "rtrim(repeat('web_search|', k), '|')", "grok": "rtrim(repeat('WebSearch|', k), '|')", "deepseek": "rtrim(repeat('SEARCH|', searching), '|')"}
_MODEL = {"chatgpt": "CASE WHEN a > 0 THEN 'gpt-' || c % 3 ELSE 'Unknown' END", "claude": "'Unknown'", "grok": "CASE WHEN a > 0 THEN 'g' ELSE 'Unknown' END", "deepseek": "CASE WHEN a > 0 THEN 'd' ELSE 'Unknown' END"}
_STAMP = "strftime(TIMESTAMP '2023-11-14 22:13:20' + to_days(c::INT) + to_seconds(last), '%Y-%m-%d %H:%M:%S')"
_WALL = "'2024-01-' || lpad((c % 28 + 1)::VARCHAR, 2, '0') || ' 10:' || lpad(last::VARCHAR, 2, '0') || ':00'"
_TIME = {"chatgpt": _STAMP, "claude": _WALL, "grok": _STAMP, "deepseek": _WALL}
_NO_ANSWERS = ("grok",)


def _turns_sql(p):
    answers = "0::BIGINT" if p in _NO_ANSWERS else "CAST(sum(a) OVER w AS BIGINT)"
    extra = " + (searching > 0)::INT" if p == "chatgpt" else ""
    return f"""WITH {_M} SELECT c::VARCHAR AS conv_id, segment::BIGINT AS segment, {_NODE[p]} AS turn_id, n_msgs::BIGINT AS n_msgs, {_TOOLS[p]} AS tools, k > 0 AS web_call, (n_msgs{extra})::BIGINT AS n_interactions, CAST(sum(u) OVER w AS BIGINT) AS asked_so_far, {answers} AS answered_so_far,
  (row_number() OVER w = 1)::INT AS conv_starter, {_MODEL[p]} AS model, {_TIME[p]} AS time FROM g WINDOW w AS (PARTITION BY c ORDER BY segment)"""


def _turns_of(platform):
    def run(spark, d):
        t = _turns(spark, d, platform)
        return t.select(
            "conv_id", "segment", "turn_id", F.col("n_msgs").cast("long").alias("n_msgs"), F.array_join("tools", "|").alias("tools"), F.coalesce(extract.web_call(F.col("tools"), F.col("platform")), F.lit(False)).alias("web_call"),
            F.size("interactions").cast("long").alias("n_interactions"), F.size("user_msg_history").cast("long").alias("asked_so_far"), F.size("assistant_msg_history").cast("long").alias("answered_so_far"),
            "conv_starter", values.primary_model(F.col("models")).alias("model"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"),
        )

    run.__doc__ = f"Turns of the {platform} export: order, segments, tools, histories, models, times."
    return run


_FIND = "'find ' || (i % 2) || ' in ' || t"
#: One row per round: c, segment, t (message), i (round in the message), q (its queries).
_ROUNDS = {
    "chatgpt": "r AS (SELECT c, segment, t, 1 AS i, CASE k WHEN 1 THEN ['find 1 in ' || t] WHEN 2 THEN ['find 1 in ' || t, 'find 0 in ' || t] ELSE ['find 1 in ' || t, 'find 0 in ' || t, 'more ' || t] END AS q, k AS n FROM m WHERE k > 0)",
    "claude": f"r AS (SELECT c, segment, t, i, [{_FIND}] AS q, 1 AS n FROM f)",
    "grok": f"r AS (SELECT c, segment, t, i, [{_FIND}] AS q, 1 AS n FROM f)",
    "deepseek": "r AS (SELECT c, segment, t, 1 AS i, list_transform(range(1, k + 1), lambda x: 'Query ' || x || ' of Iter 1') AS q, k AS n FROM m WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY c, segment ORDER BY t) = 1)",
}


def _rounds_sql(p):
    return f"""WITH {_M}, {_FOUND}, {_ROUNDS[p]}, a AS (SELECT c, segment, count(*) AS n_rounds, sum(len(q))::BIGINT AS n_queries, string_agg(array_to_string(q, '|'), '||' ORDER BY t, i) AS queries, arg_max(q[-1], t * 10 + i) AS latest, sum(n)::BIGINT AS n_sources FROM r GROUP BY c, segment)
SELECT g.c::VARCHAR AS conv_id, g.segment::BIGINT AS segment, coalesce(n_rounds, 0)::BIGINT AS n_rounds, coalesce(n_queries, 0)::BIGINT AS n_queries, coalesce(queries, '') AS queries, latest, coalesce(n_sources, 0)::BIGINT AS n_sources FROM g LEFT JOIN a USING (c, segment)"""


def _rounds_of(platform):
    def run(spark, d):
        t = rounds.query_rounds(_turns(spark, d, platform), platform)
        groups = values.clean_groups(F.col("web_queries"))
        return t.select(
            "conv_id", "segment", F.size(groups).cast("long").alias("n_rounds"), values.query_count(F.col("web_queries")).alias("n_queries"), F.array_join(F.transform(groups, lambda g: F.array_join(g, "|")), "||").alias("queries"),
            values.last_of(F.flatten(groups)).alias("latest"), F.size(F.flatten("sources")).cast("long").alias("n_sources"),
        )

    run.__doc__ = f"Query rounds of the {platform} export, cleaned and counted, with the latest query."
    return run


def _sources_sql(p):
    ref = {"chatgpt": "i", "deepseek": "i - 1"}.get(p, "NULL::INT")
    other = "SELECT c, segment, t, 9 AS i, 'https://other.org/' || t AS url, 'other.org' AS domain, NULL::INT AS ref FROM m WHERE k = 3"
    cited = f"SELECT c, segment, t, i, url, domain, {'i' if p == 'chatgpt' else 'NULL::INT'} AS ref FROM f WHERE i % 2 = 1 UNION ALL {other}"
    if p == "deepseek":
        cited = "SELECT * FROM (SELECT c, segment, t, 1 AS i, url, domain, 0 AS ref FROM f WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY c, segment ORDER BY t) = 1) UNION ALL SELECT c, segment, 9999 AS t, 9 AS i, '' AS url, '' AS domain, 9 AS ref FROM g WHERE searching > 0"
    safe = " UNION ALL SELECT c, segment, t, i, 'safe' AS kind, url, domain, NULL::INT AS ref FROM f WHERE i = 1" if p == "chatgpt" else ""
    return f"""WITH {_M}, {_FOUND}, x AS ({cited}), s AS (SELECT c, segment, t, i, 'retrieved' AS kind, url, domain, {ref} AS ref FROM f UNION ALL SELECT c, segment, t, i, 'cited' AS kind, url, domain, ref FROM x{safe})
SELECT c::VARCHAR AS conv_id, segment::BIGINT AS segment, kind, (row_number() OVER (PARTITION BY c, segment, kind ORDER BY t, i) - 1)::INT AS pos, url, domain, coalesce(ref, -1)::INT AS ref_index FROM s"""


def _sources_of(platform):
    def run(spark, d):
        t = citations.response_and_sources(_turns(spark, d, platform), platform)
        return citations.long_sources(t, ["conv_id", "segment"]).select("conv_id", "segment", "kind", "pos", "url", "domain", F.coalesce("ref_index", F.lit(-1)).alias("ref_index"))

    run.__doc__ = f"Retrieved, safe and cited sources of the {platform} export, one a row."
    return run


def _responses_sql(p):
    said = {"chatgpt": "last_text", "claude": "trim(coalesce(said, ''))", "grok": "trim(coalesce(said, ''))", "deepseek": "trim(coalesce(said, ''))"}[p]
    between = "'\n'" if p == "deepseek" else "' '"
    mark = " || CASE WHEN k > 0 THEN ' [citation:0] [citation:9] [citation:0]' ELSE '' END" if p == "deepseek" else ""
    return f"""WITH {_M}, j AS (SELECT c, segment, string_agg(text{mark}, {between} ORDER BY t) FILTER (WHERE role = 'assistant' AND text <> '') AS said FROM m GROUP BY c, segment)
SELECT c::VARCHAR AS conv_id, segment::BIGINT AS segment, trim(coalesce(asked, '')) AS asked, sha256({said}) AS said FROM g JOIN j USING (c, segment)"""


def _responses_of(platform):
    def run(spark, d):
        t = citations.response_and_sources(_turns(spark, d, platform), platform)
        return t.select("conv_id", "segment", F.col("user_query").alias("asked"), F.sha2("assistant_response", 256).alias("said"))

    run.__doc__ = f"Question and answer of every turn of the {platform} export."
    return run


for _p in extract.PLATFORMS:
    query(f"export_turns_{_p}", _turns_sql(_p))(_turns_of(_p))
    query(f"export_rounds_{_p}", _rounds_sql(_p))(_rounds_of(_p))
    query(f"export_sources_{_p}", _sources_sql(_p))(_sources_of(_p))
    query(f"export_responses_{_p}", _responses_sql(_p))(_responses_of(_p))


@query("export_grounding", f"""WITH {_M}, {_FOUND}, cited AS (SELECT c, segment, i, 'site' || (t * 3 + i) % 5 || '.com' AS domain FROM f WHERE i % 2 = 1 UNION ALL SELECT c, segment, 9, 'other.org' FROM m WHERE k = 3),
first AS (SELECT c, lower(domain) AS domain, min(segment) AS first FROM f GROUP BY ALL)
SELECT count(*) FILTER (WHERE coalesce(first <= segment, false)) AS external, count(*) FILTER (WHERE NOT coalesce(first <= segment, false)) AS internal FROM cited LEFT JOIN first USING (c, domain)""")
def export_grounding(spark, d):
    """Grounding of the ChatGPT export's citations in what the conversation has retrieved so far, by folded domain."""
    t = citations.response_and_sources(_turns(spark, d, "chatgpt"), "chatgpt")
    s = grounding.matchable(citations.long_sources(t, ["conv_id", "segment"]))
    return grounding.grounding(s, "conversation", order="segment").agg(F.count_if("external").alias("external"), F.count_if(~F.col("external")).alias("internal"))


@query("export_counters", f"WITH {_M} SELECT 4 AS users, CAST(4 * count(DISTINCT c) AS BIGINT) AS conversations, CAST(4 * count(*) AS BIGINT) AS turns, CAST(4 * count(*) FILTER (WHERE k > 0) AS BIGINT) AS turns_with_tools, CAST(4 * sum(n_msgs) AS BIGINT) AS messages, CAST(sum(2 * k + searching + (searching > 0)::INT) AS BIGINT) AS tool_calls FROM g")
def export_counters(spark, d):
    """Summary counters over the exports of all platforms."""
    cols = ["platform", "user_id", "conv_id", "tools", "n_msgs"]
    out = None
    for p in extract.PLATFORMS:
        one = _turns(spark, d, p).select(*cols)
        out = one if out is None else out.unionByName(one)
    return extract.summary_counters(out).withColumn("users", F.col("users").cast("int"))


# --- functions on scalars ----------------------------------------------------------------------


@query("coerced_lists", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '|' || event_id WHEN 1 THEN event_type || '|x' WHEN 2 THEN event_type WHEN 3 THEN event_id::VARCHAR ELSE '' END AS items, CASE WHEN event_id % 5 < 2 THEN 2 WHEN event_id % 5 < 4 THEN 1 ELSE 0 END AS n FROM events")
def coerced_lists(spark, d):
    """lists as JSON, as Python literals, as bare words and numbers, and nulls."""
    e = table(spark, d, "events").select("event_id", "event_type")
    k, q = F.col("event_id") % 5, F.lit('"')
    raw = F.when(k == 0, F.concat(F.lit("["), q, F.col("event_type"), q, F.lit(", "), F.col("event_id").cast("string"), F.lit("]"))).when(k == 1, F.concat(F.lit("('"), F.col("event_type"), F.lit("', 'x')"))).when(k == 2, F.col("event_type")).when(k == 3, F.col("event_id").cast("string"))
    got = values.coerce_list(raw)
    return e.withColumn("got", got).select("event_id", F.array_join("got", "|").alias("items"), F.size("got").alias("n"))


@query("coerced_scalars", "SELECT event_id, event_id % 4 < 2 AS flag, event_id % 3 > 0 AS whole, event_id % 5 > 1 AS part, CASE WHEN event_id % 3 = 0 THEN value END AS number, strftime(ts, '%Y-%m-01') AS month FROM events")
def coerced_scalars(spark, d):
    """truth words, truth of whole numbers (0, 1, 2) and of others (0.0, null, 0.5, 1.0, -1.5), finite numbers, months."""
    e = table(spark, d, "events")
    word = F.when(F.col("event_id") % 4 == 0, " YES\n").when(F.col("event_id") % 4 == 1, "1").when(F.col("event_id") % 4 == 2, "off")
    part = F.when(F.col("event_id") % 5 == 0, 0.0).when(F.col("event_id") % 5 == 2, 0.5).when(F.col("event_id") % 5 == 3, 1.0).when(F.col("event_id") % 5 == 4, -1.5)
    number = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, "inf").otherwise("n/a")
    return e.select("event_id", values.parse_bool(word).alias("flag"), values.parse_bool(F.col("event_id") % 3).alias("whole"), values.parse_bool(part).alias("part"), values.finite(number).alias("number"), values.month_start(F.col("ts")).alias("month"))


@query("judged_objects", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def judged_objects(spark, d):
    """the object in a judge's answer, after words with braces of their own."""
    e = table(spark, d, "events")
    answer = F.concat(F.lit("Sure {as asked}: ```json\n"), F.col("props"), F.lit("\n``` {done}"))
    return e.select("event_id", F.get_json_object(T.first_json_object(answer), "$.k").cast("long").alias("k"))


_OLD = {where: sorted(pairs) for where, pairs in topics.RENAMES.items()}
_NAMED = "CASE o_orderkey % {n} {whens} ELSE 'Other' END"


def _renamed_sql(where):
    old = _OLD[where]
    whens = " ".join(f"WHEN {i} THEN '{topics.RENAMES[where][x]}'" for i, x in enumerate(old))
    return f"SELECT '{where}' AS place, {_NAMED.format(n=len(old) + 1, whens=whens)} AS topic, count(*) AS n FROM orders GROUP BY ALL"


@query("renamed_topics", " UNION ALL ".join(_renamed_sql(w) for w in _OLD))
def renamed_topics(spark, d):
    """old topic names by their new ones."""
    out = None
    for where, old in _OLD.items():
        names = F.array(*[F.lit(x) for x in [*old, "Other"]])
        o = table(spark, d, "orders").select(topics.rename(F.element_at(names, (F.col("o_orderkey") % (len(old) + 1) + 1).cast("int")), where).alias("topic"))
        one = o.groupBy(F.lit(where).alias("place"), "topic").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("markdown_claims", """WITH s AS (SELECT event_id, event_type AS w, event_id % 3 AS k FROM events),
x AS (SELECT event_id, 0 AS claim_idx, 'First about ' || w || '.' AS claim, ['https://a.org/' || event_id] AS urls, 0 AS s FROM s
  UNION ALL SELECT event_id, 1, 'Then more of ' || w || '.', CASE WHEN k = 1 THEN ['https://a.org/' || event_id, 'https://b.org'] ELSE ['https://a.org/' || event_id] END, length('First about ' || w || '. ') FROM s
  UNION ALL SELECT event_id, 2, 'Last words without a link.', [], length('First about ' || w || '. Then more of ' || w || '. [a](https://a.org/' || event_id || '/)' || CASE WHEN k = 1 THEN ' [b](https://b.org?utm_source=openai)' ELSE '' END || ' ') FROM s WHERE k < 2)
SELECT event_id, claim_idx, claim, array_to_string(urls, '|') AS urls, s::INT AS start, (s + length(claim))::INT AS "end" FROM x""")
def markdown_claims(spark, d):
    """Claims before markdown links, with urls and places; a second link of one place belongs to the last claim."""
    from turnscope.operators import replay

    k = F.col("event_id") % 3
    link = F.concat(F.lit("[a](https://a.org/"), F.col("event_id").cast("string"), F.lit("/)"), F.when(k == 1, " [b](https://b.org?utm_source=openai)").otherwise(""))
    said = F.concat(F.lit("First about "), "event_type", F.lit(". Then more of "), "event_type", F.lit(". "), link, F.when(k < 2, " Last words without a link.").otherwise(" ok"))
    docs = table(spark, d, "events").select("event_id", said.alias("said"))
    got = replay.link_claims(docs, ["event_id"], "said")
    return got.select("event_id", F.col("claim_idx").cast("int").alias("claim_idx"), "claim", F.array_join("urls", "|").alias("urls"), "start", "end")


@query("marker_chunks", """WITH s AS (SELECT event_id, event_type AS w, event_id % 5 AS k FROM events), r AS (SELECT *, 'First about ' || w || '.' AS a, 'Then more of ' || w || '.' AS b, '0:' || k AS one, CASE WHEN k = 1 THEN '|0:9' ELSE '' END AS two FROM s)
SELECT event_id, 'all' AS mode, 0 AS chunk_idx, a AS sentence, one AS refs FROM r UNION ALL SELECT event_id, 'all', 1, b, one || two FROM r UNION ALL SELECT event_id, 'all', 2, 'Last words without any mark.', '' FROM r
UNION ALL SELECT event_id, 'joined', 0, a || ' ' || b, one || two FROM r UNION ALL SELECT event_id, 'joined', 1, 'Last words without any mark.', '' FROM r
UNION ALL SELECT event_id, 'latest', 0, b, one FROM r""")
def marker_chunks(spark, d):
    """Sentences by the markers behind them, one a row, joined, or the last one only."""
    from turnscope.operators import claims

    k = F.col("event_id") % 5
    mark = lambda n: F.concat(F.lit(f"{T.OPEN}cite{T.SEP}turn0search"), n.cast("string"), F.lit(T.CLOSE))
    said = F.concat(F.lit("First about "), "event_type", F.lit(". Then more of "), "event_type", F.lit(". "), mark(k), F.when(k == 1, mark(F.lit(9))).otherwise(""), F.lit(" Last words without any mark."))
    docs = table(spark, d, "events").select("event_id", said.alias("said"))
    out = None
    for name, how in (("all", {}), ("joined", {"joined": True}), ("latest", {"mode": "latest"})):
        one = claims.marker_chunks(docs, ["event_id"], "said", **how)
        one = one.select("event_id", F.lit(name).alias("mode"), F.col("chunk_idx").cast("int").alias("chunk_idx"), "sentence", F.array_join(F.transform("citation_refs", lambda r: F.concat_ws(":", r["turn_index"], r["ref_index"])), "|").alias("refs"))
        out = one if out is None else out.unionByName(one)
    return out
