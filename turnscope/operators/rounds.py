"""Query rounds of turns: what was searched for in each step, with thoughts, sources and memories.

Each function takes the turn table of one platform (turn_msgs as JSON) and returns it with
web_queries (list of rounds of queries), thoughts_list, sources and memories, aligned by round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.functions.urls import plain_domain
from turnscope.sources.exports import element_type

_TEXTS = "array<string>"
_NESTED = "array<array<string>>"


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _list(c: Column) -> Column:
    return F.coalesce(c, _none())


def _source(title: Column, place: Column, body: Column) -> Column:
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(e(title), F.lit("\n"), e(place), F.lit("\n"), e(body))


def parsed(turns: DataFrame, platform: str) -> DataFrame:
    """turns with msgs: the turn's messages parsed."""
    return turns.withColumn("msgs", F.from_json("turn_msgs", f"array<{element_type(platform)}>"))


def _out(turns: DataFrame, rounds: Column) -> DataFrame:
    """rounds: array of (queries, thoughts, sources, memories)."""
    t = turns.withColumn("_rounds", F.coalesce(rounds, F.array().cast(f"array<struct<q:{_TEXTS},t:{_TEXTS},s:{_TEXTS},m:{_TEXTS}>>")))
    pick = lambda name: F.transform("_rounds", lambda r: r[name])
    return t.select(*[c for c in turns.columns if c != "msgs"], pick("q").alias("web_queries"), pick("t").alias("thoughts_list"), pick("s").alias("sources"), pick("m").alias("memories"))


def chatgpt(turns: DataFrame) -> DataFrame:
    """What comes before a message with queries belongs to its round; queries of a round count once, in the order seen."""

    def facts(m):
        content, meta = m["content"], m["metadata"]
        thoughts = F.when(content["content_type"] == "thoughts", _list(F.transform(content["thoughts"], lambda t: F.coalesce(t["content"], F.lit(""))))).otherwise(_none())
        entries = F.flatten(F.transform(meta["search_result_groups"], lambda g: g["entries"]))
        sources = F.concat(_list(F.transform(entries, lambda e: _source(e["title"], plain_domain(e["url"]), e["snippet"]))), _list(F.transform(meta["image_results"], lambda e: _source(e["title"], plain_domain(e["url"]), e["snippet"]))))
        memory = meta["user_context_message_data"]["about_user_message"]
        queries = F.concat(_list(F.transform(meta["search_queries"], lambda q: q["q"])), _list(meta["search_model_queries"]["queries"]))
        return F.struct(F.array_distinct(queries).alias("q"), thoughts.alias("t"), sources.alias("s"), F.when(memory != "", F.array(memory)).otherwise(_none()).alias("m"))

    one = f"struct<q:{_TEXTS},t:{_TEXTS},s:{_TEXTS},m:{_TEXTS}>"
    zero = F.struct(F.array().cast(f"array<{one}>").alias("out"), _none().alias("t"), _none().alias("s"), _none().alias("m"))

    def step(acc, x):
        t, s, m = F.concat(acc["t"], x["t"]), F.concat(acc["s"], x["s"]), F.concat(acc["m"], x["m"])
        closed = F.concat(acc["out"], F.array(F.struct(x["q"].alias("q"), t.alias("t"), s.alias("s"), m.alias("m"))))
        has = F.size(x["q"]) > 0
        return F.struct(F.when(has, closed).otherwise(acc["out"]).alias("out"), F.when(has, _none()).otherwise(t).alias("t"), F.when(has, _none()).otherwise(s).alias("s"), F.when(has, _none()).otherwise(m).alias("m"))

    return _out(turns, F.aggregate(F.transform("msgs", facts), zero, step, lambda acc: acc["out"]))


def claude(turns: DataFrame) -> DataFrame:
    """Every web_search call with a query is a round; results belong to calls in order, as exports carry no ids."""
    blocks = F.flatten(F.transform(F.filter("msgs", lambda m: m["sender"] == "assistant"), lambda m: m["content"]))
    # a result goes to the first open call, so the k-th result that comes after k calls answers the k-th call
    kinds = F.filter(blocks, lambda b: (b["name"] == "web_search") & (((b["type"] == "tool_use") & (F.coalesce(b["input"]["query"], F.lit("")) != "")) | (b["type"] == "tool_result")))
    zero = F.struct(F.array().cast(f"array<struct<q:{_TEXTS},t:{_TEXTS},s:{_TEXTS},m:{_TEXTS}>>").alias("out"), F.lit(0).alias("done"))

    def step(acc, b):
        call = F.struct(F.concat(acc["out"], F.array(F.struct(F.array(b["input"]["query"]).alias("q"), _none().alias("t"), _none().alias("s"), _none().alias("m")))).alias("out"), acc["done"].alias("done"))
        texts = F.transform(F.filter(b["content"], lambda c: c["type"].isin("text", "knowledge") & ((F.coalesce(c["url"], F.lit("")) != "") | (F.coalesce(c["title"], F.lit("")) != "") | (F.coalesce(c["text"], F.lit("")) != ""))), lambda c: _source(c["title"], c["url"], c["text"]))
        filled = F.struct(F.transform(acc["out"], lambda r, i: F.struct(r["q"].alias("q"), r["t"].alias("t"), F.when(i == acc["done"], _list(texts)).otherwise(r["s"]).alias("s"), r["m"].alias("m"))).alias("out"), (acc["done"] + 1).alias("done"))
        return F.when(b["type"] == "tool_use", call).when(acc["done"] < F.size(acc["out"]), filled).otherwise(acc)

    return _out(turns, F.aggregate(kinds, zero, step, lambda acc: acc["out"])).withColumn("memories", F.array().cast(_NESTED))


def grok(turns: DataFrame) -> DataFrame:
    """Each step with a new WebSearch card is a round, with the step's results and the message's memories."""

    def of_message(m):
        memories = _list(F.filter(F.transform(m["metadata"]["memoryReferences"], lambda r: r["summary"]), lambda s: s != ""))
        cards = F.flatten(F.transform(m["steps"], lambda s, i: F.coalesce(F.transform(s["tool_usage_cards"], lambda c: F.struct(i.alias("step"), c["tool_usage_card_id"].alias("id"), F.map_contains_key(c["tool"], "WebSearch").alias("web"), F.try_element_at(c["tool"], F.lit("WebSearch"))["args"]["query"].alias("q"))), F.array().cast("array<struct<step:int,id:string,web:boolean,q:string>>"))))
        searching = F.filter(cards, lambda c: (F.coalesce(c["id"], F.lit("")) != "") & c["web"])
        fresh = F.filter(F.transform(searching, lambda c, i: F.struct(c["step"].alias("step"), c["q"].alias("q"), (F.size(F.filter(F.slice(searching, 1, i), lambda d: d["id"] == c["id"])) == 0).alias("new"))), lambda c: c["new"] & (F.coalesce(c["q"], F.lit("")) != ""))

        def of_step(s, i):
            found = F.flatten(F.transform(s["tool_usage_results"], lambda r: r["result"]["WebSearchResults"]))
            texts = F.filter(F.transform(found, lambda r: _source(r["title"], r["url"], r["preview"])), lambda t: t != "\n\n")
            return F.struct(F.transform(F.filter(fresh, lambda c: c["step"] == i), lambda c: c["q"]).alias("q"), _none().alias("t"), _list(texts).alias("s"), memories.alias("m"))

        return F.filter(F.transform(m["steps"], of_step), lambda r: F.size(r["q"]) > 0)

    own = F.filter("msgs", lambda m: F.lower(m["sender"]) == "assistant")
    return _out(turns, F.flatten(F.filter(F.transform(own, of_message), lambda r: r.isNotNull())))


def deepseek(turns: DataFrame) -> DataFrame:
    """Rounds of the message with most search fragments; queries are known by number only."""

    def of_message(n):
        found = F.filter(n["message"]["fragments"], lambda f: f["type"] == "SEARCH")
        raw = F.filter(
            F.transform(found, lambda f: F.struct(F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(f["results"], lambda r: r["query_indexes"]), lambda x: x.isNotNull())))).alias("i"), _list(F.filter(F.transform(f["results"], lambda r: _source(r["title"], r["url"], r["snippet"])), lambda t: t != "\n\n")).alias("s"))),
            lambda r: F.size(r["i"]) > 0,
        )
        return F.transform(raw, lambda r, k: F.struct(F.transform(r["i"], lambda q: F.concat(F.lit("Query "), q.cast("string"), F.lit(" of Iter "), (k + 1).cast("string"))).alias("q"), _none().alias("t"), r["s"].alias("s"), _none().alias("m")))

    each = F.filter(F.transform("msgs", of_message), lambda r: r.isNotNull() & (F.size(r) > 0))
    most = F.array_max(F.transform(each, lambda r: F.size(r)))
    return _out(turns, F.try_element_at(F.filter(each, lambda r: F.size(r) == most), F.lit(1))).withColumn("memories", F.array().cast(_NESTED))


ROUNDS = {"chatgpt": chatgpt, "claude": claude, "grok": grok, "deepseek": deepseek}


def query_rounds(turns: DataFrame, platform: str) -> DataFrame:
    return ROUNDS[platform](parsed(turns, platform))
