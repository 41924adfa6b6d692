"""Extraction: export conversations to messages, messages to turns.

A turn is a user message with all that follows it up to the next; messages ahead of the first
user message are a turn of their own. All steps are column expressions, windows over one conversation and
one aggregate by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.sources.stored import discard, stored

from . import trees

#: What counts as a web search call on each platform.
MARKER_TOOL = "web_search"
LEGACY_BROWSERS = ("browser", "web", "web.run")
GROK_WEB_TOOLS = ("WebSearch",)
DEEPSEEK_WEB_TOOLS = ("SEARCH",)
TEXT_FRAGMENTS = ("REQUEST", "RESPONSE", "THINK")
PLATFORMS = ("chatgpt", "claude", "grok", "deepseek")


# --- time ----------------------------------------------------------------------------------


def epoch_time(x: Column) -> Column:
    """Seconds or, above 1e12, milliseconds since 1970 as a timestamp without zone (UTC)."""
    seconds = F.when(x > 1e12, x / 1000).otherwise(x)
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")).cast("timestamp_ntz")


def iso_time(x: Column) -> Column:
    """ISO 8601 with its offset dropped, not converted."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(x, r"(Z|[+-]\d\d:?\d\d)$", ""), "T", " ")).cast("timestamp_ntz")


# --- messages by platform ------------------------------------------------------------------

_NO_TEXT = "array<string>"
_CARDS = "array<struct<id:string,tools:array<string>>>"


def _none() -> Column:
    return F.array().cast(_NO_TEXT)


def _message(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _gpt(node: Column) -> Column:
    m = node["message"]
    role, name = m["author"]["role"], m["author"]["name"]
    actor = F.coalesce(F.when(name != "", name), role, F.lit(""))
    to = F.coalesce(m["recipient"], F.lit("all"))
    meta, content = m["metadata"], m["content"]
    thought = F.coalesce(content["content_type"] == "thoughts", F.lit(False))
    dated = F.coalesce(m["create_time"] != 0, F.lit(False))
    legacy = dated & (actor == "assistant") & (to != "all")
    modern = dated & (actor == "assistant") & (to == "all") & ((F.coalesce(F.size(meta["search_result_groups"]), F.lit(0)) > 0) | (thought & (F.coalesce(F.size(meta["tool_icons"]), F.lit(0)) > 0)))
    parts = F.coalesce(content["parts"], _none())
    return _message(
        id=m["id"], role=role, is_user=F.coalesce(role == "user", F.lit(False)), keep=F.coalesce(role != "system", F.lit(True)),
        user_parts=F.when(role == "user", parts).otherwise(_none()), assistant_parts=F.when((role == "assistant") & (to == "all"), parts).otherwise(_none()),
        tools=F.when(legacy, F.array(to)).otherwise(_none()), modern=modern, interactions=F.array(F.concat(actor, F.lit(":"), to)), actor=actor,
        reasoning=F.coalesce(meta["reasoning_status"] != "", F.lit(False)), thinking=thought,
        thoughts=F.when(thought, F.array_join(F.transform(F.coalesce(content["thoughts"], F.array().cast("array<struct<content:string>>")), lambda t: F.concat(F.coalesce(t["content"], F.lit("")), F.lit("\n"))), "")).otherwise(""),
        models=F.array(meta["model_slug"]), cards=F.array().cast(_CARDS), time=epoch_time(m["create_time"]), raw=F.to_json(m),
    )


def _claude(m: Column) -> Column:
    of = lambda kind: F.filter(m["content"], lambda b: b["type"] == kind)
    texts = F.coalesce(F.filter(F.transform(of("text"), lambda b: b["text"]), lambda t: t != ""), _none())
    texts = F.when(F.size(texts) > 0, texts).when(m["text"] != "", F.array(m["text"])).otherwise(_none())
    return _message(
        id=m["uuid"], role=m["sender"], is_user=F.coalesce(m["sender"] == "human", F.lit(False)), keep=F.lit(True),
        user_parts=F.when(m["sender"] == "human", texts).otherwise(_none()), assistant_parts=F.when(m["sender"] == "assistant", texts).otherwise(_none()),
        tools=F.coalesce(F.transform(of("tool_use"), lambda b: b["name"]), _none()), modern=F.lit(False), interactions=F.array(m["sender"]), actor=m["sender"],
        reasoning=F.lit(False), thinking=F.coalesce(F.size(of("thinking")) > 0, F.lit(False)),
        thoughts=F.coalesce(F.array_join(F.transform(of("thinking"), lambda b: F.concat(F.coalesce(b["thinking"], F.lit("")), F.lit("\n"))), ""), F.lit("")),
        models=_none(), cards=F.array().cast(_CARDS), time=iso_time(m["created_at"]), raw=F.to_json(m),
    )


def _grok(m: Column) -> Column:
    steps = m["steps"]
    summaries = F.filter(F.transform(steps, lambda s: s["tagged_text"]["summary"]), lambda t: t != "")
    cards = F.flatten(F.transform(steps, lambda s: F.coalesce(F.transform(s["tool_usage_cards"], lambda c: F.struct(c["tool_usage_card_id"].alias("id"), F.coalesce(F.map_keys(c["tool"]), _none()).alias("tools"))), F.array().cast(_CARDS))))
    ms = m["create_time"]["$date"]["$numberLong"].try_cast("long")
    return _message(
        id=m["_id"], role=m["sender"], is_user=F.coalesce(m["sender"] == "human", F.lit(False)), keep=F.lit(True),
        user_parts=F.when((m["sender"] == "human") & (m["message"] != ""), F.array(m["message"])).otherwise(_none()), assistant_parts=_none(),
        tools=_none(), modern=F.lit(False), interactions=F.array(m["sender"]), actor=m["sender"], reasoning=F.lit(False),
        thinking=F.coalesce(F.size(summaries) > 0, F.lit(False)), thoughts=F.coalesce(F.array_join(F.transform(summaries, lambda t: F.concat(t, F.lit("\n"))), ""), F.lit("")),
        models=F.when(m["model"] != "", F.array(m["model"])).otherwise(_none()), cards=F.coalesce(cards, F.array().cast(_CARDS)),
        time=F.timestamp_millis(ms).cast("timestamp_ntz"), raw=F.to_json(m),
    )


def deepseek_is_user(message: Column) -> Column:
    """Any request fragment, or no fragments but files."""
    fragments = message["fragments"]
    return F.coalesce(F.exists(fragments, lambda f: f["type"] == "REQUEST"), F.lit(False)) | ((F.coalesce(F.size(fragments), F.lit(0)) == 0) & (F.coalesce(F.size(message["files"]), F.lit(0)) > 0))


def _deepseek(node: Column) -> Column:
    m = node["message"]
    user = deepseek_is_user(m)
    fragments = m["fragments"]
    text = lambda kind: F.coalesce(F.filter(F.transform(F.filter(fragments, lambda f: f["type"] == kind), lambda f: f["content"]), lambda t: t != ""), _none())
    think = F.filter(fragments, lambda f: f["type"] == "THINK")
    return _message(
        id=node["id"], role=F.when(user, "user").otherwise("assistant"), is_user=user, keep=F.lit(True),
        user_parts=F.when(user, text("REQUEST")).otherwise(_none()), assistant_parts=F.when(user, _none()).otherwise(text("RESPONSE")),
        tools=F.coalesce(F.transform(F.filter(fragments, lambda f: ~F.coalesce(f["type"], F.lit("")).isin(*TEXT_FRAGMENTS)), lambda f: f["type"]), _none()), modern=F.lit(False),
        interactions=F.array(F.when(user, "user").otherwise("assistant")), actor=F.when(user, "user").otherwise("assistant"), reasoning=F.lit(False),
        thinking=F.coalesce(F.size(think) > 0, F.lit(False)), thoughts=F.coalesce(F.array_join(F.transform(think, lambda f: F.concat(F.coalesce(f["content"], F.lit("")), F.lit("\n"))), ""), F.lit("")),
        models=F.when(m["model"] != "", F.array(m["model"])).otherwise(_none()), cards=F.array().cast(_CARDS), time=iso_time(m["inserted_at"]), raw=F.to_json(node),
    )


#: How the message tree of a platform is walked: which loose node is the root, whether children may be found by their parents, what a node becomes.
_TREES = {"chatgpt": ("last", True, _gpt), "deepseek": ("first", False, _deepseek)}


def tree_messages(convs: DataFrame, platform: str) -> DataFrame:
    """(user_id, conv_id, pos, m): messages of trees, in the order of the walk from the root; nodes are rows, so a tree may have any size."""
    root, by_parent, message = _TREES[platform]
    nodes = trees.tree_nodes(convs, "user_id", F.col("id").alias("conv_id"))
    order = trees.walk_order(nodes, root, by_parent)
    out = stored(nodes.join(order, ["tree", "node"]).filter("value.message is not null").select("user_id", "conv_id", F.col("place").alias("pos"), message(F.col("value")).alias("m")), "tree-messages")
    discard(nodes, order)
    return out


def messages(convs: DataFrame, platform: str) -> DataFrame:
    """(user_id, conv_id, pos, message fields): the messages of each conversation in order."""
    if platform in _TREES:
        return tree_messages(convs, platform).select("user_id", "conv_id", "pos", "m.*").filter("keep").drop("keep")
    if platform == "claude":
        key, items = F.col("uuid"), F.transform("chat_messages", _claude)
    elif platform == "grok":
        key = F.col("conversation")["id"]
        # the position keeps the sort stable; messages without a time come first
        stamped = F.transform("responses", lambda r, i: F.struct(F.coalesce(r["response"]["create_time"]["$date"]["$numberLong"].try_cast("long"), F.lit(0).cast("long")).alias("ms"), i.alias("i"), F.lit(0).alias("x")))
        items = F.transform(F.array_sort(stamped), lambda s: _grok(F.col("responses")[s["i"]]["response"]))
    else:
        raise ValueError(f"unknown platform {platform!r}; one of {', '.join(PLATFORMS)}")
    return convs.select("user_id", key.alias("conv_id"), F.posexplode(items).alias("pos", "m")).select("user_id", "conv_id", "pos", "m.*").filter("keep").drop("keep")


# --- turns ---------------------------------------------------------------------------------


def segment_turns(msgs: DataFrame, keys: list[str], pos: str, is_user: str = "is_user") -> DataFrame:
    """msgs with the number of their turn within the conversation: how many user messages have come."""
    w = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return msgs.withColumn("segment", F.sum(F.col(is_user).cast("long")).over(w))


def cumulative(turns: DataFrame, keys: list[str], order: str, column: str, out: str) -> DataFrame:
    """out: the lists of column of all turns of the conversation up to this one, joined."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return turns.withColumn(out, F.flatten(F.collect_list(column).over(w)))


def turns(msgs: DataFrame, platform: str) -> DataFrame:
    """The turn table from messages(): one row per turn, histories cumulative, the turn's messages as JSON."""
    keys = ["user_id", "conv_id"]
    seg = segment_turns(msgs, keys, "pos")
    by_turn = W.partitionBy(*keys, "segment")
    seg = seg.withColumn("first_modern", F.min(F.when(F.col("modern"), F.col("pos"))).over(by_turn))
    marked = F.col("modern") & (F.col("pos") == F.col("first_modern"))
    extra = lambda c: F.when(marked, F.array(c)).otherwise(_none())
    seg = seg.withColumn("tools", F.concat("tools", extra(F.lit(MARKER_TOOL)))).withColumn("interactions", F.concat("interactions", extra(F.concat("actor", F.lit(":" + MARKER_TOOL)))))
    # cards of one id count once within the turn, cards without an id each
    cols = ["id", "is_user", "user_parts", "assistant_parts", "tools", "interactions", "reasoning", "thinking", "thoughts", "models", "cards", "time", "raw"]
    g = seg.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*cols).alias("m")))).alias("ms"))
    g = g.withColumn("ms", F.transform("ms", lambda x: x["m"]))
    flat = lambda name: F.flatten(F.transform("ms", lambda m: m[name]))
    cards = F.flatten(F.transform("ms", lambda m: m["cards"]))
    once = F.filter(F.transform(cards, lambda c, i: F.struct(c["tools"].alias("tools"), (c["id"].isNull() | (F.size(F.filter(F.slice(cards, 1, i), lambda d: d["id"] == c["id"])) == 0)).alias("new"))), lambda c: c["new"])
    t = g.select(
        *keys, "segment", F.col("ms")[0]["id"].alias("turn_id"), F.concat(flat("tools"), F.flatten(F.transform(once, lambda c: c["tools"]))).alias("tools"), flat("interactions").alias("interactions"),
        F.exists("ms", lambda m: m["reasoning"]).cast("int").alias("reasoning"), F.exists("ms", lambda m: m["thinking"]).cast("int").alias("thinking"),
        F.array_join(F.transform("ms", lambda m: m["thoughts"]), "").alias("thoughts"), flat("models").alias("models"), flat("user_parts").alias("user_parts"), flat("assistant_parts").alias("assistant_parts"),
        F.concat(F.lit("["), F.array_join(F.transform("ms", lambda m: m["raw"]), ","), F.lit("]")).alias("turn_msgs"), F.element_at("ms", -1)["time"].alias("time"), F.size("ms").alias("n_msgs"),
    )
    t = cumulative(cumulative(t, keys, "segment", "user_parts", "user_msg_history"), keys, "segment", "assistant_parts", "assistant_msg_history")
    first = F.row_number().over(W.partitionBy(*keys).orderBy("segment")) == 1
    return t.withColumn("conv_starter", first.cast("int")).withColumn("platform", F.lit(platform)).withColumn("month", F.date_trunc("month", "time").cast("timestamp_ntz"))


def web_call(tools: Column, platform: Column) -> Column:
    """Whether a turn's tools hold a web search call of the platform."""
    some = lambda test: F.coalesce(F.exists(tools, test), F.lit(False))
    return (
        F.when(platform == "chatgpt", some(lambda t: F.lower(t).isin(MARKER_TOOL, *LEGACY_BROWSERS) | F.lower(t).contains("web")))
        .when(platform == "claude", some(lambda t: F.lower(t).contains("web")))
        .when(platform == "grok", some(lambda t: t.isin(*GROK_WEB_TOOLS)))
        .when(platform == "deepseek", some(lambda t: t.isin(*DEEPSEEK_WEB_TOOLS)))
    )


def summary_counters(t: DataFrame) -> DataFrame:
    """Users, conversations, turns, turns with tools, messages and tool calls, in one pass."""
    return t.agg(
        F.count_distinct("platform", "user_id").alias("users"), F.count_distinct("platform", "user_id", "conv_id").alias("conversations"), F.count("*").alias("turns"),
        F.count_if(F.size("tools") > 0).alias("turns_with_tools"), F.sum("n_msgs").cast("long").alias("messages"), F.sum(F.size("tools")).cast("long").alias("tool_calls"),
    )


def label_topic(labels: Column, turn_topics: Column) -> Column:
    """Topic of a conversation from its labels: none Other, one itself, of several the most frequent by turn, the earliest on ties."""
    t = F.filter(turn_topics, lambda x: x.isNotNull() & (x != ""))
    counted = F.transform(F.array_distinct(t), lambda x: F.struct(F.size(F.filter(t, lambda y: y == x)).alias("n"), (-F.array_position(t, x)).alias("at"), x.alias("x")))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) == 0, "Other").when(F.size(labels) == 1, labels[0]).otherwise(F.coalesce(F.array_max(counted)["x"], labels[0]))


def with_topics(t: DataFrame, labels: DataFrame | None, keyword_topic: Column) -> DataFrame:
    """topic from labels (conv_id, topic) where there is one, else from keywords."""
    if labels is None:
        return t.withColumn("topic", keyword_topic)
    known = labels.groupBy("conv_id").agg(F.min("topic").alias("_label"))
    return t.join(known, "conv_id", "left").withColumn("topic", F.coalesce("_label", keyword_topic)).drop("_label")
