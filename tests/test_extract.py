"""Exports of all four platforms, end to end on small synthetic conversations."""

import json

import pytest
from pyspark.sql import functions as F

from turnscope.operators import citations, extract, rounds
from turnscope.sources import exports


def gpt(id, role, text="", to=None, t=1.7e9, **meta):
    m = {"id": id, "author": {"role": role}, "create_time": t, "content": {"content_type": "text", "parts": [text]}, "metadata": meta}
    if to:
        m["recipient"] = to
    return m


MARK = "citeturn0search1"
GPT = [{
    "id": "c1",
    "mapping": {
        "stray": {"parent": "gone", "children": [], "message": None},
        "root": {"parent": None, "children": ["a"], "message": None},
        "a": {"parent": "root", "children": ["b", "x"], "message": gpt("a", "assistant", "hello")},
        "x": {"parent": "a", "children": [], "message": gpt("x", "user", "other branch")},
        "b": {"parent": "a", "children": ["s"], "message": gpt("b", "user", "first question", t=1.7e12)},
        "s": {"parent": "b", "children": ["c"], "message": gpt("s", "system", "hidden")},
        "c": {"parent": "s", "children": ["d"], "message": gpt("c", "assistant", "searching", to="browser")},
        "d": {"parent": "c", "children": None, "message": gpt(
            "d", "assistant", "answer " + MARK, reasoning_status="done", model_slug="m1", search_queries=[{"q": "q1"}, {"q": "q1"}], search_model_queries={"queries": ["q2"]},
            search_result_groups=[{"entries": [{"url": "https://www.a.com/p", "title": "A", "snippet": "sa", "ref_id": {"turn_index": 0, "ref_index": 1}}, {"url": "", "title": "none", "snippet": ""}]}],
            image_results=[{"url": "https://img.b.com/i.png", "title": "I"}], safe_urls=["https://a.com/p?utm_source=chatgpt.com"],
            content_references=[
                {"matched_text": MARK, "url": "https://www.a.com/p?utm_source=chatgpt.com", "title": "A", "snippet": "sa"},
                {"items": [{"url": "https://b.com:8080/x", "title": "B", "refs": [{"turn_index": 0, "ref_index": 2}]}], "sources": [{"url": "https://f.com", "title": "F"}]},
            ])},
        "e": {"parent": "d", "children": [], "message": gpt("e", "user", "second")},
    },
}]
GPT[0]["mapping"]["root"], GPT[0]["mapping"]["stray"]["parent"] = GPT[0]["mapping"].pop("root"), None
CLAUDE = [{"uuid": "c2", "chat_messages": [
    {"uuid": "m0", "sender": "human", "text": "plain", "created_at": "2025-10-14T11:13:34.610305Z", "content": []},
    {"uuid": "m1", "sender": "assistant", "text": "", "created_at": "2025-10-14T11:14:00+08:00", "content": [
        {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "web_search", "input": {"query": "one"}}, {"type": "tool_use", "name": "web_search", "input": {"query": ""}},
        {"type": "tool_use", "name": "web_search", "input": {"query": "two"}}, {"type": "tool_result", "name": "web_search", "content": [{"type": "text", "url": "https://a.org", "title": "A", "text": "aa"}]},
        {"type": "tool_result", "name": "web_search", "content": [{"type": "knowledge", "url": " https://b.org ", "title": "B", "text": "bb"}]},
        {"type": "text", "text": "Said so.", "citations": [{"url": "https://x.org", "title": "X", "start_index": 0, "end_index": 4, "details": {"url": "https://a.org", "type": "web"}}, {"url": "https://y.org", "start_index": 5, "end_index": 99}]},
    ]},
]}]
GROK = {"conversations": [{"conversation": {"id": "c3"}, "responses": [
    {"response": {"_id": "r2", "sender": "ASSISTANT", "message": "reply", "model": "g", "create_time": {"$date": {"$numberLong": "1775273426443"}}, "metadata": {"memoryReferences": [{"summary": "likes tea"}]},
        "web_search_results": [{"url": "https://w.com", "title": "W", "preview": "", "snippet": "sn"}], "card_attachments_json": [json.dumps({"id": "k", "cardType": "citation_card", "url": "", "title": "T"}), "bad json", json.dumps({"cardType": "other"})],
        "steps": [{"tagged_text": {"summary": "look"}, "tool_usage_cards": [{"tool_usage_card_id": "1", "tool": {"WebSearch": {"args": {"query": "qa"}}}}, {"tool_usage_card_id": "1", "tool": {"WebSearch": {"args": {"query": "qa"}}}}, {"tool_usage_card_id": None, "tool": {"Other": {"args": {}}}}, {"tool_usage_card_id": None, "tool": {"Other": {"args": {}}}}],
            "tool_usage_results": [{"result": {"WebSearchResults": [{"title": "t", "url": "u", "preview": "p"}]}}]}, {"tool_usage_cards": []}]}},
    {"response": {"_id": "r1", "sender": "human", "message": "ask", "create_time": {"$date": {"$numberLong": "1775273420000"}}}},
]}]}
DEEP = [{"id": "c4", "mapping": {
    "root": {"id": "root", "parent": None, "children": ["1"], "message": None},
    "1": {"id": "1", "parent": "root", "children": ["2"], "message": {"model": "d", "inserted_at": "2025-01-02T03:04:05.000+08:00", "files": [], "fragments": [{"type": "REQUEST", "content": "what"}]}},
    "2": {"id": "2", "parent": "1", "children": ["3"], "message": {"model": "d", "inserted_at": "2025-01-02T03:05:05.000+08:00", "fragments": [
        {"type": "THINK", "content": "t"}, {"type": "SEARCH", "results": [{"url": "https://s.com/1", "title": "S", "snippet": "x", "cite_index": 0, "query_indexes": [1, 0]}, {"url": "", "query_indexes": [1]}]},
        {"type": "RESPONSE", "content": "see [citation:0] and [citation:7] [citation:0]"}]}},
    "3": {"id": "3", "parent": "2", "children": [], "message": {"inserted_at": "2025-01-03T00:00:00", "files": ["f.pdf"], "fragments": []}},
}}]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for name, data in (("chatgpt", GPT), ("claude", CLAUDE), ("grok", GROK), ("deepseek", DEEP)):
        base = tmp_path_factory.mktemp(name)
        for user in ("user_10", "user_2"):
            (base / user).mkdir()
            (base / user / "conversations.json").write_text(json.dumps(data if user == "user_2" else ([] if isinstance(data, list) else {"conversations": []})))
        convs = exports.read_export(spark, str(base), name)
        out[name] = extract.turns(extract.messages(convs, name), name).cache()
    return out


def rows(df):
    return [r.asDict(recursive=True) for r in df.orderBy("segment").collect()]


def test_chatgpt_turns(tables):
    a, b, c = rows(tables["chatgpt"])
    assert (a["turn_id"], b["turn_id"], c["turn_id"]) == ("a", "b", "e")
    assert [x["conv_starter"] for x in (a, b, c)] == [1, 0, 0]
    assert b["user_id"] == 1  # user_10 sorts before user_2
    assert b["tools"] == ["browser", "web_search"] and b["reasoning"] == 1
    assert b["interactions"] == ["user:all", "assistant:browser", "assistant:all", "assistant:web_search"]
    assert b["user_msg_history"] == ["first question"] and c["user_msg_history"] == ["first question", "second"]
    assert b["assistant_msg_history"][0] == "hello" and len(b["assistant_msg_history"]) == 2
    assert b["models"] == [None, None, "m1"]


def test_web_calls(tables):
    got = {p: [r[0] for r in t.orderBy("segment").select(extract.web_call(F.col("tools"), F.col("platform"))).collect()] for p, t in tables.items()}
    assert got == {"chatgpt": [False, True, False], "claude": [True], "grok": [True], "deepseek": [True, False]}


def test_chatgpt_rounds_and_sources(tables):
    r = rows(rounds.query_rounds(tables["chatgpt"], "chatgpt"))[1]
    assert r["web_queries"] == [["q1", "q2"]] and r["sources"][0][0] == "A\na.com\nsa"
    s = rows(citations.response_and_sources(tables["chatgpt"], "chatgpt"))[1]
    assert [x["url"] for x in s["srcs_retrieved"]] == ["https://www.a.com/p", "https://img.b.com/i.png"]
    assert [(x["url"], x["ref_index"]) for x in s["srcs_cited"]] == [("https://www.a.com/p", 1), ("https://b.com:8080/x", 2), ("https://f.com", None)]
    assert s["srcs_safe_urls"][0]["url"] == "https://a.com/p" and s["srcs_cited"][1]["domain"] == "b.com:8080"
    assert s["user_query"] == "first question" and s["assistant_response"].startswith("answer")


def test_claude(tables):
    t = rows(tables["claude"])[0]
    assert t["tools"] == ["web_search"] * 3 and t["thoughts"] == "hm\n" and t["user_msg_history"] == ["plain"] and t["models"] == []
    assert str(t["time"]) == "2025-10-14 11:14:00"  # the offset is dropped, not converted
    r = rows(rounds.query_rounds(tables["claude"], "claude"))[0]
    assert r["web_queries"] == [["one"], ["two"]] and r["sources"] == [["A\nhttps://a.org\naa"], ["B\n https://b.org \nbb"]]
    s = rows(citations.response_and_sources(tables["claude"], "claude"))[0]
    assert [(x["url"], x["cited_text"]) for x in s["srcs_cited"]] == [("https://a.org", "Said"), ("https://y.org", "")]
    assert [x["url"] for x in s["srcs_retrieved"]] == ["https://a.org", "https://b.org"] and s["user_query"] == "plain"


def test_grok(tables):
    t = rows(tables["grok"])[0]
    assert t["turn_id"] == "r1" and t["tools"] == ["WebSearch", "Other", "Other"] and t["thinking"] == 1 and t["assistant_msg_history"] == []
    r = rows(rounds.query_rounds(tables["grok"], "grok"))[0]
    assert r["web_queries"] == [["qa"]] and r["sources"] == [["t\nu\np"]] and r["memories"] == [["likes tea"]]
    s = rows(citations.response_and_sources(tables["grok"], "grok"))[0]
    assert [(x["url"], x["card_id"]) for x in s["srcs_cited"]] == [("", "k")] and s["srcs_retrieved"][0]["snippet"] == "sn"


def test_deepseek(tables):
    a, b = rows(tables["deepseek"])
    assert a["tools"] == ["SEARCH"] and a["interactions"] == ["user", "assistant"] and b["turn_id"] == "3" and str(a["time"]) == "2025-01-02 03:05:05"
    r = rows(rounds.query_rounds(tables["deepseek"], "deepseek"))[0]
    assert r["web_queries"] == [["Query 0 of Iter 1", "Query 1 of Iter 1"]]
    s = rows(citations.response_and_sources(tables["deepseek"], "deepseek"))[0]
    assert [(x["url"], x["ref_index"]) for x in s["srcs_cited"]] == [("https://s.com/1", 0), ("", 7)] and s["user_query"] == "what"


def test_long_sources_and_images(tables, spark):
    s = citations.response_and_sources(tables["chatgpt"], "chatgpt")
    long = citations.long_sources(s, ["conv_id", "turn_id"])
    assert long.groupBy("kind").count().orderBy("kind").collect() == [("cited", 3), ("retrieved", 2), ("safe", 1)]
    assert citations.without_images(s).count() == 2


def test_counters_and_unknown_platform(tables, spark):
    c = extract.summary_counters(tables["chatgpt"]).first()
    assert (c.users, c.conversations, c.turns, c.turns_with_tools, c.tool_calls) == (1, 1, 3, 1, 2)
    with pytest.raises(ValueError):
        exports.parse_conversations(spark.createDataFrame([("[]",)], "value string"), "nope")


def test_label_topics(spark):
    d = spark.createDataFrame([([], ["a"]), (["x"], []), (["x", "y"], ["b", "a", "b", "a"]), (["x", "y"], [])], "l array<string>, t array<string>")
    assert [r[0] for r in d.select(extract.label_topic(F.col("l"), F.col("t"))).collect()] == ["Other", "x", "b", "x"]


def test_command_line(spark, tmp_path):
    from turnscope.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "conversations.json").write_text(json.dumps(GPT))
    (tmp_path / "taxonomy.jsonl").write_text('{"topic": "Asking", "keywords": ["question"]}\n')
    out = str(tmp_path / "out")
    main(["extract", "--platform", "chatgpt", "--input", str(tmp_path / "in"), "--output", out, "--taxonomy", str(tmp_path / "taxonomy.jsonl")])
    assert [r.topic for r in spark.read.parquet(f"{out}/turns").orderBy("segment").collect()] == ["Other", "Asking", "Asking"]
    assert spark.read.parquet(f"{out}/web_turns").count() == 1
    for stage, source in (("rounds", "turns"), ("sources", "turns"), ("decisions", "turns"), ("grounding", "sources")):
        main([stage, "--platform", "chatgpt", "--input", f"{out}/{source}", "--output", out])
    assert spark.read.parquet(f"{out}/query_rounds").count() == 3 and spark.read.parquet(f"{out}/sources").count() == 6
    r = spark.read.parquet(f"{out}/rates").first()
    assert (r.retrieved, r.cited, r.external, r.internal) == (2, 3, 1, 2)
    with pytest.raises(SystemExit):
        main(["extract", "--input", "x", "--output", "y"])
