"""Scans of conversation exports: one explicit schema per platform, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_GPT_ITEM = "url STRING, title STRING, snippet STRING, refs ARRAY<STRUCT<turn_index: INT, ref_index: INT>>"
#: The shapes of the exports. Fields that vary in type are kept as JSON text by the readers below.
CONVERSATION = {
    "chatgpt": f"""id STRING, mapping MAP<STRING, STRUCT<parent: STRING, children: ARRAY<STRING>, message: STRUCT<
        id: STRING, author: STRUCT<role: STRING, name: STRING>, recipient: STRING, create_time: DOUBLE,
        content: STRUCT<content_type: STRING, parts: ARRAY<STRING>, thoughts: ARRAY<STRUCT<content: STRING>>>,
        metadata: STRUCT<model_slug: STRING, reasoning_status: STRING, tool_icons: ARRAY<STRING>, search_queries: ARRAY<STRUCT<q: STRING>>,
          search_model_queries: STRUCT<queries: ARRAY<STRING>>,
          search_result_groups: ARRAY<STRUCT<entries: ARRAY<STRUCT<url: STRING, title: STRING, snippet: STRING, ref_id: STRUCT<turn_index: INT, ref_index: INT>>>>>,
          image_results: ARRAY<STRUCT<url: STRING, title: STRING, snippet: STRING>>, safe_urls: ARRAY<STRING>,
          user_context_message_data: STRUCT<about_user_message: STRING>,
          content_references: ARRAY<STRUCT<matched_text: STRING, url: STRING, title: STRING, snippet: STRING, refs: ARRAY<STRUCT<turn_index: INT, ref_index: INT>>,
            items: ARRAY<STRUCT<{_GPT_ITEM}>>, fallback_items: ARRAY<STRUCT<{_GPT_ITEM}>>, images: ARRAY<STRUCT<{_GPT_ITEM}>>, sources: ARRAY<STRUCT<url: STRING, title: STRING>>>>>>>>""",
    "claude": """uuid STRING, chat_messages ARRAY<STRUCT<uuid: STRING, sender: STRING, text: STRING, created_at: STRING,
        content: ARRAY<STRUCT<type: STRING, text: STRING, name: STRING, thinking: STRING, input: STRUCT<query: STRING>,
          citations: ARRAY<STRUCT<url: STRING, title: STRING, start_index: INT, end_index: INT, details: STRUCT<url: STRING, title: STRING, type: STRING>>>,
          content: ARRAY<STRUCT<type: STRING, url: STRING, title: STRING, text: STRING>>>>>>""",
    "grok": """conversation STRUCT<id: STRING>, responses ARRAY<STRUCT<response: STRUCT<_id: STRING, sender: STRING, message: STRING, model: STRING,
        create_time: STRUCT<`$date`: STRUCT<`$numberLong`: STRING>>, metadata: STRUCT<memoryReferences: ARRAY<STRUCT<summary: STRING>>>,
        web_search_results: ARRAY<STRUCT<url: STRING, title: STRING, preview: STRING, snippet: STRING>>, card_attachments_json: ARRAY<STRING>,
        steps: ARRAY<STRUCT<tagged_text: STRUCT<summary: STRING>, tool_usage_cards: ARRAY<STRUCT<tool_usage_card_id: STRING, tool: MAP<STRING, STRUCT<args: STRUCT<query: STRING>>>>>,
          tool_usage_results: ARRAY<STRUCT<result: STRUCT<WebSearchResults: ARRAY<STRUCT<title: STRING, url: STRING, preview: STRING>>>>>>>>>>""",
    "deepseek": """id STRING, title STRING, inserted_at STRING, mapping MAP<STRING, STRUCT<id: STRING, parent: STRING, children: ARRAY<STRING>, message: STRUCT<
        model: STRING, inserted_at: STRING, files: ARRAY<STRING>, fragments: ARRAY<STRUCT<type: STRING, content: STRING,
          results: ARRAY<STRUCT<url: STRING, title: STRING, snippet: STRING, cite_index: INT, query_indexes: ARRAY<INT>>>>>>>>""",
}
#: Key under which a file holds its list of conversations; None: the file is the list.
LIST_KEY = {"chatgpt": None, "claude": None, "grok": "conversations", "deepseek": None}


def parse_conversations(texts: DataFrame, platform: str, text_col: str = "value") -> DataFrame:
    """One row per conversation of each file text; other columns stay."""
    if platform not in CONVERSATION:
        raise ValueError(f"unknown platform {platform!r}; one of {', '.join(CONVERSATION)}")
    shape = f"ARRAY<STRUCT<{_typed(CONVERSATION[platform])}>>"
    key = LIST_KEY[platform]
    parsed = F.from_json(text_col, shape) if key is None else F.from_json(text_col, f"STRUCT<{key}: {shape}>")[key]
    return texts.select(*[c for c in texts.columns if c != text_col], F.inline(parsed))


def _typed(ddl: str) -> str:
    """Top-level 'name TYPE' pairs as struct fields 'name: TYPE'."""
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    out.append(part)
    return ", ".join("{}: {}".format(*p.strip().split(" ", 1)) for p in out)


def read_export(spark: SparkSession, base: str, platform: str) -> DataFrame:
    """Conversations below base: user_*/conversations.json, or a flat conversations.json; with user_id.

    Users are numbered from 0 by directory name as a string; the flat file counts only where there is no user directory.
    Files are parsed as they are read, so none is held as one text; one that isn't JSON has no conversations.
    """
    if platform not in CONVERSATION:
        raise ValueError(f"unknown platform {platform!r}; one of {', '.join(CONVERSATION)}")
    options = {"recursiveFileLookup": True, "pathGlobFilter": "conversations.json"}
    user = lambda path: F.regexp_extract(path, r"/(user_[^/]*)/conversations\.json$", 1)
    # one row per user directory: a small frame of names, from the listing alone
    users = spark.read.format("binaryFile").options(**options).load(base).select(user("path").alias("_user")).distinct()
    users = users.withColumn("_some", F.max(F.col("_user") != "").over(W.partitionBy())).filter((F.col("_user") != "") | ~F.col("_some"))
    users = users.select("_user", (F.row_number().over(W.orderBy("_user")) - 1).alias("user_id"))
    key, shape = LIST_KEY[platform], CONVERSATION[platform]
    files = spark.read.schema(shape if key is None else f"{key} ARRAY<STRUCT<{_typed(shape)}>>").options(multiLine=True, **options).json(base)
    names = files.columns
    rows = files.na.drop("all").select(*names, user(F.col("_metadata.file_path")).alias("_user")).join(users, "_user")
    return rows.select("user_id", *names) if key is None else rows.select("user_id", F.inline(key))


def element_type(platform: str) -> str:
    """DDL of one message as turns keep it: the message, of DeepSeek the tree node, of Grok the response."""
    ddl = _typed(CONVERSATION[platform])
    at = {"chatgpt": "message: STRUCT<", "claude": "chat_messages: ARRAY<STRUCT<", "grok": "response: STRUCT<", "deepseek": "mapping: MAP<STRING, STRUCT<"}[platform]
    start = ddl.index(at) + len(at)
    depth, end = 1, start
    while depth:
        depth += (ddl[end] == "<") - (ddl[end] == ">")
        end += 1
    return f"STRUCT<{ddl[start : end - 1]}>"
