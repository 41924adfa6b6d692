"""Sources of responses: what was retrieved, what was cited, and the response's text.

Each function takes parsed turns (rounds.parsed) of one platform and returns them with
srcs_retrieved, srcs_safe_urls and srcs_cited (arrays of one struct type; fields a platform lacks are null),
assistant_response and user_query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.functions import text
from turnscope.functions.urls import TRACKING_SUFFIXES, is_image, plain_domain, without_suffixes
from turnscope.operators.extract import deepseek_is_user
from turnscope.operators.rounds import parsed

FIELDS = {"url": "string", "domain": "string", "title": "string", "snippet": "string", "ref_index": "int", "turn_index": "int", "start_index": "int", "end_index": "int", "cited_text": "string", "citation_type": "string", "card_id": "string"}
SOURCE = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
#: Sources of ChatGPT lose only the first two tracking suffixes.
GPT_SUFFIXES = TRACKING_SUFFIXES[:2]


def _src(**given: Column) -> Column:
    return F.struct(*[given.get(k, F.lit(None)).cast(v).alias(k) for k, v in FIELDS.items()])


def _none() -> Column:
    return F.array().cast(f"array<{SOURCE}>")


def _all(*lists: Column) -> Column:
    return F.concat(*[F.coalesce(x, _none()) for x in lists])


def _flat(msgs: Column, f) -> Column:
    """f of every message, joined; messages without any give nothing."""
    return F.coalesce(F.flatten(F.filter(F.transform(msgs, f), lambda x: x.isNotNull())), _none())


def _e(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def richest(items: Column) -> Column:
    """One of the items of equal url and references: that with most filled fields, the first on ties, at the place of the first."""
    filled = lambda x: sum((F.when(F.trim(_e(x[k].cast("string"))) != "", 1).otherwise(0) for k in FIELDS), F.lit(0))
    key = lambda x: F.struct(_e(x["url"]), x["ref_index"], x["turn_index"])
    keys = F.array_distinct(F.transform(items, key))

    def best(k):
        mine = F.filter(items, lambda x: key(x).eqNullSafe(k))
        most = F.array_max(F.transform(mine, filled))
        return F.filter(mine, lambda x: filled(x) == most)[0]

    return F.transform(keys, best)


def _gpt_cited(m: Column) -> Column:
    def of_reference(r):
        marker = F.regexp_extract(F.trim(_e(r["matched_text"])), text.CITING_MARKER, 0)
        first = F.try_element_at(text.citation_refs(marker), F.lit(1))
        url = without_suffixes(_e(r["url"]), GPT_SUFFIXES)
        inline = F.when((marker != "") & (url != ""), F.array(_src(url=url, domain=plain_domain(url), title=r["title"], snippet=r["snippet"], ref_index=first["ref_index"], turn_index=first["turn_index"]))).otherwise(_none())

        def items(list_):
            def one(x, i):
                u = without_suffixes(_e(x["url"]), GPT_SUFFIXES)
                ref = F.coalesce(F.try_element_at(x["refs"], F.lit(1)), F.try_element_at(r["refs"], i + 1))
                return _src(url=u, domain=plain_domain(u), title=_e(x["title"]), snippet=_e(x["snippet"]), ref_index=ref["ref_index"], turn_index=ref["turn_index"])

            return F.filter(F.transform(list_, one), lambda s: s["url"] != "")

        chosen = F.when(F.size(r["fallback_items"]) > 0, r["fallback_items"]).otherwise(r["items"])

        def foot(x):
            u = without_suffixes(_e(x["url"]), GPT_SUFFIXES)
            return _src(url=u, domain=plain_domain(u), title=_e(x["title"]), snippet=F.lit(""))

        return _all(inline, items(r["images"]), items(chosen), F.filter(F.transform(r["sources"], foot), lambda s: s["url"] != ""))

    return F.flatten(F.transform(m["metadata"]["content_references"], of_reference))


def chatgpt(t: DataFrame) -> DataFrame:
    def retrieved(m):
        entries = F.filter(F.flatten(F.transform(m["metadata"]["search_result_groups"], lambda g: g["entries"])), lambda e: _e(e["url"]) != "")
        found = F.transform(entries, lambda e: _src(url=e["url"], domain=plain_domain(e["url"]), title=_e(e["title"]), ref_index=e["ref_id"]["ref_index"], turn_index=e["ref_id"]["turn_index"], snippet=e["snippet"]))
        images = F.transform(m["metadata"]["image_results"], lambda e, i: _src(url=e["url"], domain=plain_domain(e["url"]), title=_e(e["title"]), ref_index=i))
        return _all(found, images)

    def safe(m):
        urls = F.transform(F.filter(m["metadata"]["safe_urls"], lambda u: u != ""), lambda u: without_suffixes(u, GPT_SUFFIXES))
        return F.transform(urls, lambda u: _src(url=u, domain=plain_domain(u)))

    last = F.try_element_at("msgs", F.lit(-1))["content"]["parts"]
    asked = F.filter(F.transform(F.filter("msgs", lambda m: F.coalesce(F.when(m["author"]["name"] != "", m["author"]["name"]), m["author"]["role"]) == "user"), lambda m: F.trim(F.array_join(m["content"]["parts"], " "))), lambda q: q != "")
    return _out(t, _flat(F.col("msgs"), retrieved), _flat(F.col("msgs"), safe), richest(_flat(F.col("msgs"), _gpt_cited)), _e(F.array_join(last, " ")), _e(F.try_element_at(asked, F.lit(1))))


def claude(t: DataFrame) -> DataFrame:
    own = F.filter("msgs", lambda m: m["sender"] == "assistant")

    def cited(m):
        def of_block(b):
            def one(c):
                url = F.trim(F.coalesce(F.when(c["details"]["url"] != "", c["details"]["url"]), c["url"], F.lit("")))
                a, z = c["start_index"], c["end_index"]
                cut = F.when((a >= 0) & (a < z) & (z <= F.length(b["text"])), F.substring(b["text"], a + 1, z - a)).otherwise("")
                title = F.coalesce(F.when(c["details"]["title"] != "", c["details"]["title"]), c["title"], F.lit(""))
                return _src(url=url, domain=plain_domain(url), title=title, cited_text=cut, start_index=a, end_index=z, citation_type=_e(c["details"]["type"]))

            return F.coalesce(F.filter(F.transform(b["citations"], one), lambda s: s["url"] != ""), _none())

        return F.flatten(F.transform(F.filter(m["content"], lambda b: b["type"] == "text"), of_block))

    def retrieved(m):
        results = F.flatten(F.filter(F.transform(F.filter(m["content"], lambda b: (b["type"] == "tool_result") & b["name"].isin("web_search", "web_fetch")), lambda b: b["content"]), lambda c: c.isNotNull()))
        made = F.transform(results, lambda c: _src(url=F.trim(_e(c["url"])), domain=plain_domain(F.trim(c["url"])), title=_e(c["title"]), snippet=_e(c["text"])))
        return F.filter(made, lambda s: s["url"] != "")

    words = lambda m: F.coalesce(F.filter(F.transform(F.filter(m["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), lambda x: x != ""), F.array().cast("array<string>"))
    asked = F.filter(F.transform(F.filter("msgs", lambda m: m["sender"] == "human"), lambda m: F.coalesce(F.when(F.trim(F.array_join(words(m), " ")) != "", F.trim(F.array_join(words(m), " "))), F.trim(_e(m["text"])))), lambda q: q != "")
    return _out(t, _flat(own, retrieved), _none(), _flat(own, cited), F.trim(F.array_join(F.flatten(F.transform(own, words)), " ")), _e(F.try_element_at(asked, F.lit(1))))


def grok(t: DataFrame) -> DataFrame:
    own = F.filter("msgs", lambda m: F.lower(m["sender"]) == "assistant")
    first = lambda a, b: F.coalesce(F.when(a != "", a), b, F.lit(""))

    def retrieved(m):
        made = F.transform(m["web_search_results"], lambda r: _src(url=F.trim(_e(r["url"])), domain=plain_domain(F.trim(r["url"])), title=_e(r["title"]), snippet=first(r["preview"], r["snippet"])))
        return F.filter(made, lambda s: s["url"] != "")

    def cited(m):
        cards = F.filter(F.transform(m["card_attachments_json"], lambda c: F.from_json(c, "id string, cardType string, url string, title string, preview string, snippet string")), lambda c: c["cardType"] == "citation_card")
        return F.transform(cards, lambda c: _src(url=F.trim(_e(c["url"])), domain=plain_domain(F.trim(c["url"])), title=_e(c["title"]), snippet=first(c["preview"], c["snippet"]), card_id=_e(c["id"])))

    said = F.filter(F.transform(own, lambda m: m["message"]), lambda x: F.trim(x) != "")
    asked = F.filter(F.transform(F.filter("msgs", lambda m: F.lower(m["sender"]) == "human"), lambda m: F.trim(_e(m["message"]))), lambda q: q != "")
    return _out(t, _flat(own, retrieved), _none(), _flat(own, cited), F.trim(F.array_join(said, " ")), _e(F.try_element_at(asked, F.lit(1))))


def deepseek(t: DataFrame) -> DataFrame:
    own = F.filter("msgs", lambda n: ~deepseek_is_user(n["message"]))

    def retrieved(n):
        results = F.flatten(F.filter(F.transform(F.filter(n["message"]["fragments"], lambda f: f["type"] == "SEARCH"), lambda f: f["results"]), lambda r: r.isNotNull()))
        made = F.transform(results, lambda r: _src(url=F.trim(_e(r["url"])), domain=plain_domain(F.trim(r["url"])), title=_e(r["title"]), snippet=_e(r["snippet"]), ref_index=r["cite_index"]))
        return F.filter(made, lambda s: s["url"] != "")

    said = F.flatten(F.transform(own, lambda n: F.coalesce(F.filter(F.transform(F.filter(n["message"]["fragments"], lambda f: f["type"] == "RESPONSE"), lambda f: f["content"]), lambda x: x != ""), F.array().cast("array<string>"))))
    asked = F.filter(F.transform(F.filter("msgs", lambda n: deepseek_is_user(n["message"])), lambda n: F.trim(_e(F.array_join(F.filter(F.transform(F.filter(n["message"]["fragments"], lambda f: f["type"] == "REQUEST"), lambda f: f["content"]), lambda x: x != ""), " ")))), lambda q: q != "")
    d = t.withColumn("_found", _flat(own, retrieved)).withColumn("_said", F.trim(F.array_join(said, "\n")))
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("_said", F.lit(r"\[citation:(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")))
    cited = F.transform(F.filter(numbers, lambda i: i.isNotNull()), lambda i: F.coalesce(F.try_element_at(F.filter("_found", lambda s: s["ref_index"] == i), F.lit(1)), _src(url=F.lit(""), domain=F.lit(""), title=F.lit(""), snippet=F.lit(""), ref_index=i)))
    return _out(d, F.col("_found"), _none(), cited, F.col("_said"), _e(F.try_element_at(asked, F.lit(1)))).drop("_found", "_said")


def _out(t: DataFrame, retrieved: Column, safe: Column, cited: Column, response: Column, query: Column) -> DataFrame:
    return t.select("*", retrieved.alias("srcs_retrieved"), safe.alias("srcs_safe_urls"), cited.alias("srcs_cited"), response.alias("assistant_response"), query.alias("user_query")).drop("msgs")


CITATIONS = {"chatgpt": chatgpt, "claude": claude, "grok": grok, "deepseek": deepseek}


def response_and_sources(turns: DataFrame, platform: str) -> DataFrame:
    return CITATIONS[platform](parsed(turns, platform))


def long_sources(t: DataFrame, keys: list[str]) -> DataFrame:
    """One row per source: keys, kind, pos and the fields."""
    out = None
    for kind, name in (("retrieved", "srcs_retrieved"), ("safe", "srcs_safe_urls"), ("cited", "srcs_cited")):
        one = t.select(*keys, F.lit(kind).alias("kind"), F.posexplode(name).alias("pos", "s")).select(*keys, "kind", "pos", "s.*")
        out = one if out is None else out.unionByName(one)
    return out


def without_images(t: DataFrame) -> DataFrame:
    """Turns none of whose cited or retrieved urls is an image."""
    some = lambda c: F.exists(c, lambda s: is_image(s["url"]))
    return t.filter(~(some("srcs_retrieved") | some("srcs_cited")))
