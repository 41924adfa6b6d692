"""Replays of prompts on several models: selection of prompts, agreement, scores, alignment.

calls: one row per (model, sample) with called (boolean); base is the model compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions import text
from turnscope.functions.urls import match_key
from turnscope.functions.values import CLAIM_RELATIONS, RESPONSE_CATEGORIES, among, finite, outcome_key, relation, strip
from turnscope.operators.claims import BUCKETS, latest_of_runs


def pii_safe(annotations: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Keys all of whose turns say no to every flag; anything else, null too, fails."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & F.coalesce(F.lower(F.trim(F.col(f))) == "no", F.lit(False))
    return annotations.groupBy(key).agg(F.bool_and(ok).alias("_ok")).filter("_ok").select(key)


def fullest_turn(rows: DataFrame, key: str, size: str, order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(size), order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def seeded_sample(rows: DataFrame, by: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """n rows per group in the order of a seeded hash of their id: a sampling operator, the same at any parallelism."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    w = W.partitionBy(*by).orderBy(h, id_col)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def web_and_other(t: DataFrame, web: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among web's, and the rest."""
    keys = web.select(key).distinct()
    return t.join(keys, key, "left_semi"), t.join(keys, key, "left_anti")


def prompt_messages(users: Column, assistants: Column, last: int) -> Column:
    """The last turns of a dialogue as role and content, the prompt at the end."""
    n = F.size(users)
    start = F.greatest(n - last + 1, F.lit(1))
    pairs = F.flatten(F.transform(F.sequence(start, F.greatest(n, F.lit(1))), lambda i: F.array(F.struct(F.lit("user").alias("role"), F.try_element_at(users, i).alias("content")), F.struct(F.lit("assistant").alias("role"), F.when(i < n, F.try_element_at(assistants, i)).alias("content")))))
    return F.filter(pairs, lambda m: m["content"].isNotNull())


def todo(keys: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Keys not yet in an output: what a resumed run has left to do."""
    return keys.join(done.select(*key).distinct(), key, "left_anti")


def normalized_rows(raw: DataFrame, json_col: str) -> DataFrame:
    """Queries, sources, cited urls and text of a replayed answer in either API shape (output items, or content blocks)."""
    item = "STRUCT<type: STRING, name: STRING, text: STRING, action: STRUCT<query: STRING, queries: ARRAY<STRING>, sources: ARRAY<STRUCT<url: STRING, title: STRING>>>, input: STRUCT<query: STRING>, content: ARRAY<STRUCT<type: STRING, text: STRING, url: STRING, title: STRING, annotations: ARRAY<STRUCT<type: STRING, url: STRING, title: STRING>>>>, citations: ARRAY<STRUCT<url: STRING, title: STRING, cited_text: STRING>>>"
    p = F.from_json(json_col, f"STRUCT<output: ARRAY<{item}>, content: ARRAY<{item}>>")
    d = raw.withColumn("_items", F.coalesce(p["output"], p["content"], F.from_json(F.lit("[]"), f"ARRAY<{item}>")))
    none = F.array().cast("array<string>")
    queries = F.transform("_items", lambda i: F.filter(F.array_distinct(F.concat(F.coalesce(i["action"]["queries"], none), F.array(i["action"]["query"], i["input"]["query"]))), lambda q: F.trim(q) != ""))
    src = "array<struct<url:string,title:string>>"
    fetched = F.flatten(F.transform("_items", lambda i: F.concat(F.coalesce(i["action"]["sources"].cast(src), F.array().cast(src)), F.when(i["type"] == "web_search_tool_result", F.transform(F.filter(i["content"], lambda c: c["url"].isNotNull()), lambda c: F.struct(c["url"].alias("url"), c["title"].alias("title")))).otherwise(F.array().cast(src)))))
    cited = F.flatten(F.transform("_items", lambda i: F.concat(F.coalesce(F.flatten(F.transform(F.filter(i["content"], lambda c: c["annotations"].isNotNull()), lambda c: F.transform(c["annotations"], lambda a: a["url"]))), none), F.coalesce(F.transform(i["citations"], lambda c: c["url"]), none))))
    body = F.array_join(F.filter(F.transform("_items", lambda i: F.coalesce(F.when(i["type"] == "text", i["text"]), F.array_join(F.transform(F.filter(i["content"], lambda c: c["type"].isin("output_text", "text")), lambda c: c["text"]), ""))), lambda t: t != ""), "\n")
    return d.select(*[c for c in raw.columns if c != json_col], F.filter(queries, lambda q: F.size(q) > 0).alias("web_queries"), F.array_distinct(F.filter(fetched, lambda s: s["url"] != "")).alias("sources"), F.array_distinct(F.filter(cited, lambda u: u != "")).alias("cited_urls"), body.alias("output_text"))


def common_samples(calls: DataFrame) -> DataFrame:
    """Samples that every model has a row for."""
    n = calls.agg(F.count_distinct("model").alias("n"))
    have = calls.groupBy("sample").agg(F.count_distinct("model").alias("k"))
    return have.join(F.broadcast(n), F.col("k") == F.col("n")).select("sample")


def all_called(calls: DataFrame) -> DataFrame:
    """Common samples on which every model called the web."""
    ok = calls.groupBy("sample").agg(F.bool_and("called").alias("ok")).filter("ok").select("sample")
    return common_samples(calls).join(ok, "sample", "left_semi")


def agreement(calls: DataFrame, base: str) -> DataFrame:
    """2 x 2 outcomes of every other model against the base on the samples both have."""
    b = calls.filter(F.col("model") == base).select("sample", F.col("called").alias("base"))
    j = calls.filter(F.col("model") != base).join(b, "sample")
    g = j.groupBy("model", outcome_key(F.col("base"), F.col("called")).alias("outcome")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("model")))


def matching_models(calls: DataFrame, base: str) -> DataFrame:
    """Over common samples: how many of the other models decide as the base, for bases that called and that didn't; every number listed."""
    kept = calls.join(common_samples(calls), "sample", "left_semi")
    b = kept.filter(F.col("model") == base).select("sample", F.col("called").alias("base"))
    per = kept.filter(F.col("model") != base).join(b, "sample").groupBy("sample", "base").agg(F.count_if(F.col("called") == F.col("base")).alias("matching"))
    models = calls.agg(F.count_distinct("model").alias("_n"))  # one row
    spine = models.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_n") - 1, F.lit(0)))).alias("matching"), F.array(F.lit(True), F.lit(False)).alias("_b")).select(F.explode("_b").alias("base"), "matching")
    g = spine.join(per.groupBy("base", "matching").agg(F.count("*").alias("n")), ["base", "matching"], "left").na.fill({"n": 0})
    return g.withColumn("share", F.coalesce(F.try_divide("n", F.sum("n").over(W.partitionBy("base"))), F.lit(0.0)))


def topic_shares(t: DataFrame, topic: str, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Counts and shares of topics but for those left out, whatever their case."""
    g = t.filter(~F.lower(topic).isin(*left_out)).groupBy(topic).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def heatmap(calls: DataFrame, models: list[str], value: str) -> DataFrame:
    """Common samples by model, with how many models called."""
    kept = calls.join(common_samples(calls), "sample", "left_semi")
    wide = kept.groupBy("sample").pivot("model", models).agg(F.sum(value).cast("long"))
    total = kept.groupBy("sample").agg(F.count_if(F.col("called")).alias("callers"))
    return wide.join(total, "sample")


def likert_means(scores: DataFrame, bucket: str, mode: str, metric: str) -> DataFrame:
    """Mean scores by mode and metric, overall (bucket null) and by bucket."""
    g = scores.groupingSets([[bucket, mode, metric], [mode, metric]], bucket, mode, metric)
    return g.agg(F.count("score").alias("n"), F.round(F.avg("score"), 9).alias("mean"))


#: What replays are scored for, and the groups their means are taken over.
LIKERT_METRICS = ("factuality", "completeness", "relevance")
CALL_BUCKETS = ("overall", "auto_web_call", "auto_no_web_call")


def likert_by_model(calls: DataFrame, scores: DataFrame) -> DataFrame:
    """(model, bucket, mode, metric, n, n_scores, mean): mean scores of each model over the samples that all models have.

    calls: model, result_key, called (whether the free run searched). scores: model, result_key, mode, metric, score. n counts the bucket's samples, scored or not;
    a mode is listed for a model that has any score in it, on whatever sample. Buckets are overall, and samples with and without a search of that model.
    """
    one = calls.groupBy("model", "result_key").agg(F.coalesce(F.max("called"), F.lit(False)).alias("called"))
    models = one.agg(F.count_distinct("model").alias("_models"))  # one row
    common = one.groupBy("result_key").agg(F.count_distinct("model").alias("_has")).crossJoin(models).filter("_has = _models").select("result_key")
    kept = one.join(common, "result_key").withColumn("bucket", F.explode(F.array(F.lit(CALL_BUCKETS[0]), F.when(F.col("called"), CALL_BUCKETS[1]).otherwise(CALL_BUCKETS[2]))))
    marks = scores.select("model", "result_key", "mode", "metric", finite(F.col("score")).alias("score")).filter("score is not null")
    means = kept.join(marks, ["model", "result_key"]).groupBy("model", "bucket", "mode", "metric").agg(F.count("*").alias("n_scores"), F.round(F.avg("score"), 9).alias("mean"))
    sizes = kept.groupBy("model", "bucket").agg(F.count("*").alias("n"))
    every = lambda names: F.explode(F.array(*[F.lit(x) for x in names]))
    spine = marks.select("model", "mode").distinct().withColumn("metric", every(LIKERT_METRICS)).withColumn("bucket", every(CALL_BUCKETS))
    return spine.join(sizes, ["model", "bucket"], "left").join(means, ["model", "bucket", "mode", "metric"], "left").na.fill({"n": 0, "n_scores": 0})


def label_counts(rows: DataFrame, by: list[str], label: Column, allowed: tuple[str, ...] | None, name: str) -> DataFrame:
    """(by, name, n, pct): counts and percent of labels within each group; rows without one don't count, and labels beyond the allowed ones are OTHER."""
    named = rows.select(*by, (label if allowed is None else among(label, allowed)).alias(name)).filter(F.col(name).isNotNull())
    g = named.groupBy(*by, name).agg(F.count("*").alias("n"))
    return g.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def relation_counts(judgments: DataFrame, by: list[str], column: str = "judgment", collapse: bool = True) -> DataFrame:
    """Counts and percent of the relations of aligned claims; column holds judgments as values.judgment() reads them."""
    rows = judgments.select(*by, F.explode(F.col(column)["alignments"]).alias("_a"))
    return label_counts(rows, by, relation(F.col("_a.relation")), CLAIM_RELATIONS if collapse else None, "relation")


def category_counts(judgments: DataFrame, by: list[str], column: str = "judgment", collapse: bool = True) -> DataFrame:
    """Counts and percent of the categories of whole responses."""
    category = strip(F.col(column)["category"])
    return label_counts(judgments, by, F.when(category != "", category), RESPONSE_CATEGORIES if collapse else None, "category")


#: Fixed value: a markdown link that cites a page.
LINK = r"\[[^\n]{0,120}?\]\((https?://[^)\s]+)\)"


def _placed(part: Column) -> Column:
    """Claims of a text with their place in it: each is looked for behind the one before, else from the start; -1 where it isn't."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<claim:string,start:int>>").alias("out"))

    def step(acc, c):
        ahead = F.call_function("locate", c, part, acc["at"])
        found = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", c, part, F.lit(1)))
        one = F.struct(c.alias("claim"), (found - 1).alias("start"))
        return F.struct(F.when(found > 0, found + F.length(c)).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(text.sentences(part), zero, step, lambda acc: acc["out"])


def link_claims(docs: DataFrame, keys: list[str], text_col: str, mode: str = "all") -> DataFrame:
    """keys, claim_idx, claim, urls, start, end: claims with the urls of the markdown link that follows them.

    mode all: every claim between two links has the second one's url; latest: only the last claim before a link is kept. A link without a claim
    before it adds its url to the row before. What follows the last link has no url. A text none of whose pieces holds a claim is taken whole.
    Places count from 0, the end is exclusive; both are null where the claim isn't found as it is.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.arrays_zip(F.split(t, LINK, -1).alias("part"), F.regexp_extract_all(t, F.lit(f"({LINK})"), F.lit(1)).alias("marker"), F.regexp_extract_all(t, F.lit(LINK), F.lit(1)).alias("url"))
    whole = F.array(F.struct(t.alias("part"), F.lit(None).cast("string").alias("marker"), F.lit(None).cast("string").alias("url")))
    some = F.exists(pieces, lambda p: F.size(text.sentences(p["part"])) > 0)
    seq = docs.select(*keys, F.posexplode(F.when(some, pieces).otherwise(whole)).alias("i", "p"))
    w = W.partitionBy(*keys).orderBy("i")
    length = F.length("p.part") + F.coalesce(F.length("p.marker"), F.lit(0))
    seq = seq.withColumn("offset", F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("cs", _placed(F.col("p.part")))
    url = F.when(match_key(F.col("p.url")) != "", match_key(F.col("p.url")))
    seq = seq.withColumn("url", url).withColumn("home", F.last(F.when(F.size("cs") > 0, F.col("i")), ignorenulls=True).over(w)).filter("home is not null")
    # one row per piece that holds claims, with the urls of those without that follow it
    by_home = seq.groupBy(*keys, "home").agg(
        F.max_by("cs", -F.col("i")).alias("cs"), F.min("offset").alias("offset"), F.max(F.when(F.col("i") == F.col("home"), F.col("url"))).alias("own"), F.max(F.when(F.col("i") == F.col("home"), F.col("p.marker"))).alias("marker"),
        F.array_sort(F.collect_list(F.when(F.col("i") > F.col("home"), F.struct("i", "url")))).alias("more"),
    )
    if mode == "latest":
        by_home = by_home.withColumn("cs", F.when(F.col("marker").isNull(), F.col("cs")).otherwise(F.slice("cs", -1, 1)))
    rows = by_home.select(*keys, "home", "offset", "own", "more", F.size("cs").alias("n"), F.posexplode("cs").alias("j", "c"))
    none = F.array().cast("array<string>")
    own = F.when(F.col("own").isNotNull(), F.array("own")).otherwise(none)
    extra = F.when(F.col("j") == F.col("n") - 1, F.filter(F.transform("more", lambda m: m["url"]), lambda u: u.isNotNull())).otherwise(none)
    at = F.when(F.col("c.start") >= 0, F.col("offset") + F.col("c.start")).cast("int")
    return rows.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("home", "j")) - 1).alias("claim_idx"), F.col("c.claim").alias("claim"), F.array_distinct(F.concat(own, extra)).alias("urls"), at.alias("start"), (at + F.length("c.claim")).alias("end"))


def linked_text(blocks: Column) -> Column:
    """Blocks of an answer (text, citations with urls) as one text, each block followed by links to its pages."""
    def one(b):
        urls = F.array_distinct(F.filter(F.transform(F.coalesce(b["citations"], F.array().cast("array<struct<url:string>>")), lambda c: match_key(c["url"])), lambda u: u != ""))
        return F.concat(b["text"], F.array_join(F.transform(urls, lambda u: F.concat(F.lit(" [Cited]("), u, F.lit(")"))), ""))

    return F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != ""), one), "")


def span_claims(claims: DataFrame, cites: DataFrame, keys: list[str], mode: str = "all") -> DataFrame:
    """claims with urls from cited spans (keys, url, start, end): of every span that overlaps them, or, mode latest, each span's url at the claim that ends last of those it overlaps."""
    a = claims.filter("start is not null").select(*keys, "claim_idx", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = cites.filter("url <> '' and end > start").select(*keys, "url", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = span_overlaps(a, b, keys)
    if mode == "latest":
        met = met.groupBy(*keys, "url", "b_start", "b_end").agg(F.max_by("claim_idx", F.struct("a_end", -F.col("claim_idx"))).alias("claim_idx"))
    urls = met.groupBy(*keys, "claim_idx").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("b_start", "b_end", "url"))), lambda x: x["url"])).alias("urls"))
    return claims.drop("urls").join(urls, [*keys, "claim_idx"], "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))


def url_candidates(claims: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate sources of every claim: those its urls name (cited ones first), other cited ones, retrieved ones not cited; each url once.

    claims: keys, claim_idx, urls. sources: keys, kind, pos, url.
    """
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("pos")))
    s = sources.withColumn("url", match_key(F.col("url"))).filter("url <> ''").groupBy(*keys, "url").agg(at("cited").alias("_c"), at("retrieved").alias("_r"))
    j = claims.select(*keys, "claim_idx", "urls").join(s, keys)
    priority = F.when(F.array_contains("urls", F.col("url")), 1).when(F.col("_c").isNotNull(), 2).otherwise(3)
    order = W.partitionBy(*keys, "claim_idx").orderBy("priority", F.col("_c").isNull(), F.coalesce("_c", "_r"), "url")
    return j.withColumn("priority", priority).select(*keys, "claim_idx", "url", "priority", F.row_number().over(order).cast("long").alias("pos"))


def latest_claims(rows: DataFrame, keys: list[str], order: str = "claim_idx") -> DataFrame:
    """Of consecutive claims with the same urls, the last; claims without urls go."""
    return latest_of_runs(rows.withColumn("_same", F.array_join("urls", "\n")), keys, order, "_same").filter("_same <> ''").drop("_same")


#: Other names of buckets, as alignments read them.
BUCKET_NAMES = {"": "Unexplained", "Unknown": "Unexplained", "unknown": "Unexplained", "Parametric Knowledge": "Unexplained", "Associated Citations": "Marker-cited", "Marked Citations": "Marker-cited", "Other Citations": "Other cited"}


def alignment(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group, how the buckets found agree with the urls an answer marks itself.

    rows: by, urls (what the answer marks), bucket (found), entailed_url. marked: claims with urls; associated: those found marker-cited;
    same_url: those whose entailed url is among their own, and both; parametric: claims found unexplained, and those of them without urls.
    """
    bucket = F.coalesce(F.col("bucket"), F.lit(""))
    for old, new in BUCKET_NAMES.items():
        bucket = F.when(bucket == old, new).otherwise(bucket)
    gold, found = F.size("urls") > 0, bucket == BUCKETS[0]
    same = gold & F.coalesce(F.array_contains("urls", match_key(F.col("entailed_url"))), F.lit(False))
    g = rows.groupBy(*by).agg(
        F.count_if(gold).alias("marked"), F.count_if(gold & found).alias("associated"), F.count_if(same).alias("same_url"), F.count_if(same & found).alias("associated_same_url"),
        F.count_if(bucket == BUCKETS[3]).alias("parametric"), F.count_if((bucket == BUCKETS[3]) & ~gold).alias("parametric_unmarked"),
        *[F.count_if(gold & (bucket == b)).alias(f"marked_{i}") for i, b in enumerate(BUCKETS, 1)], *[F.count_if(~gold & (bucket == b)).alias(f"unmarked_{i}") for i, b in enumerate(BUCKETS, 1)],
    )
    share = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    return g.select("*", *[share(n, "marked").alias(f"{n}_rate") for n in ("associated", "same_url", "associated_same_url")], share("parametric_unmarked", "parametric").alias("parametric_unmarked_rate"))


def span_overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int = 512) -> DataFrame:
    """Pairs of spans that overlap within a key: an interval join on buckets of positions, each pair once.

    a: keys, a_start, a_end; b: keys, b_start, b_end (ends exclusive). A pair is kept in the bucket of the later start.
    """
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)))
    x, y = a.withColumn("_k", buckets("a_start", "a_end")), b.withColumn("_k", buckets("b_start", "b_end"))
    j = x.join(y, [*keys, "_k"]).filter("greatest(a_start, b_start) < least(a_end, b_end)")
    return j.filter(F.col("_k") == F.floor(F.greatest("a_start", "b_start") / width)).drop("_k")
