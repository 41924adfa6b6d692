"""Queries on claims, dead links and replays, over documents, order lines and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions import stats, text, values
from turnscope.operators import claims as C
from turnscope.operators import matching
from turnscope.operators import replay as R
from turnscope.operators import urlcheck as U
from turnscope.operators.grounding import grounding

from .views import chat_turns, line_sources, table, with_views

Q, S = {}, {}


def query(name, sql=None, views=()):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = with_views(sql, *views) if views else sql.strip()
        return f

    return add


# --- chunks and claims ---------------------------------------------------------------------


@query("sentence_chunks")
def sentence_chunks(spark, d):
    """F7, A41 without markers: DuckDB's patterns lack lookbehind, so tests compare with Python."""
    return C.sentence_chunks(table(spark, d, "documents"), ["doc_id"], "text")


@query("document_terms", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS terms, CAST(ceil(length(text) / 3) AS BIGINT) AS tokens, sha256(text) AS claim_key, length(substr(text, 1, 300)) AS trimmed FROM documents")
def document_terms(spark, d):
    """F5, F10, F23."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.term_count(t).alias("terms"), text.token_estimate(t).alias("tokens"), text.claim_key(t).alias("claim_key"), F.length(text.trim_to_tokens(t, 100)).cast("long").alias("trimmed"))


@query("content_tokens", r"SELECT lang, CAST(sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS BIGINT) AS tokens, CAST(sum(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOPWORDS["en"]) + ")))) AS BIGINT) AS content FROM documents GROUP BY lang")
def content_tokens(spark, d):
    """F6 with the stopword fallback."""
    t = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(text.word_tokens(t))).cast("long").alias("tokens"), F.sum(F.size(text.content_tokens(t))).cast("long").alias("content"))


@query("language_guess", """WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents),
c AS (SELECT doc_id, """.replace("\\\\", "\\") + ", ".join(f"count(*) FILTER (WHERE t IN ({', '.join(repr(x) for x in ws)})) AS {k}" for k, ws in sorted(text.STOPWORDS.items())) + """ FROM w GROUP BY doc_id),
g AS (SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN '' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS guess FROM c)
SELECT lang, coalesce(guess, '') AS guess, count(*) AS n FROM documents LEFT JOIN g USING (doc_id) GROUP BY ALL""")
def language_guess(spark, d):
    """E14 with the stopword fallback."""
    return table(spark, d, "documents").groupBy("lang", text.guess_language(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query("benchmark_token_f1", r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS x, len(w) AS n FROM t), c AS (SELECT item_id, x, n, count(*) AS k FROM u GROUP BY ALL),
b AS (SELECT a.item_id AS a, b.item_id AS b, sum(least(a.k, b.k)) AS hits, any_value(a.n) + any_value(b.n) AS total FROM c a JOIN c b ON a.x = b.x AND b.item_id = a.item_id + 1 GROUP BY ALL)
SELECT a AS item_id, round(2.0::DOUBLE * hits / total, 9) AS f1 FROM b""")
def benchmark_token_f1(spark, d):
    """F12 of each item and the next."""
    b = table(spark, d, "benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return b.join(n, "item_id").select("item_id", F.round(text.token_f1(F.col("text"), F.col("next")), 9).alias("f1")).filter("f1 > 0")


@query("benchmark_rouge")
def benchmark_rouge(spark, d):
    """precision of n-grams and of the longest common subsequence of neighbouring items (tests compare with Python)."""
    b = table(spark, d, "benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    j = b.join(n, "item_id")
    return j.select("item_id", *[text.rouge_n_precision(F.col("text"), F.col("next"), k).alias(f"rouge{k}") for k in (1, 2)], text.rouge_l_precision("text", "next").alias("rouge_l"))


@query("similar_vectors", """WITH p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10) SELECT * FROM p""")
def similar_vectors(spark, d):
    """cosine of vectors ten apart of one label."""
    e = table(spark, d, "embeddings")
    o = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2"), "label")
    return e.withColumn("other", F.col("vec_id") + 10).join(o, ["label", "other"]).select("vec_id", "other", F.round(text.cosine(F.col("embedding"), F.col("e2")), 6).alias("cosine"))


@query("match_texts", r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM benchmark")
def match_texts(spark, d):
    """F13."""
    return table(spark, d, "benchmark").select("item_id", text.match_text(F.col("text")).alias("t"))


CLAIMS = """k AS (SELECT conv_id, turn_id, pos AS claim_idx FROM line_sources WHERE kind = 'cited'),
ch AS (SELECT conv_id, turn_id, claim_idx, s.pos, s.url, CASE WHEN s.pos = claim_idx THEN 1 WHEN kind = 'cited' THEN 2 ELSE 3 END AS priority, (l_partkey + claim_idx) % 4 = 0 AS entailed FROM k JOIN line_sources s USING (conv_id, turn_id)),
fi AS (SELECT *, min(CASE WHEN entailed THEN priority * 100 + pos END) OVER (PARTITION BY turn_id, claim_idx) AS first FROM ch),
abk AS (SELECT turn_id, claim_idx, CASE min(first) // 100 WHEN 1 THEN 'Marker-cited' WHEN 2 THEN 'Other cited' WHEN 3 THEN 'Retrieved Sources' ELSE 'Unexplained' END AS bucket,
  struct_extract(min(struct_pack(p := priority, q := pos, u := url)) FILTER (WHERE entailed), 'u') AS entailed_url, count(*) FILTER (WHERE priority = 1 OR first IS NULL OR priority * 100 + pos <= first) AS checked FROM fi GROUP BY ALL)"""


def _attributed(spark, d):
    s = line_sources(spark, d)
    k = s.filter("kind = 'cited'").select("turn_id", F.col("pos").alias("claim_idx"))
    ch = k.join(s, "turn_id").select("turn_id", "claim_idx", "pos", "url", "platform", F.when(F.col("pos") == F.col("claim_idx"), 1).when(F.col("kind") == "cited", 2).otherwise(3).alias("priority"), ((F.col("l_partkey") + F.col("claim_idx")) % 4 == 0).alias("entailed"))
    return C.attribution(ch, ["platform", "turn_id", "claim_idx"])


@query("attribution", f"WITH {CLAIMS} SELECT * FROM abk", ("line_sources",))
def attribution(spark, d):
    """Each cited line as a claim, all lines of its order as checked candidates."""
    return _attributed(spark, d).drop("platform")


@query("claim_candidates", """WITH s AS (SELECT turn_id, kind, pos, url, CASE WHEN kind = 'cited' AND pos % 3 = 0 THEN NULL ELSE pos END AS ref FROM line_sources), k AS (SELECT turn_id, pos AS claim_idx, [pos, pos + 1] AS refs FROM line_sources WHERE kind = 'cited'),
c AS (SELECT turn_id, url, min(pos) FILTER (WHERE kind = 'cited') AS cpos, min(pos) FILTER (WHERE kind = 'retrieved') AS rpos, list(ref) FILTER (WHERE kind = 'cited' AND ref IS NOT NULL) AS crefs, list(ref) FILTER (WHERE kind = 'retrieved' AND ref IS NOT NULL) AS rrefs FROM s GROUP BY ALL),
j AS (SELECT turn_id, claim_idx, url, cpos, rpos, coalesce(list_has_any(crefs, refs), false) AS direct, coalesce(list_has_any(rrefs, refs), false) AS found FROM k JOIN c USING (turn_id)),
p AS (SELECT *, CASE WHEN cpos IS NOT NULL AND (direct OR found) THEN 1 WHEN cpos IS NOT NULL THEN 2 ELSE 3 END AS priority FROM j)
SELECT turn_id, claim_idx, url, priority, row_number() OVER (PARTITION BY turn_id, claim_idx ORDER BY priority, CASE WHEN priority = 1 AND NOT direct THEN 1 ELSE 0 END, coalesce(cpos, rpos), url) AS pos FROM p""", ("line_sources",))
def claim_candidates(spark, d):
    """The candidate sources of every claim, marker-cited, other cited, retrieved."""
    s = line_sources(spark, d).select("turn_id", "kind", "pos", "url", F.when((F.col("kind") == "retrieved") | (F.col("pos") % 3 != 0), F.col("pos").cast("int")).alias("ref_index"))
    k = s.filter("kind = 'cited'").select("turn_id", F.col("pos").alias("claim_idx"), F.array(F.col("pos").cast("int"), (F.col("pos") + 1).cast("int")).alias("refs"))
    return C.candidates(k, s, ["turn_id"])


@query("bucket_shares", f"""WITH {CLAIMS}, p AS (SELECT DISTINCT turn_id, platform FROM line_sources), g AS (SELECT platform, bucket, count(*) AS n FROM abk JOIN p USING (turn_id) GROUP BY ALL)
SELECT x.platform, CASE b.bucket WHEN 'Retrieved Sources' THEN 'Search Results' ELSE b.bucket END AS bucket, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY x.platform) AS share
FROM (SELECT DISTINCT platform FROM p) x CROSS JOIN (SELECT unnest(['Marker-cited', 'Other cited', 'Retrieved Sources', 'Unexplained']) AS bucket) b LEFT JOIN g ON g.platform = x.platform AND g.bucket = b.bucket""", ("line_sources",))
def bucket_shares(spark, d):
    """A44, A65."""
    return C.bucket_shares(_attributed(spark, d), ["platform"], summary_names=True)


@query("bucket_share_ci")
def bucket_share_ci(spark, d):
    """Seeded bootstrap of the shares of all four buckets, by response (no SQL for the generator)."""
    return stats.exact_group_ci(_attributed(spark, d), ["platform"], ["turn_id"], "bucket", list(C.BUCKETS))


@query("bucket_share_estimates", f"""WITH {CLAIMS}, p AS (SELECT DISTINCT turn_id, platform FROM line_sources), j AS (SELECT * FROM abk JOIN p USING (turn_id)), t AS (SELECT platform, count(*) AS total, count(DISTINCT turn_id) AS n_responses FROM j GROUP BY platform), g AS (SELECT platform, bucket, count(*) AS n FROM j GROUP BY ALL)
SELECT t.platform, b.bucket, coalesce(n, 0) AS n, n_responses, round(coalesce(n, 0) / total, 9) AS estimate, true AS inside FROM t CROSS JOIN (SELECT unnest(['Marker-cited', 'Other cited', 'Retrieved Sources', 'Unexplained']) AS bucket) b LEFT JOIN g ON g.platform = t.platform AND g.bucket = b.bucket""", ("line_sources",))
def bucket_share_estimates(spark, d):
    """The shares and counts beside the Poisson intervals, and that each interval holds its share."""
    ci = stats.poisson_group_ci(_attributed(spark, d), ["platform"], ["turn_id"], "bucket", list(C.BUCKETS))
    return ci.select("platform", "bucket", "n", "n_responses", F.round("estimate", 9).alias("estimate"), F.col("estimate").between(F.col("ci_low") - 1e-9, F.col("ci_high") + 1e-9).alias("inside"))


@query("latest_of_runs", """WITH r AS (SELECT *, coalesce((event_type <> lag(event_type) OVER w)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r)
SELECT user_id, event_type, max(event_id) AS event_id FROM i GROUP BY user_id, run, event_type""")
def latest_of_runs(spark, d):
    """Islands of equal neighbours, the last of each."""
    return C.latest_of_runs(table(spark, d, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_type", "event_id")


@query("score_summary", f"""WITH {CLAIMS}, s AS (SELECT bucket, CASE WHEN turn_id % 7 <> 0 THEN (turn_id + claim_idx) % 5 + 1 END AS score FROM abk), g AS (SELECT bucket, count(*) AS n, round(avg(score), 9) AS mean, median(score)::DOUBLE AS median FROM s WHERE score IS NOT NULL AND bucket <> 'Other cited' GROUP BY bucket)
SELECT 1 AS one, b.bucket, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(median, 0) AS median FROM (SELECT unnest(['Marker-cited', 'Other cited', 'Retrieved Sources', 'Unexplained']) AS bucket) b LEFT JOIN g USING (bucket)""", ("line_sources",))
def score_summary(spark, d):
    """Absent buckets are 0."""
    a = _attributed(spark, d).filter("bucket <> 'Other cited'").withColumn("one", F.lit(1)).withColumn("score", F.when(F.col("turn_id") % 7 != 0, (F.col("turn_id") + F.col("claim_idx")) % 5 + 1))
    return C.score_summary(a, ["one"])


@query("factuality", """WITH j AS (SELECT lang AS platform, source AS grp, 1 + 4 * quality AS score FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), g AS (SELECT platform, grp, count(*) AS n, round(avg(score), 9) AS mean_score FROM j GROUP BY GROUPING SETS ((platform, grp), (grp)))
SELECT *, n / sum(n) OVER (PARTITION BY platform) AS share FROM g""")
def factuality(spark, d):
    """Joined by claim, for each platform and all."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("platform"), F.col("source").alias("grp"))
    facts = table(spark, d, "labels").filter("quality is not null").select("doc_id", (1 + 4 * F.col("quality")).alias("score"))
    return C.factuality(docs, facts, ["doc_id"], "grp", "platform")


@query("factuality_ci")
def factuality_ci(spark, d):
    """Seeded bootstrap of mean factuality by group; responses (here ten documents each) are drawn once for all groups."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality is not null"), "doc_id")
    rows = docs.select("lang", (F.col("doc_id") % 10).alias("group"), F.floor(F.col("doc_id") / 10).alias("response"), (1.0 + 4 * F.col("quality")).alias("score")).withColumn("group", F.element_at(F.array(*[F.lit(b) for b in C.BUCKETS]), (F.col("group") % 4 + 1).cast("int")))
    return stats.exact_group_ci(rows, ["lang"], ["response"], "group", list(C.BUCKETS), "score")


@query("diagnosis", """SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS both_bad,
  round(count(*) FILTER (WHERE quality = 1) / count(*), 4) AS good_rate, round(count(*) FILTER (WHERE toxic = 1) / count(*), 4) AS toxic_rate, round(count(*) FILTER (WHERE quality = 0 AND toxic = 1) / count(*), 4) AS both_bad_rate FROM labels""")
def diagnosis(spark, d):
    """A48."""
    return C.diagnosis(table(spark, d, "labels"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "both_bad": (F.col("quality") == 0) & (F.col("toxic") == 1)})


@query("aligned_labels", "SELECT a.quality AS first, b.toxic AS second, count(*) AS n FROM labels a JOIN labels b USING (doc_id) GROUP BY ALL")
def aligned_labels(spark, d):
    """A49."""
    x = table(spark, d, "labels")
    return C.aligned(x.select("doc_id", F.col("quality").alias("l")), x.select("doc_id", F.col("toxic").alias("l")), ["doc_id"], "l")


@query("usual_query", """WITH g AS (SELECT user_id, event_type || repeat('!', CAST(value AS INT) % 2) AS q, count(*) AS n FROM (SELECT user_id, event_type, floor(value) AS value FROM events) GROUP BY ALL)
SELECT user_id, q FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(q) DESC, q) = 1""")
def usual_query(spark, d):
    """A50."""
    e = table(spark, d, "events").select("user_id", F.concat("event_type", F.repeat(F.lit("!"), (F.floor("value") % 2).cast("int"))).alias("q"))
    return C.usual_query(e, "user_id", "q")


@query("bucket_ranks", f"""WITH {CLAIMS}, u AS (SELECT bucket, (turn_id + claim_idx) % 89 AS rank FROM abk) SELECT bucket, count(*) AS n, round(avg(rank), 6) AS mean_rank, median(rank)::DOUBLE AS median_rank, round(avg(log10(rank)), 6) AS mean_log10, round(median(log10(rank)), 6) AS median_log10 FROM u WHERE rank > 0 GROUP BY bucket""", ("line_sources",))
def bucket_ranks(spark, d):
    """A37."""
    return C.bucket_ranks(_attributed(spark, d).withColumn("rank", (F.col("turn_id") + F.col("claim_idx")) % 89), ["bucket"], "rank")


# --- urls ----------------------------------------------------------------------------------

CITED = """f AS (SELECT conv_id, domain, min(turn_id) AS first FROM line_sources WHERE kind = 'retrieved' GROUP BY ALL),
x AS (SELECT s.*, coalesce(f.first <= s.turn_id, false) AS external FROM line_sources s LEFT JOIN f USING (conv_id, domain) WHERE kind = 'cited'),
o AS (SELECT CASE WHEN external THEN 'cited_and_retrieved' ELSE 'cited_not_retrieved' END AS grp, url, count(*) AS n, min(month) AS first_month FROM x GROUP BY ALL)"""


@query("citation_occurrences", f"WITH {CITED} SELECT * FROM o", ("line_sources",))
def citation_occurrences(spark, d):
    """A51."""
    return U.occurrences(grounding(line_sources(spark, d), "conversation"))


@query("hallucinated_rates", f"""WITH {CITED}, b AS (SELECT *, CASE CAST(split_part(url, '/', 2) AS INT) % 4 WHEN 0 THEN '404' WHEN 1 THEN '200' WHEN 2 THEN 'timeout' ELSE '301' END AS status, CASE length(url) % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'hallucinated' END AS archive_class FROM o),
c AS (SELECT *, CASE WHEN status IN ('200', '301') THEN 'valid' WHEN status = '404' AND archive_class IS NOT NULL THEN archive_class ELSE 'unknown' END AS bucket FROM b)
SELECT grp, CAST(coalesce(sum(n) FILTER (WHERE bucket = 'valid'), 0) AS BIGINT) AS valid, CAST(coalesce(sum(n) FILTER (WHERE bucket = 'unknown'), 0) AS BIGINT) AS unknown, CAST(coalesce(sum(n) FILTER (WHERE bucket = 'stale'), 0) AS BIGINT) AS stale,
  CAST(coalesce(sum(n) FILTER (WHERE bucket = 'hallucinated'), 0) AS BIGINT) AS hallucinated, CAST(sum(n) AS BIGINT) AS total, coalesce(sum(n) FILTER (WHERE bucket = 'hallucinated'), 0) / sum(n) AS hallucinated_rate FROM c GROUP BY grp""", ("line_sources",))
def hallucinated_rates(spark, d):
    """A52."""
    o = U.occurrences(grounding(line_sources(spark, d), "conversation"))
    # the tables of statuses stand for a crawl's: one row per url that sources hold
    u = line_sources(spark, d).filter("kind = 'cited'").select("url").distinct()
    s = F.split_part("url", F.lit("/"), F.lit(2)).cast("int") % 4
    status = u.select("url", F.when(s == 0, "404").when(s == 1, "200").when(s == 2, "timeout").otherwise("301").alias("status"))
    archive = u.select("url", F.when(F.length("url") % 3 == 0, "stale").when(F.length("url") % 3 == 1, "hallucinated").alias("archive_class"))
    return U.rates(U.bucketed(o, status, archive), ["grp"])


# --- replays -------------------------------------------------------------------------------

CALLS = "c AS (SELECT user_id AS sample, event_type AS model, max(value) > 90 AS called, count(*) FILTER (WHERE value > 90) AS n_calls FROM events GROUP BY ALL)"


def _calls(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("model")).agg((F.max("value") > 90).alias("called"), F.count_if(F.col("value") > 90).alias("n_calls"))


@query("pii_safe", "SELECT user_id FROM events GROUP BY user_id HAVING bool_and(event_type <> 'purchase' OR value < 95)")
def pii_safe(spark, d):
    """A53."""
    a = table(spark, d, "events").select("user_id", F.when((F.col("event_type") != "purchase") | (F.col("value") < 95), " No ").otherwise("yes").alias("personal"), F.lit("no").alias("special"))
    return R.pii_safe(a, "user_id", ["personal", "special"])


@query("fullest_turns", "SELECT conv_id, turn_no, n_msgs FROM chat_turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n_msgs DESC, turn_no) = 1", ("chat_turns",))
def fullest_turns(spark, d):
    """The fullest turn of each conversation."""
    return R.fullest_turn(chat_turns(spark, d), "conv_id", "n_msgs", "turn_no").select("conv_id", "turn_no", "n_msgs")


@query("sampled_documents", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= 5")
def sampled_documents(spark, d):
    """A seeded sample per topic (a sampling operator)."""
    return R.seeded_sample(table(spark, d, "documents"), ["source"], "doc_id", 5, 42).select("source", "doc_id")


@query("web_and_other", "SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS web, count(*) AS n FROM orders GROUP BY 1")
def web_and_other(spark, d):
    """Semi and anti join against the web turns."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    a, b = R.web_and_other(o, o.filter("o_orderpriority in ('1-URGENT', '2-HIGH')"), "o_orderkey")
    return a.withColumn("web", F.lit(True)).unionByName(b.withColumn("web", F.lit(False))).groupBy("web").agg(F.count("*").alias("n"))


@query("prompts", "SELECT conv_id, count(*) AS turns, string_agg(user_text, '|' ORDER BY turn_no) FILTER (WHERE turn_no > m - 2) AS users FROM (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS m FROM chat_turns) GROUP BY conv_id", ("chat_turns",))
def prompts(spark, d):
    """The last two turns of every dialogue as messages."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn_no", c))), lambda x: x[c])
    t = chat_turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("turns"), listed("user_text").alias("u"), listed("assistant_text").alias("a"))
    m = R.prompt_messages(F.col("u"), F.col("a"), 2)
    return t.select("conv_id", "turns", F.array_join(F.transform(F.filter(m, lambda x: x["role"] == "user"), lambda x: x["content"]), "|").alias("users"))


@query("common_samples", f"WITH {CALLS} SELECT sample FROM c GROUP BY sample HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM c)")
def common_samples(spark, d):
    """A57."""
    return R.common_samples(_calls(spark, d))


@query("all_called", f"WITH {CALLS} SELECT sample FROM c GROUP BY sample HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM c) AND bool_and(called)")
def all_called(spark, d):
    """All models called."""
    return R.all_called(_calls(spark, d))


@query("agreement", f"""WITH {CALLS}, j AS (SELECT o.model, CASE WHEN b.called AND o.called THEN 'base_called_and_model_called' WHEN b.called THEN 'base_called_and_model_not_called' WHEN o.called THEN 'base_not_called_and_model_called' ELSE 'base_not_called_and_model_not_called' END AS outcome FROM c o JOIN c b ON o.sample = b.sample AND b.model = 'click' AND o.model <> 'click')
SELECT model, outcome, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY model) AS share FROM j GROUP BY model, outcome""")
def agreement(spark, d):
    """A58, F25."""
    return R.agreement(_calls(spark, d), "click")


@query("call_heatmap", f"WITH {CALLS} SELECT sample, CAST(sum(n_calls) FILTER (WHERE model = 'click') AS BIGINT) AS click, CAST(sum(n_calls) FILTER (WHERE model = 'purchase') AS BIGINT) AS purchase, count(*) FILTER (WHERE called) AS callers FROM c GROUP BY sample HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM c)")
def call_heatmap(spark, d):
    """A59."""
    return R.heatmap(_calls(spark, d), ["click", "purchase"], "n_calls")


@query("replay_topic_shares", "SELECT c_mktsegment AS topic, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'misc') GROUP BY 1")
def replay_topic_shares(spark, d):
    """A60."""
    return R.topic_shares(table(spark, d, "customer").select(F.col("c_mktsegment").alias("topic")), "topic", ("building", "misc"))


@query("matching_models", f"""WITH {CALLS}, n AS (SELECT sample FROM c GROUP BY sample HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM c)), b AS (SELECT sample, called AS base FROM c SEMI JOIN n USING (sample) WHERE model = 'click'),
m AS (SELECT sample, base, count(*) FILTER (WHERE called = base) AS matching FROM c JOIN b USING (sample) WHERE model <> 'click' GROUP BY ALL), k AS (SELECT unnest(range(0, (SELECT count(DISTINCT model) FROM c))) AS matching),
g AS (SELECT x.base, k.matching, count(m.sample) AS n FROM (SELECT unnest([true, false]) AS base) x CROSS JOIN k LEFT JOIN m ON m.base = x.base AND m.matching = k.matching GROUP BY ALL)
SELECT base, matching::BIGINT AS matching, n, CASE WHEN sum(n) OVER (PARTITION BY base) > 0 THEN n / sum(n) OVER (PARTITION BY base) ELSE 0 END AS share FROM g""")
def matching_models(spark, d):
    """How many of the other models decide as the base does."""
    return R.matching_models(_calls(spark, d), "click")


@query("likert_means", """WITH s AS (SELECT CASE WHEN value > 50 THEN 'auto_web' ELSE 'auto_no_web' END AS bucket, event_type AS mode, 'm' || user_id % 3 AS metric, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS score FROM events)
SELECT bucket, mode, metric, count(score) AS n, round(avg(score), 9) AS mean FROM s GROUP BY GROUPING SETS ((bucket, mode, metric), (mode, metric))""")
def likert_means(spark, d):
    """A61."""
    e = table(spark, d, "events")
    s = e.select(F.when(F.col("value") > 50, "auto_web").otherwise("auto_no_web").alias("bucket"), F.col("event_type").alias("mode"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("metric"), (1 + F.get_json_object("props", "$.k").cast("long") % 5).alias("score"))
    return R.likert_means(s, "bucket", "mode", "metric")


@query("likert_by_model", """
WITH e AS (SELECT event_id // 9 AS key, event_type AS model, value, event_id FROM events),
c AS (SELECT model, key, max(value) > 60 AS called FROM e GROUP BY ALL),
common AS (SELECT key FROM c GROUP BY key HAVING count(*) = (SELECT count(DISTINCT model) FROM c)),
k AS (SELECT model, key, unnest(['overall', CASE WHEN called THEN 'auto_web_call' ELSE 'auto_no_web_call' END]) AS bucket FROM c JOIN common USING (key)),
s AS (SELECT model, key, ['auto', 'none', 'required'][event_id % 3 + 1] AS mode, ['factuality', 'completeness', 'relevance'][event_id // 3 % 3 + 1] AS metric, 1 + event_id % 5 AS score FROM e WHERE event_id % 7 > 0 AND NOT (model = 'click' AND event_id % 3 = 2)),
m AS (SELECT model, bucket, mode, metric, count(*) AS n_scores, round(avg(score), 9) AS mean FROM k JOIN s USING (model, key) GROUP BY ALL),
z AS (SELECT model, bucket, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT * FROM (SELECT DISTINCT model, mode FROM s), (SELECT unnest(['factuality', 'completeness', 'relevance']) AS metric), (SELECT unnest(['overall', 'auto_web_call', 'auto_no_web_call']) AS bucket))
SELECT model, bucket, mode, metric, coalesce(n, 0) AS n, coalesce(n_scores, 0) AS n_scores, mean FROM p LEFT JOIN z USING (model, bucket) LEFT JOIN m USING (model, bucket, mode, metric)""")
def likert_by_model(spark, d):
    """Mean scores by model over the samples all models have, in all and by whether the free run searched."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 9).alias("result_key"), F.col("event_type").alias("model"), "value", "event_id")
    calls = e.groupBy("model", "result_key").agg((F.max("value") > 60).alias("called"))
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    mode, metric = pick(("auto", "none", "required"), F.col("event_id") % 3), pick(R.LIKERT_METRICS, F.floor(F.col("event_id") / 3) % 3)
    score = F.when(F.col("event_id") % 7 > 0, (1 + F.col("event_id") % 5).cast("string")).otherwise("n/a")
    scores = e.filter(~((F.col("model") == "click") & (F.col("event_id") % 3 == 2))).select("model", "result_key", mode.alias("mode"), metric.alias("metric"), score.alias("score"))
    return R.likert_by_model(calls, scores)


#: Judgments of orders: every kind of category and relation, the older names and keys, blanks, and answers that are no judgment.
JUDGED = """j AS (SELECT o_orderkey AS k, o_orderstatus AS model, CASE o_orderkey % 7 WHEN 0 THEN 'SAME_CLAIMS' WHEN 1 THEN 'UPDATED_OR_SPECIFIED' WHEN 2 THEN 'CORRECTED' WHEN 3 THEN 'NEW_CLAIMS' WHEN 4 THEN 'same_claims' END AS category FROM orders WHERE o_orderkey % 11 > 0),
a AS (SELECT model, CASE (k + i) % 8 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'REFINEMENT' WHEN 2 THEN 'CONTRADICTION' WHEN 3 THEN 'UNMATCHED' WHEN 4 THEN 'UNMATCHED' WHEN 5 THEN 'match' END AS relation FROM j CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) WHERE i <= k % 4)"""


def _judged(spark, d):
    k = F.col("o_orderkey")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    category = pick(("SAME_CLAIMS", "UPDATED_OR_SPECIFIED", " CORRECTED\n", "NEW_CLAIMS", "same_claims", " ", None), k % 7)
    old = lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("no_web_claim"), pick(("MATCH", "REFINEMENT ", "CONTRADICTION", "UNMATCHED", "NEW_CLAIM", "match", "", None), (k + i) % 8).alias("relation"), F.lit("b").alias("web_claim"))
    payload = F.to_json(F.struct(category.alias("category"), F.lit("why").alias("explanation"), F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: i <= k % 4), old).alias("alignments")))
    raw = F.when(k % 11 == 0, "no judgment").when(k % 2 == 0, F.replace(F.replace(payload, F.lit("no_web_claim"), F.lit("claim_a")), F.lit("web_claim"), F.lit("claim_b"))).otherwise(payload)
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("model"), values.judgment(raw).alias("judgment"))


@query("claim_relations", f"""WITH {JUDGED}, s AS (SELECT model, CASE WHEN relation = 'match' THEN 'OTHER' ELSE relation END AS relation FROM a WHERE relation IS NOT NULL)
SELECT model, relation, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY model) AS pct FROM s GROUP BY model, relation""")
def claim_relations(spark, d):
    """Relations of aligned claims by model, from judges' answers with newer and older keys; blanks don't count, unknown names are OTHER."""
    return R.relation_counts(_judged(spark, d), ["model"])


@query("response_categories", f"""WITH {JUDGED}, s AS (SELECT model, CASE WHEN category = 'same_claims' THEN 'OTHER' ELSE category END AS category FROM j WHERE category IS NOT NULL),
every AS (SELECT 'all' AS model, category FROM j WHERE category IS NOT NULL)
SELECT model, category, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY model) AS pct FROM (SELECT * FROM s UNION ALL SELECT * FROM every) GROUP BY model, category""")
def response_categories(spark, d):
    """Categories of whole responses by model, unknown ones as OTHER, and over all models by the names given."""
    j = _judged(spark, d)
    named = R.category_counts(j.withColumn("model", F.lit("all")), ["model"], collapse=False)
    return R.category_counts(j, ["model"]).unionByName(named)


@query("factuality_scores", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type ELSE '' END AS label, CASE event_id % 6 WHEN 0 THEN event_id % 5 WHEN 1 THEN event_id % 5 + 0.5 WHEN 2 THEN 3 ELSE 0 END::DOUBLE AS score, CASE event_id % 6 WHEN 0 THEN 'so' WHEN 1 THEN 'thus' ELSE '' END AS reasoning FROM events")
def factuality_scores(spark, d):
    """scores of claims from judges' answers: newer and older keys, numbers as text, none, null, and answers that are no object."""
    k = F.col("event_id") % 6
    n = (F.col("event_id") % 5).cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"score": '), n, F.lit(', "label": " '), "event_type", F.lit(' ", "reasoning": "so"}'))).when(k == 1, F.concat(F.lit('{"rating": "'), n, F.lit('.5", "verdict": "'), "event_type", F.lit('", "reason": "thus"}')))
        .when(k == 2, '{"score": " 3 ", "label": null}').when(k == 3, '{"score": "high"}').when(k == 4, "[1, 2]")
    )
    return table(spark, d, "events").select("event_id", values.factuality(raw).alias("f")).select("event_id", "f.*")


@query("span_overlaps", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 AS s, l_partkey % 900 + CAST(l_quantity AS BIGINT) * 20 AS e FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber AS a_line, b.l_linenumber AS b_line FROM a JOIN a b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND greatest(a.s, b.s) < least(a.e, b.e)""")
def span_overlaps(spark, d):
    """Interval join of the lines of an order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 900).alias("s"), (F.col("l_partkey") % 900 + F.col("l_quantity").cast("long") * 20).alias("e"))
    a = li.select("l_orderkey", F.col("l_linenumber").alias("a_line"), F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    b = li.select("l_orderkey", F.col("l_linenumber").alias("b_line"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    return R.span_overlaps(a, b, ["l_orderkey"]).filter("a_line < b_line").select("l_orderkey", "a_line", "b_line")


@query("resume", "SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume(spark, d):
    """What a resumed run has left."""
    o = table(spark, d, "orders").select("o_orderkey")
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.todo(o, done, ["o_orderkey"]).agg(F.count("*").alias("n"))


@query("best_blocks")
def best_blocks(spark, d):
    """Sentences of neighbouring benchmark items matched to items (tests compare with Python)."""
    b = table(spark, d, "benchmark")
    chunks = C.sentence_chunks(b, ["item_id"], "text").select((F.col("item_id") / 4).cast("long").alias("g"), (F.col("item_id") * 100 + F.col("chunk_idx")).alias("chunk_idx"), "chunk", F.array().cast("array<string>").alias("urls"))
    blocks = b.select((F.col("item_id") / 4).cast("long").alias("g"), F.col("item_id").alias("block_idx"), F.col("text").alias("block"), F.array().cast("array<string>").alias("block_urls"))
    return matching.best_block(chunks, blocks, ["g"])


# --- claims of replays -----------------------------------------------------------------------

MARKED = """mc AS (SELECT turn_id, min(platform) AS platform, pos AS claim_idx, CASE WHEN pos % 2 = 0 THEN [min(url)] ELSE []::VARCHAR[] END AS urls, min(l_partkey) AS p FROM line_sources GROUP BY turn_id, pos)"""


def _marked_claims(spark, d):
    """Each line of an order as a claim; those of even number mark their own source."""
    s = line_sources(spark, d)
    none = F.array().cast("array<string>")
    g = s.groupBy("turn_id", F.col("pos").alias("claim_idx")).agg(F.min("platform").alias("platform"), F.min("url").alias("url"), F.min("l_partkey").alias("p"))
    return g.select("turn_id", "platform", "claim_idx", F.when(F.col("claim_idx") % 2 == 0, F.array("url")).otherwise(none).alias("urls"), "p")


CASCADE = f"""{MARKED}, u AS (SELECT turn_id, url, min(pos) FILTER (WHERE kind = 'cited') AS c, min(pos) FILTER (WHERE kind = 'retrieved') AS r FROM line_sources GROUP BY ALL),
cd AS (SELECT turn_id, platform, claim_idx, urls, p, url, CASE WHEN list_contains(urls, url) THEN 1 WHEN c IS NOT NULL THEN 2 ELSE 3 END AS priority, c, r FROM mc JOIN u USING (turn_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY turn_id, claim_idx ORDER BY priority, c IS NULL, coalesce(c, r), url) AS pos FROM cd), en AS (SELECT *, (p + pos) % 3 = 0 AS entailed FROM rk),
fr AS (SELECT *, min(CASE WHEN entailed THEN pos END) OVER (PARTITION BY turn_id, claim_idx) AS first FROM en),
ab AS (SELECT platform, turn_id, claim_idx, any_value(urls) AS urls, CASE min(CASE WHEN pos = first THEN priority END) WHEN 1 THEN 'Marker-cited' WHEN 2 THEN 'Other cited' WHEN 3 THEN 'Retrieved Sources' ELSE 'Unexplained' END AS bucket, min(CASE WHEN pos = first THEN url END) AS entailed_url,
  count(*) FILTER (WHERE priority = 1 OR first IS NULL OR pos <= first) AS checked FROM fr GROUP BY ALL)"""


def _cascade(spark, d):
    c = _marked_claims(spark, d)
    cand = R.url_candidates(c, line_sources(spark, d), ["turn_id"])
    checks = cand.join(c.select("turn_id", "claim_idx", "platform", "p"), ["turn_id", "claim_idx"]).withColumn("entailed", (F.col("p") + F.col("pos")) % 3 == 0)
    return C.attribution(checks, ["platform", "turn_id", "claim_idx"]).join(c.select("turn_id", "claim_idx", "urls"), ["turn_id", "claim_idx"])


@query("replay_attribution", f"WITH {CASCADE} SELECT turn_id, claim_idx, bucket, entailed_url, checked FROM ab", ("line_sources",))
def replay_attribution(spark, d):
    """Candidates by url and the attribution cascade of replayed answers."""
    return _cascade(spark, d).select("turn_id", "claim_idx", "bucket", "entailed_url", "checked")


@query("replay_alignment", f"""WITH {CASCADE}, z AS (SELECT *, len(urls) > 0 AS gold, len(urls) > 0 AND coalesce(list_contains(urls, entailed_url), false) AS same FROM ab)
SELECT platform, count(*) FILTER (WHERE gold) AS marked, count(*) FILTER (WHERE gold AND bucket = 'Marker-cited') AS associated, count(*) FILTER (WHERE same) AS same_url, count(*) FILTER (WHERE same AND bucket = 'Marker-cited') AS associated_same_url,
  count(*) FILTER (WHERE bucket = 'Unexplained') AS parametric, count(*) FILTER (WHERE bucket = 'Unexplained' AND NOT gold) AS parametric_unmarked,
  """ + ", ".join(f"count(*) FILTER (WHERE {g} AND bucket = '{b}') AS {n}_{i}" for g, n in (("gold", "marked"), ("NOT gold", "unmarked")) for i, b in enumerate(C.BUCKETS, 1)) + """,
  coalesce(associated / nullif(marked, 0), 0) AS associated_rate, coalesce(same_url / nullif(marked, 0), 0) AS same_url_rate, coalesce(associated_same_url / nullif(marked, 0), 0) AS associated_same_url_rate, coalesce(parametric_unmarked / nullif(parametric, 0), 0) AS parametric_unmarked_rate
FROM z GROUP BY platform""", ("line_sources",))
def replay_alignment(spark, d):
    """How the buckets agree with the answers' own marks."""
    return R.alignment(_cascade(spark, d), ["platform"])


@query("latest_claims", f"""WITH {MARKED}, y AS (SELECT turn_id, claim_idx, (claim_idx // 2) % 3 AS k FROM mc), z AS (SELECT *, lead(k) OVER (PARTITION BY turn_id ORDER BY claim_idx) AS nxt FROM y)
SELECT turn_id, claim_idx, 'u' || k AS url FROM z WHERE k > 0 AND k IS DISTINCT FROM nxt""", ("line_sources",))
def latest_claims(spark, d):
    """Of consecutive claims with the same urls the last."""
    k = F.floor(F.col("claim_idx") / 2) % 3
    c = _marked_claims(spark, d).select("turn_id", "claim_idx", F.when(k > 0, F.array(F.concat(F.lit("u"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("urls"))
    return R.latest_claims(c, ["turn_id"]).select("turn_id", "claim_idx", F.col("urls")[0].alias("url"))


@query("span_claims", """WITH a AS (SELECT l_orderkey, l_linenumber AS claim_idx, min(l_partkey % 900) AS s, min(l_partkey % 900) + CAST(min(l_quantity) AS BIGINT) * 20 AS e FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_suppkey::VARCHAR AS url, l_partkey % 700 AS s, l_partkey % 700 + 40 AS e FROM lineitem),
m AS (SELECT l_orderkey, claim_idx, b.url, a.e AS ae, b.s AS bs, b.e AS be FROM a JOIN b USING (l_orderkey) WHERE greatest(a.s, b.s) < least(a.e, b.e)), f AS (SELECT l_orderkey, arg_max(claim_idx, ae * 100 - claim_idx) AS claim_idx, url, bs, be FROM m GROUP BY l_orderkey, url, bs, be),
x AS (SELECT l_orderkey, claim_idx, string_agg(DISTINCT url, '|' ORDER BY url) AS urls FROM m GROUP BY ALL), y AS (SELECT l_orderkey, claim_idx, string_agg(DISTINCT url, '|' ORDER BY url) AS urls FROM f GROUP BY ALL)
SELECT a.l_orderkey, a.claim_idx, coalesce(x.urls, '') AS every, coalesce(y.urls, '') AS latest FROM a LEFT JOIN x USING (l_orderkey, claim_idx) LEFT JOIN y USING (l_orderkey, claim_idx)""")
def span_claims(spark, d):
    """Urls of cited spans at the claims they overlap, all of them or the one that ends last."""
    li = table(spark, d, "lineitem")
    start = F.min(F.col("l_partkey") % 900)
    claims = li.groupBy("l_orderkey", F.col("l_linenumber").alias("claim_idx")).agg(start.alias("start"), (start + F.min("l_quantity").cast("long") * 20).alias("end"))
    cites = li.select("l_orderkey", F.col("l_suppkey").cast("string").alias("url"), (F.col("l_partkey") % 700).alias("start"), (F.col("l_partkey") % 700 + 40).alias("end"))
    listed = lambda mode, n: R.span_claims(claims, cites, ["l_orderkey"], mode).select("l_orderkey", "claim_idx", F.array_join(F.array_sort("urls"), "|").alias(n))
    return listed("all", "every").join(listed("latest", "latest"), ["l_orderkey", "claim_idx"])
