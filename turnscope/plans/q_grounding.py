"""Queries on query formulation and grounding, over events as rounds and order lines as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import stats, text, urls
from turnscope.operators import formulation as M
from turnscope.operators import grounding as G

from .views import chat_turns, line_sources, rounds, site_pages, table, with_views

Q, S = {}, {}
TURN = ["turn_user", "turn_day"]


def query(name, sql=None, views=()):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = with_views(sql, *views) if views else sql.strip()
        return f

    return add


PER_TURN = """p AS (SELECT turn_user, turn_day, month, round, count(*) AS n FROM rounds GROUP BY ALL),
t AS (SELECT turn_user, turn_day, month, count(*) AS n_hops, max(n) AS widest, CAST(sum(n) AS BIGINT) AS queries FROM p GROUP BY ALL)"""


@query("query_counts", f"WITH {PER_TURN} SELECT turn_user, turn_day, month, n_hops, widest, queries, queries AS counted FROM t", ("rounds",))
def query_counts(spark, d):
    """Rounds, fan-out and queries of each turn; counted again from the cleaned groups with blanks among them (Q5, Q6)."""
    from turnscope.functions import values

    r = rounds(spark, d)
    groups = r.groupBy(*TURN, "round").agg(F.collect_list("query").alias("qs")).groupBy(*TURN).agg(F.collect_list(F.concat(F.array(F.lit(" ")), "qs")).alias("groups"))
    clean = values.clean_groups(F.concat("groups", F.array(F.array(F.lit(""), F.lit("  ")))))
    counts = groups.select(*TURN, F.size(clean).cast("long").alias("n_hops"), F.array_max(F.transform(clean, lambda g: F.size(g))).cast("long").alias("widest"), values.query_count(F.col("groups")).alias("counted"))
    return M.per_turn(r, [*TURN, "month"]).select(*TURN, "month", "queries").join(counts, TURN).select(*TURN, "month", "n_hops", "widest", "queries", "counted")


@query("hops_by_fanout", f"""WITH {PER_TURN}, b AS (SELECT CASE WHEN n_hops >= 3 THEN '3+' ELSE n_hops::VARCHAR END AS hops, CASE WHEN widest >= 3 THEN '3+' ELSE widest::VARCHAR END AS fanout FROM t),
g AS (SELECT hops, fanout, count(*) AS n FROM b GROUP BY ALL)
SELECT h.x AS hops, f.x AS fanout, coalesce(n, 0) AS n, 100.0::DOUBLE * coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS pct
FROM (VALUES ('1'), ('2'), ('3+')) h(x) CROSS JOIN (VALUES ('1'), ('2'), ('3+')) f(x) LEFT JOIN g ON hops = h.x AND fanout = f.x""", ("rounds",))
def hops_by_fanout(spark, d):
    """A11."""
    return M.hops_by_fanout(M.per_turn(rounds(spark, d), TURN))


@query("loops_over_time", f"WITH {PER_TURN} SELECT month, count(*) AS turns, avg(n_hops) AS mean_hops, avg(widest) AS mean_widest, avg(queries) AS mean_queries FROM t GROUP BY month", ("rounds",))
def loops_over_time(spark, d):
    """A12, A13."""
    return M.over_time(M.per_turn(rounds(spark, d), [*TURN, "month"]))


TERMS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"


@query("term_metrics", f"SELECT turn_no, count(*) AS n, avg({TERMS.format('user_text')}) AS mean_terms, median({TERMS.format('user_text')})::DOUBLE AS median_terms FROM chat_turns GROUP BY turn_no", ("chat_turns",))
def term_metrics(spark, d):
    """Terms of prompts."""
    return M.term_metrics(chat_turns(spark, d).withColumn("terms", text.term_count(F.col("user_text"))), ["turn_no"])


@query("term_ecdf", f"SELECT turn_no, conv_id, {TERMS.format('user_text')} AS terms, row_number() OVER (PARTITION BY turn_no ORDER BY {TERMS.format('user_text')}, conv_id) / count(*) OVER (PARTITION BY turn_no) AS ecdf FROM chat_turns", ("chat_turns",))
def term_ecdf(spark, d):
    """Distribution function i/n."""
    t = chat_turns(spark, d).select("turn_no", "conv_id", text.term_count(F.col("user_text")).alias("terms"))
    return stats.ecdf(t, "terms", ["turn_no"], ["conv_id"])


@query("retrieved_per_query", """WITH c AS (SELECT platform, turn_id, count(*) FILTER (WHERE kind = 'retrieved') AS retrieved, turn_id % 4 AS queries FROM line_sources GROUP BY platform, turn_id)
SELECT platform, CAST(sum(queries) AS BIGINT) AS queries, sum(retrieved) / sum(queries) AS retrieved_per_query FROM c WHERE queries > 0 GROUP BY platform""", ("line_sources",))
def retrieved_per_query(spark, d):
    """Retrieved per query, weighted by queries."""
    c = G.per_turn_counts(line_sources(spark, d), ["platform", "turn_id"]).withColumn("queries", F.col("turn_id") % 4)
    return M.retrieved_per_query(c, ["platform"])


LANG = """u AS (SELECT user_id AS sample, 'user' AS kind, event_id::VARCHAR AS text_id, event_type AS lang FROM events WHERE event_id % 3 = 0),
q AS (SELECT user_id AS sample, 'query' AS kind, concat_ws('.', event_id, 1) AS text_id, event_type AS lang FROM events WHERE event_id % 3 <> 0), r AS (SELECT * FROM u UNION ALL SELECT * FROM q)"""


def _lang_rows(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("event_id").alias("i"), F.lit(1).alias("j"), F.col("event_type").alias("lang"))
    return M.language_rows(e.filter("i % 3 = 0"), e.filter("i % 3 <> 0"))


@query("language_rows", f"WITH {LANG} SELECT * FROM r")
def language_rows(spark, d):
    """Every third event is a prompt, the others are queries."""
    return _lang_rows(spark, d)


@query("language_diversity", f"WITH {LANG}, n AS (SELECT kind, sample, count(DISTINCT lang) AS n FROM r GROUP BY ALL) SELECT kind, CASE WHEN n >= 4 THEN '4+' ELSE n::VARCHAR END AS languages, count(*) AS samples FROM n GROUP BY ALL")
def language_diversity(spark, d):
    """A18."""
    return M.language_diversity(_lang_rows(spark, d))


@query("language_pairs", f"""WITH {LANG}, g AS (SELECT kind, sample, lang, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY kind, sample ORDER BY n DESC, lang) = 1),
p AS (SELECT a.lang AS user_lang, b.lang AS query_lang, count(*) AS n FROM m a JOIN m b USING (sample) WHERE a.kind = 'user' AND b.kind = 'query' GROUP BY ALL)
SELECT *, 100.0::DOUBLE * n / (SELECT sum(n) FROM p) AS pct FROM p ORDER BY n DESC, user_lang, query_lang LIMIT 10""")
def language_pairs(spark, d):
    """Top pairs (a top-k report)."""
    return M.language_pairs(_lang_rows(spark, d), 10)


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


PROVENANCE = f"""y AS (SELECT conv_id, string_agg(text, ' ') AS memory FROM conversations WHERE role = 'system' GROUP BY conv_id),
h AS (SELECT conv_id, turn_no, user_text, lag(user_text) OVER w AS prompt, coalesce(lag(assistant_text) OVER w, '') AS history, coalesce(assistant_text, '') AS sources, coalesce(memory, '') AS memory FROM chat_turns LEFT JOIN y USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)),
k AS (SELECT conv_id, turn_no, unnest(list_distinct({TOKENS.format('user_text')})) AS token, {TOKENS.format("coalesce(prompt, '')")} AS p, {TOKENS.format('history')} AS h, {TOKENS.format('memory')} AS y, {TOKENS.format('sources')} AS s FROM h),
o AS (SELECT conv_id, turn_no, CASE WHEN list_contains(p, token) THEN 'prompt' WHEN list_contains(h, token) THEN 'history' WHEN list_contains(y, token) THEN 'memory' WHEN list_contains(s, token) THEN 'source' ELSE 'parametric' END AS origin FROM k),
n AS (SELECT conv_id, turn_no, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE origin = '{x}') AS {x}" for x in ("prompt", "history", "memory", "source", "parametric"))} FROM o GROUP BY conv_id, turn_no)"""


@query("token_provenance", f"WITH {PROVENANCE} SELECT conv_id, turn_no, prompt, history, memory, source, parametric FROM n", ("chat_turns",))
def token_provenance(spark, d):
    """The user's next message stands for the query, the answer to it for its sources, system messages for memories."""
    return M.provenance_sets(_provenance_tokens(spark, d), ["conv_id", "turn_no"])


def _provenance_tokens(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn_no")
    said = table(spark, d, "conversations").filter("role = 'system'").groupBy("conv_id").agg(F.array_join(F.collect_list("text"), " ").alias("memory"))
    t = chat_turns(spark, d).select("conv_id", "turn_no", "user_text", F.lag("user_text").over(w).alias("prompt"), F.lag("assistant_text").over(w).alias("history"), "assistant_text").join(said, "conv_id", "left")
    words = lambda c: text.word_tokens(F.coalesce(F.col(c), F.lit("")))
    return M.token_origins(t, ["conv_id", "turn_no"], words("user_text"), words("prompt"), words("history"), words("memory"), words("assistant_text"))


@query("provenance_rates", f"WITH {PROVENANCE} SELECT turn_no, count(*) AS turns, round(avg((prompt + history) / total), 9) AS context, round(avg((parametric + memory) / total), 9) AS own, round(avg(source / total), 9) AS source_share FROM n GROUP BY turn_no", ("chat_turns",))
def provenance_rates(spark, d):
    """A20."""
    return M.provenance_rates(_provenance_tokens(spark, d), ["conv_id"], ["turn_no"])


@query("specificity_distribution", """
WITH s AS (SELECT CASE WHEN round >= 3 THEN '3+' ELSE round::VARCHAR END AS stage, event_type AS dimension, 1 + k % 5 AS score FROM rounds),
g AS (SELECT stage, dimension, score, count(*) AS n FROM s GROUP BY ALL),
f AS (SELECT a.x AS stage, b.x AS dimension, c.x AS score, coalesce(n, 0) AS n FROM (VALUES ('1'), ('2'), ('3+')) a(x) CROSS JOIN (SELECT DISTINCT event_type AS x FROM events) b CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS x) c
  LEFT JOIN g ON stage = a.x AND dimension = b.x AND score = c.x)
SELECT stage, dimension, score::BIGINT AS score, n, CAST(sum(n) OVER w AS BIGINT) AS total, CASE WHEN sum(n) OVER w = 0 THEN 0 ELSE n / sum(n) OVER w END AS rate FROM f WINDOW w AS (PARTITION BY stage, dimension)""", ("rounds",))
def specificity_distribution(spark, d):
    """A21."""
    from turnscope.functions.values import bucket

    s = rounds(spark, d).select(bucket(F.col("round"), 3).alias("stage"), F.col("event_type").alias("dimension"), (1 + F.col("k") % 5).alias("score"))
    dims = [r[0] for r in table(spark, d, "events").select("event_type").distinct().collect()]  # five of them
    return M.score_distribution(s, dims, ["1", "2", "3+"])


@query("specificity_direction", """
WITH s AS (SELECT turn_user, turn_day, round, event_type AS dim, max(1 + k % 5) AS score FROM rounds GROUP BY ALL),
p AS (SELECT a.turn_user, a.turn_day, b.dim, b.score - a.score AS delta FROM s a JOIN s b ON a.turn_user = b.turn_user AND a.turn_day = b.turn_day AND a.dim = b.dim AND a.round = 1 AND b.round = 2),
o AS (SELECT turn_user, turn_day, CASE WHEN max(delta) > 0 THEN 1 WHEN max(delta) = 0 AND min(delta) = 0 THEN 0 ELSE -1 END AS direction FROM p GROUP BY ALL)
SELECT 'overall' AS dimension, direction, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT dim, CASE WHEN delta > 0 THEN 1 ELSE 0 END, count(*) FROM p GROUP BY ALL""", ("rounds",))
def specificity_direction(spark, d):
    """Of the first to the second round, overall and by dimension."""
    s = rounds(spark, d).groupBy(*TURN, "round", F.col("event_type").alias("dim")).agg(F.max(1 + F.col("k") % 5).alias("score"))
    maps = s.filter("round <= 2").groupBy(*TURN).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("round") == r, F.struct("dim", "score")))).alias(n) for r, n in ((1, "a"), (2, "b"))]).filter("size(a) > 0 and size(b) > 0")
    whole = maps.select(F.lit("overall").alias("dimension"), M.direction(F.col("a"), F.col("b")).alias("direction")).filter("direction is not null")
    dims = maps.select(F.explode("a").alias("dimension", "u"), "b").select("dimension", M.dimension_direction(F.col("u"), F.try_element_at("b", F.col("dimension"))).alias("direction")).filter("direction is not null")
    return whole.unionByName(dims).groupBy("dimension", "direction").agg(F.count("*").alias("n"))


# --- sources -------------------------------------------------------------------------------

COUNTS = "c AS (SELECT platform, month, model, conv_id, turn_id, count(*) FILTER (WHERE kind = 'retrieved') AS retrieved, count(*) FILTER (WHERE kind = 'cited') AS cited FROM line_sources GROUP BY ALL)"
EXT_TURN = "x AS (SELECT s.*, EXISTS (SELECT 1 FROM line_sources r WHERE r.kind = 'retrieved' AND r.conv_id = s.conv_id AND r.turn_id = s.turn_id AND r.domain = s.domain) AS external FROM line_sources s WHERE kind = 'cited')"
EXT_CONV = "f AS (SELECT conv_id, domain, min(turn_id) AS first FROM line_sources WHERE kind = 'retrieved' GROUP BY ALL), x AS (SELECT s.*, coalesce(f.first <= s.turn_id, false) AS external FROM line_sources s LEFT JOIN f USING (conv_id, domain) WHERE kind = 'cited')"


@query("source_counts", "SELECT platform, turn_id, count(*) FILTER (WHERE kind = 'retrieved') AS retrieved, count(*) FILTER (WHERE kind = 'cited') AS cited FROM line_sources GROUP BY ALL", ("line_sources",))
def source_counts(spark, d):
    """A24, raw."""
    return G.per_turn_counts(line_sources(spark, d), ["platform", "turn_id"])


@query("unique_source_counts", "SELECT conv_id, count(DISTINCT CASE WHEN kind = 'retrieved' THEN url END) AS retrieved, count(DISTINCT CASE WHEN kind = 'cited' THEN url END) AS cited FROM line_sources GROUP BY ALL", ("line_sources",))
def unique_source_counts(spark, d):
    """A24, distinct."""
    return G.per_turn_counts(line_sources(spark, d), ["conv_id"], unique=True)


@query("responses_with_sources", f"WITH {COUNTS} SELECT platform, count(*) AS responses, count(*) FILTER (WHERE retrieved > 0) AS with_retrieved, count(*) FILTER (WHERE cited > 0) AS with_cited, count(*) FILTER (WHERE retrieved > 0 AND cited > 0) AS with_both FROM c GROUP BY platform", ("line_sources",))
def responses_with_sources(spark, d):
    """A25."""
    return G.with_any(G.per_turn_counts(line_sources(spark, d), ["platform", "turn_id"]), ["platform"])


@query("grounding_turn", f"WITH {EXT_TURN} SELECT turn_id, pos, domain, external FROM x", ("line_sources",))
def grounding_turn(spark, d):
    """A26 within a turn."""
    return G.grounding(line_sources(spark, d), "turn").select("turn_id", "pos", "domain", "external")


@query("grounding_conversation", f"WITH {EXT_CONV} SELECT turn_id, pos, domain, external FROM x", ("line_sources",))
def grounding_conversation(spark, d):
    """A26 up to the turn in the conversation."""
    return G.grounding(line_sources(spark, d), "conversation").select("turn_id", "pos", "domain", "external")


@query("grounding_supplier", "WITH f AS (SELECT conv_id, domain, min(turn_id) AS first FROM line_sources_supp WHERE kind = 'retrieved' GROUP BY ALL) SELECT platform, count(*) FILTER (WHERE coalesce(first <= turn_id, false)) AS external, count(*) AS total FROM line_sources_supp LEFT JOIN f USING (conv_id, domain) WHERE kind = 'cited' GROUP BY platform", ("line_sources_supp",))
def grounding_supplier(spark, d):
    """A26 with suppliers as domains."""
    return G.grounding(line_sources(spark, d, "supplier"), "conversation").groupBy("platform").agg(F.count_if("external").alias("external"), F.count("*").alias("total"))


def _rates(by, ext):
    cols = ", ".join(by)
    return f"""WITH {COUNTS}, {ext}, g AS (SELECT {cols}, count(*) FILTER (WHERE external) AS external, count(*) FILTER (WHERE NOT external) AS internal FROM x GROUP BY ALL),
m AS (SELECT {cols}, CAST(sum(retrieved) AS BIGINT) AS retrieved, CAST(sum(cited) AS BIGINT) AS cited FROM c GROUP BY ALL)
SELECT {cols}, retrieved, cited, coalesce(external, 0) AS external, coalesce(internal, 0) AS internal, external / nullif(retrieved, 0) AS external_per_retrieved, external / nullif(cited, 0) AS external_per_cited FROM m LEFT JOIN g USING ({cols})"""


@query("grounding_rates", _rates(["platform"], EXT_TURN), ("line_sources",))
def grounding_rates(spark, d):
    """Ratios of sums."""
    return G.grounding_rates(line_sources(spark, d), ["platform"])


@query("grounding_rates_by_model", _rates(["platform", "model"], EXT_CONV), ("line_sources",))
def grounding_rates_by_model(spark, d):
    """A27 by model, conversation level."""
    return G.grounding_rates(line_sources(spark, d), ["platform", "model"], "conversation")


def _over_time(ext):
    return f"""WITH {COUNTS}, {ext}, e AS (SELECT conv_id, turn_id, count(*) FILTER (WHERE external) AS cited_retrieved FROM x GROUP BY ALL), j AS (SELECT c.*, coalesce(e.cited_retrieved, 0) AS cited_retrieved FROM c LEFT JOIN e USING (conv_id, turn_id))
SELECT month, count(*) AS turns, avg(retrieved) AS mean_retrieved, avg(cited) AS mean_cited, avg(cited_retrieved) AS mean_cited_retrieved, CAST(sum(retrieved) AS BIGINT) AS retrieved, CAST(sum(cited) AS BIGINT) AS cited, CAST(sum(cited_retrieved) AS BIGINT) AS cited_retrieved,
  round(avg(CASE WHEN retrieved > 0 THEN cited_retrieved / retrieved ELSE 0 END), 9) AS citation_rate, round(avg(CASE WHEN cited > 0 THEN cited_retrieved / cited ELSE 0 END), 9) AS grounding_rate FROM j GROUP BY month"""


@query("sources_over_time", _over_time(EXT_TURN), ("line_sources",))
def sources_over_time(spark, d):
    """Means of ratios, within the turn."""
    return G.mean_of_ratios(line_sources(spark, d), ["month"])


@query("sources_over_time_conversation", _over_time(EXT_CONV), ("line_sources",))
def sources_over_time_conversation(spark, d):
    """Means of ratios, up to the turn in the conversation."""
    return G.mean_of_ratios(line_sources(spark, d), ["month"], "conversation")


@query("top_domains", """WITH b AS (SELECT conv_id, turn_id FROM line_sources GROUP BY ALL HAVING count(*) FILTER (WHERE kind = 'retrieved') > 0 AND count(*) FILTER (WHERE kind = 'cited') > 0),
g AS (SELECT kind, lower(domain) AS domain, count(*) AS n FROM line_sources SEMI JOIN b USING (conv_id, turn_id) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, domain) AS position FROM g QUALIFY position <= 10""", ("line_sources",))
def top_domains(spark, d):
    """A top-k report."""
    return G.top_domains(line_sources(spark, d), 10)


@query("cited_domain_split", f"WITH {EXT_TURN} SELECT domain, count(*) FILTER (WHERE external) AS external, count(*) AS total, count(*) FILTER (WHERE NOT external) AS internal FROM x GROUP BY domain", ("line_sources",))
def cited_domain_split(spark, d):
    """A30 by domain."""
    return G.cited_domain_split(line_sources(spark, d))


@query("cited_url_split", "WITH f AS (SELECT DISTINCT conv_id, turn_id, url FROM line_sources WHERE kind = 'retrieved') SELECT domain, count(f.url) AS external, count(*) AS total, count(*) - count(f.url) AS internal FROM line_sources s LEFT JOIN f USING (conv_id, turn_id, url) WHERE s.kind = 'cited' GROUP BY domain", ("line_sources",))
def cited_url_split(spark, d):
    """A30 by exact url."""
    return G.cited_domain_split(line_sources(spark, d), match="url")


@query("unique_domains", "WITH g AS (SELECT platform, domain, count(*) AS n FROM site_pages GROUP BY ALL) SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY domain) = 1", ("site_pages",))
def unique_domains(spark, d):
    """One platform against the rest (site language as platform)."""
    return G.unique_domains(site_pages(spark, d))


@query("unique_top_domains", "WITH g AS (SELECT platform, domain, count(*) AS n FROM site_pages GROUP BY ALL), t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY platform ORDER BY n DESC, domain) <= 20) SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY domain) = 1", ("site_pages",))
def unique_top_domains(spark, d):
    """A31 among each platform's top 20."""
    return G.unique_domains(site_pages(spark, d), 20)


@query("pairwise_unique_domains", "WITH d AS (SELECT DISTINCT platform, domain FROM site_pages), n AS (SELECT DISTINCT platform FROM d) SELECT a.platform, b.platform AS other, (SELECT count(*) FROM d x WHERE x.platform = a.platform AND x.domain NOT IN (SELECT domain FROM d y WHERE y.platform = b.platform)) AS only_first FROM n a JOIN n b ON a.platform <> b.platform", ("site_pages",))
def pairwise_unique_domains(spark, d):
    """A31 pairwise."""
    return G.pairwise_unique_domains(site_pages(spark, d))


@query("monthly_source_counts", f"""WITH {EXT_TURN}, c AS (SELECT month, conv_id, turn_id, count(DISTINCT CASE WHEN kind = 'retrieved' THEN url END) AS retrieved, count(DISTINCT CASE WHEN kind = 'cited' THEN url END) AS cited FROM line_sources GROUP BY ALL),
e AS (SELECT conv_id, turn_id, count(DISTINCT CASE WHEN external THEN url END) AS external, count(DISTINCT CASE WHEN NOT external THEN url END) AS internal FROM x GROUP BY ALL), j AS (SELECT c.*, coalesce(external, 0) AS external, coalesce(internal, 0) AS internal FROM c LEFT JOIN e USING (conv_id, turn_id))
SELECT month, count(*) AS n, """ + ", ".join(f"avg({c}) AS {c}_mean, round(stddev_samp({c}) / sqrt(count({c})), 9) AS {c}_sem" for c in ("retrieved", "cited", "external", "internal")) + " FROM j GROUP BY month", ("line_sources",))
def monthly_source_counts(spark, d):
    """Mean and standard error."""
    return G.monthly_counts(line_sources(spark, d), ["month"])


@query("retrieved_by_month_model", f"WITH {COUNTS}, o AS (SELECT model, row_number() OVER (ORDER BY count(*) DESC, model) AS model_order FROM c GROUP BY model) SELECT month, model, count(*) AS n, avg(retrieved) AS mean, round(stddev_samp(retrieved) / sqrt(count(*)), 9) AS sem, any_value(model_order) AS model_order FROM c JOIN o USING (model) GROUP BY month, model", ("line_sources",))
def retrieved_by_month_model(spark, d):
    """A33."""
    return G.monthly_by_model(line_sources(spark, d))


@query("rank_scatter", "SELECT kind, pos, l_suppkey % 50 AS rank, count(*) AS n FROM line_sources GROUP BY ALL", ("line_sources",))
def rank_scatter(spark, d):
    """A34."""
    return G.rank_scatter(line_sources(spark, d).withColumn("rank", F.col("l_suppkey") % 50), "kind", "pos", "rank")


RANKS = "k AS (SELECT p_brand AS domain, min(p_size) AS rank FROM part WHERE p_size > 2 AND p_brand <> 'Brand#11' GROUP BY p_brand)"


def _ranks(spark, d):
    return table(spark, d, "part").filter("p_size > 2 and p_brand <> 'Brand#11'").select(F.col("p_brand").alias("domain"), F.col("p_size").alias("rank"))


@query("popularity_ranks", f"WITH {RANKS} SELECT s.domain, coalesce(rank, -1) AS rank, count(*) AS n FROM line_sources s LEFT JOIN k USING (domain) GROUP BY ALL", ("line_sources",))
def popularity_ranks(spark, d):
    """Best rank per domain, -1 without one."""
    return G.with_rank(line_sources(spark, d), _ranks(spark, d)).groupBy("domain", "rank").agg(F.count("*").alias("n"))


@query("mean_ranks", f"""WITH {RANKS}, {EXT_CONV}, y AS (SELECT platform, conv_id, turn_id, domain, 'retrieved' AS series FROM line_sources WHERE kind = 'retrieved' UNION ALL SELECT platform, conv_id, turn_id, domain, CASE WHEN external THEN 'external' ELSE 'internal' END FROM x),
q AS (SELECT platform, series, conv_id, turn_id, avg(rank) AS r FROM y JOIN k USING (domain) GROUP BY ALL)
SELECT platform, series, count(*) AS responses, round(avg(r), 6) AS mean_rank, round(min(r), 6) AS min_rank, round(max(r), 6) AS max_rank FROM q GROUP BY ALL""", ("line_sources",))
def mean_ranks(spark, d):
    """Popularity ranks of retrieved sources and of citations that were, and weren't, retrieved."""
    return G.mean_ranks(line_sources(spark, d), _ranks(spark, d), ["platform"])


@query("source_types_long", "SELECT turn_id, kind AS source_type, url, (row_number() OVER (PARTITION BY turn_id, kind ORDER BY pos, url) - 1)::INT AS pos FROM line_sources", ("line_sources",))
def source_types_long(spark, d):
    """A turn's lists of sources as one row per source."""
    from turnscope.operators import citations

    s = line_sources(spark, d)
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "url")))), lambda e: F.struct(e["url"].alias("url")))
    t = s.groupBy("turn_id").agg(listed("retrieved").alias("srcs_retrieved"), listed("safe").alias("srcs_safe_urls"), listed("cited").alias("srcs_cited"))
    return citations.long_sources(t, ["turn_id"]).select("turn_id", F.col("kind").alias("source_type"), "url", "pos")


@query("exclusive_source_types", "WITH s AS (SELECT conv_id, url, kind, CASE kind WHEN 'cited' THEN 1 ELSE 3 END AS p FROM line_sources), t AS (SELECT * FROM s QUALIFY p = min(p) OVER (PARTITION BY conv_id, url)) SELECT kind, count(*) AS n, count(DISTINCT url) AS urls FROM t GROUP BY kind", ("line_sources",))
def exclusive_source_types(spark, d):
    """A39."""
    return G.exclusive_types(line_sources(spark, d), ["conv_id"]).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("label_rates", "SELECT platform, kind, count(*) AS n, avg((l_linestatus = 'O')::INT) AS O_rate, avg((l_linestatus = 'F')::INT) AS F_rate FROM line_sources GROUP BY ALL", ("line_sources",))
def label_rates(spark, d):
    """A40."""
    return G.label_rates(line_sources(spark, d), ["platform", "kind"], "l_linestatus", ["O", "F"])


# --- urls and pages ------------------------------------------------------------------------


@query("page_domains", r"SELECT page_id, domain, platform, regexp_replace(regexp_replace(url, '\?utm_source=(chatgpt\.com|openai)$', ''), '/+$', '') AS match_key FROM site_pages", ("site_pages",))
def page_domains(spark, d):
    """F2, F3, F4."""
    return site_pages(spark, d).select("page_id", "domain", "platform", urls.match_key(F.col("url")).alias("match_key"))


@query("normalized_urls", r"""
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN contains(url, '?') THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END || CASE WHEN contains(url, '#') THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END AS url FROM pages""")
def normalized_urls(spark, d):
    """F1."""
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query("page_flags", r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://EN.wikipedia.org:443/wiki/P' || page_id || '?a=b#c' WHEN 1 THEN 'https://user@wikipedia.org/w/x.PNG?q' WHEN 2 THEN 'https://notwikipedia.org/wiki/P.jpeg' ELSE url END AS u, url, page_id % 4 AS k FROM pages)
SELECT page_id, k IN (1, 2) OR (k = 3 AND regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\.(jpg|jpeg|png|gif|webp|svg|bmp|ico|avif)$')) AS image, k < 2 AS wikipedia, CASE WHEN k = 0 THEN 'https://EN.wikipedia.org:443/w/index.php?title=P' || page_id || '&action=history' END AS history FROM p""")
def page_flags(spark, d):
    """Images, wikipedia and its revision lists, on urls made for three of four pages."""
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.concat(F.lit("https://EN.wikipedia.org:443/wiki/P"), F.col("page_id").cast("string"), F.lit("?a=b#c"))).when(k == 1, "https://user@wikipedia.org/w/x.PNG?q").when(k == 2, "https://notwikipedia.org/wiki/P.jpeg").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", urls.is_image(u).alias("image"), urls.is_wikipedia(u).alias("wikipedia"), urls.wikipedia_history(u).alias("history"))


@query("page_text")
def page_text(spark, d):
    """F16: visible text of every page."""
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("grounding_ci")
def grounding_ci(spark, d):
    """Cluster bootstrap of external per cited, seeded (no SQL for the generator)."""
    g = G.grounding(line_sources(spark, d), "conversation").groupBy("platform", "conv_id").agg(F.count_if("external").alias("p"), F.count("*").alias("q"))
    return stats.exact_ratio_ci(g, ["platform"], "conv_id", "p", "q", n_bootstrap=10_000)


@query("grounding_ci_poisson")
def grounding_ci_poisson(spark, d):
    """The same at any size: Poisson bootstrap from hashes."""
    g = G.grounding(line_sources(spark, d), "conversation").groupBy("platform", "conv_id").agg(F.count_if("external").alias("p"), F.count("*").alias("q"))
    return stats.poisson_ratio_ci(g, ["platform"], "conv_id", "p", "q")
