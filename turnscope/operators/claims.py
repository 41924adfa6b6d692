"""Claims of responses: chunks, candidate sources, attribution, factuality.

claims: one row per claim, with the keys of its turn and claim_idx. checks: one row per claim and
candidate source with priority (1 marker-cited, 2 other cited, 3 retrieved), pos and entailed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions import text

#: Names of the buckets by priority, as the summaries list them.
BUCKETS = ("Marker-cited", "Other cited", "Retrieved Sources", "Unexplained")
SUMMARY_NAMES = {"Retrieved Sources": "Search Results"}


def sentence_chunks(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per sentence, numbered from 0."""
    return docs.select(*keys, F.posexplode(text.sentences(F.col(text_col))).alias("chunk_idx", "chunk"))


def marker_chunks(docs: DataFrame, keys: list[str], text_col: str, mode: str = "all", joined: bool = False) -> DataFrame:
    """Sentences with the references of the marker that follows them: keys, chunk_idx, sentence, citation_refs.

    mode all: every sentence before a marker has its references, a marker without a new sentence adds its references to the row before,
    what follows the last marker has none. mode latest: the last sentence before each marker only; if the next
    marker has the same references, the later sentence takes the place of the earlier. A text without markers is its sentences.
    joined (mode all): the sentences before a marker with references are one row.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(t, text.MARKER, -1)
    markers = F.regexp_extract_all(t, F.lit("(" + text.MARKER + ")"), F.lit(1))
    pairs = F.transform(parts, lambda p, i: F.struct(text.sentences(p).alias("ss"), F.when(i < F.size(markers), text.citation_refs(F.try_element_at(markers, i + 1))).alias("refs")))
    refs_type = "array<struct<turn_index:int,ref_index:int>>"
    empty = F.array().cast(refs_type)
    if mode == "all":
        zero = F.array().cast(f"array<struct<sentence:string,refs:{refs_type}>>")

        def step(rows, p):
            refs = F.coalesce(p["refs"], empty)
            ss = F.when((F.size(refs) > 0) & (F.size(p["ss"]) > 0), F.array(F.array_join(p["ss"], " "))).otherwise(p["ss"]) if joined else p["ss"]
            more = F.concat(rows, F.transform(ss, lambda s: F.struct(s.alias("sentence"), refs.alias("refs"))))
            last = F.try_element_at(rows, F.lit(-1))
            merged = F.concat(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), F.array(F.struct(last["sentence"].alias("sentence"), F.array_union(last["refs"], refs).alias("refs"))))
            return F.when((F.size(p["ss"]) == 0) & (F.size(rows) > 0) & (F.size(refs) > 0), merged).otherwise(more)

        rows = F.aggregate(pairs, zero, step)
        return docs.select(*keys, F.posexplode(rows).alias("chunk_idx", "r")).select(*keys, "chunk_idx", F.col("r.sentence").alias("sentence"), F.col("r.refs").alias("citation_refs"))
    seq = docs.select(*keys, F.posexplode(F.filter(pairs, lambda p: p["refs"].isNotNull())).alias("m", "p")).select(*keys, "m", F.try_element_at("p.ss", F.lit(-1)).alias("sentence"), F.col("p.refs").alias("citation_refs"))
    w = W.partitionBy(*keys).orderBy("m")
    seq = seq.withColumn("run", F.sum(F.coalesce((F.lag("citation_refs").over(w) != F.col("citation_refs")).cast("int"), F.lit(1))).over(w))
    kept = seq.filter((F.size("citation_refs") > 0) & F.col("sentence").isNotNull())
    last = kept.groupBy(*keys, "run").agg(F.max_by("sentence", "m").alias("sentence"), F.max_by("citation_refs", "m").alias("citation_refs"))
    idx = F.row_number().over(W.partitionBy(*keys).orderBy("run")) - 1
    return last.select(*keys, idx.alias("chunk_idx"), "sentence", "citation_refs")


def candidates(claims: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate sources of every claim in order: marker-cited, other cited, retrieved but not cited; each url once.

    claims: keys, claim_idx, refs (ref_index list). sources: keys, kind, pos, url, ref_index.
    """
    cited = sources.filter("kind = 'cited'").groupBy(*keys, "url").agg(F.min("pos").alias("pos"), F.collect_set("ref_index").alias("own_refs"))
    found = sources.filter("kind = 'retrieved'").groupBy(*keys, "url").agg(F.min("pos").alias("rpos"), F.collect_set("ref_index").alias("found_refs"))
    s = cited.join(found, [*keys, "url"], "full")
    j = claims.join(s, keys)
    cited_ = F.col("pos").isNotNull()
    direct = F.arrays_overlap(F.coalesce("own_refs", F.array().cast("array<int>")), "refs")
    by_retrieved = F.arrays_overlap(F.coalesce("found_refs", F.array().cast("array<int>")), "refs")
    priority = F.when(cited_ & (direct | by_retrieved), 1).when(cited_, 2).otherwise(3)
    order = F.struct((~F.coalesce(direct, F.lit(False))).alias("late"), F.coalesce("pos", "rpos").alias("pos"))
    j = j.withColumn("priority", priority)
    rank = F.row_number().over(W.partitionBy(*keys, "claim_idx").orderBy("priority", F.when(F.col("priority") == 1, order["late"]), order["pos"], "url"))
    return j.select(*keys, "claim_idx", "url", "priority", rank.cast("long").alias("pos"))


def attribution(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket of each claim: its first entailed candidate's, and how many the cascade looks at.

    All marker-cited candidates are looked at; the others in order up to the first entailed one, and only if none before is.
    """
    w = W.partitionBy(*keys)
    first = F.min(F.when(F.col("entailed"), F.struct("priority", "pos"))).over(w)
    c = checks.withColumn("_first", first)
    looked = (F.col("priority") == 1) | F.col("_first").isNull() | (F.struct("priority", "pos") <= F.col("_first"))
    return c.groupBy(*keys).agg(
        F.coalesce(F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), F.min("_first.priority")), F.lit(BUCKETS[3])).alias("bucket"),
        F.min(F.when(F.col("entailed"), F.struct("priority", "pos", "url")))["url"].alias("entailed_url"),
        F.count_if(looked).alias("checked"),
    )


def bucket_shares(claims: DataFrame, by: list[str], summary_names: bool = False) -> DataFrame:
    """Claims and share by bucket, the four listed for every group."""
    names = claims.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    g = claims.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    full = claims.select(*by).distinct().crossJoin(F.broadcast(names)).join(g, [*by, "bucket"], "left").na.fill({"n": 0})
    full = full.withColumn("share", F.try_divide("n", F.sum("n").over(W.partitionBy(*by))))
    if summary_names:
        for old, new in SUMMARY_NAMES.items():
            full = full.withColumn("bucket", F.when(F.col("bucket") == old, new).otherwise(F.col("bucket")))
    return full


def latest_of_runs(rows: DataFrame, keys: list[str], order: str, same: str) -> DataFrame:
    """Of consecutive rows with equal `same` within keys, the last."""
    w = W.partitionBy(*keys).orderBy(order)
    run = F.sum(F.coalesce((~F.col(same).eqNullSafe(F.lag(same).over(w))).cast("int"), F.lit(1))).over(w)
    marked = rows.withColumn("_run", run)
    last = F.row_number().over(W.partitionBy(*keys, "_run").orderBy(F.desc(order)))
    return marked.withColumn("_last", last).filter("_last = 1").drop("_run", "_last")


def score_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and median of non-null scores by bucket, absent buckets 0."""
    names = rows.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    g = rows.filter("score is not null").groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean"), F.median("score").alias("median"))
    return rows.select(*by).distinct().crossJoin(F.broadcast(names)).join(g, [*by, "bucket"], "left").na.fill({"n": 0, "mean": 0.0, "median": 0.0})


def factuality(rows: DataFrame, facts: DataFrame, keys: list[str], group: str, platform: str) -> DataFrame:
    """Share of claims and mean factuality by group, for each platform and all (platform null), by grouping sets."""
    j = rows.join(facts, keys)
    g = j.groupingSets([[platform, group], [group]], platform, group).agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(platform)))


def diagnosis(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Counts of conditions and their rates to four places."""
    counts = [F.count_if(c).alias(n) for n, c in flags.items()]
    g = rows.agg(F.count("*").alias("total"), *counts)
    return g.select("*", *[F.round(F.try_divide(F.col(n), F.col("total")), 4).alias(f"{n}_rate") for n in flags])


def aligned(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """How the labels of two runs over the same claims agree."""
    j = a.select(*keys, F.col(label).alias("first")).join(b.select(*keys, F.col(label).alias("second")), keys)
    return j.groupBy("first", "second").agg(F.count("*").alias("n"))


def usual_query(rows: DataFrame, key: str, query: str) -> DataFrame:
    """Most frequent query of each key, the longest, then the first in order, on ties."""
    g = rows.groupBy(key, query).agg(F.count("*").alias("_n"))
    w = W.partitionBy(key).orderBy(F.desc("_n"), F.desc(F.length(query)), query)
    return g.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, query)


def bucket_ranks(rows: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Count, mean, median of ranks and of their decimal logarithms."""
    v = rows.filter(F.col(rank) > 0)
    return v.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(rank), 6).alias("mean_rank"), F.median(rank).alias("median_rank"), F.round(F.avg(F.log10(rank)), 6).alias("mean_log10"), F.round(F.median(F.log10(rank)), 6).alias("median_log10"))
