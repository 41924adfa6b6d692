"""Stages of the analysis from the command line.

python -m turnscope extract --platform P --input EXPORT --output DIR [--labels FILE] [--taxonomy FILE]
python -m turnscope rounds|sources --platform P --input TURNS --output DIR
python -m turnscope decisions --input TURNS --output DIR [--since YYYY-MM-DD]
python -m turnscope grounding --input SOURCES --output DIR [--level turn|conversation]
python -m turnscope claims --input RESPONSES --output DIR
python -m turnscope links --input SOURCES --output DIR [--level turn|conversation] [--status URL_STATUS --archive URL_CLASS]
python -m turnscope replays --input RESULTS --output DIR

Inputs and outputs are Parquet paths that Spark can reach; extract reads JSON exports, replays files of results. links gives what is to be checked, and
its rates once tables of status (url, status) and archive (url, archive_class) are there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turnscope.functions import text, topics
from turnscope.operators import citations, claims, decisions, extract, grounding, replay, rounds, urlcheck
from turnscope.sources import exports, tables


def run_extract(spark, a) -> None:
    """Export to the turn table: all turns below turns/, those with a web call below web_turns/."""
    t = extract.turns(extract.messages(exports.read_export(spark, a.input, a.platform), a.platform), a.platform)
    words = topics.load_keywords(spark, a.taxonomy) if a.taxonomy else {}
    labels = None
    if a.labels:
        labels = (tables.topic_labels_csv if a.labels.endswith(".csv") else tables.topic_labels_jsonl)(spark, a.labels)
    said = F.array_join("user_msg_history", "\n")
    t = extract.with_topics(t, labels, topics.classify(said, words)).withColumn("language", text.guess_language(said))
    t = t.withColumn("web_call", F.coalesce(extract.web_call(F.col("tools"), F.col("platform")), F.lit(False))).withColumn("tool_used", F.size("tools") > 0)
    tables.write_summary(t, f"{a.output}/turns")
    done = spark.read.parquet(f"{a.output}/turns")
    tables.write_summary(done.filter("web_call"), f"{a.output}/web_turns")
    tables.write_summary(extract.summary_counters(done), f"{a.output}/counters", by=None)


def run_rounds(spark, a) -> None:
    tables.write_summary(rounds.query_rounds(spark.read.parquet(a.input).filter(F.col("platform") == a.platform), a.platform), f"{a.output}/query_rounds")


def run_sources(spark, a) -> None:
    """Responses with their sources, and the sources one a row."""
    t = citations.response_and_sources(spark.read.parquet(a.input).filter(F.col("platform") == a.platform), a.platform)
    tables.write_summary(t, f"{a.output}/responses")
    keys = ["platform", "month", "user_id", "conv_id", "turn_id"]
    long = citations.long_sources(spark.read.parquet(f"{a.output}/responses"), keys)
    tables.write_summary(long, f"{a.output}/sources")


def run_decisions(spark, a) -> None:
    t = spark.read.parquet(a.input).withColumn("month", F.date_format("month", "yyyy-MM-dd"))
    for name, df in (("monthly_rates", decisions.monthly_rates(t)), ("platform_web_rates", decisions.platform_web_rates(t, a.since)), ("topic_shares", decisions.topic_shares(t)), ("topic_web_rates", decisions.topic_web_rates(t, spark.createDataFrame([(x,) for x in topics.TAXONOMY], "topic string")))):
        tables.write_summary(df, f"{a.output}/{name}", by=None)


def run_grounding(spark, a) -> None:
    s = grounding.matchable(spark.read.parquet(a.input))
    for name, df in (("rates", grounding.grounding_rates(s, ["platform"], a.level)), ("over_time", grounding.mean_of_ratios(s, ["platform", "month"], a.level)), ("domains", grounding.cited_domain_split(s, a.level)), ("top_domains", grounding.top_domains(s, 20))):
        tables.write_summary(df, f"{a.output}/{name}", by=None)


def run_claims(spark, a) -> None:
    """Responses to claims by citation marker, and the candidate sources of each."""
    keys = ["platform", "user_id", "conv_id", "turn_id"]
    t = spark.read.parquet(a.input)
    tables.write_summary(claims.marker_chunks(t, keys, "assistant_response").withColumnRenamed("chunk_idx", "claim_idx"), f"{a.output}/claims", by=None)
    refs = spark.read.parquet(f"{a.output}/claims").select(*keys, "claim_idx", F.transform("citation_refs", lambda r: r["ref_index"]).alias("refs"))
    s = grounding.matchable(citations.long_sources(t, keys)).select(*keys, "kind", "pos", "url", "ref_index")
    tables.write_summary(claims.candidates(refs, s, keys), f"{a.output}/candidates", by=None)


def run_links(spark, a) -> None:
    """Cited urls with how often, by whether they were retrieved; their states and rates, if known."""
    s = grounding.matchable(spark.read.parquet(a.input))
    tables.write_summary(urlcheck.occurrences(grounding.grounding(s, a.level)), f"{a.output}/links", by=None)
    if a.status and a.archive:
        b = urlcheck.bucketed(spark.read.parquet(f"{a.output}/links"), spark.read.parquet(a.status), spark.read.parquet(a.archive))
        tables.write_summary(urlcheck.rates(b, ["grp"]), f"{a.output}/link_rates", by=None)


def run_replays(spark, a) -> None:
    """Results of replayed prompts as rows: queries, sources, cited urls, text, and the text's linked claims."""
    rows = replay.normalized_rows(tables.read_replays(spark, a.input), "payload")
    tables.write_summary(rows, f"{a.output}/replays", by=None)
    done = spark.read.parquet(f"{a.output}/replays")
    tables.write_summary(replay.link_claims(done, ["result_key"], "output_text"), f"{a.output}/replay_claims", by=None)


STAGES = {"claims": run_claims, "links": run_links, "replays": run_replays, "extract": run_extract, "rounds": run_rounds, "sources": run_sources, "decisions": run_decisions, "grounding": run_grounding}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="turnscope", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--platform", choices=extract.PLATFORMS)
    p.add_argument("--labels")
    p.add_argument("--taxonomy")
    p.add_argument("--status")
    p.add_argument("--archive")
    p.add_argument("--since", default="2023-01-01")
    p.add_argument("--level", choices=("turn", "conversation"), default="turn")
    a = p.parse_args(argv)
    if a.stage in ("extract", "rounds", "sources") and not a.platform:
        p.error("--platform is needed")
    spark = SparkSession.builder.appName(f"turnscope-{a.stage}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    STAGES[a.stage](spark, a)


if __name__ == "__main__":
    main()
