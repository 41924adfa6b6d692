"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

run() writes each stage to the shared folder named by spark.checkpoint.dir, deletes what the next one
has read, and returns the last one's rows. All stages but the last return the columns of documents; the mix does too, as it
emits each document as often as its source's rate takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm import common, decontaminate, mixing, quality, secrets, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF rejects go."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id. Near duplicates
    share 0.8 of their five-word shingles, by exact Jaccard similarity.

    Rows are told apart by doc_id and two hashes of the row, so unlike texts that repeat an id are
    documents of their own; equal rows are one. A document without an id takes a negative one for
    this stage, from the hash. Columns of any type and name ride along.
    """
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    own, other = F.xxhash64(*plain), F.xxhash64(F.lit("again"), *plain)
    number = F.coalesce(F.col("doc_id"), F.lit(-1).cast("long") - F.pmod(own, F.lit(1 << 62)))
    keyed = docs.select(F.struct(number.alias("number"), own.alias("row"), other.alias("again")).alias("_pipe_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_pipe_row"))
    found = simhash.similar_documents(keyed.select("_pipe_id", F.col("_pipe_row.text").alias("text")), "_pipe_id")
    kept = common.materialize(found.filter("id = component").select(F.col("id").alias("_pipe_kept")).distinct(), "pipe-kept")
    # the join leaves equal ids together, so equal rows fall into one without another shuffle
    rows = keyed.join(kept, keyed["_pipe_id"] == kept["_pipe_kept"], "left_semi").dropDuplicates(["_pipe_id"])
    common.release(found)
    out = rows.select("_pipe_row.*")
    out._stored_at = kept._stored_at  # run() deletes it when out has been written
    return out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, parts linked in the whole paragraph; the documents stay, n_chars follows."""
    out = secrets.redact(docs, reach=None)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The quality, near-duplicate and decontamination stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, out = docs, stage(spark, docs, sf_dir)
        docs = common.materialize(out, "stage")
        common.release(before, out)
    return docs
