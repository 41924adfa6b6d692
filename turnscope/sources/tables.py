"""Readers and writers of the engine's tables: summaries, labels, ranks, caches, replays, checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_summary(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt)
    reader = reader.option("header", True).option("multiLine", True).option("escape", '"') if fmt == "csv" else reader
    return (reader.schema(schema) if schema else reader).load(path)


def write_summary(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "platform") -> None:
    """df by platform; CSV gets nested columns as JSON text."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    if fmt == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    w = df.write.mode("overwrite").format(fmt)
    w = w.option("header", True).option("escape", '"') if fmt == "csv" else w
    (w.partitionBy(by) if by and by in df.columns else w).save(path)


def first_existing(spark: SparkSession, candidates: list[tuple[str, str]]) -> DataFrame:
    """The first (path, format) that exists."""
    for path, fmt in candidates:
        if _exists(spark, path):
            return read_summary(spark, path, fmt)
    raise FileNotFoundError(", ".join(p for p, _ in candidates))


def topic_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, topic): empty topics are Other."""
    t = spark.read.option("header", True).csv(path)
    return t.select("conv_id", F.coalesce(F.when(F.trim("topic_new") != "", F.col("topic_new")), F.lit("Other")).alias("topic"))


def topic_labels_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, topic) by label_topic(); bad lines are skipped."""
    from turnscope.operators.extract import label_topic

    shape = "conversation_id string, conversation_label array<string>, data_per_turn array<struct<topic:string>>"
    t = spark.read.text(path).select(F.from_json("value", shape).alias("r")).select("r.*").filter("conversation_id is not null")
    return t.select(F.col("conversation_id").alias("conv_id"), label_topic(F.col("conversation_label"), F.transform("data_per_turn", lambda x: x["topic"])).alias("topic"))


def popularity_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(domain, rank) from a headerless CSV, domains folded, the best rank of each."""
    from turnscope.functions.urls import fold_domain
    from turnscope.operators.grounding import best_ranks

    t = spark.read.schema("rank int, domain string").csv(path)
    return best_ranks(t.select("rank", fold_domain(F.col("domain")).alias("domain")).filter("domain <> '' and rank is not null"))


def url_texts(spark: SparkSession, path: str) -> DataFrame:
    """(url, text) from a JSON object of url to text; what isn't text is empty."""
    t = spark.read.option("wholetext", True).text(path)
    v = t.select(F.explode(F.from_json("value", "map<string,variant>")).alias("url", "v"))
    return v.select("url", F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).otherwise("").alias("text"))


def read_replays(spark: SparkSession, path: str) -> DataFrame:
    """(result_key, payload): one row per result of an object in JSON, or else as a Python literal; payload as JSON text."""
    from turnscope.functions.text import literal_json

    t = spark.read.option("wholetext", True).text(path)
    read = lambda c: F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
    is_json = F.try_parse_json("value").isNotNull()
    both = t.select("value", is_json.alias("ok"))
    plain = both.filter("ok").select(read(F.col("value")).alias("m"))
    literal = both.filter("not ok").select(read(literal_json("value")).alias("m"))
    return plain.unionByName(literal).select(F.explode("m").alias("result_key", "payload"))


def write_replays(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """One line of JSON (or a row of CSV) per result key, with its models' rows by model where there are several."""
    payload = [c for c in rows.columns if c not in ("model", "result_key")]
    g = rows.groupBy("result_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct(*payload).alias("row"))))).alias("models"))
    if fmt == "json":
        g.write.mode("overwrite").json(path)
    else:
        write_summary(g, path, fmt, by=None)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """A table that append_new() has written, all batches of it; what isn't committed is hidden."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key the output hasn't yet, as one batch; how many there were. A rerun adds nothing.

    A batch is written beside the others under a hidden name and appears by one rename, so readers see all of it or nothing, and a failed append leaves
    nothing. Rows are computed once: they are counted from what was written. Two appends at a time claim the same number; the later one fails and can be run again.
    """
    made = spark._jvm.org.apache.hadoop.fs.Path
    fs = made(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = _exists(spark, path)
    batches = [s.getPath().getName() for s in fs.listStatus(made(path))] if done else []
    held = [b for b in batches if not b.startswith(("_", "."))]
    if held:
        rows = rows.join(read_batches(spark, path).select(*key).distinct(), key, "left_anti")
    number = 1 + max((int(b.removeprefix("batch=")) for b in held if b.startswith("batch=")), default=0)
    staged = f"{path}/_staging-{uuid.uuid4().hex}"
    try:
        rows.dropDuplicates(key).write.parquet(staged)
        n = spark.read.schema(rows.schema).parquet(staged).count()
        target = made(f"{path}/batch={number:09d}")
        if n and (fs.exists(target) or not fs.rename(made(staged), target)):
            raise RuntimeError(f"{target.toString()} was written by another append")
    finally:
        fs.delete(made(staged), True)
    return n


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, order: list[str] | None = None, path: str | None = None) -> None:
    """df as a table in buckets of its keys, each sorted by keys and order.

    Tables in as many buckets of the same keys join, group and window by them without a shuffle: turns, rounds, sources and claims of a conversation lie in the same bucket.
    One file a bucket: rows are dealt by the hash that buckets use. A few hundred MB a bucket suit a scan; a path makes the table an external one.
    """
    w = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *(order or []))
    (w.option("path", path) if path else w).saveAsTable(name)
