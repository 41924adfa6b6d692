"""Grounding as a stream: equal to the batch operator, whatever the batches; late rows; forgetting."""

import random

import pytest
from pyspark.sql import functions as F

from turnscope.operators.grounding import grounding
from turnscope.plans.q_stream import drained
from turnscope.streaming.grounded import stream_grounding

SCHEMA = "conv_id string, domain string, turn_id string, pos long, time timestamp, kind string"


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)


def run(spark, folder, batches, late, keep=None):
    """One file, so one micro-batch, for each batch; files are taken in order of their time of change."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame([(c, d, t, p, None if s is None else at(s), k) for c, d, t, p, s, k in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i}")
        for name in os.listdir(f"{folder}/b{i}"):
            os.utime(f"{folder}/b{i}/{name}", (1_700_000_000 + 10 * i,) * 2)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")
    out = drained(stream_grounding(source, late, keep))
    return sorted((r.conv_id, r.domain, r.turn_id, r.pos, r.external) for r in out.collect())


END = ("z", "z", "end", 0, 10_000_000, "retrieved")


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = sorted(((rnd.choice("ab"), rnd.choice("xyz"), str(i), i % 3, rnd.randrange(4_000), rnd.choice(["retrieved", "cited"])) for i in range(120)), key=lambda r: r[4] + rnd.randrange(600))
    batches = [rows[i : i + 30] for i in range(0, 120, 30)] + [[END]]
    got = run(spark, tmp_path, batches, "20 minutes")
    s = spark.createDataFrame([(c, d, t, p, at(x), k) for c, d, t, p, x, k in rows], SCHEMA)
    want = sorted((r.conv_id, r.domain, r.turn_id, r.pos, r.external) for r in grounding(s, "conversation", "time").collect())
    assert got == want and {r[4] for r in got} == {True, False}


def test_late_rows_change_no_answer(spark, tmp_path):
    batches = [
        [("a", "x", "1", 0, 100, "cited"), ("a", "y", "2", 0, 100, "cited"), ("a", None, "8", 0, 100, "cited"), ("a", "x", "9", 0, None, "cited"), ("a", "x", "7", 0, 100, "seen")],
        [("a", "y", "3", 0, 90, "retrieved"), ("b", "x", "4", 0, 500, "retrieved")],  # 90 isn't late yet
        [("b", "x", "5", 0, 600, "cited")],
        [("a", "x", "6", 0, 50, "retrieved")],  # late: the watermark is at 540
        [("a", "x", "10", 0, 700, "cited"), ("a", "x", "10", 0, 700, "cited")],
        [END],
    ]
    got = run(spark, tmp_path, batches, "1 minute")
    assert got == [("a", "x", "1", 0, False), ("a", "x", "10", 0, False), ("a", "x", "10", 0, False), ("a", "y", "2", 0, True), ("b", "x", "5", 0, True)]


def test_what_is_kept_is_bounded(spark, tmp_path):
    batches = [[("a", "x", "1", 0, 0, "retrieved"), ("b", "x", "2", 0, 0, "retrieved")], [("b", "x", "3", 0, 3_000, "cited")], [("c", "x", "4", 0, 5_000, "retrieved")], [("a", "x", "5", 0, 5_100, "cited"), ("b", "x", "6", 0, 5_100, "cited")], [END]]
    got = run(spark, tmp_path, batches, "1 second", "1 hour")
    assert got == [("a", "x", "5", 0, False), ("b", "x", "3", 0, True), ("b", "x", "6", 0, True)]


@pytest.mark.parametrize("keep", [None, "10 minutes"])
def test_many_pairs_share_few_groups(spark, tmp_path, keep):
    """Groups of the stream, and so calls of Python, don't grow with conversations and domains; pairs of one bucket stay apart."""
    rnd = random.Random(3)
    rows = sorted(((str(rnd.randrange(60)), rnd.choice("uvwxyz"), str(i), i % 3, rnd.randrange(4_000), rnd.choice(["retrieved", "cited"])) for i in range(900)), key=lambda r: r[4])
    for i in range(3):
        part = spark.createDataFrame([(c, d, t, p, at(x), k) for c, d, t, p, x, k in rows[i * 300 : i * 300 + 300] + ([END] if i == 2 else [])], SCHEMA)
        part.coalesce(1).write.parquet(f"{tmp_path}/b{i}")
    got = []
    for buckets in (3, 500):
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b*")
        where = f"{tmp_path}/out{buckets}"
        run = stream_grounding(source, "1 minute", keep, buckets=buckets).writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
        assert 0 < max(held) <= buckets
        got.append(sorted((r.conv_id, r.domain, r.turn_id, r.pos, r.external) for r in spark.read.parquet(f"{where}/rows").collect()))
    assert got[0] == got[1] and {r[4] for r in got[0]} == {True, False}
    s = spark.createDataFrame([(c, d, t, p, at(x), k) for c, d, t, p, x, k in rows], SCHEMA)
    want = sorted((r.conv_id, r.domain, r.turn_id, r.pos, r.external) for r in grounding(s, "conversation", "time").collect())
    assert got[0] == want if keep is None else len(got[0]) == len(want) and got[0] != want
