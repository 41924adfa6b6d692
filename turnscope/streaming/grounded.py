"""Grounding of citations as a stream: whether a domain was retrieved in the conversation up to the citation's time.

State is what is known of each conversation and domain: when it was first retrieved, and the citations whose answer isn't
certain yet. A citation is answered once the watermark has passed it, since until then an earlier retrieval may still
come; a timer on the oldest open one sees to that without new rows. So the answers are those of
operators.grounding.grounding(level="conversation", order="time") over all rows that weren't late.

Conversations and domains share buckets by their hash, and a bucket is one group of the stream with its state as columns: Python
is called once a bucket and batch, not once a pair, and works on whole columns. A batch rewrites the buckets it touches, so
its cost grows with what is known of these; more buckets suit many pairs and small batches. A checkpoint keeps its number.

Defined cases: a row behind the watermark is late and dropped, a citation too, and an answer once given stays. Rows
without time, conversation, domain or one of the two kinds are passed over. Repeated citations get an answer each.
With `keep`, a conversation's domain untouched for that long is forgotten, and a later citation counts as not retrieved;
without it the state grows with the conversations and domains seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Pairs of conversation and domain, then open citations with the place of their pair among these.
_STATE = "convs array<string>, domains array<string>, firsts array<long>, lasts array<long>, pairs array<long>, times array<long>, turns array<string>, places array<long>"
_OUT = "conv_id string, domain string, turn_id string, pos long, time_us long, external boolean"
#: As the first time of what was never retrieved.
_NEVER = np.iinfo(np.int64).max
#: Groups of the stream; at most so many tasks have work.
BUCKETS = 1_024


def _settle(parts: Iterable[pd.DataFrame], state: GroupState, keep_us: int | None) -> Iterator[pd.DataFrame]:
    """One bucket: new rows (none when a timer fires) into the state, and what the watermark has passed out of it."""
    known = state.get if state.exists else ([],) * 8
    convs, domains, turns = (np.array(known[i], object) for i in (0, 1, 6))
    firsts, lasts, pairs, times, places = (np.array(known[i], np.int64) for i in (2, 3, 4, 5, 7))
    passed = max(0, state.getCurrentWatermarkMs())

    def answers(sure):
        of = pairs[sure]
        external = (firsts[of] != _NEVER) & (firsts[of] <= times[sure])
        return pd.DataFrame({"conv_id": convs[of], "domain": domains[of], "turn_id": turns[sure], "pos": places[sure], "time_us": times[sure], "external": external})

    def reduce(pair, citation):
        """Only those pairs and open citations stay."""
        nonlocal convs, domains, firsts, lasts, pairs, times, turns, places
        pairs, times, turns, places = (np.cumsum(pair) - 1)[pairs[citation]], times[citation], turns[citation], places[citation]
        convs, domains, firsts, lasts = convs[pair], domains[pair], firsts[pair], lasts[pair]

    if keep_us is not None:  # forgotten, timer or not
        gone = (lasts + keep_us) // 1000 < passed
        if gone.any():
            if gone[pairs].any():
                yield answers(gone[pairs])
            reduce(~gone, ~gone[pairs])
    if not state.hasTimedOut:
        rows = pd.concat([pd.DataFrame({"conv_id": convs, "domain": domains}), *(p[["conv_id", "domain", "turn_id", "pos", "time_us", "cited"]] for p in parts)], ignore_index=True)
        old, groups = len(convs), rows.groupby(["conv_id", "domain"], sort=False)
        of = groups.ngroup().to_numpy(np.int64)  # by first appearance, so known pairs keep their places
        new = groups.head(1)
        convs, domains = new["conv_id"].to_numpy(object), new["domain"].to_numpy(object)
        came, of = rows.iloc[old:], of[old:]
        time, cited = came["time_us"].to_numpy(np.int64), came["cited"].to_numpy(bool)
        firsts = np.concatenate([firsts, np.full(len(convs) - old, _NEVER)])
        lasts = np.concatenate([lasts, np.full(len(convs) - old, np.iinfo(np.int64).min)])
        np.minimum.at(firsts, of[~cited], time[~cited])
        np.maximum.at(lasts, of, time)
        pairs, times = np.concatenate([pairs, of[cited]]), np.concatenate([times, time[cited]])
        turns, places = np.concatenate([turns, came["turn_id"].to_numpy(object)[cited]]), np.concatenate([places, came["pos"].to_numpy(np.int64)[cited]])
    sure = times // 1000 < passed
    if sure.any():
        yield answers(sure)
    held = firsts != _NEVER
    held[pairs[~sure]] = True
    reduce(held, ~sure)
    if not len(convs):
        if state.exists:
            state.remove()
        return
    state.update(tuple(x.tolist() for x in (convs, domains, firsts, lasts, pairs, times, turns, places)))
    due = [int(times.min()) // 1000] if len(times) else []
    if keep_us is not None:
        due.append((int(lasts.min()) + keep_us) // 1000)
    if due:
        state.setTimeoutTimestamp(max(min(due), passed + 1))


def stream_grounding(sources: DataFrame, late: str = "1 hour", keep: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(conv_id, domain, turn_id, pos, time_us, external), a row per citation; sources has conv_id, domain, turn_id, pos, time and kind ('retrieved' or 'cited').

    Append mode; ids come back as strings, times as microseconds since 1970.
    """
    keep_us = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1e6)
    rows = sources.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("domain").cast("string").alias("domain"), F.coalesce(F.col("turn_id").cast("string"), F.lit("")).alias("turn_id"),
        F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("pos"), "kind", F.col("time").cast("timestamp").alias("time"), F.unix_micros(F.col("time").cast("timestamp")).alias("time_us"),
    )
    fine = rows.filter("time is not null and conv_id is not null and domain is not null and kind in ('retrieved', 'cited')")
    dealt = fine.withColumn("cited", F.col("kind") == "cited").drop("kind").withColumn("bucket", F.pmod(F.xxhash64("conv_id", "domain"), F.lit(buckets)))

    def settle(key, parts, state):
        return _settle(parts, state, keep_us)

    return dealt.withWatermark("time", late).groupBy("bucket").applyInPandasWithState(settle, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
