"""Chat formatting: the best root-to-leaf paths of reply trees, each formatted as one conversation.

Paths are enumerated by self-joins that double: after round k every message knows its ancestor 2^k steps up and the score of the
steps between, so a tree of depth d takes log2(d) equi-joins on (tree, message), whose keys are unique and hence even, however large a tree is. A leaf's
branch scores the sum over its messages; branches are ranked by score, length, then leaf, and the best of each tree are kept before any path is
spelled out. The kept ones are spelled out by the same tables from the top: with each level every known message of a path adds the one 2^k steps above.

Texts meet their places by message and are dealt by (path, run of places), so a hot conversation is many tasks. Each streams its messages in order
into parts of bounded size that hold whole turns; nearly every conversation is one part, longer ones are their parts in order.

The template marks turns as <|turn|>role<|says|>text<|end|> and a line feed. Control strings inside roles and texts, of this template and of others
(<s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>, <|any_name|>), get a backslash after their first character, and one more where
they have some already, so nothing that reads as one is left and taking one away restores the text. The loss mask is a list of code point ranges, one per assistant text.

Defined cases: a null role or text is empty; a null tree is a tree of its own. A message whose parent is null or unknown is a root. Messages on a circle, or below one, have no root and are on no
path. Rows that repeat a message follow each other by role and text. Null scores count as 0; ties go to the longer branch, then to the smaller leaf. Empty
and very long texts are kept whole: a part holds at least one turn. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.functions.ranks import global_places

from .common import materialize, release, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
ASSISTANT = "assistant"
#: What follows the first character of a control string.
CONTROL_TAIL = r"/?s>|/?INST\]|/?SYS>>|\|[A-Za-z0-9_]+\|>"
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*)({CONTROL_TAIL})"), re.compile(rf"([<\[])\\(\\*)({CONTROL_TAIL})")
_TURN = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(SAYS) + r"(.*?)" + re.escape(END), re.DOTALL)
#: Places of a path that are dealt together, and bytes after which a part ends.
RUN, PART_BYTES = 512, 1 << 20


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _key(tree: str = "tree", node: str = "node") -> Column:
    return F.struct(F.col(tree).alias("tree"), F.col(node).alias("node"))


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((key, tree, node, hops, total) of every message with a root, stored; [(key, up)] by level, stored).

    nodes: tree, node, parent, score, one row per message. up is the message 2^level steps above; total is the score from the message to its root.
    """
    above = nodes.select(_key().alias("above"))
    first = nodes.select(_key().alias("key"), F.when(F.col("parent").isNotNull(), F.struct(F.col("tree").alias("tree"), F.col("parent").alias("node"))).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    # a parent that isn't there ends the path
    now = materialize(first.join(above, first["up"] == above["above"], "left").select("key", F.col("above").alias("up"), F.lit(1).cast("long").alias("hops"), "total"), "chat-level")
    levels, ended, most = [], [], nodes.count()
    while True:
        ended.append(now.filter("up is null").select("key", "hops", "total"))
        levels.append(now)
        open_ = now.filter("up is not null")
        if 1 << len(levels) > 2 * most or open_.isEmpty():  # no path is longer than all messages: what is left goes round
            break
        other = now.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"), F.col("total").alias("rest"))
        done = [e.select(F.col("key").alias("up"), F.lit(None).cast(now.schema["up"].dataType).alias("next"), F.col("hops").alias("more"), F.col("total").alias("rest")) for e in ended[:-1]]
        for d in done:
            other = other.unionByName(d)
        now = materialize(open_.join(other, "up").select("key", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("total") + F.col("rest")).alias("total")), "chat-level")
    rooted = ended[0]
    for e in ended[1:]:
        rooted = rooted.unionByName(e)
    return rooted, levels


def best_branches(rooted: DataFrame, nodes: DataFrame, best: int = 1) -> DataFrame:
    """(leaf, rank, score, length): the best branches of every tree; leaf is the key of the message a branch ends with."""
    parents = nodes.filter("parent is not null").select(F.struct(F.col("tree").alias("tree"), F.col("parent").alias("node")).alias("key")).distinct()
    leaves = rooted.join(parents, "key", "left_anti")
    # only a tree's best rows of each task are shuffled
    order = W.partitionBy(F.struct("key.tree")).orderBy(F.desc("total"), F.desc("hops"), F.col("key.node"))
    ranked = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select(F.col("key").alias("leaf"), "rank", F.col("total").alias("score"), F.col("hops").alias("length"))


def spell(branches: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """branches with (key, place): a row for every message of every branch, place counted from the root. Stored."""
    found = materialize(branches.select("*", F.col("leaf").alias("key"), F.lit(0).cast("long").alias("back")), "chat-paths")
    for level in range(len(levels) - 1, -1, -1):
        up = levels[level].filter("up is not null")
        further = found.join(up.select("key", "up"), "key").select("leaf", "rank", "score", "length", F.col("up").alias("key"), (F.col("back") + F.lit(1 << level)).alias("back"))
        new = materialize(found.unionByName(further), "chat-paths")
        release(found)
        found = new
    out = found.select("leaf", "rank", "score", "length", "key", (F.col("length") - 1 - F.col("back")).alias("place"))
    out._stored_at = found._stored_at
    return out


_PARTS = "rank int, score double, length long, part long, n_messages long, whole boolean, text string, loss array<struct<start:long,end:long>>"


def write_parts(rows: DataFrame) -> DataFrame:
    """(tree, leaf, rank, score, length, part, n_messages, whole, text, loss): the formatted conversations.

    rows: leaf, rank, score, length, place, role, said. part is the place of the part's first turn, n_messages its turns; whole says that it is all of
    the conversation. loss holds the code point ranges of assistant texts in the part's text.
    """
    run = F.floor(F.col("place") / RUN)
    dealt = rows.select("leaf", "rank", "score", "length", "place", "role", "said", run.alias("run")).repartition("leaf", "run")
    dealt = dealt.sortWithinPartitions("leaf", "run", "place", F.col("role").asc_nulls_first(), F.col("said").asc_nulls_first())

    def write(batches):
        held = None  # the part being written

        def part(own, first, last, n, size, chunks, loss):
            leaf, rank, score, length = own
            whole = first == 0 and last == length - 1
            names = ["leaf", "rank", "score", "length", "part", "n_messages", "whole", "text", "loss"]
            loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [leaf, pa.array([rank], pa.int32()), pa.array([score], pa.float64()), pa.array([length], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([whole])]
            return pa.RecordBatch.from_arrays([*cols, pa.array(["".join(chunks)], pa.string()), pa.array([loss], loss_type)], names=names)

        for b in batches:
            keys, ranks, scores, lengths = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            places, roles, said, runs = (b.column(c).to_pylist() for c in (4, 5, 6, 7))
            for i, key in enumerate(keys):
                now = (key, runs[i])
                # a part ends between places only, so that rows of one message are never parted and whole is certain
                if held and (held["now"] != now or (held["bytes"] >= PART_BYTES and places[i] != held["last"])):
                    yield part(held["own"], held["first"], held["last"], held["n"], held["chars"], held["chunks"], held["loss"])
                    held = None
                if held is None:
                    held = {"now": now, "own": (b.column(0).slice(i, 1), ranks[i], scores[i], lengths[i]), "first": places[i], "n": 0, "bytes": 0, "chars": 0, "chunks": [], "loss": []}
                role, text = escape(roles[i] or ""), escape(said[i] or "")
                start = held["chars"] + len(TURN) + len(role) + len(SAYS)
                held["chunks"] += [TURN, role, SAYS, text, END]
                if roles[i] == ASSISTANT:
                    held["loss"].append({"start": start, "end": start + len(text)})
                held["chars"] = start + len(text) + len(END)
                held["bytes"] += len(text.encode()) + len(role.encode())
                held["n"] += 1
                held["last"] = places[i]
        if held:
            yield part(held["own"], held["first"], held["last"], held["n"], held["chars"], held["chunks"], held["loss"])

    kind = rows.schema["leaf"].dataType.simpleString()
    return dealt.mapInArrow(write, f"leaf {kind}, {_PARTS}").select(F.col("leaf.tree").alias("tree"), F.col("leaf.node").alias("leaf"), "rank", "score", "length", "part", "n_messages", "whole", "text", "loss")


def format_trees(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | Column | None = None, best: int = 1, nodes: DataFrame | None = None) -> DataFrame:
    """The formatted conversations of the best branches, as write_parts() gives them, stored.

    score: a column of messages, or 1 for each message, so that the longest branch is the best. nodes (tree, node, parent, score) may be given where messages repeat.
    """
    m = messages.select(F.col(f"`{tree}`").alias("tree"), F.col(f"`{node}`").alias("node"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("said"))
    if nodes is None:
        points = F.lit(1.0) if score is None else F.col(f"`{score}`") if isinstance(score, str) else score
        given = messages.select(F.col(f"`{tree}`").alias("tree"), F.col(f"`{node}`").alias("node"), F.col(f"`{parent}`").alias("parent"), points.cast("double").alias("score"))
        # rows that repeat a message have its smallest parent and best score
        nodes = materialize(given.filter("node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score")), "chat-nodes")
    rooted, levels = climb(nodes)
    branches = best_branches(rooted, nodes, best)
    paths = spell(branches, levels)
    release(*levels, nodes)
    placed = paths.select("leaf", "rank", "score", "length", "place", "key")
    rows = m.select(_key().alias("key"), "role", "said").join(placed, "key")
    out = materialize(write_parts(rows), "chat-parts")
    release(paths)
    return out


def linear_nodes(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """(tree, node, parent, score) of conversations without branches: each distinct order value of a tree replies to the one before it. Stored.

    node is a struct of the order columns. Places in the order of all trees at once tell neighbours, so a long conversation isn't one window.
    """
    keys = rows.select(F.col(tree).alias("tree"), F.struct(*order).alias("node")).distinct()
    placed = global_places(keys, F.col("tree").asc_nulls_first(), F.col("node").asc_nulls_first())
    before = placed.select(F.col("tree").alias("_tree"), F.col("node").alias("parent"), (F.col("place") + 1).alias("place"))
    joined = placed.join(before, (placed["place"] == before["place"]) & placed["tree"].eqNullSafe(before["_tree"]), "left")
    out = materialize(joined.select("tree", "node", "parent", F.lit(1.0).alias("score")), "chat-nodes")
    release(placed)
    return out


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation or part."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def digests(parts: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the parts, which should be stored.

    Conversations of one part are read where they are. The parts of longer ones are streamed in order through their digests, one part in memory at a time.
    """
    kinds = {c: parts.schema[c].dataType.simpleString() for c in ("tree", "leaf")}
    schema = f"tree {kinds['tree']}, leaf {kinds['leaf']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        held = None

        def row(h):
            cols = [pa.array([v], t) for v, t in ((h["n"], pa.int64()), (h["all"].hexdigest(), pa.string()), (h["m"], pa.int64()), (h["loss"].hexdigest(), pa.string()), (h["chars"], pa.int64()))]
            return pa.RecordBatch.from_arrays([*h["own"], *cols], names=names)

        for b in batches:
            for i in range(b.num_rows):
                key = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if held and held["key"] != key:
                    yield row(held)
                    held = None
                if held is None:
                    held = {"key": key, "own": [b.column(0).slice(i, 1), b.column(1).slice(i, 1)], "n": 0, "m": 0, "chars": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                text, loss = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                for who, said in read_turns(text):
                    held["all"].update(f"{who}\n{said}\n".encode())
                    held["n"] += 1
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    held["loss"].update(said.encode())
                    held["m"] += len(said)
                held["chars"] += len(text)
                if b.column(4)[i].as_py():  # whole: nothing follows
                    yield row(held)
                    held = None
        if held:
            yield row(held)

    one = parts.filter("whole").select("tree", "leaf", "text", "loss", "whole").mapInArrow(read, schema)
    cut = parts.filter("not whole").select("tree", "leaf", "text", "loss", "whole", "part").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "part")
    return one.unionByName(cut.drop("part").mapInArrow(read, schema))


def op13_chat_format(spark, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, read back from the formatted text."""
    extra = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], rows.schema))
    rows = rows.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")
    nodes = linear_nodes(rows, "conv_id", ["turn", "role", "digest"])
    messages = rows.select("conv_id", F.struct("turn", "role", "digest").alias("node"), "role", "text")
    parts = format_trees(messages, "conv_id", "node", role="role", text="text", nodes=nodes)
    return digests(parts).select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_E = rf"([<\[])(\\*)({CONTROL_TAIL})"

#: Escaping adds one character for each control string.
OP13_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, role AS raw, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw NULLS FIRST, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, raw NULLS FIRST, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN) + len(SAYS) + len(END)} + length(role) + length(text) + len(regexp_extract_all(role, '{_E}')) + len(regexp_extract_all(text, '{_E}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
