"""Queries of the forms that hold at any size: trees as rows, delta histories, ranks by range, threshold joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import bootstrap, stats
from turnscope.functions.ranks import global_places
from turnscope.operators import grounding as G
from turnscope.operators import histories, matching, trees
from turnscope.sources.stored import stored

from .views import chat_turns, line_sources, table, with_views

Q, S = {}, {}


def query(name, sql=None, views=()):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = with_views(sql, *views) if views else sql.strip()
        return f

    return add


@query("tree_order", """
WITH p AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations)
SELECT 0 AS tree, conv_id || '-' || turn AS node, i::BIGINT AS place FROM p""")
def tree_order(spark, d):
    """All messages as one tree, each the first child of the one before; every third names no child and is followed by the one that names it. Side branches stay out."""
    placed = global_places(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    name = F.concat_ws("-", "conv_id", "turn")
    rows = placed.select("place", name.alias("node"))
    up = rows.select((F.col("place") + 1).alias("place"), F.col("node").alias("parent"))
    down = rows.select((F.col("place") - 1).alias("place"), F.col("node").alias("child"))
    linked = rows.join(up, "place", "left").join(down, "place", "left")
    main = linked.select(F.lit(0).alias("tree"), (2 * F.col("place")).alias("idx"), "node", F.coalesce("parent", F.lit("gone")).alias("parent"), F.when(F.col("place") % 3 > 0, F.col("child")).alias("child"))
    side = linked.filter("child is not null").select(F.lit(0).alias("tree"), (2 * F.col("place") + 3).alias("idx"), F.concat("node", F.lit("b")).alias("node"), F.col("node").alias("parent"), F.lit(None).cast("string").alias("child"))
    return trees.walk_order(stored(main.unionByName(side), "tree-nodes"), "last", True)


_HISTORY = ["conv_id"], "turn_no"


def _parts(spark, d):
    turns = chat_turns(spark, d).select("conv_id", "turn_no", F.filter(F.array("user_text", "assistant_text"), lambda t: t != "").alias("said"))
    return histories.history_parts(turns, *_HISTORY, "said")


_SAID = "x AS (SELECT conv_id, turn_no, list_filter([user_text, assistant_text], lambda t: t <> '') AS p FROM chat_turns)"


@query("history_parts", f"WITH {_SAID} SELECT conv_id, turn_no, (sum(len(p)) OVER (PARTITION BY conv_id ORDER BY turn_no) - len(p))::BIGINT AS \"offset\", len(p)::BIGINT AS n, md5(array_to_string(p, '|')) AS digest FROM x", ("chat_turns",))
def history_parts(spark, d):
    """What each turn adds to its conversation's history, and where."""
    return _parts(spark, d).select("conv_id", "turn_no", "offset", "n", F.md5(F.array_join("parts", "|").cast("binary")).alias("digest"))


@query("history_lookup", f"WITH {_SAID}, h AS (SELECT conv_id, turn_no, list(p) OVER (PARTITION BY conv_id ORDER BY turn_no) AS h, max(turn_no) OVER (PARTITION BY conv_id) AS last FROM x) SELECT conv_id, turn_no, len(flatten(h))::BIGINT AS n, md5(array_to_string(flatten(h), '|')) AS digest FROM h WHERE turn_no = last", ("chat_turns",))
def history_lookup(spark, d):
    """The whole history of every conversation, read back from the parts of its turns."""
    parts = _parts(spark, d)
    last = parts.groupBy("conv_id").agg(F.max("turn_no").alias("turn_no"))
    return histories.histories_at(parts, last, *_HISTORY).select("conv_id", "turn_no", F.size("history").cast("long").alias("n"), F.md5(F.array_join("history", "|").cast("binary")).alias("digest"))


@query("history_tails", f"WITH {_SAID}, h AS (SELECT conv_id, turn_no, flatten(list(p) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS h FROM x) SELECT conv_id, turn_no, least(len(h), 3)::BIGINT AS n, md5(array_to_string(h[-3:], '|')) AS digest FROM h", ("chat_turns",))
def history_tails(spark, d):
    """The last three parts of the history of every turn, a range of offsets each."""
    parts = _parts(spark, d)
    return histories.histories_at(parts, parts, *_HISTORY, last=3).select("conv_id", "turn_no", F.size("history").cast("long").alias("n"), F.md5(F.array_join("history", "|").cast("binary")).alias("digest"))


@query("price_ecdf", "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) / count(*) OVER () AS ecdf FROM lineitem")
def price_ecdf(spark, d):
    """2.7: a distribution function over one group of all rows."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return stats.ecdf(li, "l_extendedprice", [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "ecdf")


_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_FLAT = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query("matched_blocks", f"""
WITH l AS (SELECT conv_id, turn * 1000 + i AS idx, string_split(text, chr(10))[i] AS block FROM conversations, range(1, 1000) t(i) WHERE role = 'assistant' AND i <= len(string_split(text, chr(10)))),
b AS (SELECT *, 'u' || idx % 5 AS url FROM l),
w AS (SELECT conv_id, idx, 'u' || idx % 7 AS url, idx % 4 AS k, block, string_split(block, ' ') AS ws FROM l),
c AS (SELECT conv_id, idx, url, CASE k WHEN 0 THEN block WHEN 1 THEN array_to_string(list_reverse(ws), ' ') WHEN 2 THEN array_to_string(ws[2:len(ws) // 2 + 1], ' ') ELSE 'qz' || idx || ' ' || ws[1] END AS chunk FROM w),
j AS (SELECT c.conv_id, c.idx AS chunk_idx, b.idx AS block_idx, contains({_FLAT.format("block")}, {_FLAT.format("chunk")}) AS held, c.url = b.url AS linked, {_TOK.format("chunk")} AS x, {_TOK.format("block")} AS y FROM c JOIN b USING (conv_id) WHERE {_FLAT.format("chunk")} <> ''),
f AS (SELECT *, CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE round(2.0 * coalesce(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))), 0) / (len(x) + len(y)), 9) END AS f1 FROM j),
s AS (SELECT *, CASE WHEN held THEN 3 WHEN f1 >= 0.45 THEN 2 WHEN linked THEN 1 END AS tier FROM f)
SELECT conv_id, chunk_idx, block_idx, tier FROM s WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, chunk_idx ORDER BY tier DESC, CASE WHEN tier < 3 THEN f1 END DESC, block_idx) = 1""")
def matched_blocks(spark, d):
    """Lines of a conversation's answers as blocks; those lines as they are, turned round, cut or replaced as chunks, each matched to its best block."""
    said = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "block"))
    lines = said.select("conv_id", (F.col("turn") * 1000 + F.col("i") + 1).alias("idx"), "block")
    ws, k = F.split("block", " "), F.col("idx") % 4
    cut = F.slice(ws, 2, F.floor(F.size(ws) / 2).cast("int"))
    chunk = F.when(k == 0, F.col("block")).when(k == 1, F.array_join(F.reverse(ws), " ")).when(k == 2, F.array_join(cut, " ")).otherwise(F.concat(F.lit("qz"), F.col("idx").cast("string"), F.lit(" "), ws[0]))
    url = lambda n: F.array(F.concat(F.lit("u"), (F.col("idx") % n).cast("string")))
    chunks = lines.select("conv_id", F.col("idx").alias("chunk_idx"), chunk.alias("chunk"), url(7).alias("urls"))
    blocks = lines.select("conv_id", F.col("idx").alias("block_idx"), "block", url(5).alias("block_urls"))
    return matching.best_block(chunks, blocks, ["conv_id"])


@query("grounding_ci_split")
def grounding_ci_split(spark, d):
    """Cluster bootstrap of external per cited with draws split over tasks, the same at any parallelism (no SQL for the generator)."""
    g = G.grounding(line_sources(spark, d), "conversation").select("platform", "conv_id", F.col("external").cast("int").alias("p"), F.lit(1).alias("q"))
    return bootstrap.split_ratio_ci(g, ["platform"], "conv_id", "p", "q", n_bootstrap=1_000)
