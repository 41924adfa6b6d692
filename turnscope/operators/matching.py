"""Texts matched to texts by token F1, without comparing all of a group with all.

A text is the set of its tokens, each numbered among its equals, so the overlap of two multisets is the size of an intersection. F1 of at
least t needs an overlap of t / (2 - t) of either text's tokens, so two texts that reach it share one of the first n - ceil(t n / (2 - t)) + 1 elements of each in
any common order. Elements are ordered by how rare they are, and only those prefixes are posted: pairs meet at rare elements, within bounds of length, and are then counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.functions import text
from turnscope.sources.stored import discard, stored

TOKEN = "[a-z0-9]+"
LEAST_F1 = 0.45
#: F1 that the best block is looked for at first, each level among the texts that the one before has left.
LEVELS = (1.0, 0.8)
#: F1 is rounded to so many digits before it is compared.
DIGITS = 9


def _tokens(column: str):
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_elements(texts: DataFrame, ids: list[str], column: str) -> DataFrame:
    """(ids, elem): the numbered tokens of each text, by 64-bit hashes of token and number."""
    toks = texts.select(*ids, F.explode(_tokens(column)).alias("tok")).groupBy(*ids, "tok").agg(F.count("*").cast("int").alias("_c"))
    return toks.select(*ids, "tok", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_k")).select(*ids, _element(F.col("tok"), F.col("_k")).alias("elem"))


def _element(token, number):
    return F.xxhash64(token, number)


def rarest_first(a: DataFrame, b: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """((key, a_id, elems), (key, b_id, elems)): the elements of each text as one list, in an order common to all: by how many texts have them, then by hash. Stored."""
    frequency = stored(a.select("elem").unionAll(b.select("elem")).groupBy("elem").agg(F.count("*").alias("freq")), "match-frequency")
    order = lambda e, i: e.join(frequency, "elem").groupBy(*key, i).agg(F.array_sort(F.collect_list(F.struct("freq", "elem")))["elem"].alias("elems"))
    out = stored(order(a, "a_id"), "match-a"), stored(order(b, "b_id"), "match-b")
    discard(frequency)
    return out


def _prefixes(lists: DataFrame, ids: list[str], least: float) -> DataFrame:
    n = F.size("elems")
    need = F.ceil(F.lit(least / (2 - least)) * n - 1e-9).cast("int")
    return lists.select(*ids, n.alias("n"), F.posexplode(F.slice("elems", F.lit(1), n - need + 1)).alias("_at", "elem")).withColumn("_at", F.col("_at") + 1)


def pair_f1(pairs: DataFrame, a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """pairs (key, a_id, b_id) with f1; a and b are lists of elements. A text without tokens has none with any."""
    left = pairs.join(a.withColumnRenamed("elems", "_x"), [*key, "a_id"], "left")
    both = left.join(b.withColumnRenamed("elems", "_y"), [*key, "b_id"], "left")
    shared = F.coalesce(F.size(F.array_intersect("_x", "_y")), F.lit(0))
    f1 = F.coalesce(F.round(F.try_divide(2.0 * shared, F.size("_x") + F.size("_y")), DIGITS), F.lit(0.0))
    return both.withColumn("f1", f1).drop("_x", "_y")


def close_pairs(a: DataFrame, b: DataFrame, key: list[str], least: float = LEAST_F1) -> DataFrame:
    """(key, a_id, b_id): pairs of a text of a and one of b that meet in their prefixes and may reach `least`; all that do are among them.

    What a pair shares beyond the last element shared in the prefixes comes after it in both texts, so the shared ones and the shorter rest bound the
    overlap. a, b: lists of elements as rarest_first() gives them.
    """
    x = _prefixes(a, [*key, "a_id"], least).withColumnsRenamed({"n": "_m", "_at": "_i"})
    y = _prefixes(b, [*key, "b_id"], least)
    low = least / (2 - least)
    fits = (F.col("n") >= low * F.col("_m") - 1e-6) & (F.col("_m") >= low * F.col("n") - 1e-6)
    met = x.join(y, [*key, "elem"]).filter(fits).groupBy(*key, "a_id", "b_id").agg(F.count("*").alias("_same"), F.min(F.least(F.col("_m") - F.col("_i"), F.col("n") - F.col("_at"))).alias("_rest"), F.max("_m").alias("_m"), F.max("n").alias("n"))
    return met.filter(F.col("_same") + F.col("_rest") >= least / 2 * (F.col("_m") + F.col("n")) - 1e-6).select(*key, "a_id", "b_id")


def holding_pairs(chunks: DataFrame, blocks: DataFrame, a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, a_id, b_id): chunks with the blocks that hold them, by text without case and runs of blanks.

    chunks: key, a_id, chunk; blocks: key, b_id, block; a, b: their lists of elements. The tokens inside a chunk, its first and last apart, are tokens of a block that
    holds it: the rarest is looked up. A chunk of fewer than three tokens has none inside and is looked for in all blocks of its group.
    """
    toks = chunks.select(*key, "a_id", _tokens("chunk").alias("_t"))
    inside = F.transform(F.slice("_t", 2, F.size("_t") - 2), lambda t: _element(t, F.lit(1)))
    inner = toks.filter(F.size("_t") > 2).join(a, [*key, "a_id"]).select(*key, "a_id", F.array_intersect("elems", inside)[0].alias("elem"))
    met = inner.join(b.select(*key, "b_id", F.explode("elems").alias("elem")), [*key, "elem"]).select(*key, "a_id", "b_id")
    short = toks.filter(F.size("_t") <= 2).select(*key, "a_id").join(blocks.select(*key, "b_id"), key)
    pairs = met.unionByName(short).join(chunks.select(*key, "a_id", "chunk"), [*key, "a_id"]).join(blocks.select(*key, "b_id", "block"), [*key, "b_id"])
    return pairs.filter(F.contains(text.match_text(F.col("block")), text.match_text(F.col("chunk")))).select(*key, "a_id", "b_id")


def best_block(chunks: DataFrame, blocks: DataFrame, key: list[str], least: float = LEAST_F1) -> DataFrame:
    """(key, chunk_idx, block_idx, tier): the raw block that a chunk comes from.

    3: the first block that holds it; else 2: the one of best token F1 from `least` on, the first of equals; else 1: the one with most shared
    urls, then best F1, then the first. A chunk of blanks, and one that finds none, has no row. chunks: key, chunk_idx, chunk, urls. blocks: key, block_idx, block, block_urls.
    Equal texts of a group are looked up once. Reads a stored table.
    """
    full = chunks.filter(text.match_text(F.col("chunk")) != "")
    said = stored(full.groupBy(*key, "chunk").agg(F.min("chunk_idx").alias("a_id")), "match-chunks")
    raw = stored(blocks.withColumn("block", F.coalesce("block", F.lit(""))).groupBy(*key, "block").agg(F.min("block_idx").alias("b_id")), "match-blocks")
    a, b = rarest_first(token_elements(said, [*key, "a_id"], "chunk"), token_elements(raw, [*key, "b_id"], "block"), key)
    held = stored(holding_pairs(said, raw, a, b, key).groupBy(*key, "a_id").agg(F.min("b_id").alias("_held")), "match-held")
    # a chunk that some block holds needs no other, nor does one whose best lies at a higher level, where prefixes are short
    rest, levels = a.join(held.select(*key, "a_id"), [*key, "a_id"], "left_anti"), []
    for level in (*(x for x in LEVELS if x > least), least):
        found = pair_f1(close_pairs(rest, b, key, level), a, b, key).filter(F.col("f1") >= level)
        levels.append(stored(found.groupBy(*key, "a_id").agg(F.max_by("b_id", F.struct("f1", -F.col("b_id"))).alias("_near")), "match-near"))
        rest = rest.join(levels[-1].select(*key, "a_id"), [*key, "a_id"], "left_anti")
    near = levels[0]
    for more in levels[1:]:
        near = near.unionByName(more)
    texts = said.join(held, [*key, "a_id"], "left").join(near, [*key, "a_id"], "left").select(*key, F.col("chunk").alias("_chunk"), "a_id", "_held", "_near")
    same = [full[k] == texts[k] for k in key] + [full["chunk"] == texts["_chunk"]]
    rows = stored(full.join(texts, same).select(*[full[k] for k in key], "chunk_idx", "urls", "a_id", F.coalesce("_held", "_near").alias("block_idx"), F.when(F.col("_held").isNotNull(), 3).when(F.col("_near").isNotNull(), 2).alias("tier")), "match-rows")
    open_ = rows.filter("tier is null").select(*key, "chunk_idx", "a_id", F.explode(F.array_distinct("urls")).alias("url"))
    sites = blocks.select(*key, "block_idx", F.coalesce("block", F.lit("")).alias("block"), F.explode(F.array_distinct("block_urls")).alias("url")).join(raw, [*key, "block"])
    shared = open_.join(sites.select(*key, "block_idx", "b_id", "url"), [*key, "url"]).groupBy(*key, "chunk_idx", "a_id", "block_idx", "b_id").agg(F.count("*").alias("_shared"))
    linked = pair_f1(shared, a, b, key).groupBy(*key, "chunk_idx").agg(F.max_by("block_idx", F.struct("_shared", "f1", -F.col("block_idx"))).alias("block_idx"))
    out = rows.filter("tier is not null").select(*key, "chunk_idx", "block_idx", "tier").unionByName(linked.select(*key, "chunk_idx", "block_idx", F.lit(1).alias("tier")))
    out = stored(out, "match-out")
    discard(said, raw, a, b, held, rows, *levels)
    return out
