"""The main text of every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions.maintext import BLOCK, COST, ENTITIES, LINK, TAG, UNSEEN, main_text

from .views import table

Q, S = {}, {}


def page_main_text(spark, d):
    """F16: the best run of blocks of every page."""
    return table(spark, d, "pages").select("page_id", main_text(F.col("html")).alias("main_text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(markup: str) -> str:
    out = f"regexp_replace({markup}, {_quoted(TAG)}, ' ', 'g')"
    for name, by in ENTITIES:
        out = f"replace({out}, {_quoted(name)}, {_quoted(by)})"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


_SEEN = "coalesce(html, '')"
for _p in UNSEEN:
    _SEEN = f"regexp_replace({_SEEN}, {_quoted(_p)}, ' ', 'g')"

Q["page_main_text"] = page_main_text
S["page_main_text"] = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, string_split_regex({_SEEN}, {_quoted(BLOCK)}) AS parts FROM pages),
c AS (SELECT rid, i, parts[i] AS part FROM p, range(1, 100000) t(i) WHERE i <= len(parts)),
b AS (SELECT rid, i, {_plain("part")} AS text, coalesce(list_sum(list_transform(regexp_extract_all(part, {_quoted(LINK)}, 1), lambda a: length({_plain("a")}))), 0) AS linked FROM c),
k AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY i) AS j, text, length(text) - 2 * linked - {COST} AS score FROM b WHERE text <> ''),
s AS (SELECT *, sum(score) OVER (PARTITION BY rid ORDER BY j) AS upto FROM k),
e AS (SELECT x.rid, y.j AS first, x.j AS last FROM s x JOIN s y ON x.rid = y.rid AND y.j <= x.j WHERE x.upto - y.upto + y.score > 0
  QUALIFY row_number() OVER (PARTITION BY x.rid ORDER BY x.upto - y.upto + y.score DESC, x.j, y.j DESC) = 1),
m AS (SELECT k.rid, string_agg(text, chr(10) ORDER BY j) AS main_text FROM k JOIN e ON e.rid = k.rid AND j BETWEEN first AND last GROUP BY k.rid)
SELECT page_id, coalesce(main_text, '') AS main_text FROM p LEFT JOIN m USING (rid)"""
