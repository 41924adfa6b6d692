"""The main text of a page: the run of blocks with most text that isn't links.

Markup is cut at block-level tags. A block counts the length of its text, less twice that of its links, less COST, so menus, footers and
crumbs count against a run and paragraphs for it; the main text is the run of consecutive blocks of the greatest sum, found in
one pass over the page's blocks.

Defined cases: a null or empty page, or one without a block that counts, has no main text (empty). Of equal runs the one that ends first
wins, and of those the shortest. A link that a block-level tag cuts open counts as text. Blocks without text are no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length that a block must exceed to count for a run.
COST = 40
UNSEEN = (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?s)<!--.*?-->")
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>"
LINK = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
TAG = r"(?s)<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _plain(markup: Column) -> Column:
    t = F.regexp_replace(markup, TAG, " ")
    for name, by in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(by))
    return F.btrim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def blocks(html: Column) -> Column:
    """(text, score) of every block of a page that has text, in order."""
    t = F.coalesce(html, F.lit(""))
    for pattern in UNSEEN:
        t = F.regexp_replace(t, pattern, " ")

    def block(part):
        linked = F.aggregate(F.regexp_extract_all(part, F.lit(LINK), F.lit(1)), F.lit(0), lambda n, a: n + F.length(_plain(a)))
        text = _plain(part)
        return F.struct(text.alias("text"), (F.length(text) - 2 * linked - COST).cast("long").alias("score"))

    return F.filter(F.transform(F.split(t, BLOCK, -1), block), lambda b: b["text"] != "")


def main_text(html: Column) -> Column:
    """The texts of the best run of blocks, a line each."""
    long = lambda n: F.lit(n).cast("long")

    def step(s, b):
        fresh = s["sum"] <= 0
        now = F.when(fresh, b["score"]).otherwise(s["sum"] + b["score"])
        begin = F.when(fresh, s["at"]).otherwise(s["begin"])
        more = now > s["best"]
        keep = lambda new, old: F.when(more, new).otherwise(s[old]).alias(old)
        return F.struct((s["at"] + 1).alias("at"), now.alias("sum"), begin.alias("begin"), keep(now, "best"), keep(begin, "first"), keep(s["at"], "last"))

    zero = F.struct(long(1).alias("at"), long(0).alias("sum"), long(1).alias("begin"), long(0).alias("best"), long(1).alias("first"), long(0).alias("last"))

    def cut(bs):
        run = F.transform(F.array(F.aggregate(bs, zero, step)), lambda r: F.slice(bs, r["first"].cast("int"), (r["last"] - r["first"] + 1).cast("int")))[0]
        return F.array_join(F.transform(run, lambda b: b["text"]), "\n")

    return F.transform(F.array(blocks(html)), cut)[0]
