"""Secret scans with multipart credential linking, with DataFrame functions only.

Three base kinds, leftmost and non-overlapping per kind: key-value assignments, cloud access
identifiers and long hexadecimal strings. Spans come from cutting a text at the matches of a
pattern: pieces and matches alternate, so running sums of their lengths are the positions, in
code points. Weak candidates (bare 40-character secrets and service endpoints) say little
alone. They are linked by an interval join within a scope, the paragraph: a secret-shaped string
is reported only if an access identifier is in the same scope; an endpoint only if an access
identifier and a secret (base assignment or linked string) are. A reach, in code points, may narrow
the links further; there is none unless the caller gives one. The
join runs inside each document's row over its own spans, as sweeps forward and backward that carry
the nearest part, so no document's spans meet another's, no two spans of a document are paired, and
nothing is shuffled.

Defined cases: a null text is scanned as empty; empty texts have no spans and the digest of the
empty string. Repeated rows each get a row. Columns besides id and text are ignored by scan()
and kept by redact(). An empty table gives an empty result. Ties at one start go by kind, in the
order listed in KINDS. Very long texts are scanned whole, near linearly in their spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The base patterns and the least length of what they must hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 16
#: Runs of hexadecimal digits are maximal, so asking for the length inside the pattern finds the same ones.
HEX = r"[0-9a-f]{32,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
BASE_KINDS = KINDS[:3]
SCOPE = r"\n[\x20\t\r]*\n"
#: Items to a chunk of a pass over spans.
CHUNK = 256
_FAR = 1 << 40

_SPAN = "struct<start:long,end:long>"
_ITEM = "struct<start:long,rank:int,end:long,scope:long,near:boolean,clear:boolean>"
_TAGGED = "array<struct<start:long,rank:int,end:long>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _pass(items: Column, state: Column, kind: str, step, chunk: int = CHUNK) -> Column:
    """Outputs of one pass over items: step(state, x) gives the next state and an array of outputs of type kind.

    Arrays are copied when they grow, so outputs are gathered by chunks of items: time is near
    linear in their number, where one growing array would make it quadratic.
    """

    def inner(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc, part):
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), inner)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def chunked(it):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(it) - 1) / F.lit(chunk)).cast("int")), lambda k: F.slice(it, k * chunk + 1, chunk))
        zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(it) > 0, F.aggregate(parts, zero, outer, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(f"array<{kind}>"))

    return _let(items, chunked)


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """Start and end of every match; keep(match) may drop matches after they have taken their place."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = _let(found, lambda f: F.zip_with(F.slice(gaps, 1, F.size(f)), f, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), (keep(m) if keep else F.lit(True)).alias("ok"))))

    def step(at, x):
        start = at + x["gap"]
        end = start + x["len"]
        return end, F.when(x["ok"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(_none())

    return _pass(both, F.lit(0).cast("long"), _SPAN, step)


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _flag(items: Column, part, base, reach: int) -> Column:
    """items, in order, with near: part(y) holds for an item y of x's scope within reach; and clear: no item with base(y) overlaps x.

    An interval join by sweeping. Parts don't overlap each other, so the nearest one before and the
    nearest one after x decide: one pass forward, one backward.
    """

    def sweep(it, far, meets, overlaps, better):
        def step(s, x):
            near = x["near"] | ((s["scope"] == x["scope"]) & meets(s["at"], x))
            clear = x["clear"] & ~overlaps(s["base"], x)
            after = F.struct(
                F.when(part(x), x["scope"]).otherwise(s["scope"]).alias("scope"), F.when(part(x), better(x)).otherwise(s["at"]).alias("at"),
                (F.when(base(x), F.greatest(s["base"], x["end"]) if far < 0 else F.least(s["base"], x["start"])).otherwise(s["base"])).alias("base"),
            )
            out = F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["scope"].alias("scope"), near.alias("near"), clear.alias("clear"))
            return after, F.array(out)

        edge = F.lit(far).cast("long")
        return _pass(it, F.struct(F.lit(-1).cast("long").alias("scope"), edge.alias("at"), edge.alias("base")), _ITEM, step)

    ahead = sweep(items, -_FAR, lambda at, x: at >= x["start"] - reach, lambda b, x: b > x["start"], lambda x: x["end"])
    return F.reverse(sweep(F.reverse(ahead), _FAR, lambda at, x: at <= x["end"] + reach, lambda b, x: b < x["end"], lambda x: x["start"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """One row per row of docs: id, the base spans by kind, the linked weak spans and all spans in order.

    A span is (kind, start, end), code points, end exclusive. Without reach the scope alone bounds the links.
    """
    reach = _FAR if reach is None else reach
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("_t"))
    # whole-text tests that cost a byte search skip the pattern machinery for texts without a chance
    low = F.lower("_t")
    hint = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    value = lambda m: F.length(F.regexp_extract(m, "^(?:" + ASSIGN + ")$", 2)) >= ASSIGN_LEAST
    d = d.select(
        "*",
        F.when(hint, _spans(F.col("_t"), ASSIGN, value)).otherwise(_none()).alias("assign"),
        F.when(F.col("_t").contains("AKIA"), _spans(F.col("_t"), ACCESS, lambda m: F.length(m) >= ACCESS_LEAST)).otherwise(_none()).alias("access"),
        F.when(F.col("_t").rlike(HEX), _spans(F.col("_t"), HEX)).otherwise(_none()).alias("hex"),
    )
    # complementary parts: without an access identifier nothing weak can be reported
    some = F.size("access") > 0
    d = d.select(
        "*",
        F.when(some, _spans(F.col("_t"), WEAK_SECRET)).otherwise(_none()).alias("weak"),
        F.when(some, _spans(F.col("_t"), ENDPOINT)).otherwise(_none()).alias("points"),
        F.when(some, _spans(F.col("_t"), SCOPE)).otherwise(_none()).alias("breaks"),
    )
    flat = lambda k, name: F.transform(F.col(name), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end")))
    tags = lambda which: [flat(i, n) for i, n in which]
    kinds = list(enumerate(("assign", "access", "hex", "weak", "points")))
    base = F.array_sort(F.concat(*tags(kinds[:3])))
    # scope breaks take their place among the spans by where they end, before spans that start there
    ends = F.transform(F.col("breaks"), lambda x: F.struct(x["end"].alias("start"), F.lit(-1).alias("rank"), x["end"].alias("end")))

    def numbered(scope, x):
        is_break = x["rank"] < 0
        item = F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), scope.alias("scope"), F.lit(False).alias("near"), F.lit(True).alias("clear"))
        return scope + is_break.cast("long"), F.when(is_break, F.array().cast(f"array<{_ITEM}>")).otherwise(F.array(item))

    items = F.when(some, _pass(F.array_sort(F.concat(ends, *tags(kinds))), F.lit(0).cast("long"), _ITEM, numbered))
    by_access = _flag(items, lambda x: x["rank"] == 1, lambda x: x["rank"] < 3, reach)
    d = d.select("id", "assign", "access", "hex", base.alias("base"), by_access.alias("_items"))
    # weak secrets near an identifier stay, and so do endpoints near one, if a secret is near them too
    left = F.transform(F.filter("_items", lambda x: (x["rank"] == 0) | (x["rank"] >= 3) & x["near"] & x["clear"]), lambda x: x.withField("near", F.lit(False)))
    by_secret = _flag(left, lambda x: x["rank"].isin(0, 3), lambda x: F.lit(False), reach)
    added = F.transform(F.filter(by_secret, lambda x: (x["rank"] == 3) | (x["rank"] == 4) & x["near"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    d = d.select("id", "assign", "access", "hex", "base", F.coalesce(added, F.array().cast(_TAGGED)).alias("added"))
    return d.select("*", F.array_sort(F.concat("base", "added")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Pieces cut out of one stretch of a text.
STRETCH = 256


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]", reach: int | None = None) -> DataFrame:
    """docs with every span of the scan replaced by mark in the text, overlapping spans as one; other columns stay.

    The scan is evaluated on the row itself, so nothing is joined back and repeated ids do no harm.
    """
    key = "_scan_row"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(key), F.col(text_col).alias("_scan_text"))
    s = scan(packed, key, "_scan_text", reach)
    text = F.coalesce(F.col("id")[text_col], F.lit(""))

    kind = "struct<from:bigint,to:bigint>"

    def step(at, x):  # what stays between spans
        return F.greatest(at, x["end"]), F.when(x["start"] < at, F.array().cast(f"array<{kind}>")).otherwise(F.array(F.struct(at.alias("from"), x["start"].alias("to"))))

    def cut(part):  # a place is found by counting from the start, so pieces are cut out of a stretch of the text
        low = part[0]["from"]
        stretch = F.substring(text, (low + 1).cast("int"), (F.element_at(part, -1)["to"] - low).cast("int"))
        return _let(stretch, lambda w: F.transform(part, lambda r: F.substring(w, (r["from"] - low + 1).cast("int"), (r["to"] - r["from"]).cast("int"))))

    end = F.array_max(F.transform("spans", lambda x: x["end"]))
    kept = F.concat(_pass(F.col("spans"), F.lit(0).cast("long"), kind, step), F.array(F.struct(end.alias("from"), F.length(text).cast("long").alias("to"))))
    parts = _let(kept, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / F.lit(STRETCH)).cast("int")), lambda k: F.slice(r, k * STRETCH + 1, STRETCH)))
    new = F.when(F.size("spans") > 0, F.array_join(F.flatten(F.transform(parts, cut)), mark)).otherwise(F.col("id")[text_col])
    return s.select(*[(new if c == text_col else F.col("id")[c]).alias(c) for c in docs.columns])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    s = scan(table(spark, sf_dir, "documents"))
    count = lambda c: F.size(c).cast("long")
    return s.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )
