"""Column functions on scalars and lists: coercions, buckets, labels."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
TRUE_WORDS = ("1", "true", "yes", "y", "t")
CLAIM_RELATIONS = ("MATCH", "REFINEMENT", "CONTRADICTION", "UNMATCHED")
RESPONSE_CATEGORIES = ("SAME_CLAIMS", "UPDATED_OR_SPECIFIED", "CORRECTED", "NEW_CLAIMS")
OLD_RELATION, OTHER_LABEL = "NEW_CLAIM", "OTHER"


def clean_groups(groups: Column) -> Column:
    """Query groups without blank queries and empty groups, queries stripped."""
    return F.filter(F.transform(groups, lambda g: F.filter(F.transform(g, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))), lambda g: F.size(g) > 0)


def query_count(groups: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.flatten(groups), lambda q: q.isNotNull() & (F.trim(q) != ""))), F.lit(0)).cast("long")


def last_of(items: Column, *fallbacks: Column) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(-1)), *fallbacks)


def primary_model(models: Column) -> Column:
    """Last named model, else Unknown."""
    return F.coalesce(F.try_element_at(F.filter(models, lambda m: m.isNotNull() & (m != "")), F.lit(-1)), F.lit("Unknown"))


def most_common(items: Column) -> Column:
    """Most frequent element, the first on ties."""
    counted = F.transform(F.array_distinct(items), lambda x: F.struct(F.size(F.filter(items, lambda y: y == x)).alias("n"), (-F.array_position(items, x)).alias("at"), x.alias("x")))
    return F.array_max(counted)["x"]


def bucket(n: Column, cap: int, plus: bool = True) -> Column:
    """'1', '2' ... and 'cap+' from cap on."""
    return F.when(n >= cap, F.lit(f"{cap}+" if plus else str(cap))).otherwise(n.cast("string"))


def outcome_key(base: Column, other: Column) -> Column:
    called = lambda c: F.when(c, "called").otherwise("not_called")
    return F.concat(F.lit("base_"), called(base), F.lit("_and_model_"), called(other))


def parse_bool(value: Column) -> Column:
    """Truth of a value of any type: numbers are true unless zero, NaN or null, other values if they are a truth word."""
    number = F.typeof(value).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    x = value.try_cast("double")
    return F.when(number, F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))).otherwise(F.coalesce(F.lower(strip(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False)))


def strip(text: Column) -> Column:
    """Text without the blanks around it, line feeds and tabs too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def finite(value: Column) -> Column:
    x = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def month_start(time: Column) -> Column:
    return F.date_format(F.date_trunc("month", time), "yyyy-MM-dd")


def relation(raw: Column) -> Column:
    """A claim's relation as judges name it, the old name by the new one; null where there is none."""
    r = strip(raw)
    return F.when(r == OLD_RELATION, "UNMATCHED").when(r != "", r)


def among(label: Column, allowed: tuple[str, ...]) -> Column:
    """The label, OTHER if it isn't one of the allowed ones; null stays."""
    return F.when(label.isin(*allowed), label).when(label.isNotNull(), OTHER_LABEL)


_JUDGMENT = "struct<category:string,explanation:string,alignments:array<struct<claim_a:string,no_web_claim:string,relation:string,claim_b:string,web_claim:string>>>"
_ALIGNMENT = "array<struct<claim_a:string,relation:string,claim_b:string>>"


def judgment(raw: Column) -> Column:
    """A judge's comparison of claims (JSON) as (category, explanation, alignments of claim_a, relation, claim_b), null if nothing in it is usable.

    The older keys of claims are read where the newer ones are missing; alignments with nothing in them go.
    """
    j = F.from_json(raw, _JUDGMENT)
    said = lambda *names: lambda a: F.coalesce(strip(F.coalesce(*[a[n] for n in names])), F.lit(""))
    one = lambda a: F.struct(said("claim_a", "no_web_claim")(a).alias("claim_a"), F.coalesce(relation(a["relation"]), F.lit("")).alias("relation"), said("claim_b", "web_claim")(a).alias("claim_b"))
    lines = F.filter(F.transform(F.coalesce(j["alignments"], F.array().cast(_JUDGMENT[_JUDGMENT.index("array") : -1])), one), lambda a: (a["claim_a"] != "") | (a["relation"] != "") | (a["claim_b"] != ""))
    out = F.struct(F.coalesce(strip(j["category"]), F.lit("")).alias("category"), F.coalesce(strip(j["explanation"]), F.lit("")).alias("explanation"), lines.cast(_ALIGNMENT).alias("alignments"))
    return F.when((out["category"] != "") | (out["explanation"] != "") | (F.size(out["alignments"]) > 0), out)


def factuality(raw: Column) -> Column:
    """A judge's score of a claim (JSON) as (label, score, reasoning): older keys where the newer ones are missing, 0 for a score that is none."""
    j = F.from_json(raw, "struct<score:string,rating:string,label:string,verdict:string,reasoning:string,reason:string>")
    score = F.coalesce(j["score"], j["rating"])
    number = F.when(score == "true", 1.0).otherwise(F.coalesce(strip(score).try_cast("double"), F.lit(0.0)))
    said = lambda *names: F.coalesce(strip(F.coalesce(*[j[n] for n in names])), F.lit(""))
    return F.struct(said("label", "verdict").alias("label"), number.alias("score"), said("reasoning", "reason").alias("reasoning"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def coerce_list(value: pd.Series) -> pd.Series:
    """A list stored as text, JSON or Python literal; scalars become one element, failures an empty list."""

    def one(v):
        if v is None:
            return []
        for read in (json.loads, ast.literal_eval):
            try:
                got = read(v)
            except (ValueError, SyntaxError):
                continue
            got = list(got) if isinstance(got, (list, tuple, set)) else [got]
            return [x if isinstance(x, str) or x is None else json.dumps(x) for x in got]
        return [v] if v.strip() else []

    return pd.Series([one(v) for v in value], dtype=object)
