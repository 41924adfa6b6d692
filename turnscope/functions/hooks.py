"""Hooks for what needs a model or the network: results come as tables, or from a function given here.

Each hook takes a plain Python function over a batch and returns the column or table that the
operators expect. Nothing in this package calls out by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_hook(f: Callable[[list[str]], list[str]]):
    """Column function from a batch function on texts: language, lemma, stem, readability, PDF text."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(f(["" if v is None else v for v in s]), dtype=object)

    return run


def embedding_hook(f: Callable[[list[str]], list[list[float]]]):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in f(["" if v is None else v for v in s])], dtype=object)

    return run


def judge(pairs: DataFrame, f: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """pairs through a batch judge (entailment, factuality, specificity, comparison): whatever rows it returns, in schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(pairs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_pylist(f(b.to_pylist()), schema=arrow)

    return pairs.mapInArrow(run, schema)


def memoized(keys: DataFrame, cache: DataFrame | None, key: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers for keys: cached ones, and computed ones for the rest; each distinct key is computed once."""
    wanted = keys.select(*key).distinct()
    if cache is None:
        return compute(wanted)
    fresh = compute(wanted.join(cache.select(*key), key, "left_anti"))
    return cache.join(wanted, key, "left_semi").unionByName(fresh)
