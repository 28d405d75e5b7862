"""Optional predicates of a search and pruning projections."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows whose columns equal the given values or are among given lists; None and empty lists filter nothing."""
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            if value:
                df = df.filter(F.col(name).isin(*sorted(value, key=str)))
        elif value is not None:
            df = df.filter(F.col(name) == value)
    return df


def list_argument(value) -> list | None:
    """A list, or the JSON text of one; anything else is None."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    return value if isinstance(value, list) else None


def above(df: DataFrame, least: float | None, score: str = "score") -> DataFrame:
    """Scores strictly above a bound; null scores go."""
    return df if least is None else df.filter(F.col(score) > float(least))


def required(c: Column, name: str) -> Column:
    """The value, or an error where it is null."""
    return F.coalesce(c, F.raise_error(F.lit(f"missing {name}")))


def top(df: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The k rows of greatest score, ties by key; null scores last."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(k)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of a totally ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)
