"""Array elements to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, array: Column, pos: str, item: str, *keep: str | Column) -> DataFrame:
    """One row per element of a computed array, with its position.

    A plain explode makes Spark add a size filter that computes the array again, twice. The outer form with
    a null check computes it once, which matters when it is a regex over a whole text or a parsed file.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def each_struct(df: DataFrame, array: Column, required: str, *keep: str | Column) -> DataFrame:
    """One row per struct of a computed array, its fields as columns; ``required`` is never null in it."""
    return df.select(*keep, F.inline_outer(array)).filter(F.col(required).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column, key: Callable[[Column], Column]) -> Column:
    """The runs of neighbours with one key, as an array of arrays; none for an empty array or null."""

    def cut(a: Column, starts: Column) -> Column:
        return F.transform(starts, lambda s, j: F.slice(a, s + 1, F.coalesce(F.get(starts, j + 1), F.size(a)) - s))

    def first(a: Column) -> Column:
        begins = lambda i: (i == 0) | (key(F.get(a, i)) != key(F.get(a, i - 1)))
        return F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(0), F.size(a) - 1), begins)).otherwise(F.array().cast("array<int>"))

    return let(items, lambda a: let(first(a), lambda starts: cut(a, starts)))
