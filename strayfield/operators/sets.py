"""Set operations on row lists, masks, maps and arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strayfield.operators.ordering import row_index


def union_rows(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def mask_or(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id", "y", "x")) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def mask_and(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id", "y", "x")) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` minus those of ``b``, duplicates counted."""
    return a.exceptAll(b)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def distinct_elements(col: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.col(col) if isinstance(col, str) else col))


def zip_rows(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Pair two lists by position; the shorter one decides the length. Column names must differ."""
    return row_index(a, order_a, name="position").join(row_index(b, order_b, name="position"), "position")
