"""Scalar helpers on strings, dates, numbers, maps and JSON used by the item operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strayfield.operators.ordering import as_col


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def parent_name(path: str | Column) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -2)


def strip_extension(name: str | Column) -> Column:
    return F.regexp_replace(as_col(name), r"\.[^.]*$", "")


def join_ids(ids: str | Column) -> Column:
    return F.array_join(as_col(ids), "_")


def zero_pad(n: str | Column, width: int) -> Column:
    return F.lpad(as_col(n).cast("string"), width, "0")


def signed_round(x: str | Column, digits: int) -> Column:
    """``round`` of a double as C and SQL engines give it: what rounds to zero from below is -0.0, which Spark's own makes 0.0."""
    return F.round(F.abs(as_col(x)), digits) * F.signum(as_col(x))


def stamp(ts: str | Column) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd_HH_mm_ss")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(as_col(end)) - F.unix_micros(as_col(start))) / F.lit(1e6)


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(as_col(x), F.lit(lo)), F.lit(hi))


def signed_log10(x: str | Column) -> Column:
    """``-sign(x) * log10(|x|)``, and 0 for 0."""
    col = as_col(x)
    return F.when(col == 0, F.lit(0.0)).otherwise(-F.signum(col) * F.log10(F.abs(col)))


def merge_maps(left: str | Column, right: str | Column) -> Column:
    """Merge two maps; the right one wins on equal keys."""
    a, b = as_col(left), as_col(right)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def map_get(m: str | Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(as_col(m), key), default)


def json_field(col: str | Column, field: str, kind: str = "bigint") -> Column:
    return F.from_json(as_col(col), f"{field} {kind}")[field]
