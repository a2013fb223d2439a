"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SPACE = " \t\n\x0b\x0c\r"  # the white space of all word rules: [\x20\x09-\x0D]
SPACES = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def replace(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns at the end; an input column of the same name, in any case, gives way."""
    new = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new], *[e.alias(c) for c, e in columns.items()])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Maximal runs of non-space characters, in order; none for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def unit(*seed: Column) -> Column:
    """A number in [0, 1) that depends on ``seed`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*seed), 11).cast("double") * F.lit(2.0**-53)


def bucket_count(rows: int) -> int:
    """Buckets of about 4,096 rows each; at least 64, so that small tables are spread as well."""
    return max(64, rows // 4096)


def lay_out(df: DataFrame, group: str, size: str, order: str, totals: DataFrame, bucket: str, start: str, rank: str) -> DataFrame:
    """Give every row its place in the stream of its group: units before it (``start``), rows before it (``rank``).

    The stream of a group runs through its hash buckets in turn, and by ``order`` inside a bucket, so that a group of
    any size is windowed in pieces. ``totals`` has one row per (group, bucket) with columns ``size`` and ``n``; only
    this small table is windowed by group. Rows keep the partitioning of the window for the join: no second shuffle.
    """
    before = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    g, b, units, n = fresh(df, "lay_group", "lay_bucket", "lay_units", "lay_rows")
    offsets = totals.select(
        F.col(group).alias(g), F.col(bucket).alias(b), F.coalesce(F.sum("size").over(before), F.lit(0)).alias(units), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(n)
    )
    inside = W.partitionBy(group, bucket).orderBy(order)
    local = df.withColumns(
        {
            start: F.coalesce(F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            rank: F.row_number().over(inside) - 1,
        }
    )
    joined = local.join(offsets, F.col(group).eqNullSafe(F.col(g)) & (F.col(bucket) == F.col(b)))
    return joined.withColumns({start: F.col(start) + F.col(units), rank: F.col(rank) + F.col(n)}).drop(g, b, units, n)


def bucket_totals(df: DataFrame, group: str, size: str, bucket: str) -> DataFrame:
    """Units and rows of each (group, bucket): combined map-side, one small row each."""
    return df.groupBy(group, bucket).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in (columns or df.columns)])
