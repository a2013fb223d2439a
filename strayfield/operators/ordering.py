"""Ranks, running totals and moving frames that never put one key's rows into one task.

A window with ``partitionBy(key)`` sorts all rows of a key in a single task, and a window without keys
sorts the whole table there. The functions below cut the global order ``(by..., order...)`` into slices
with sampled cut points, work inside a slice, and carry totals from slice to slice through a table that
has one row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from strayfield.session import parallelism

SLICE_ROWS = 1 << 20  # rows of a slice, about
MAX_SLICES = 1 << 14  # beyond that slices hold more rows, and their sorts spill
PER_SLICE = 64  # sampled keys for each slice: slices then differ by an eighth of their size, typically


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(df: DataFrame, c: str | Column) -> Column:
    """A sort key as long, double or string, so that cut points survive the trip through Python."""
    col = as_col(c)
    kind = df.select(col.alias("k")).schema["k"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return col.cast("double")
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return col.cast("long")
    return col.cast("string")


def _sort_key(df: DataFrame, cols: Sequence[str | Column]) -> list[Column]:
    return [_plain(df, c).alias(f"k{i}") for i, c in enumerate(cols)]


def cut_points(df: DataFrame, keys: list[Column], slices: int) -> list[tuple]:
    """``slices - 1`` cut points of the order ``keys``, from a hash sample of ``PER_SLICE`` rows per slice.

    Rows fall into hash groups and every group contributes its smallest hash: a uniform sample that is combined
    map-side and repeatable. The sample, ``PER_SLICE * MAX_SLICES`` keys at most, is ranked in a task; only the cut points,
    ``MAX_SLICES`` at most, come to the driver, however many rows there are.
    """
    names = [f"k{i}" for i in range(len(keys))]
    sample = (
        df.select(*keys)
        .withColumn("h", F.xxhash64(*names))
        .groupBy(F.pmod("h", F.lit(PER_SLICE * slices)).alias("g"))
        .agg(*[F.min_by(n, "h").alias(n) for n in names])
    )
    whole = W.partitionBy(F.lit(0))
    ranked = sample.select(*names, (F.row_number().over(whole.orderBy(*names)) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("n"))
    part = F.floor(F.col("i") * slices / F.col("n"))
    cuts = ranked.where((F.col("i") > 0) & (part > F.floor((F.col("i") - 1) * slices / F.col("n"))))
    return [tuple(r) for r in cuts.orderBy("i").select(*names).collect()]


def slice_index(bounds: Column, n: int, keys: list[Column]) -> Column:
    """Number of the ``n`` sorted ``bounds`` at or before the row, by binary search."""
    row = F.struct(*keys)
    step, steps = 1, []
    while step <= n:
        steps.append(step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda lo, s: F.when((lo + s <= F.lit(n)) & (F.get(bounds, lo + s - 1) <= row), lo + s).otherwise(lo),
    )


def with_slice(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    slices: int | None = None,
    name: str = "_slice",
    sample: DataFrame | None = None,
) -> DataFrame:
    """Add a slice number that never decreases along ``order`` within ``by``.

    Groups may follow each other in any order, so a hash stands for ``by``. ``sample`` is a cheaper table
    with the same key columns to take the cut points from; any cut points give a right result. The number of
    slices follows the number of rows. Rows that tie on the whole order are told apart by a hash of the row, so
    that a value held by a third of all rows is spread over slices as well; their order is free anyway.
    """
    slices = slices or min(MAX_SLICES, max(8, 2 * parallelism(df.sparkSession), df.count() // SLICE_ROWS))
    group = [F.xxhash64(*by)] if by else []
    own = _sort_key(df, [*group, *order])
    if sample is None:
        simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        own.append(F.xxhash64(*[F.col(f"`{c}`") for c in simple]).alias(f"k{len(own)}"))
    points = cut_points(df if sample is None else sample, own, slices)
    if not points:
        return df.withColumn(name, F.lit(0))
    names = [f"k{i}" for i in range(len(own))]
    table = df.sparkSession.createDataFrame(points, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.select(*own).schema.fields)]))
    bounds = table.select(F.array_sort(F.collect_list(F.struct(*names)))).scalar()  # kept out of the plan
    marked = df.withColumn("_bounds", bounds)
    return marked.withColumn(name, slice_index(F.col("_bounds"), len(points), own)).drop("_bounds")


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys come from ``df``."""
    renamed = other.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in keys], *[F.col(f"`{c}`") for c in other.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
    return df.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def carry_join(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row per (key, slice) to its rows; AQE broadcasts it when it proves small at run time."""
    return null_safe_join(df, carried, keys)


def row_index(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    name: str = "rn",
    slices: int | None = None,
) -> DataFrame:
    """1-based position of every row within ``by`` along ``order`` (ascending; negate to descend)."""
    by = list(by)
    cut = with_slice(df, by, order, slices)
    here = [*by, "_slice"]
    local = cut.withColumn("_local", F.row_number().over(W.partitionBy(*here).orderBy(*[as_col(c) for c in order])))
    sizes = local.groupBy(*here).agg(F.max("_local").cast("long").alias("_n"))
    before = sizes.select(*here, _before(F.sum("_n"), by, sizes).alias("_before"))
    return (
        carry_join(local, before, here)
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_local"))
        .drop("_slice", "_local", "_before")
    )


def _before(agg: Column, by: Sequence[str], sizes: DataFrame) -> Column:
    # at most one row per slice and key: bounded by the number of slices
    return agg.over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))


def group_size(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Attach the group's row count through a map-side combined aggregate instead of a window."""
    return attach(df, df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)), by)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one-row-per-key ``stats`` onto ``df``.

    A NULL key is a key like any other. Nothing is hinted: AQE measures ``stats`` and broadcasts it below the threshold, else runs a sort-merge
    join whose skewed partitions it splits. Without keys the stats are one row, read as scalar subqueries.
    """
    by = list(by)
    if not by:
        row = stats.select(F.struct(*stats.columns)).scalar()  # one subquery, however many columns
        return df.select("*", *[row[c].alias(c) for c in stats.columns])
    return null_safe_join(df, stats, by, how)


def running(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str | Column] | None = None,
    maxima: dict[str, str | Column] | None = None,
    by: Sequence[str] = (),
    slices: int | None = None,
    sample: DataFrame | None = None,
    totals_as: dict[str, str] | None = None,
) -> DataFrame:
    """Running sums / maxima over ``unboundedPreceding..currentRow`` of ``order`` within ``by``.

    ``totals_as`` names a column for the group total of a running sum: it falls out of the slice totals.
    """
    by, sums, maxima = list(by), dict(sums or {}), dict(maxima or {})
    cut = with_slice(df, by, order, slices, sample=sample)
    here = [*by, "_slice"]
    ordered = W.partitionBy(*here).orderBy(*[as_col(c) for c in order])
    w = ordered.rowsBetween(W.unboundedPreceding, 0)
    local = cut.select(
        "*",
        F.row_number().over(ordered).alias("_at"),
        *[F.sum(as_col(c)).over(w).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(as_col(c)).over(w).alias(f"_m_{n}") for n, c in maxima.items()],
    )
    # the last running value of a slice is its total: read from the window's own exchange
    totals = local.groupBy(*here).agg(
        *[F.max_by(f"_s_{n}", "_at").alias(f"_ts_{n}") for n in sums],
        *[F.max(f"_m_{n}").alias(f"_tm_{n}") for n in maxima],
    )
    before = totals.select(
        *here,
        *[_before(F.sum(f"_ts_{n}"), by, totals).alias(f"_ps_{n}") for n in sums],
        *[_before(F.max(f"_tm_{n}"), by, totals).alias(f"_pm_{n}") for n in maxima],
        *[F.sum(f"_ts_{n}").over(W.partitionBy(*(by or [F.lit(0)]))).alias(t) for n, t in (totals_as or {}).items()],
    )
    out = carry_join(local, before, here)
    for n in sums:
        out = out.withColumn(n, F.coalesce(f"_ps_{n}", F.lit(0)) + F.col(f"_s_{n}"))
    for n in maxima:
        out = out.withColumn(n, F.greatest(f"_pm_{n}", f"_m_{n}"))
    keep = [*df.columns, *[c for c in [*sums, *maxima, *(totals_as or {}).values()] if c not in df.columns]]
    return out.select(*keep)


def framed(
    df: DataFrame,
    order: Sequence[str | Column],
    width: int,
    exprs: dict[str, Column],
    by: Sequence[str] = (),
    chunk: int = 1 << 14,
) -> DataFrame:
    """Aggregates over the frame of the last ``width`` rows, given as unbound aggregate columns.

    Rows are numbered, cut into chunks of ``chunk`` rows, and the last ``width - 1`` rows of a chunk are
    copied into the next one, so every frame is complete inside its chunk.
    """
    chunk = max(chunk, 2 * width)
    by = list(by)
    ranked = row_index(df, order, by, "_rn")
    at = F.floor((F.col("_rn") - 1) / F.lit(chunk)).cast("long")
    spill = (F.col("_rn") - 1) % F.lit(chunk) >= F.lit(chunk - (width - 1))
    both = ranked.withColumn("_at", at).withColumn(
        "_chunk", F.explode(F.when(spill, F.array(F.col("_at"), F.col("_at") + 1)).otherwise(F.array("_at")))
    )
    w = W.partitionBy(*by, "_chunk").orderBy("_rn").rowsBetween(-(width - 1), 0)
    return (
        both.select("*", *[e.over(w).alias(n) for n, e in exprs.items()])
        .where("_chunk = _at")
        .drop("_rn", "_at", "_chunk")
    )


def top_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rn", salts: int = 32) -> DataFrame:
    """The first ``k`` rows per key, in two rounds so that a hot key is cut by many tasks first.

    Round one keeps ``k`` per (key, salt); a row beyond that cannot be among the first ``k``. Round two
    ranks at most ``k * salts`` rows per key.
    """
    by = list(by)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = (
        df.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(W.partitionBy(*by, "_salt").orderBy(*order)))
        .where(F.col("_r") <= k)
        .drop("_r", "_salt")
    )
    return first.withColumn(name, F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).where(
        F.col(name) <= k
    )
