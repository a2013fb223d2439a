"""Ordered operators: moving and running statistics, ranks, boundaries, folds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strayfield.operators.ordering import as_col, framed, null_safe_join, row_index, running, top_per_key
from strayfield.session import cut_lineage

CHUNK = 1 << 14
FAN = 64  # chunk tables that one task composes


def topk(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group with their 1-based rank ``rn``."""
    return top_per_key(df, by, order, k)


def moving_avg(df: DataFrame, col: str, order: Sequence[str], n: int = 20, by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    return framed(df, order, n, {"moving_avg": F.avg(col)}, by, chunk)


def running_avg(df: DataFrame, col: str, order: Sequence[str], weight: str | Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    w = F.lit(1.0) if weight is None else as_col(weight).cast("double")
    out = running(df, order, {"_sum": F.col(col) * w, "_weight": w}, by=by)
    return out.withColumn("running_avg", F.col("_sum") / F.nullif("_weight", F.lit(0.0))).drop("_sum", "_weight")


def running_best(df: DataFrame, col: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Best value so far and the position where it first occurred."""
    best = F.struct(F.col(col).alias("value"), (-F.col(order)).alias("at"))
    out = running(df, [order], maxima={"_best": best}, by=by)
    return out.withColumn("best", F.col("_best.value")).withColumn("best_at", -F.col("_best.at")).drop("_best")


def gap_seconds(df: DataFrame, ts: str, by: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Seconds since the previous row of the key; NULL on its first row."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    out = framed(df, [ts, *tie], 2, {"_prev": F.first(micros), "_seen": F.count(F.lit(1))}, by)
    gap = F.when(F.col("_seen") == 2, (micros - F.col("_prev")) / F.lit(1e6))
    return out.withColumn("gap", gap).drop("_prev", "_seen")


def area_rank(px: DataFrame, image: str = "image_id", mask: str = "mask_id") -> DataFrame:
    """Masks of an image ranked by pixel count, largest first."""
    areas = px.groupBy(image, mask).agg(F.count(F.lit(1)).alias("area"))
    return row_index(areas, [-F.col("area"), mask], [image], "rank")


def boundary_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the stretches of equal ``keys`` in arrival order, from 1."""
    key = F.struct(*keys)
    seen = framed(df, order, 2, {"_prev": F.first(key), "_n": F.count(F.lit(1))})
    flagged = seen.withColumn("_new", F.when((F.col("_n") == 1) | (F.col("_prev") != key), 1).otherwise(0))
    return running(flagged, order, {"group_no": "_new"}).drop("_prev", "_n", "_new")


def _affine_scan(df: DataFrame, by: list[str], rows: int, chunk: int) -> DataFrame:
    """Prefix composition of the maps e -> a * e + b along ``pos``; ``value`` is the result from e = 0.

    Chunks are scanned side by side; their totals are scanned the same way and carried in.
    """
    chunked = df.select(*by, "pos", "a", "b", F.floor(F.col("pos") / F.lit(chunk)).cast("long").alias("_chunk"))
    types = {f.name: f.dataType.simpleString() for f in chunked.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in [*by, "_chunk", "pos"]) + ", _a double, _b double"

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        a, b = pdf["a"].to_numpy(float).copy(), pdf["b"].to_numpy(float).copy()
        step = 1
        while step < len(a):  # each pass composes twice as many maps
            a[step:], b[step:] = a[step:] * a[:-step], a[step:] * b[:-step] + b[step:]
            step *= 2
        return pdf[[*by, "_chunk", "pos"]].assign(_a=a, _b=b)

    local = chunked.groupBy(*by, "_chunk").applyInPandas(scan, schema)
    if rows <= chunk:
        return local.select(*by, "pos", F.col("_b").alias("value"))
    last = local.groupBy(*by, "_chunk").agg(F.max_by(F.struct("_a", "_b"), "pos").alias("t"))
    totals = last.select(*by, F.col("_chunk").alias("pos"), F.col("t._a").alias("a"), F.col("t._b").alias("b"))
    carried = _affine_scan(totals, by, -(-rows // chunk), chunk).select(
        *by, (F.col("pos") + 1).alias("_chunk"), F.col("value").alias("_carry")
    )
    joined = null_safe_join(local, carried, [*by, "_chunk"], "left")
    return joined.select(*by, "pos", (F.col("_b") + F.col("_a") * F.coalesce("_carry", F.lit(0.0))).alias("value"))


def ema(
    df: DataFrame, col: str, order: Sequence[str], decay: float, ramp: bool = True, by: Sequence[str] = (), chunk: int = CHUNK
) -> DataFrame:
    """Exponential moving average e_i = d_i * e_(i-1) + (1 - d_i) * x_i with d_i = min(1 - 1/(i+1), decay).

    The first value starts the average. The recurrence is a chain of affine maps, so chunks are folded in
    parallel and then linked.
    """
    by = list(by)
    ranked = cut_lineage(row_index(df, order, by, "_i").withColumn("pos", F.col("_i") - 1).drop("_i"))  # read three times
    d = F.least(F.lit(1.0) - F.lit(1.0) / (F.col("pos") + 1), F.lit(decay)) if ramp else F.lit(decay)
    d = F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(d)
    maps = ranked.select(*by, "pos", d.alias("a"), ((1 - d) * F.col(col)).alias("b"))
    rows = maps.agg(F.max("pos")).first()[0]
    values = _affine_scan(maps, by, (rows if rows is not None else -1) + 1, chunk)
    return null_safe_join(ranked, values.withColumnRenamed("value", "ema"), [*by, "pos"]).drop("pos")


def _closings(counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Running counts from 0, and for each row the row that closes the batch that starts behind it (past the end: none)."""
    total = np.r_[0, np.cumsum(counts)]
    after = np.searchsorted(total[1:], total[1:] + threshold)
    return total, np.r_[np.maximum(after, np.arange(1, len(counts) + 1)), len(counts)]


def greedy_batches(
    df: DataFrame, threshold: int, order: str, count: str = "n", by: Sequence[str] = (), chunk: int = CHUNK
) -> DataFrame:
    """Fill a batch row by row until its count reaches ``threshold``, then start the next one (``batch``, from 0).

    The running count is a small state (0..threshold-1). Each chunk is summarised as a table "state in ->
    (state out, batches closed)". Tables compose, so they are chained in levels of ``FAN`` chunks, and chunks then
    replay from their true state. Inside a chunk, the row that closes a batch follows from running counts by search.
    Counts are not negative.
    """
    by, columns = list(by), list(df.columns)
    ranked = cut_lineage(row_index(df, [order], by, "_i"))
    chunked = ranked.withColumn("_chunk", F.floor((F.col("_i") - 1) / F.lit(chunk)).cast("long"))
    types = {f.name: f.dataType.simpleString() for f in chunked.schema.fields}
    keys = ", ".join(f"{c} {types[c]}" for c in [*by, "_chunk"])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf.sort_values("_i")[count].to_numpy(np.int64)
        n, (total, then) = len(counts), _closings(counts, threshold)
        closed, last, jump = (then < n).astype(np.int64), np.where(then < n, then, np.arange(n + 1)), then
        while (jump < n).any():  # pointers double: batches closed after a row, and the last row that closes one
            closed, last, jump = closed + closed[jump], last[last], jump[jump]
        first = np.searchsorted(total[1:], threshold - np.arange(threshold))
        some = first < n
        at = np.minimum(first, n)
        out = np.where(some, total[n] - total[np.minimum(last[at] + 1, n)], np.arange(threshold) + total[n])
        return pdf[[*by, "_chunk"]].head(1).assign(out=[out.astype(np.int64)], closed=[np.where(some, closed[at] + 1, 0).astype(np.int64)])

    tables = cut_lineage(chunked.groupBy(*by, "_chunk").applyInPandas(summarise, f"{keys}, out array<long>, closed array<long>"))
    starts = _chain(tables, by, keys, tables.agg(F.max("_chunk")).first()[0] or 0)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        counts, state = pdf[count].to_numpy(np.int64), int(pdf["_state"].iloc[0])
        total, then = _closings(counts, threshold)
        closes, at = np.zeros(len(counts) + 1, np.int64), int(np.searchsorted(total[1:], threshold - state))
        while at < len(counts):  # one step per batch
            closes[at + 1] = 1
            at = int(then[at])
        return pdf[columns].assign(batch=int(pdf["_batch"].iloc[0]) + np.cumsum(closes)[:-1])

    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", batch long"
    return null_safe_join(chunked, starts, [*by, "_chunk"]).groupBy(*by, "_chunk").applyInPandas(replay, schema)


def _chain(tables: DataFrame, by: list[str], keys: str, last: int) -> DataFrame:
    """``_state`` and ``_batch`` at the start of each chunk. A task composes ``FAN`` tables; their products are chained
    the same way, one level up, and carried back in."""
    up = tables.withColumn("_up", F.floor(F.col("_chunk") / FAN).cast("long"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        out, closed = np.arange(len(pdf["out"].iloc[0])), np.zeros(len(pdf["out"].iloc[0]), np.int64)
        for o, c in zip(pdf["out"], pdf["closed"]):
            out, closed = np.asarray(o)[out], closed + np.asarray(c)[out]
        return pdf[[*by]].head(1).assign(_chunk=pdf["_up"].iloc[0], out=[out], closed=[closed])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        state, batch, starts = int(pdf["_state"].iloc[0]), int(pdf["_batch"].iloc[0]), []
        for out, closed in zip(pdf["out"], pdf["closed"]):
            starts.append((state, batch))
            state, batch = int(out[state]), batch + int(closed[state])
        return pdf[[*by, "_chunk"]].assign(_state=[s for s, _ in starts], _batch=[b for _, b in starts])

    if last < FAN:
        begun = up.withColumns({"_state": F.lit(0).cast("long"), "_batch": F.lit(0).cast("long")})
    else:
        higher = up.groupBy(*by, "_up").applyInPandas(compose, f"{keys}, out array<long>, closed array<long>")
        above = _chain(cut_lineage(higher), by, keys, last // FAN).withColumnRenamed("_chunk", "_up")
        begun = null_safe_join(up, above, [*by, "_up"])
    return begun.groupBy(*by, "_up").applyInPandas(deal, f"{keys}, _state long, _batch long")
