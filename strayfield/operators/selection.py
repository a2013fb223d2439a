"""The k nearest rows of each row within its group, as a sum and a k-th distance, without a list of neighbours.

A group of one block is one matrix product and one partial sort. In larger groups rounds of distance bins close in on each
row's k-th distance: a block adds up, for every visitor, count and sum of the distances below an interval and in each of
its bins, so one short row per visitor and block travels, whatever k. The interval becomes the bin that holds the k-th
distance, until that bin holds just the distances still wanted, or equal ones. Everything is counted anew in each round, so
rounding at an interval's edge never loses or doubles a distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strayfield.operators import blocks as B
from strayfield.operators.ordering import attach, row_index, running
from strayfield.session import cut_lineage

BINS = 32
SHARES = 64  # blocks of all cells together, besides one for each cell, while they hold fewer than a full block
FINE = 1e-12  # relative width at which distances count as equal


def _sides(rows: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    return rows.select("cell", "query_id", "vec", "k", *extra), rows.select("cell", F.col("query_id").alias("bank_id"), "vec", "w")


def _strips(q: pd.DataFrame, b: pd.DataFrame, metric: str, p: float) -> Iterator[tuple[slice, np.ndarray]]:
    vectors, bank = B.matrix(q["vec"]), B.matrix(b["vec"])
    step = max(1, B.TILE // max(1, len(bank)))
    for lo in range(0, len(vectors), step):
        at = slice(lo, lo + step)
        yield at, np.maximum(B.distances(vectors[at], bank, metric, p), 0.0)


def _direct(d: np.ndarray, k: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the ``k`` smallest of each row, and the largest of them; a column counts ``w`` times."""
    most = int(k.max())
    if w.max() == 1 and most < d.shape[1]:
        d = np.sort(np.partition(d, most - 1, axis=1)[:, :most], axis=1)
        times = np.ones_like(d)
    else:
        if most < d.shape[1]:  # each column counts at least once
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            d, w = np.take_along_axis(d, near, 1), w[near]
        else:
            w = np.broadcast_to(w, d.shape)
        order = d.argsort(1, kind="stable")
        d, times = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1).astype(float)
    before = np.cumsum(times, axis=1) - times
    used = np.clip(k[:, None] - before, 0.0, times)
    return (d * used).sum(1), np.where(used > 0, d, 0.0).max(1)


def nearest_sums(rows: DataFrame, metric: str = "l2sq", p: float = 1.5, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """``cell, query_id, total, kth`` for ``rows(cell, query_id, vec, k, w)``, each row itself included.

    ``total`` is the sum of the ``k`` smallest distances to rows of the same cell, and ``kth`` the last of them. ``w`` says
    how many copies a row stands for; ``k`` is at most the copies in the cell. Ids are unique within a cell.
    """
    rows = cut_lineage(rows)
    # a block or chunk takes its share of all rows at least, until it is full: in each round a pair of them is a call, however small
    block_rows = max(block_rows, min(B.BLOCK_ROWS, rows.count() // SHARES))
    kind, cell = rows.schema["query_id"].dataType.simpleString(), rows.schema["cell"].dataType.simpleString()
    keys = ["cell", "query_id"]
    head = f"cell {cell}, query_id {kind}"
    many = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block_rows).select("cell")

    def whole(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return q[keys][:0].assign(total=0.0, kth=0.0)
        k, w = q["k"].to_numpy(), b["w"].to_numpy()
        both = [_direct(d, k[at], w) for at, d in _strips(q, b, metric, p)]
        return q[keys].assign(total=np.concatenate([t for t, _ in both]), kth=np.concatenate([t for _, t in both]))

    out = B.block_join(*_sides(rows.join(many, "cell", "left_anti")), whole, f"{head}, total double, kth double", block_rows, block_rows)
    if many.isEmpty():
        return out
    wide = cut_lineage(rows.join(many, "cell", "left_semi"))

    def reach(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The k-th distance within a block bounds the one within the cell; without k rows the largest one may be needed."""
        if q.empty or b.empty:
            return q[keys][:0].assign(near=0.0, far=0.0)
        k, w = q["k"].to_numpy(), b["w"].to_numpy()
        near = np.concatenate([_direct(d, np.minimum(k[at], w.sum()), w)[1] for at, d in _strips(q, b, metric, p)])
        far = np.concatenate([d.max(1) for _, d in _strips(q, b, metric, p)])
        return q[keys].assign(near=np.where(k <= w.sum(), near, np.inf), far=far)

    spans = B.block_join(*_sides(wide), reach, f"{head}, near double, far double", block_rows, block_rows)
    high = F.least(F.min("near"), F.max("far"))
    # widths are compared with the largest distance there is, so that equal distances of zero end the rounds as well
    state = spans.groupBy(*keys).agg((high * (1 + 1e-9) + 1e-200).alias("hi"), (F.max("far") + 1e-200).alias("scale"))
    state = cut_lineage(state.withColumn("lo", -F.col("hi") * FINE))

    def tally(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return q[keys][:0].assign(below=0.0, below_sum=0.0, n=None, s=None)
        w = b["w"].to_numpy(float)
        lo, hi = q["lo"].to_numpy()[:, None], q["hi"].to_numpy()[:, None]
        found: list[list[np.ndarray]] = [[], [], [], []]
        for at, d in _strips(q, b, metric, p):
            a, z = lo[at], hi[at]
            under, inside = d <= a, (d > a) & (d <= z)
            row, col = np.nonzero(inside)
            slot = np.clip(np.ceil((d[row, col] - a[row, 0]) / (z - a)[row, 0] * BINS) - 1, 0, BINS - 1).astype(np.int64) + row * BINS
            size = len(d) * BINS
            found[0].append((under * w).sum(1))
            found[1].append((np.where(under, d, 0.0) * w).sum(1))
            found[2].append(np.bincount(slot, w[col], size).reshape(-1, BINS))
            found[3].append(np.bincount(slot, w[col] * d[row, col], size).reshape(-1, BINS))
        below, below_sum, n, s = (np.concatenate(x) for x in found)
        return q[keys].assign(below=below, below_sum=below_sum, n=list(n), s=list(s))

    def close_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n, s, k = np.stack(pdf["n"]), np.stack(pdf["s"]), pdf["k"].to_numpy(float)
            i = np.arange(len(pdf))
            held = pdf["below"].to_numpy()[:, None] + np.cumsum(n, axis=1)
            slot = np.minimum((held < k[:, None]).sum(1), BINS - 1)
            before = held[i, slot] - n[i, slot]
            total = pdf["below_sum"].to_numpy() + np.cumsum(s, axis=1)[i, slot] - s[i, slot]
            lo, width = pdf["lo"].to_numpy(), (pdf["hi"].to_numpy() - pdf["lo"].to_numpy()) / BINS
            left, high = k - before, lo + (slot + 1) * width
            value = np.divide(s[i, slot], n[i, slot], out=high.copy(), where=n[i, slot] > 0)
            done = (n[i, slot] == left) | (width <= FINE * pdf["scale"].to_numpy())
            total = total + np.where(n[i, slot] == left, s[i, slot], left * value)
            yield pdf[keys].assign(lo=lo + slot * width, hi=high, scale=pdf["scale"], total=total, done=done)

    closed, bank = None, _sides(wide)[1]
    while True:
        visits = _sides(wide.join(state, keys), "lo", "hi", "scale")[0]  # rows still open, against all
        part = B.block_join(visits, bank, tally, f"{head}, below double, below_sum double, n array<double>, s array<double>", block_rows, block_rows)
        added = [F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(BINS)]).alias(c) for c in ("n", "s")]
        summed = part.groupBy(*keys).agg(F.sum("below").alias("below"), F.sum("below_sum").alias("below_sum"), *added)
        known = summed.join(visits.select(*keys, "k", "lo", "hi", "scale"), keys)
        step = cut_lineage(known.mapInPandas(close_in, f"{head}, lo double, hi double, scale double, total double, done boolean"))
        settled = step.where("done").select(*keys, "hi", "total")
        closed = settled if closed is None else closed.unionByName(settled)
        state = step.where("not done").select(*keys, "lo", "hi", "scale")
        if state.isEmpty():
            break

    def widest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return q[keys][:0].assign(kth=0.0)
        hi = q["hi"].to_numpy()[:, None]
        return q[keys].assign(kth=np.concatenate([np.where(d <= hi[at], d, 0.0).max(1) for at, d in _strips(q, b, metric, p)]))

    visits = _sides(wide.join(closed, keys), "hi")[0]
    last = B.block_join(visits, bank, widest, f"{head}, kth double", block_rows, block_rows).groupBy(*keys).agg(F.max("kth").alias("kth"))
    return out.unionByName(closed.select(*keys, "total").join(last, keys))


def kth_on_a_line(rows: DataFrame, k: DataFrame) -> DataFrame:
    """``value, n, d``: for each value of ``rows(id, value)``, its copies and the distance of its ``k``-th nearest row, itself included.

    ``k`` is a table of one number. On a line the ``k`` nearest rows are neighbours in order: of all runs of ``k`` rows it is one of the two
    whose midpoints lie on either side of the value. So two ranks and joins by rank replace the comparison of pairs. A NULL value is near nothing.
    """
    ranked = cut_lineage(row_index(rows.where("value is not null"), ["value", "id"], name="i").select("i", "value"))
    ends = attach(ranked, k, []).where("i >= k").select((F.col("i") - F.col("k") + 1).alias("i"), F.col("value").alias("high"))
    runs = cut_lineage(ranked.select("i", F.col("value").alias("low")).join(ends, "i"))
    values = ranked.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # doubled midpoints and doubled values in one order; a value comes before the runs whose midpoint it is
    marks = runs.select((F.col("low") + F.col("high")).alias("at"), F.lit(1).alias("run"), F.col("i").alias("id"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n"))
    asked = values.select((F.col("value") * 2).alias("at"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("id"), "value", "n")
    placed = running(marks.unionByName(asked), ["at", "run", "id"], {"i": F.col("run").cast("long")}).where("run = 0").select("value", "n", "i")
    left = runs.select("i", "low")
    right = runs.select((F.col("i") - 1).alias("i"), "high")
    both = placed.join(left, "i", "left").join(right, "i", "left")
    return both.select("value", "n", F.least(F.col("value") - F.col("low"), F.col("high") - F.col("value")).alias("d"))
