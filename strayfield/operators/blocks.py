"""Distance work in blocks: the shared machinery of nearest-neighbour and radius operators.

Pairs never become rows. Bank vectors fall into cells (leaves of a pivot tree, inverted lists, or given groups); cells
are cut into blocks and their visitors into chunks of bounded size, and one (block, chunk) pair is one small matrix
product inside a task. A cell of any size is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strayfield.session import parallelism

BLOCK_ROWS = 32768
MOST_BLOCKS = 16  # of a cell, while they hold fewer than BLOCK_ROWS rows each
TILE = 4_000_000  # elements of one distance matrix held in memory
STRIP = 1_000_000  # of one matrix of lower bounds, of which two are held
ROUNDING = 1e-11  # of sums over a row's elements, relative; far above what doubles lose
CACHED = 32768  # elements of a distance matrix that a core's cache holds with their scratch space
SHORTS = (8, 8192)  # visitors and rows of a matrix of short integers that a core's cache holds with its scratch space
STEPS = 32  # of a short integer for half of the range, at least
SINGLE = 2.0**-24  # relative rounding of a single-precision number


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def distances(q: np.ndarray, b: np.ndarray, metric: str, p: float = 1.5) -> np.ndarray:
    """Distance matrix; the L2 form is squared and the Minkowski form keeps its power."""
    if metric == "l2sq":
        d = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (q @ b.T)
        return np.maximum(d, 0.0, out=d)
    if metric == "cosine":
        return 1.0 - unit(q) @ unit(b).T
    out = np.zeros((len(q), len(b)))
    columns = np.ascontiguousarray(b.T)
    wide = max(1, min(len(b), CACHED // 4))
    high = CACHED // wide
    for lo in range(0, len(q), high):
        for at in range(0, len(b), wide):
            part, rows, bank = out[lo : lo + high, at : at + wide], q[lo : lo + high], columns[:, at : at + wide]
            gap, root = np.empty(part.shape), np.empty(part.shape)
            for j in range(q.shape[1]):
                np.subtract(rows[:, j, None], bank[j], out=gap)
                np.abs(gap, out=gap)
                part += gap if metric == "l1" else _raised(gap, p, root)
    return out


def _raised(gap: np.ndarray, p: float, scratch: np.ndarray | None = None) -> np.ndarray:
    """``gap ** p``; the usual 1.5 by a square root, which takes a fraction of the time."""
    if p != 1.5:
        return gap**p
    root = np.sqrt(gap, out=scratch)
    root *= gap
    return root


def lower_bounds(q: np.ndarray, b: np.ndarray, p: float) -> np.ndarray | None:
    """A matrix that is nowhere above the sum of ``gap ** p``, p under 2, from matrix products alone; None where none is to be had.

    With S(r) the sum of ``gap ** r``, log S is convex in r, so S(p) is at least ``S(2) ** ((4 - p) / 2) / S(4) ** ((2 - p) / 2)``. Both sums
    are polynomials of the two rows. They are taken about the bank's mean, and each is moved by more than its rounding.
    """
    if not 0 < p < 2:
        return None
    with np.errstate(all="ignore"):
        centre = b.mean(0)
        q, b = q - centre, b - centre
        q2, b2 = q * q, b * b
        of_q, of_b = np.stack([q2.sum(1), (q2 * q2).sum(1), np.ones(len(q))], 1), np.stack([b2.sum(1), (b2 * b2).sum(1), np.ones(len(b))], 1)
        if not (np.isfinite(of_q).all() and np.isfinite(of_b).all()):
            return None
        less, more = 1.0 - ROUNDING, 1.0 + 8.0 * ROUNDING
        low = np.hstack([q, less * of_q[:, [0, 2]]]) @ np.hstack([-2.0 * b, of_b[:, [2, 0]]]).T
        high = np.hstack([q2 * q, q2, q, more * of_q[:, [1, 2]]]) @ np.hstack([-4.0 * b, 6.0 * b2, -4.0 * (b2 * b), of_b[:, [2, 1]]]).T
        np.maximum(low, 0.0, out=low)
        np.maximum(high, 1e-300, out=high)
        if p == 1.5:
            np.divide(low, high, out=high)
            np.sqrt(np.sqrt(high, out=high), out=high)
        else:  # low / sqrt(high) does not overflow
            np.divide(low, np.sqrt(high, out=high), out=high)
            high **= 2.0 - p
            low **= p / 2.0
        high *= low
        return high


class Steps:
    """L1 distances of a block's rows from below, in whole steps of a unit: vectors are rounded to short integers, whose gaps are added up as such.

    Rounding moves a gap by a step at most, and what lies beyond the range is drawn to its end, which shortens gaps. A sum that does not fit
    wraps to a smaller one.
    """

    def __init__(self, b: np.ndarray):
        dims = b.shape[1]
        self.most = min(16383, 65535 // (2 * max(1, dims)))
        with np.errstate(all="ignore"):
            self.centre = b.mean(0)
            gap = b - self.centre
            wide = min(np.abs(gap).max(initial=0.0), 6.0 * np.sqrt(np.square(gap).mean()))
            self.unit = wide / self.most
            moved = 8.0 * dims * np.finfo(float).eps * np.abs(b).max(initial=0.0) / self.unit  # by the subtraction of the centre
        self.usable = self.most >= STEPS and np.isfinite(moved) and moved < dims and 1e-290 < self.unit < 1e290
        self.spare = 2 * dims + 4
        self.columns = np.ascontiguousarray(self._short(b).T) if self.usable else None

    def _short(self, m: np.ndarray) -> np.ndarray:
        return np.rint(np.clip((m - self.centre) / self.unit, -self.most, self.most)).astype(np.int16)

    def of(self, q: np.ndarray) -> np.ndarray | None:
        if not self.usable or not np.isfinite(q).all() or np.abs(q).max(initial=0.0) > 1e6 * (self.unit * self.most + np.abs(self.centre).max()):
            return None
        rows, n = self._short(q)[:, :, None], self.columns.shape[1]
        out = np.zeros((len(q), n), np.uint16)
        high, wide = SHORTS
        gap = np.empty((high, min(wide, n)), np.int16)
        for lo in range(0, len(q), high):
            for at in range(0, n, wide):
                visitors, bank = rows[lo : lo + high], self.columns[:, at : at + wide]
                part, scratch = out[lo : lo + high, at : at + wide], gap[: len(visitors), : bank.shape[1]]
                total = np.zeros(scratch.shape, np.uint16)
                for j in range(len(bank)):
                    np.subtract(visitors[:, j], bank[j], out=scratch)
                    np.abs(scratch, out=scratch)
                    total += scratch.view(np.uint16)
                part[:] = total
        return out

    def level(self, top: np.ndarray) -> np.ndarray:
        """What a row within the distance ``top`` has at most."""
        with np.errstate(all="ignore"):
            steps = np.floor(top * (1.0 + 1e-9) / self.unit) + self.spare
        return np.where(steps < 65535, np.maximum(steps, 0.0), 65535).astype(np.uint16)


class Powers:
    """``lower_bounds`` on a block's rows in single precision: its columns are laid out once, and every sum is moved by more than its rounding."""

    def __init__(self, b: np.ndarray, p: float):
        dims, self.p = b.shape[1], p
        self.less, self.more = 1.0 - 4.0 * (dims + 16) * SINGLE, 1.0 + 16.0 * (3 * dims + 32) * SINGLE
        with np.errstate(all="ignore"):
            self.centre = b.mean(0)
            self.size = np.sqrt(np.square(b - self.centre).mean())
            moved = np.abs(b).max(initial=0.0) * np.finfo(float).eps / self.size
            # values between 1e-100 and 1e100 can be raised without loss in double precision, too
            self.usable = 0 < p < 2 and self.less > 0.5 and np.isfinite(moved) and moved < SINGLE and 1e-100 < self.size < 1e100
            if self.usable:
                b = self._scaled(b)
                self.usable = np.abs(b).max(initial=0.0) < 1e4
        if self.usable:
            b2 = b * b
            second, fourth, one = b2.sum(1)[:, None], (b2 * b2).sum(1)[:, None], np.ones((len(b), 1))
            self.low = np.ascontiguousarray(np.hstack([-2.0 * b, one, self.less * second]).T, dtype=np.float32)
            self.high = np.ascontiguousarray(np.hstack([-4.0 * b, 6.0 * b2, -4.0 * (b2 * b), one, self.more * fourth]).T, dtype=np.float32)

    def _scaled(self, m: np.ndarray) -> np.ndarray:
        return (m - self.centre) / self.size

    def of(self, q: np.ndarray) -> np.ndarray | None:
        if not self.usable:
            return None
        with np.errstate(all="ignore"):
            q = self._scaled(q)
            if not np.abs(q).max(initial=0.0) < 1e4:
                return None
            q2 = q * q
            one = np.ones((len(q), 1))
            low = np.hstack([q, self.less * q2.sum(1)[:, None], one]).astype(np.float32) @ self.low
            high = np.hstack([q2 * q, q2, q, self.more * (q2 * q2).sum(1)[:, None], one]).astype(np.float32) @ self.high
            np.maximum(low, 0.0, out=low)
            np.maximum(high, 1e-30, out=high)
            if self.p == 1.5:
                np.divide(low, high, out=high)
                np.sqrt(np.sqrt(high, out=high), out=high)
            else:
                np.divide(low, np.sqrt(high, out=high), out=high)
                high **= 2.0 - self.p
                low **= self.p / 2.0
            high *= low
            return high

    def level(self, top: np.ndarray) -> np.ndarray:
        """What a row within the distance ``top`` has at most."""
        with np.errstate(all="ignore"):
            return (top * (1.0 + 1e-4) / self.size**self.p + 1e-20).astype(np.float32)


class Doubles:
    """``lower_bounds`` itself, for rows that the others do not take."""

    def __init__(self, b: np.ndarray, p: float):
        self.b, self.p = b, p

    def of(self, q: np.ndarray) -> np.ndarray | None:
        return lower_bounds(q, self.b, self.p)

    def level(self, top: np.ndarray) -> np.ndarray:
        return top + 1e-9 * (1.0 + np.abs(top))


def bounds_below(b: np.ndarray, metric: str, p: float) -> list[Steps | Powers | Doubles]:
    """Lower bounds of distances to the rows of a block, the fastest first: ``of(visitors)`` is a matrix or None, and a row whose entry is over
    ``level(top)`` is farther than ``top``."""
    if metric not in ("l1", "lp"):
        return []
    return [Steps(b) if metric == "l1" else Powers(b, p), Doubles(b, 1.0 if metric == "l1" else p)]


def paired(q: np.ndarray, b: np.ndarray, metric: str, p: float = 1.5) -> np.ndarray:
    """Exact distances of aligned rows, so that equal vectors give exactly equal distances."""
    if metric == "l2sq":
        return ((q - b) ** 2).sum(1)
    if metric == "cosine":
        return 1.0 - (unit(q) * unit(b)).sum(1)
    gap = np.abs(q - b)
    return (gap if metric == "l1" else _raised(gap, p)).sum(1)


def as_metric_space(d: np.ndarray, metric: str, p: float = 1.5) -> np.ndarray:
    """Turn operator distances into ones that obey the triangle inequality."""
    if metric == "l2sq":
        return np.sqrt(d)
    if metric == "cosine":
        return np.sqrt(np.maximum(2.0 * d, 0.0))
    return d if metric == "l1" else d ** (1.0 / p)


@dataclass(frozen=True)
class Cells:
    """Centres of inverted lists with their sizes: as many as the caller asks for."""

    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    metric: str
    p: float

    def to_pivots(self, q: np.ndarray) -> np.ndarray:
        return as_metric_space(np.maximum(distances(q, self.pivots, self.metric, self.p), 0.0), self.metric, self.p)

    def strips(self, rows: int) -> Iterator[slice]:
        """Row ranges whose distances to all pivots fit into one matrix of bounded size."""
        step = max(1, TILE // max(1, len(self.pivots)))
        return (slice(lo, lo + step) for lo in range(0, rows, step))


def visit(queries: DataFrame, cells: Cells | None, reach: Callable[[np.ndarray, Cells], np.ndarray]) -> DataFrame:
    """One row per (query, cell to search). ``reach`` gives the mask of cells from the pivot distances."""
    if cells is None:
        return queries.withColumn("cell", F.lit(0).cast("long"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in cells.strips(len(pdf)):
                part = pdf.iloc[at]
                row, cell = np.nonzero(reach(cells.to_pivots(matrix(part["vec"])), cells))
                yield part.iloc[row].assign(cell=cell.astype(np.int64))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(choose, f"{kept}, cell long")


def probe_reach(probes: int, k: int) -> Callable[[np.ndarray, Cells], np.ndarray]:
    """The approximate search: the ``probes`` nearest cells, and more where these hold fewer than ``k`` rows."""

    def reach(d: np.ndarray, cells: Cells) -> np.ndarray:
        order = np.where(cells.count[None, :] > 0, d, np.inf).argsort(1)
        held = cells.count[order]
        wanted = (np.arange(d.shape[1])[None, :] < probes) | (np.cumsum(held, axis=1) - held < k)
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, wanted, 1)
        return out & (cells.count > 0)[None, :]

    return reach


def block_join(
    visits: DataFrame,
    bank: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = BLOCK_ROWS,
    cell: str = "cell",
    full_chunk: int = BLOCK_ROWS,
    few_cells: bool = False,
) -> DataFrame:
    """Run ``kernel(visitors, block)`` on every (block, chunk) of every cell that has both.

    Every row of a cell is copied once for each block or chunk of the other side, so beyond ``MOST_BLOCKS`` pieces it is the
    pieces that grow, up to ``BLOCK_ROWS`` rows (chunks: ``full_chunk``), and only then their number. With ``few_cells``, no more than the bank has full blocks, their sizes go to all
    tasks, and neither side is dealt out twice.
    """

    def pieces(rows: int, full: int) -> Column:
        n = F.count(F.lit(1))
        return F.greatest(F.ceil(n / F.lit(max(rows, full))), F.least(F.ceil(n / F.lit(rows)), F.lit(MOST_BLOCKS))).cast("int")

    blocks = bank.groupBy(cell).agg(pieces(block_rows, BLOCK_ROWS).alias("_nb"))
    chunks = visits.groupBy(cell).agg(pieces(query_rows, full_chunk).alias("_nc"))
    sizes = blocks.join(chunks, cell)
    sizes = F.broadcast(sizes) if few_cells else sizes
    q = (
        visits.join(sizes, cell)
        .withColumn("_chunk", F.pmod(F.xxhash64("query_id"), F.col("_nc")).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .drop("_nb", "_nc")
    )
    b = (
        bank.join(sizes, cell)
        .withColumn("_block", F.pmod(F.xxhash64("bank_id"), F.col("_nb")).cast("int"))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
        .drop("_nb", "_nc")
    )
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides may come from one table
    at = [cell, "_block", "_chunk"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return kernel(left, right)

    # a visitor's copies compress to few bytes, by which pieces would be merged into few tasks; their work is in the distances
    tasks = parallelism(bank.sparkSession)
    return q.repartition(tasks, *at).groupBy(*at).cogroup(b.repartition(tasks, *at).groupBy(*at)).applyInPandas(run, schema)
