"""Work on whole images, or on tiles of large ones, as dense blocks inside a task.

Spark deals the pixels by tile and sorts them; a task reads its tiles one after the other and holds those of one Arrow batch, and of
these as many at a time as ``CELLS`` allow. So no pixel is copied for each cell of a window, and nothing is aggregated by pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TILE = 512  # side of a tile in windowed work
CELLS = 4_000_000  # cells of dense blocks held at once
PLACE = ("_ty", "_tx")

Work = Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First row of each run of equal keys; NULL equals NULL."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        code = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def tile_by_tile(px: DataFrame, keys: Sequence[str], work: Work, schema: str, order: Sequence[str] = ()) -> DataFrame:
    """Run ``work(rows, starts)`` on rows of whole groups of ``keys``; ``starts`` is the first row of each of them."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_starts(pa.Table.from_batches([batch]), keys)[-1])
            if held:  # where the group of the last row begins, unless it fills this batch and may have begun before
                ends = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
                if last == 0 and len(_starts(ends, keys)) == 1:
                    held.append(batch)
                    continue
            whole = pa.Table.from_batches([*held, batch.slice(0, last)])
            if whole.num_rows:
                yield from work(whole, _starts(whole, keys))
            held = [batch.slice(last)]
        if held:
            whole = pa.Table.from_batches(held)
            yield from work(whole, _starts(whole, keys))

    return px.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fields(df: DataFrame, names: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.int64()).to_numpy()


def slide(px: DataFrame, how: str, k: int, h: int, w: int, by: Sequence[str], value: str | None = None, tile: int = TILE) -> DataFrame:
    """``any``, ``all``, ``max`` or ``sum`` over the k x k window around every cell (anchor ``k // 2``), where a pixel is in reach.

    For ``all``, cells outside the raster count as set. Absent cells and NULLs take no part in ``max`` and ``sum``, whose ``value`` is a double; a
    window of NULLs alone gives NULL. A tile takes its pixels and the rim that its windows reach into.
    """
    before, after = k // 2, k - 1 - k // 2
    by, names = list(by), [value] if value else []
    high, wide = min(h, tile), min(w, tile)
    hh, ww = high + k - 1, wide + k - 1

    def cover(axis: str, n: int):
        if n <= tile:
            return F.lit(0)
        lo, hi = F.greatest(F.col(axis) - after, F.lit(0)), F.least(F.col(axis) + before, F.lit(n - 1))
        return F.explode(F.sequence(F.floor(lo / tile).cast("int"), F.floor(hi / tile).cast("int")))

    cells = px.select(*by, "y", "x", *names).where(F.col("y").between(-before, h - 1 + after) & F.col("x").between(-before, w - 1 + after))
    cells = cells.withColumn("_ty", cover("y", h)).withColumn("_tx", cover("x", w))
    fold = {"any": np.logical_or, "all": np.logical_and, "max": np.maximum, "sum": np.add}[how]

    def across(block: np.ndarray, join) -> np.ndarray:
        rows = block[:, :high].copy()
        for d in range(1, k):
            join(rows, block[:, d : d + high], out=rows)
        out = rows[:, :, :wide].copy()
        for d in range(1, k):
            join(out, rows[:, :, d : d + wide], out=out)
        return out

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, table.num_rows))
        ty, tx = column(table, "_ty")[starts] * tile, column(table, "_tx")[starts] * tile
        group = np.repeat(np.arange(len(starts)), sizes)
        y, x = column(table, "y") - ty[group] + before, column(table, "x") - tx[group] + before
        step = max(1, CELLS // (hh * ww))
        for lo in range(0, len(starts), step):
            hi = min(lo + step, len(starts))
            rows = slice(starts[lo], starts[hi] if hi < len(starts) else table.num_rows)
            at = (group[rows] - lo, y[rows], x[rows])
            block = np.zeros((hi - lo, hh, ww), dtype=bool)
            block[at] = True
            if how == "all":
                r, c = ty[lo:hi, None] - before + np.arange(hh), tx[lo:hi, None] - before + np.arange(ww)
                block |= ((r < 0) | (r >= h))[:, :, None] | ((c < 0) | (c >= w))[:, None, :]
            reach = across(block, fold if how == "all" else np.logical_or)
            reach &= (ty[lo:hi, None] + np.arange(high) < h)[:, :, None] & (tx[lo:hi, None] + np.arange(wide) < w)[:, None, :]
            g, i, j = np.nonzero(reach)
            out = [table.column(b).take(pa.array(starts[lo + g])).combine_chunks() for b in by]
            out += [pa.array(v).cast(table.schema.field(n).type) for n, v in (("y", i + ty[lo + g]), ("x", j + tx[lo + g]))]
            if value:
                column_ = table.column(value).slice(rows.start, rows.stop - rows.start)
                known = column_.is_valid().to_numpy()
                numbers = np.full((hi - lo, hh, ww), -np.inf if how == "max" else 0.0)
                numbers[tuple(a[known] for a in at)] = column_.drop_null().to_numpy()
                empty = None
                if not known.all():
                    block[tuple(a[~known] for a in at)] = False
                    empty = ~across(block, np.logical_or)[g, i, j]
                out.append(pa.array(across(numbers, fold)[g, i, j], mask=empty))
            yield pa.RecordBatch.from_arrays([o.combine_chunks() if isinstance(o, pa.ChunkedArray) else o for o in out], names=[*by, "y", "x", *names])

    return tile_by_tile(cells, [*by, *PLACE], work, fields(px, [*by, "y", "x", *names]))
