"""A tree of pivots over a bank of vectors: the index behind exact nearest-neighbour and radius searches.

A node that holds more than two blocks of different vectors is split by up to ``FAN`` pivots, sampled from its own rows; every row goes to
its nearest one. The first level's pivots travel with the tasks, which is a fixed number of vectors; deeper levels are
tables that rows and queries meet by node, so the tree grows with the bank and no task or driver holds it.

A search takes the bound from the data: it first goes down to the nearest leaves that hold k rows and searches them; the
true k-th distance found there is the radius of the second way down. That leaves out a node if the radius ends before its
nearest or beyond its farthest row (from the triangle inequality and the distances to its pivot), or if some other pivot of
its parent is nearer to the query by more than twice the radius (a row is nowhere nearer to another pivot than to its own).

A search may stop at nodes of a full block (``stop``), leaves or not, and those of a parent are packed up to a full block: a query goes to a pack
once, with the list of its nodes there. So its copies follow the bank's full blocks, however small the leaves are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from strayfield.operators import blocks as B
from strayfield.session import cut_lineage, parallelism

FAN = 64  # pivots of a node at most
SPREAD = 2  # pivots for each block of different vectors
LEAVES = 64  # wanted, while leaves hold fewer rows than a full block: a visit of a query costs more than a look at some rows
PIECE = 8192  # rows of one frame that leaves a task: each carries a vector, copied for every child it visits
CHUNK = 2048  # queries that go down from a node together: up to FAN times as many come out at once
DEPTH = 8  # levels at most; node ids then fit a long
SLACK = 1e-6  # relative room for rounding, above the error of a distance from a matrix product

#: children of a node: their pivots, rows, and smallest and largest distance of a row to its pivot
Choice = Callable[[np.ndarray, "Children", pd.DataFrame], np.ndarray]


@dataclass(frozen=True)
class Children:
    node: np.ndarray
    pivot: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaf: np.ndarray
    stop: np.ndarray
    pack: np.ndarray

    @staticmethod
    def of(pdf: pd.DataFrame) -> Children:
        return Children(pdf["bank_id"].to_numpy(np.int64), B.matrix(pdf["vec"]), *(pdf[c].to_numpy() for c in ("n", "low", "high", "leaf", "stop", "pack")))


@dataclass(frozen=True)
class Tree:
    """``placed`` is the bank with its leaf as ``cell``, ``packs`` has the node (``home``) and ``pack`` that hold a ``leaf``. Without a split there are no levels and one cell, 0."""

    placed: DataFrame
    top: Children | None
    levels: list[DataFrame]  # below the first one: cell (the parent), bank_id (the child), vec and what Children holds
    metric: str
    p: float
    rows: int
    packs: DataFrame | None = None

    def packed(self) -> DataFrame:
        """The bank with the node that a packed search stops at (``leaf``), and its pack as ``cell``."""
        columns = [c for c in self.placed.columns if c != "cell"]
        known = self.placed.withColumnRenamed("cell", "_leaf").join(self.packs.withColumnRenamed("leaf", "_leaf"), "_leaf")
        return known.select(*columns, F.col("home").alias("leaf"), F.col("pack").alias("cell"))

    def leaves(self) -> int:
        below = sum(level.where("leaf").count() for level in self.levels)
        return 1 if self.top is None else int(self.top.leaf.sum()) + below


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _sampled(rows: DataFrame, sizes: DataFrame, block_rows: int, level: int) -> DataFrame:
    """``cell, bank_id, vec``: pivots of each cell of ``sizes(cell, kinds)``, numbered as its children.

    A cell's vectors fall into as many hash groups as it wants pivots, and each group gives the vector of its smallest hash:
    a map-side minimum. So a cell has at least one pivot, and no two are equal, however often a vector is repeated.
    """
    wanted = sizes.select("cell", F.least(F.lit(FAN), F.greatest(F.lit(2), F.ceil(F.col("kinds") * SPREAD / F.lit(block_rows)))).cast("int").alias("want"))
    hashed = rows.select("cell", F.xxhash64(F.lit(level), "vec").alias("h"), "bank_id", "vec")
    least = hashed.join(wanted, "cell").groupBy("cell", F.pmod("h", F.col("want")).alias("i")).agg(F.min("h").alias("h"))
    one = hashed.join(least, ["cell", "h"]).groupBy("cell", "i").agg(F.min_by("vec", "bank_id").alias("vec"))
    return one.select("cell", (F.col("cell") * (FAN + 1) + F.col("i") + 1).alias("bank_id"), "vec")


_NOTHING = {"n": 0, "low": 0.0, "high": -1.0, "leaf": True, "kinds": 0}  # a pivot that no row is nearest to


def _stats(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.approx_count_distinct(F.xxhash64("vec")).alias("kinds"))


def _with_packs(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``stop``, ``home`` and ``pack`` of each child in ``nodes(cell, bank_id, n, leaf, ...)``, where ``above(cell, _home, _pack)`` has its parent's.

    What begins in the same full block of a parent's rows is a pack, named by the first of them. A parent has FAN children at most.
    """
    stop = F.col("leaf") | (F.col("n") <= F.lit(B.BLOCK_ROWS))
    before = F.coalesce(F.sum(F.when(F.col("stop"), F.col("n"))).over(W.partitionBy("cell").orderBy("bank_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slotted = nodes.withColumn("stop", stop).withColumn("_slot", F.floor(before / F.lit(B.BLOCK_ROWS)))
    first = F.when(F.col("stop"), F.min("bank_id").over(W.partitionBy("cell", "stop", "_slot")))
    own = slotted.withColumn("home", F.when(F.col("stop"), F.col("bank_id"))).withColumn("pack", first).join(above, "cell")
    pack = F.when(F.col("_home").isNotNull(), F.col("_pack")).otherwise(F.coalesce("pack", "bank_id"))
    return own.withColumn("pack", pack).withColumn("home", F.coalesce("_home", "home")).drop("_slot", "_home", "_pack")


def grow(bank: DataFrame, metric: str, p: float = 1.5, block_rows: int = B.BLOCK_ROWS) -> Tree:
    """Index ``bank(bank_id, vec, ...)``. A bank of one block stays one cell and is not written.

    Where no search can prune, every query visits every leaf. So a block takes at least its share of the bank among ``LEAVES``,
    until it is full (``BLOCK_ROWS``); small blocks alone would make the visits grow with the square of the rows.
    """
    root = bank.withColumn("cell", F.lit(0).cast("long"))
    rows = bank.count()
    block_rows = max(block_rows, min(B.BLOCK_ROWS, rows // LEAVES))
    if rows <= block_rows:
        return Tree(root, None, [], metric, p, rows)
    space = lambda q, v: B.as_metric_space(np.maximum(B.distances(q, v, metric, p), 0.0), metric, p)
    kept = _fields(bank)
    shape = ["query_id" if c == "bank_id" else c for c in bank.columns] + ["cell", "gap"]
    first = _sampled(root, root.sparkSession.range(1).select(F.col("id").alias("cell"), F.lit(rows).alias("kinds")), block_rows, 0).orderBy("bank_id").collect()  # FAN rows at most
    pivot, ids = np.array([r["vec"] for r in first], dtype=np.float64), np.array([r["bank_id"] for r in first])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = space(B.matrix(pdf["vec"]), pivot)
                own = d.argmin(1)
                yield pdf.assign(cell=ids[own], gap=d[np.arange(len(d)), own])

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return q.assign(gap=0.0)[:0][shape]
        b = b.sort_values("bank_id")
        own, gap = [], []
        vectors, children = B.matrix(q["vec"]), B.matrix(b["vec"])
        for lo in range(0, len(q), 4096):
            d = space(vectors[lo : lo + 4096], children)
            own.append(d.argmin(1))
            gap.append(d.min(1))
        return q.assign(cell=b["bank_id"].to_numpy()[np.concatenate(own)], gap=np.concatenate(gap))[shape]

    placed = cut_lineage(bank.mapInPandas(assign, f"{kept}, cell long, gap double"))
    leaf = F.col("kinds") <= 2 * block_rows
    stats = _stats(placed).withColumn("leaf", leaf).toPandas()  # FAN rows at most
    top = pd.DataFrame({"bank_id": ids, "vec": list(pivot)}).merge(stats, left_on="bank_id", right_on="cell", how="left")
    top = top.fillna(_NOTHING).infer_objects(copy=False).astype({"n": np.int64, "leaf": bool})
    top["stop"] = top["leaf"] | (top["n"] <= B.BLOCK_ROWS)
    slot = np.where(top["stop"], top["n"].where(top["stop"], 0).cumsum().shift(fill_value=0) // B.BLOCK_ROWS, -1 - np.arange(len(top)))
    top["pack"] = top.groupby(slot)["bank_id"].transform("min")
    known = [(int(r.bank_id), *((int(r.bank_id), int(r.pack)) if r.stop else (None, None))) for r in top.itertuples()]
    above = root.sparkSession.createDataFrame(known, "cell long, _home long, _pack long")
    packs = [above.join(root.sparkSession.createDataFrame([(int(r.bank_id),) for r in top.itertuples() if r.leaf], "cell long"), "cell").toDF("leaf", "home", "pack")]
    split = [(int(r.bank_id), int(r.kinds)) for r in top.itertuples() if not r.leaf]
    sizes = root.sparkSession.createDataFrame(split, "cell long, kinds long")
    parts: list[DataFrame] = []
    levels: list[DataFrame] = []
    while split:
        rest = placed.drop("gap")
        parts.append(rest.join(sizes, "cell", "left_anti").select(*rest.columns))
        todo = rest.join(sizes.select("cell"), "cell", "left_semi").select(*rest.columns)
        pivots = cut_lineage(_sampled(todo, sizes, block_rows, len(levels) + 1))
        moved = todo.withColumnRenamed("bank_id", "query_id")
        # all pivots of a node meet a row together, or it would be placed once for each block of them
        placed = B.block_join(moved, pivots, nearest, f"{_fields(moved)}, gap double", query_rows=block_rows)
        placed = cut_lineage(placed.withColumnRenamed("query_id", "bank_id"))
        stats = _stats(placed).withColumn("leaf", leaf if len(levels) < DEPTH - 2 else F.lit(True))
        known = pivots.join(stats.withColumnRenamed("cell", "bank_id"), "bank_id", "left")
        levels.append(cut_lineage(_with_packs(known.na.fill(_NOTHING), above)))
        above = levels[-1].select(F.col("bank_id").alias("cell"), F.col("home").alias("_home"), F.col("pack").alias("_pack"))
        packs.append(levels[-1].where("leaf").select(F.col("bank_id").alias("leaf"), "home", "pack"))
        sizes = levels[-1].where("not leaf").select(F.col("bank_id").alias("cell"), "kinds")
        split = sizes.take(1)
    parts.append(placed.drop("gap"))
    whole = functools.reduce(DataFrame.unionByName, parts)
    return Tree(whole, Children.of(top), levels, metric, p, rows, functools.reduce(DataFrame.unionByName, packs))


def _visits(part: pd.DataFrame, row: np.ndarray, child: np.ndarray, children: Children, packed: bool) -> Iterator[pd.DataFrame]:
    if not packed:
        for at in range(0, max(1, len(row)), PIECE):
            to = child[at : at + PIECE]
            yield part.iloc[row[at : at + PIECE]].assign(cell=children.node[to], leaf=children.leaf[to])
        return
    home = np.where(children.stop, children.pack, children.node)
    order = np.lexsort((home[child], row))
    row, child = row[order], child[order]
    home = home[child]
    edges = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (home[1:] != home[:-1]), [True]])) if len(row) else np.zeros(1, np.int64)
    for at in range(0, max(1, len(edges) - 1), PIECE):
        lo, hi = edges[:-1][at : at + PIECE], edges[1:][at : at + PIECE]
        looked = pd.Series([children.node[child[a:z]] for a, z in zip(lo, hi)], dtype=object)
        went = part.iloc[row[lo]]
        yield went.assign(cell=home[lo], leaf=children.stop[child[lo]], leaves=looked.set_axis(went.index))


def descend(queries: DataFrame, tree: Tree, choose: Choice, packed: bool = False) -> DataFrame:
    """``queries(query_id, vec, ...)`` with a row for each leaf (``cell``) that ``choose`` leads to; ``packed``: for each pack (``cell``), with its nodes as ``leaves``."""
    if tree.top is None:
        return queries.withColumn("cell", F.lit(0).cast("long"))
    top, metric, p = tree.top, tree.metric, tree.p

    def picked(pdf: pd.DataFrame, children: Children) -> Iterator[pd.DataFrame]:
        vectors = B.matrix(pdf["vec"])
        for lo in range(0, len(pdf), 4096):
            part = pdf.iloc[lo : lo + 4096]
            d = B.as_metric_space(np.maximum(B.distances(vectors[lo : lo + 4096], children.pivot, metric, p), 0.0), metric, p)
            row, child = np.nonzero(choose(d, children, part))
            yield from _visits(part, row, child, children, packed)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield from picked(pdf, top)

    def below(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return q.assign(cell=0, leaf=True, leaves=None)[:0][names]
        return pd.concat(list(picked(q, Children.of(b.sort_values("bank_id")))), ignore_index=True)[names]

    schema = f"{_fields(queries)}, cell long, leaf boolean" + (", leaves array<long>" if packed else "")
    names = [*queries.columns, "cell", "leaf"] + (["leaves"] if packed else [])
    # few bytes that become a row for each child: dealt to all tasks first, and not merged by size
    here = queries.repartition(parallelism(queries.sparkSession), "query_id").mapInPandas(first, schema)
    out = here.where("leaf")
    for level in tree.levels:
        here = B.block_join(here.where("not leaf").select(*queries.columns, "cell"), level, below, schema, query_rows=CHUNK, full_chunk=CHUNK)
        out = out.unionByName(here.where("leaf"))
    return out.drop("leaf")


def until(k: int) -> Choice:
    """The nearest children that together hold ``k`` rows, or all rows there are."""

    def choose(d: np.ndarray, children: Children, _: pd.DataFrame) -> np.ndarray:
        order = np.where(children.n > 0, d, np.inf).argsort(1, kind="stable")
        held = children.n[order]
        wanted = (np.cumsum(held, axis=1) - held < k) & (held > 0)
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, wanted, 1)
        return out

    return choose


def within(radius: float | None = None) -> Choice:
    """All children that may hold a row within the radius, or within each query's own ``bound``."""

    def choose(d: np.ndarray, children: Children, queries: pd.DataFrame) -> np.ndarray:
        r = np.full(len(d), radius) if radius is not None else queries["bound"].to_numpy(float)
        r, room = r[:, None], SLACK * (1.0 + d)
        # what is not a number rules nothing out
        out = (d - children.high[None, :] > r + room) | (d + r + room < children.low[None, :])
        out |= d - d.min(1, keepdims=True) > 2.0 * (r + room)
        return (children.n > 0)[None, :] & ~out

    return choose
