"""Connected components of links between documents, for the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strayfield.session import cut_lineage, drop_table

_PASS = 1 << 17  # links that a task joins up at a time


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node, root`` of the nodes that ``u`` and ``v`` link, root being the smallest; roots themselves are left out."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


def thinned(edges: DataFrame) -> DataFrame:
    """The same components from fewer links: each task replaces what it holds by stars."""
    kind = edges.schema["u"].dataType
    schema = pa.schema([("u", to_arrow_type(kind)), ("v", to_arrow_type(kind))])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size >= _PASS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], schema=schema)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], schema=schema)

    return edges.select("u", "v").mapInArrow(join_up, f"u {kind.simpleString()}, v {kind.simpleString()}")


def _hangs_on_roots(edges: DataFrame) -> bool:
    """Every ``u`` has one ``v``, and no ``v`` is a ``u``."""
    uses = edges.select("u", F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n")))
    by_node = uses.groupBy("u").agg(F.sum("n").alias("as_node"), F.min("n").alias("least"))
    return by_node.where("as_node > 1 or (as_node > 0 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node but the roots; root is the smallest node that links reach. Ids are numbers.

    Stars are built in turn around every node's smallest neighbour, from both directions, which takes O(log^2) rounds at
    most. The smallest neighbour is a map-side minimum that is joined back, so a hub is never gathered in one task. Each
    round's table is written, and the one before it deleted.
    """
    apart = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = cut_lineage(thinned(apart).distinct())
    while not _hangs_on_roots(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        wide = cut_lineage(large)
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        small = wide.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = cut_lineage(thinned(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct())
        drop_table(current)
        drop_table(wide)
        current = following
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
