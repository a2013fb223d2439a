"""Resharding that moves the fewest bytes.

Old shards hold known bytes, new shards have capacities, and a byte that stays in its shard costs nothing while a byte
that moves costs one, wherever it goes: a minimum-cost flow on the graph old shard -> new shard. With these costs the
flow is solved in closed form. First every old shard that lives on sends what fits, min(bytes, capacity), along its free
arc; a flow that sent less there would have to move those bytes at cost one and could be improved by exchanging arcs.
All arcs left cost one, so any flow that empties the surplus into the room left is optimal: surplus and room are laid
end to end and matched. The problem has one number per shard, so it is solved on the driver; documents never go there.

Each flow is a run of an old shard's byte stream. A document goes where its middle byte lies, so a new shard is off its
capacity by half a document for each of its runs at most. ``rewritten`` then names the shards that gain or lose
documents: only their files are written again.

This law is ``bytes``: a group of equal texts is spread, not kept together. Edge cases: a NULL text has size 1. Rows
with a NULL old shard are an old shard of their own, the last. Repeated rows are placed one by one. An empty table gives
an empty result. Input columns with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegralType

from strayfield.llm.common import bucket_count, bucket_totals, fresh, lay_out, replace, row_hash
from strayfield.session import cut_lineage
from strayfield.sources.sinks import _fs

SHARDS = 8
NUMBERED = 1_000_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one for the end of the record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fewest_moves(old: Sequence[int], room: Sequence[int]) -> list[tuple[int, int, int]]:
    """The flow ``(old shard, new shard, bytes)`` of least cost; old shard i may stay as new shard i for free.

    Flows of an old shard come in the order of its stream. ``sum(room)`` must be ``sum(old)``.
    """
    stay = [min(b, room[i]) if i < len(room) else 0 for i, b in enumerate(old)]
    left = [c - (stay[i] if i < len(stay) else 0) for i, c in enumerate(room)]
    flows, to = [(i, i, b) for i, b in enumerate(stay) if b], 0
    for i, b in enumerate(old):
        rest = b - stay[i]
        while rest:
            while not left[to]:
                to += 1
            moved = min(rest, left[to])
            flows.append((i, to, moved))
            rest, left[to] = rest - moved, left[to] - moved
    return sorted(flows, key=lambda f: f[0])  # stable: what stays is first in its old shard's stream


def resharded(df: DataFrame, old: str, size: Column | None = None, key: Sequence[str] = ("doc_id", "text"), shards: int = SHARDS, room: Sequence[float] | None = None) -> DataFrame:
    """``df`` with ``size``, ``old_shard``, ``shard``, ``slot`` (gapless from 0 in each shard) and ``moved``.

    ``old`` is the column that names the old shard of a row; old shards are numbered by their names, NULL last (a column
    of whole numbers from 0 to below ``NUMBERED`` is the number itself), and one numbered below ``shards`` may stay. ``size`` is the size of a row, that of ``text`` if not given; a row's place in
    its old shard's stream comes from a hash of ``key``, so reruns agree. ``room`` gives the capacities in proportion; equal ones if not given.
    """
    name, hashed, bucket, start, rank, run = fresh(df, "old_name", "row_hash", "row_bucket", "row_start", "row_rank", "row_run")
    buckets = bucket_count(df.count())
    sized = df.withColumns({name: F.col(f"`{old}`").cast("string"), run: size_of(F.col("text")) if size is None else size, hashed: row_hash(df, key)})
    sized = sized.withColumn(bucket, F.pmod(F.col(hashed), F.lit(buckets)).cast("int"))
    totals = cut_lineage(bucket_totals(sized, name, run, bucket))
    sizes = totals.groupBy(name).agg(F.sum("size").alias("b")).orderBy(F.col(name).asc_nulls_last()).collect()  # one row per old shard
    olds, held = [r[0] for r in sizes], [r[1] for r in sizes]
    if isinstance(df.select(F.col(f"`{old}`")).schema[0].dataType, IntegralType) and all(n is None or 0 <= int(n) < NUMBERED for n in olds):
        last = 1 + max((int(n) for n in olds if n is not None), default=-1)
        of = {last if n is None else int(n): (n, b) for n, b in zip(olds, held)}
        olds, held = [of.get(i, (None, 0))[0] for i in range(last + 1)], [of.get(i, (None, 0))[1] for i in range(last + 1)]
    share = [float(x) for x in room] if room else [1.0] * shards
    ends = [round(sum(held) * sum(share[: i + 1]) / sum(share)) for i in range(len(share))]
    flows = fewest_moves(held, [b - a for a, b in zip([0, *ends], ends)])

    rows, at = [], {}
    for i, to, b in flows:
        rows.append((olds[i], i, to, at.get(i, 0), at.get(i, 0) + b))
        at[i] = at.get(i, 0) + b
    spark = df.sparkSession
    runs = spark.createDataFrame(rows, "run_name string, old_no int, new_no int, lo long, hi long")
    laid = lay_out(sized, name, run, hashed, totals, bucket, start, rank)
    middle = F.col(start) + F.floor(F.col(run) / 2)
    placed = laid.join(runs, F.col(name).eqNullSafe(F.col("run_name")) & (middle >= F.col("lo")) & (middle < F.col("hi")))
    placed = cut_lineage(placed.drop("run_name", "hi", hashed, bucket, start, name))
    # a run is contiguous in its old shard, so a row's slot follows from its rank and one small row per run
    runs_of = placed.groupBy(F.col("old_no").alias("run_old"), F.col("new_no").alias("run_new")).agg(F.min(rank).alias("run_first"), F.count(F.lit(1)).alias("run_n"))
    before = W.partitionBy("run_new").orderBy(F.col("run_old") != F.col("run_new"), "run_old").rowsBetween(W.unboundedPreceding, -1)
    runs_of = runs_of.withColumn("run_slot", F.coalesce(F.sum("run_n").over(before), F.lit(0)))
    out = placed.join(runs_of, (F.col("old_no") == F.col("run_old")) & (F.col("new_no") == F.col("run_new")))
    out = replace(
        out,
        size=F.col(run),
        old_shard=F.col("old_no"),
        shard=F.col("new_no"),
        slot=(F.col("run_slot") + F.col(rank) - F.col("run_first")).cast("long"),
        moved=F.col("old_no") != F.col("new_no"),
    )
    return out.drop(run, rank, "old_no", "new_no", "lo", "run_old", "run_new", "run_first", "run_n", "run_slot")


def rewritten(placed: DataFrame) -> DataFrame:
    """The shards whose files change: those that gain or lose a document."""
    moved = placed.where("moved")
    return moved.select("shard").union(moved.select("old_shard")).distinct()


def rewrite(placed: DataFrame, folder: str) -> None:
    """Write the affected shards, each in slot order, as ``folder/shard=N``; other shards keep their files.

    ``folder`` is empty or holds the old shards by their numbers in ``old_shard``. Shards that end without rows are
    removed, and only after the others are written: a call that broke off loses no row, and a second call with the
    same ``placed`` finishes it. Shards that keep their files keep their columns too (read with ``mergeSchema``).
    """
    spark = placed.sparkSession
    changed = [r[0] for r in rewritten(placed).collect()]  # one row per shard
    touched = placed.where(F.col("shard").isin(changed))
    left = {r[0] for r in touched.select("shard").distinct().collect()}
    ordered = touched.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    for shard in sorted(set(changed) - left):
        fs, path = _fs(spark, f"{folder}/shard={shard}")
        if fs.exists(path) and not fs.delete(path, True):
            raise OSError(f"{folder}/shard={shard} has no rows left and can't be removed")
