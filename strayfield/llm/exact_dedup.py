"""Exact duplicates, with the frequent texts split off.

A text is its SHA-256 after each run of white space became one space. A few texts may make up a third of all rows, and
a shuffle by digest would send each of them to one task. So a Misra-Gries summary (Spark's ``approx_top_k``, a mergeable
summary of that family: each task counts its own rows in bounded memory and only summaries travel) proposes frequent
digests; exact counts verify them, and the verified winners, at most ``TRACKED`` rows of some 60 bytes, are broadcast so
that their copies are settled where they are read. All other digests, each of them rare, are shuffled as usual.

Edge cases: a NULL text counts as empty. Of equal texts the row with the smallest id stays, a NULL id coming last. Of
rows that share text and id one stays. An empty table gives an empty result. Input columns with the name of a result
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strayfield.llm.common import SPACES, fresh
from strayfield.session import cut_lineage

TRACKED = 1024  # most winners that can be broadcast
COUNTERS = 65536  # a text with more than about rows / COUNTERS copies has a counter of its own


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes of a text with every run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


def frequent(digests: DataFrame, key: str) -> DataFrame:
    """Candidate frequent values of ``key``: the ``TRACKED`` largest by the summary's counts."""
    top = digests.agg(F.expr(f"approx_top_k(`{key}`, {TRACKED}, {COUNTERS})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))


def groups(rows: DataFrame, key: str, id: str) -> DataFrame:
    """One row per digest: the id that stays, its rows, and all rows. Combined map-side, so a hot digest is cheap."""
    first = F.min(F.struct(F.col(id).isNull().alias("no"), F.col(id).alias("id")))
    return rows.groupBy(key).agg(first["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def winners(rows: DataFrame, key: str, id: str) -> DataFrame:
    """Exact groups of the candidates that do occur twice or more: at most ``TRACKED`` rows."""
    return groups(rows.join(F.broadcast(frequent(rows, key)), key, "left_semi"), key, id).where("group_size > 1")


def labelled(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    The texts are read and digested once; all else works on the written digests.
    """
    rows = cut_lineage(df.select(F.col(f"`{id}`").alias("id_"), digest(F.col(f"`{text}`")).alias("text_sha256")))
    hot = F.broadcast(cut_lineage(winners(rows, "text_sha256", "id_")))
    known = rows.join(hot, "text_sha256", "left")
    rare = W.partitionBy("text_sha256")
    first = F.min(F.struct(F.col("id_").isNull().alias("no"), F.col("id_").alias("id"))).over(rare)
    common = known.where("group_size is not null")
    others = known.where("group_size is null").withColumns({"keep_id": first["id"], "group_size": F.count(F.lit(1)).over(rare)})
    both = common.unionByName(others)
    stays = F.col("id_").eqNullSafe(F.col("keep_id"))
    # rows of one id and text: counted map-side, then dealt out again, the first of them kept
    again = both.where(stays).groupBy("id_", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    one = again.select("id_", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    out = both.where(~stays).select("id_", "keep_id", "group_size", F.lit(False).alias("kept"), "text_sha256")
    out = out.unionByName(one.select("id_", "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "text_sha256"))
    return out.withColumnRenamed("id_", id)


def deduplicated(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns.

    Copies of a frequent text never leave the task that reads them; a rare text goes through one shuffle.
    """
    key, keep, size, n, rank, key2 = fresh(df, "sha", "keep", "size", "n", "rank", "sha2")
    marked = df.withColumn(key, digest(F.col(f"`{text}`")))
    small = cut_lineage(marked.select(key, F.col(f"`{id}`").alias("id_")))
    hot = cut_lineage(winners(small, key, "id_").withColumnsRenamed({key: key2, "keep_id": keep, "group_size": size}))
    known = marked.join(F.broadcast(hot), F.col(key) == F.col(key2), "left")
    best = known.where(F.col(size).isNotNull() & F.col(f"`{id}`").eqNullSafe(F.col(keep))).dropDuplicates([key])
    by_id = W.partitionBy(key).orderBy(F.col(f"`{id}`").asc_nulls_last())
    rare = known.where(F.col(size).isNull()).withColumn(rank, F.row_number().over(by_id)).where(F.col(rank) == 1)
    names = [F.col(f"`{c}`") for c in df.columns]
    return best.select(*names).unionByName(rare.select(*names))
