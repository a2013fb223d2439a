"""Sampling, splits, replication and batching. Randomness is a hash of (seed, id): repeatable anywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strayfield.operators import blocks as B
from strayfield.operators.neighbours import knn, linear_map
from strayfield.operators.ordering import attach, row_index, running, top_per_key
from strayfield.session import cut_lineage, drop_table

HEX_DIGITS = 13  # 52 random bits: exact in a double


def hash_order(seed: int, *cols: str | Column) -> Column:
    """A sort key in random but repeatable order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def hash_unit(seed: int, *cols: str | Column) -> Column:
    """Uniform number in [0, 1) per row."""
    digits = F.substring(hash_order(seed, *cols), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**HEX_DIGITS))


def k_shot(df: DataFrame, n: int, seed: int, by: Sequence[str] = ("class", "defect"), image: str = "image_id") -> DataFrame:
    """n images per group, with all their instances."""
    images = df.select(*by, image).distinct().withColumn("_h", hash_order(seed, image))
    chosen = top_per_key(images, by, [F.col("_h"), F.col(image)], n).select(*by, image)
    return df.join(chosen, [*by, image], "left_semi")


def prefix_split(df: DataFrame, ratio: float, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First ``int(n * ratio)`` rows per group are ``train``, the rest ``val``."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(row_index(df, order, by, "_rn"), sizes, by)
    part = F.when(F.col("_rn") <= (F.col("_n") * F.lit(ratio)).cast("int"), "train").otherwise("val")
    return ranked.withColumn("part", part).drop("_rn", "_n")


def cap(df: DataFrame, n: int, seed: int, item: str) -> DataFrame:
    """At most n rows, a random choice."""
    return df.orderBy(hash_order(seed, item), item).limit(n)


def random_sample(df: DataFrame, p: float, seed: int, item: str) -> DataFrame:
    """Exactly ``int(n * p)`` rows without replacement."""
    if not 0 < p < 1:
        raise ValueError("p must lie strictly between 0 and 1")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(row_index(df, [hash_order(seed, item), item], name="_rn"), total, [])
    return ranked.where(F.col("_rn") <= (F.col("_n") * F.lit(p)).cast("long")).drop("_rn", "_n")


def draw(df: DataFrame, k: int, seed: int, item: str, replace: bool = True) -> DataFrame:
    """k random rows as ``draw_no`` 0..k-1, with or without replacement."""
    if not replace:
        picked = df.orderBy(hash_order(seed, item), item).limit(k)
        return row_index(picked, [hash_order(seed, item), item], name="_rn").withColumn("draw_no", F.col("_rn") - 1).drop("_rn")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    draws = attach(df.sparkSession.range(k).withColumnRenamed("id", "draw_no"), total, [])
    picks = draws.select("draw_no", (F.floor(hash_unit(seed, "draw_no") * F.col("_n")) + 1).alias("_rn"))
    return row_index(df, [item], name="_rn").join(picks, "_rn").drop("_rn")


def resample_to(df: DataFrame, n: int, seed: int, item: str) -> DataFrame:
    """Exactly n rows: a sample if there are enough, else of ``ceil(n / len)`` copies of every row (``copy``)."""
    copies = df.agg(F.ceil(F.lit(float(n)) / F.count(F.lit(1))).cast("int").alias("_c"))
    repeated = attach(df, copies, []).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).drop("_c")
    return row_index(repeated, [hash_order(seed, item, "copy"), item, "copy"], name="_rn").where(F.col("_rn") <= n).drop("_rn")


def replicate(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def rotations(df: DataFrame, interval: int) -> DataFrame:
    """One row per angle 0, interval, 2*interval, ... below 360."""
    return df.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(360 // interval * interval - interval), F.lit(interval))))


def weighted_sample(df: DataFrame, weight: str, k: int, seed: int, item: str, by: Sequence[str] = (), power: float = 0.5) -> DataFrame:
    """k rows per group without replacement, chance proportional to ``weight ** power`` at every draw."""
    u = hash_unit(seed, *by, item)
    keyed = df.withColumn("_key", F.coalesce(-F.log(F.greatest(u, F.lit(1e-300))) / F.nullif(F.pow(F.col(weight), F.lit(power)), F.lit(0.0)), F.lit(float("inf"))))
    return top_per_key(keyed, by, [F.col("_key"), F.col(item)], k).drop("_key")


def uniform_weights(dims_in: int, dims_out: int, seed: int) -> np.ndarray:
    """Weights of a freshly initialised bias-free linear layer: uniform in +-1/sqrt(dims_in)."""
    bound = 1.0 / math.sqrt(dims_in)
    return np.random.default_rng(seed).uniform(-bound, bound, (dims_out, dims_in))


def random_project(df: DataFrame, weights: np.ndarray, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Linear map before selection; a square request (already the target size) is left alone."""
    if weights.shape[0] == weights.shape[1]:
        return df if out == vec else df.withColumn(out, F.col(vec))
    return linear_map(df, vec, weights, out)


def _nearest_of(centres: np.ndarray):
    """Distance of every vector to the closest of a bounded set of new centres."""

    @F.pandas_udf("double")
    def to_centres(v: pd.Series) -> pd.Series:
        m = B.matrix(v)
        best = np.full(len(m), np.inf)
        for c in centres:
            best = np.minimum(best, B.paired(np.broadcast_to(c, m.shape), m, "l2sq"))
        return pd.Series(np.sqrt(best))

    return to_centres


def _grow(start: DataFrame, picks: int, item: str, look: int) -> DataFrame:
    """Farthest-first picks from ``start(item, vec, anchor)``, in order (``pick_no``).

    Anchors only shrink, so the ``look`` largest ones are enough to make several exact picks at once: a pick
    is certain while the best updated candidate still beats the largest anchor left outside. Each round is
    one top-``look`` query and one pass that lowers all anchors and marks the picks; the driver never holds
    more than ``look`` rows.
    """
    spark = start.sparkSession
    state, done = start.withColumn("pick_no", F.lit(None).cast("long")), 0
    while done < picks:
        best = state.where("pick_no is null").select("anchor", item, "vec").orderBy(F.col("anchor").desc(), item).limit(look + 1)
        # the first rows of all partitions meet in a task: collected at once, each partition would send its own to the driver
        top = best.mapInArrow(lambda batches: batches, best.schema).collect()
        outside = (top[look]["anchor"], top[look][item]) if len(top) > look else None
        ids = [r[item] for r in top[:look]]
        m = np.array([r["vec"] for r in top[:look]], dtype=float)
        anchor = np.array([r["anchor"] for r in top[:look]], dtype=float)
        by_id = np.argsort(np.argsort(np.array(ids)))  # ties go to the lowest id
        free, fresh = set(range(len(ids))), []
        while free and done + len(fresh) < picks:
            i = max(free, key=lambda j: (anchor[j], -by_id[j]))
            beaten = outside is not None and (anchor[i] < outside[0] or (anchor[i] == outside[0] and ids[i] > outside[1]))
            if fresh and beaten:
                break
            fresh.append(i)
            free.discard(i)
            anchor = np.minimum(anchor, np.sqrt(B.paired(np.broadcast_to(m[i], m.shape), m, "l2sq")))
        marks = spark.createDataFrame([(ids[i], done + j) for j, i in enumerate(fresh)], f"{item} {_kind(start, item)}, _no long")
        lowered = F.least("anchor", _nearest_of(m[fresh])("vec"))
        last, state = state, cut_lineage(
            state.join(F.broadcast(marks), item, "left").select(  # at most ``look`` rows
                item, "vec", lowered.alias("anchor"), F.coalesce("pick_no", "_no").alias("pick_no")
            )
        )
        if done:
            drop_table(last)  # else each round would leave a copy of all vectors
        done += len(fresh)
    return state.where("pick_no is not null").select("pick_no", item)


def _kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def greedy_coreset(df: DataFrame, p: float, item: str = "vec_id", vec: str = "vec", look: int = 1024) -> DataFrame:
    """k-centre coreset of ``int(n * p)`` rows: ``(pick_no, item)``.

    The start value of a row is the norm of its distances to all rows, which needs no pairs:
    sum_j |x - y_j|^2 = n|x|^2 - 2 x.S + Q with S and Q summed once.
    """
    if not 0 < p < 1:
        raise ValueError("p must lie strictly between 0 and 1")
    base = df.select(item, F.col(vec).cast("array<double>").alias("vec"))
    n, s, q = _moments(base)
    picks = int(n * p)

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> pd.Series:
        m = B.matrix(v)
        return pd.Series(np.sqrt(np.maximum(n * (m * m).sum(1) - 2.0 * m @ s + q, 0.0)))

    return _grow(base.withColumn("anchor", spread("vec")), picks, item, look)


def approx_coreset(
    df: DataFrame, p: float, starts: int = 10, seed: int = 0, item: str = "vec_id", vec: str = "vec", look: int = 1024
) -> DataFrame:
    """Coreset whose start value is the mean distance to ``starts`` random rows."""
    if not 0 < p < 1:
        raise ValueError("p must lie strictly between 0 and 1")
    base = df.select(item, F.col(vec).cast("array<double>").alias("vec"))
    n = base.count()
    first = np.array([r["vec"] for r in base.orderBy(hash_order(seed, item), item).limit(min(starts, n)).collect()])

    @F.pandas_udf("double")
    def mean_distance(v: pd.Series) -> pd.Series:
        m = B.matrix(v)
        return pd.Series(np.sqrt(np.stack([B.paired(np.broadcast_to(c, m.shape), m, "l2sq") for c in first])).mean(0))

    return _grow(base.withColumn("anchor", mean_distance("vec")), int(n * p), item, look)


def _farthest_first(m: np.ndarray, anchor: np.ndarray, picks: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows picked one by one where ``anchor`` is largest, the first of equals, and the anchor of each when it was picked."""
    anchor, norm = anchor.copy(), (m * m).sum(1)
    order, reach = np.zeros(picks, np.int64), np.zeros(picks)
    for step in range(picks):
        i = int(anchor.argmax())
        order[step], reach[step] = i, anchor[i]
        np.minimum(anchor, np.sqrt(np.maximum(norm + norm[i] - 2.0 * m @ m[i], 0.0)), out=anchor)
        anchor[i] = -1.0  # and it stays so, being the smallest
    return order, reach


def two_level_coreset(
    df: DataFrame, p: float, starts: int = 10, seed: int = 0, item: str = "vec_id", vec: str = "vec", part_rows: int = 1 << 15, spare: float = 2.0
) -> DataFrame:
    """A coreset of ``int(n * p)`` rows in two rounds, whatever n: ``(pick_no, item)``.

    Rows are dealt evenly to parts of ``part_rows``; each part picks ``spare`` times its share farthest-first by itself. The
    picks are dealt again, and each part of them picks its exact share; up to ``part_rows`` of them are one part, so the last
    round is the greedy choice over all of them. A row is then as near to a pick as the two rounds' radii add up to: the
    cover is within a constant of the greedy one, and ``cover_radius`` measures it. Start values are as in
    ``approx_coreset``. Nothing is written in between but the picks of the first round.
    """
    if not 0 < p < 1:
        raise ValueError("p must lie strictly between 0 and 1")
    base = df.select(F.col(item).alias("item"), F.col(vec).cast("array<double>").alias("vec"))
    n = base.count()
    picks, parts = int(n * p), max(1, -(-n // part_rows))
    first = np.array([r["vec"] for r in base.orderBy(hash_order(seed, "item"), "item").limit(min(starts, n)).collect()])
    schema = f"item {_kind(base, 'item')}, vec array<double>, step long, reach double"

    def chosen(pdf: pd.DataFrame, wanted: int) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        m = B.matrix(pdf["vec"])
        start = np.sqrt(np.stack([B.paired(np.broadcast_to(c, m.shape), m, "l2sq") for c in first])).mean(0)
        order, reach = _farthest_first(m, start, min(wanted, len(m)))
        return pd.DataFrame({"item": pdf["item"].to_numpy()[order], "vec": list(m[order]), "step": np.arange(len(order)), "reach": reach})

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return chosen(pdf, math.ceil(spare * p * len(pdf)))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        return chosen(pdf.drop(columns=["step", "reach"]), int(pdf["want"].iloc[0]))

    near = base.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(parts)))
    union = cut_lineage(near.groupBy("part").applyInPandas(some, schema))
    last = max(1, -(-union.count() // part_rows))
    dealt = row_index(union, [hash_order(seed, F.lit("deal"), "item"), "item"], name="rn") if last > 1 else union.withColumn("rn", F.lit(1).cast("long"))
    dealt = dealt.withColumn("part", (F.col("rn") - 1) % last).drop("rn")
    want = F.floor((F.col("part") + 1) * picks / last) - F.floor(F.col("part") * picks / last)
    final = dealt.withColumn("want", want.cast("long")).groupBy("part").applyInPandas(share, schema)
    numbered = row_index(cut_lineage(final.select("item", "step", "reach")), ["step", -F.col("reach"), "item"], name="rn")
    return numbered.select((F.col("rn") - 1).alias("pick_no"), F.col("item").alias(item))


def cover_radius(df: DataFrame, picks: DataFrame, item: str = "vec_id", vec: str = "vec", block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """One row: how far the farthest row is from its nearest pick (``radius``)."""
    bank = df.join(picks.select(item), item, "left_semi")
    hits = knn(df, bank, 1, query_id=item, bank_id=item, vec=vec, block_rows=block_rows)
    return hits.agg(F.sqrt(F.max("distance")).alias("radius"))


def _moments(base: DataFrame) -> tuple[int, np.ndarray, float]:
    """Row count, vector sum and sum of squared norms, reduced per task first."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, None, 0.0
        for pdf in batches:
            if len(pdf):
                m = B.matrix(pdf["vec"])
                n, q = n + len(m), q + float((m * m).sum())
                s = m.sum(0) if s is None else s + m.sum(0)
        if s is not None:
            flat = np.concatenate([[float(n), q], s])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    rows = base.select("vec").mapInPandas(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = [r["v"] for r in rows]
    return int(flat[0]), np.array(flat[2:]), flat[1]


def class_chances(conf: DataFrame, smooth: bool = False) -> DataFrame:
    """Chance of drawing a class: softmax of 1 - conf, or of its cube root. One row per class."""
    base = F.lit(1.0) - F.col("conf")
    raised = F.exp(F.pow(base, F.lit(1 / 3)) if smooth else base)
    weights = conf.select("class_id", raised.alias("w"))
    return attach(weights, weights.agg(F.sum("w").alias("_t")), []).select("class_id", (F.col("w") / F.col("_t")).alias("chance"))


def sample_from_bank(presence: DataFrame, conf: DataFrame, draws: int, seed: int, smooth: bool = False) -> DataFrame:
    """Draw a class by ``class_chances``, then a random image that shows it, else any image.

    ``presence(image_id, class_id, present)``. A class owns an interval of [0, 1); intervals are cut into as many equal cells
    as there are classes, at least, and a draw meets those in its cell: an equal join, whose cost for a draw doesn't grow with
    the number of classes. Draws are MD5 hashes of seed and number.
    """
    chances = class_chances(conf, smooth)
    past = running(chances, ["class_id"], {"past": "chance"})
    cells = 1 << max(6, chances.count().bit_length())
    edge = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    owned = past.withColumn("_from", F.col("past") - F.col("chance")).withColumn("_cell", F.explode(F.sequence(edge(F.greatest(F.col("_from"), F.lit(0.0))), edge(F.col("past")))))
    tries = presence.sparkSession.range(draws).withColumnRenamed("id", "draw_no").withColumn("_u", hash_unit(seed, F.lit("class"), "draw_no"))
    reached = tries.withColumn("_cell", edge(F.col("_u"))).join(owned.select("_cell", "class_id", "past"), "_cell", "left")
    # the first class whose interval ends beyond the draw; rounding can leave the last draws beyond all of them
    first = reached.groupBy("draw_no").agg(F.min(F.when(F.col("past") > F.col("_u"), F.col("class_id"))).alias("class_id"))
    last = chances.select(F.max("class_id")).scalar()
    chosen = first.select("draw_no", F.coalesce("class_id", last).alias("class_id"))
    shown = row_index(presence.where("present = 1"), ["image_id"], ["class_id"], "_rn").select("class_id", "image_id", "_rn")
    sizes = shown.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n"))
    everyone = row_index(presence.select("image_id").distinct(), ["image_id"], name="_rn")
    total = everyone.agg(F.count(F.lit(1)).alias("_all"))
    u = hash_unit(seed, F.lit("image"), "draw_no")
    sized = attach(chosen.join(sizes, "class_id", "left"), total, [])
    hit = sized.where("_n is not null").withColumn("_rn", F.floor(u * F.col("_n")) + 1).join(shown, ["class_id", "_rn"])
    miss = sized.where("_n is null").withColumn("_rn", F.floor(u * F.col("_all")) + 1).join(everyone, "_rn")
    cols = ["draw_no", "class_id", "image_id"]
    return hit.select(*cols).unionByName(miss.select(*cols))


def batch_id(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Fixed-size batches by position."""
    return row_index(df, order, name="_rn").withColumn("batch", F.floor((F.col("_rn") - 1) / F.lit(size)).cast("long")).drop("_rn")


def identity(df: DataFrame) -> DataFrame:
    return df
