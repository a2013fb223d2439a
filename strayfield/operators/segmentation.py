"""Segmentation metrics, confidences and losses over class-probability pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strayfield.functions.arrays import argmax, bind, doubles, entropy, log_softmax, softmax, total
from strayfield.operators.ordering import attach, row_index

IGNORE = 255


def _classes(df: DataFrame, k: int, name: str) -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias(name))


def confusion(df: DataFrame, pred: str = "pred", gt: str = "gt", ignore: int = IGNORE) -> DataFrame:
    """Pixel counts per (prediction, truth): at most classes^2 rows, combined map-side."""
    return df.where(F.col(gt) != ignore).groupBy(pred, gt).agg(F.count(F.lit(1)).alias("n"))


def iou(df: DataFrame, k: int, pred: str = "pred", gt: str = "gt", ignore: int = IGNORE) -> DataFrame:
    """Intersection, union and target area per class 0..k-1, and their IoU."""
    cells = confusion(df, pred, gt, ignore)
    same = F.col(pred) == F.col(gt)
    parts = F.array(
        F.struct(F.col(pred).cast("int").alias("class_id"), F.col("n").alias("out"), F.lit(0).cast("long").alias("target")),
        F.struct(F.col(gt).cast("int").alias("class_id"), F.lit(0).cast("long").alias("out"), F.col("n").alias("target")),
    )
    long = cells.select(F.explode(parts).alias("p"), F.when(same, F.col("n")).otherwise(0).alias("hit"))
    # a hit shows up once as prediction and once as truth
    sums = long.groupBy("p.class_id").agg(
        (F.sum("hit") / 2).cast("long").alias("intersection"), F.sum("p.out").alias("out"), F.sum("p.target").alias("target")
    )
    full = _classes(df, k, "class_id").join(sums, "class_id", "left").na.fill(0)
    union = F.col("out") + F.col("target") - F.col("intersection")
    return full.select(
        "class_id", "intersection", union.alias("union"), "target", (F.col("intersection") / (union + F.lit(1e-10))).alias("iou")
    )


def mean_iou(df: DataFrame, k: int, pred: str = "pred", gt: str = "gt", ignore: int = IGNORE) -> DataFrame:
    return iou(df, k, pred, gt, ignore).agg(F.avg("iou").alias("miou"))


def topk_accuracy(df: DataFrame, ks: Sequence[int], probs: str = "vec", gt: str = "gt") -> DataFrame:
    """Percent of rows whose true class is among the k highest; equal values rank by class number."""
    p = doubles(probs)
    mine = F.get(p, F.col(gt))
    above = F.size(F.filter(p, lambda x, i: (x > mine) | ((x == mine) & (i < F.col(gt)))))
    ranked = df.select(above.alias("_rank"))
    return ranked.agg(*[(F.avg((F.col("_rank") < k).cast("double")) * 100).alias(f"top{k}") for k in ks])


def class_confidence(df: DataFrame, k: int, probs: str = "probs", gt: str = "gt") -> DataFrame:
    """Mean probability of class c where the truth is c; 0 for absent classes."""
    mean = df.groupBy(F.col(gt).cast("int").alias("class_id")).agg(F.avg(F.get(probs, F.col(gt))).alias("confidence"))
    return _classes(df, k, "class_id").join(mean, "class_id", "left").na.fill(0.0, ["confidence"])


def entropy_confidence(df: DataFrame, by: Sequence[str] = ("image_id",), probs: str = "probs") -> DataFrame:
    """Mean over pixels of (1 - H(p) / ln C) * max p."""
    p = F.col(probs)
    conf = (F.lit(1.0) - entropy(p) / F.log(F.size(p).cast("double"))) * F.array_max(p)
    return df.groupBy(*by).agg(F.avg(conf).alias("confidence"))


def class_counts(df: DataFrame, k: int, label: str = "label", ignore: int = IGNORE) -> DataFrame:
    counts = df.where(F.col(label) != ignore).groupBy(F.col(label).cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return _classes(df, k, "class_id").join(counts, "class_id", "left").na.fill(0)


def presence(df: DataFrame, k: int, t: float, size: int, label: str = "label", image: str = "image_id") -> DataFrame:
    """1 where a class covers at least ``t * size`` pixels of an image, for every image and class."""
    flags = [
        F.struct(F.lit(c).alias("class_id"), (F.sum((F.col(label) == c).cast("long")) >= F.greatest(F.lit(t * size), F.lit(1))).cast("int").alias("present"))
        for c in range(k)
    ]
    return df.groupBy(image).agg(F.array(*flags).alias("f")).select(image, F.inline("f"))


def hard_examples(
    df: DataFrame, t: float, min_kept: int, order: Sequence[str], probs: str = "probs", gt: str = "gt", ignore: int = IGNORE
) -> DataFrame:
    """Pixels hard enough to train on: probability of the true class at most max(t, min_kept-th smallest).

    Everything is kept when fewer than ``min_kept`` pixels are valid.
    """
    valid = df.where(F.col(gt) != ignore).withColumn("true_prob", F.get(probs, F.col(gt)))
    ranked = row_index(valid, ["true_prob", *order], name="_rn")
    total_rows = valid.agg(F.count(F.lit(1)).alias("_valid"))
    kth = ranked.where(F.col("_rn") == F.least(F.lit(min_kept), total_rows.scalar())).agg(F.max("true_prob").alias("_kth"))
    limit = F.greatest(F.lit(t), F.col("_kth")) if min_kept > 0 else F.lit(t)
    marked = attach(attach(valid, total_rows, []), kth, [])
    return marked.where((F.col("_valid") < min_kept) | (F.col("true_prob") <= limit)).drop("_valid", "_kth")


def weighted_loss(df: DataFrame, item: Sequence[str], loss: str = "loss", hardness: str = "hardness") -> DataFrame:
    """Mean over items of (mean loss of the item) * hardness."""
    per_item = df.groupBy(*item).agg(F.avg(loss).alias("l"), F.max(hardness).alias("h"))
    return per_item.agg(F.avg(F.col("l") * F.col("h")).alias("loss"))


def seg_quality(df: DataFrame, k: int, logits: str = "logits", gt: str = "gt", by: Sequence[str] = ("image_id",), ignore: int | None = None) -> DataFrame:
    """Per image: cross-entropy on softmaxed values, class-balanced dice, dice-log, histogram L1 (plain and
    on unit-length histograms) and entropy. ``ignore`` drops one class from everything but the entropy.

    All class sums are plain aggregates (k is small), so one pass and one shuffle do.
    """
    classes = [c for c in range(k) if c != ignore]
    p = df.select(*by, softmax(logits).alias("p"), F.col(gt).cast("int").alias("g"))
    kept = F.col("p") if ignore is None else F.array(*[F.get("p", c) for c in classes])
    hot = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("g")).cast("int")
    ce = F.when(hot > 0, -F.get(log_softmax(kept), hot - 1)).otherwise(F.lit(0.0))
    rows = p.select(*by, "p", "g", ce.alias("ce"), F.aggregate("p", F.lit(0.0), lambda a, x: a - x * F.log(x + F.lit(1e-5))).alias("h"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ce").alias("cross_entropy"),
        (F.avg("h") / F.lit(float(k))).alias("entropy"),
        F.array(
            *[
                F.struct(
                    F.sum(F.get("p", c)).alias("p"),
                    F.sum(F.when(F.col("g") == c, 1.0).otherwise(0.0)).alias("t"),
                    F.sum(F.when(F.col("g") == c, F.get("p", c)).otherwise(0.0)).alias("i"),
                )
                for c in classes
            ]
        ).alias("s"),
    )
    eps = 1e-5
    inverse = F.transform("s", lambda s: F.lit(1.0) / (s["t"] + eps))
    balanced = F.zip_with("s", "w", lambda s, w: w * (1 - (2 * s["i"] + eps) / (s["p"] + s["t"] + eps + eps)))
    hit = F.aggregate("s", F.lit(0.0), lambda a, s: a + s["i"])
    p_len = F.greatest(F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, s: a + s["p"] * s["p"])), F.lit(1e-12))
    t_len = F.greatest(F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, s: a + s["t"] * s["t"])), F.lit(1e-12))
    m = float(len(classes))
    return sums.withColumn("w", inverse).select(
        *by,
        "cross_entropy",
        (total(balanced) / total(F.col("w")) / F.lit(m)).alias("balanced_dice"),
        (-F.log(2 * hit / (hit + F.col("n") * F.lit(m) + F.lit(1e-6)))).alias("dice_log"),
        F.aggregate("s", F.lit(0.0), lambda a, s: a + F.abs(s["t"] - s["p"]) / F.col("n")).alias("hist_l1"),
        bind(
            F.struct(t_len.alias("t"), p_len.alias("p")),
            lambda n: F.aggregate("s", F.lit(0.0), lambda a, s: a + F.abs(s["t"] / n["t"] - s["p"] / n["p"])) / F.lit(m),
        ).alias("unit_hist_l1"),
        "entropy",
    )


def merge_tiles(tiles: DataFrame, k: int, by: Sequence[str] = ("image_id", "y", "x"), logits: str = "logits") -> DataFrame:
    """Sum the softmax of all tiles over a pixel and take the class: overlapping tile inference."""
    p = tiles.select(*by, softmax(logits).alias("p"))
    summed = p.groupBy(*by).agg(F.array(*[F.sum(F.get("p", c)) for c in range(k)]).alias("probs"))
    return summed.select(*by, "probs", argmax("probs").alias("label"))


def crop_starts(length: int, crop: int) -> list[int]:
    """Tile starts of one axis: steps of int(crop * 2 / 3)."""
    return list(range(0, length, int(crop * 2 / 3)))


def tile_pixels(px: DataFrame, h: int, w: int, crop: int) -> DataFrame:
    """Copy every pixel into each overlapping crop that covers it (``ty``, ``tx``)."""

    def covering(axis: str, starts: list[int]) -> Column:
        return F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: (F.col(axis) >= s) & (F.col(axis) < s + crop))

    return px.withColumn("ty", F.explode(covering("y", crop_starts(h, crop)))).withColumn(
        "tx", F.explode(covering("x", crop_starts(w, crop)))
    )
