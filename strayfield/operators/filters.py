"""Filters, gates and existence tests on items, masks and label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strayfield.operators.metrics import anomalous_only  # noqa: F401  (B4 lives with the metrics)
from strayfield.operators.ordering import attach
from strayfield.operators.sampling import hash_order

IGNORE = 255


def filter_classes(df: DataFrame, values: Sequence[str], col: str = "class") -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose output does not exist yet."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def with_partner(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def anomalous_items(df: DataFrame, n: int, seed: int, item: str, defect: str = "defect") -> DataFrame:
    """n random test items that are not good."""
    picked = df.where((F.col("split") == "test") & (F.col(defect) != "good"))
    return picked.orderBy(hash_order(seed, item), item).limit(n)


def filter_instances(
    df: DataFrame, min_frac: float = 0.01, max_w: float = 0.97, target: int = 256, image: str = "image_id", unit: float = 1.0
) -> DataFrame:
    """Drop instances that are too small, too wide, or vanish when scaled to ``target``.

    ``df`` has ``area, w, h, canvas_w``. ``unit`` is the value a set mask pixel is stored with (255 for byte
    masks): the image total counts pixels in that unit.
    """
    totals = df.groupBy(image).agg((F.sum("area") / F.lit(unit)).alias("_total"))
    scale = F.lit(float(target)) / F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))
    return (
        attach(df, totals, [image])
        .where(F.col("area") >= F.lit(min_frac) * F.col("_total"))
        .where(F.col("w") <= F.col("canvas_w") * F.lit(max_w))
        .where(((F.col("w") * scale).cast("int") > 0) & ((F.col("h") * scale).cast("int") > 0))
        .drop("_total")
    )


def split_by_index(df: DataFrame, index: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows listed in ``index`` and the rest."""
    listed = index.select(key)
    return df.join(listed, key, "left_semi"), df.join(listed, key, "left_anti")


def drop_small_labels(
    px: DataFrame, min_px: int | None = None, min_frac: float | None = None, size: int | None = None,
    keys: Sequence[str] = ("image_id", "label"),
) -> DataFrame:
    """Keep labels with more than ``min_px`` pixels, or more than ``min_frac`` of ``size`` pixels."""
    n = F.count(F.lit(1))
    rule = n > F.lit(min_px) if min_px is not None else n / F.lit(size) > F.lit(min_frac)
    kept = px.groupBy(*keys).agg(rule.alias("_keep")).where("_keep").select(*keys)
    return px.join(kept, list(keys), "left_semi")


def pseudo_label_gate(prob: DataFrame, t: float, confidence: str = "confidence", label: str = "label") -> DataFrame:
    """Labels below the confidence threshold become 255."""
    kept = (F.col(confidence) >= F.lit(t)) & (F.col(label) != IGNORE)
    return prob.withColumn("kept", kept.cast("int")).withColumn(label, F.when(kept, F.col(label)).otherwise(F.lit(IGNORE)))


def gate_loss(gated: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean loss over all rows, gated ones counting 0, and the kept ratio."""
    return gated.agg(
        F.avg(F.when(F.col("kept") == 1, F.col(loss)).otherwise(F.lit(0.0))).alias("loss"),
        F.avg(F.col("kept").cast("double")).alias("kept_ratio"),
    )


def ignore_label(df: DataFrame, value: int = IGNORE, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != value)


def count_violations(df: DataFrame, n: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Groups whose row count is not the expected one."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != n)


def instance_count(df: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def filter_overlap(masks: DataFrame, fg: DataFrame, t: float, denom: str = "own", keep_equal: bool = False) -> DataFrame:
    """Masks whose overlap with the foreground exceeds ``t``."""
    from strayfield.operators.raster import foreground_overlap

    ratio = foreground_overlap(masks, fg, denom)
    kept = ratio.where(F.col("ratio") >= t) if keep_equal else ratio.where(F.col("ratio") > t)
    return masks.join(kept.select("image_id", "mask_id"), ["image_id", "mask_id"], "left_semi")
