"""Ranking metrics over (score, label) rows: curves, areas, best F1, error shares.

Rows are first combined per distinct score. The cumulative counts along the scores then come from
sliced running sums, so neither a hot score nor a single big group ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strayfield.operators.ordering import attach, running
from strayfield.session import cut_lineage


def threshold_counts(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at every distinct score."""
    return df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )


def curve(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: rows at it (``pos``, ``neg``), at or above it (``tp``, ``fp``), totals (``p``, ``n``)."""
    return curve_of(threshold_counts(df, score, label, by), by)


def curve_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The curve of ``threshold, pos, neg``, one row per distinct score. They are written once and then read by every
    step, so the rows they come from are scanned once."""
    sums = {"tp": "pos", "fp": "neg"}
    return running(cut_lineage(counts), [-F.col("threshold")], sums, by=by, totals_as={"tp": "p", "fp": "n"})


def roc_curve(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    return curve(df, score, label, by).select(
        *by, "threshold", (F.col("fp") / F.nullif("n", F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif("p", F.lit(0))).alias("tpr")
    )


def pr_curve(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    return curve(df, score, label, by).select(
        *by,
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.nullif("p", F.lit(0))).alias("recall"),
    )


def _area() -> Column:
    pairs = F.max("p").cast("double") * F.max("n").cast("double")  # beyond a long's range at some 3e9 rows of each class
    return F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2)) / F.nullif(pairs, F.lit(0.0))


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def _previous_precision() -> Column:
    """Precision one threshold higher; 1 before the first."""
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    return F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(1.0))


def _average_precision() -> Column:
    return F.sum(F.col("pos") * _precision()) / F.nullif(F.max("p"), F.lit(0))


def _best() -> Column:
    f1 = F.lit(2.0) * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    return F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("neg_threshold"), "tp", "fp", "p", "n"))


def auroc(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores share their trapezoid. NULL when a class is missing."""
    return curve(df, score, label, by).groupBy(*by).agg(_area().alias("auroc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    return curve(df, score, label, by).groupBy(*by).agg(_average_precision().alias("ap"))


def auc_pr(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the precision-recall curve, starting at recall 0 and precision 1."""
    area = F.sum(F.col("pos") * (_precision() + _previous_precision()) / 2) / F.nullif(F.max("p"), F.lit(0))
    return curve(df, score, label, by).groupBy(*by).agg(area.alias("auc_pr"))


def best_f1(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    """Highest F1 and its threshold; the lowest threshold wins ties."""
    best = curve(df, score, label, by).groupBy(*by).agg(_best().alias("b"))
    return best.select(*by, F.col("b.f1").alias("f1"), (-F.col("b.neg_threshold")).alias("threshold"))


def error_shares(
    df: DataFrame, thresholds: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()
) -> DataFrame:
    """False positives and false negatives at ``threshold``, both as a share of all rows."""
    hit = F.col(score) >= F.col("threshold")
    marked = attach(df, thresholds.select(*by, "threshold"), by)
    return marked.groupBy(*by).agg(
        F.avg(F.when(hit & (F.col(label) == 0), 1.0).otherwise(0.0)).alias("fp_share"),
        F.avg(F.when(~hit & (F.col(label) == 1), 1.0).otherwise(0.0)).alias("fn_share"),
    )


def summary(df: DataFrame, score: str = "score", label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    """AUROC, AP, best F1 with its threshold and error shares, all from one curve."""
    return summary_of(curve(df, score, label, by), by)


def summary_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    best = points.groupBy(*by).agg(
        _area().alias("auroc"), _average_precision().alias("ap"), _best().alias("b")
    )
    rows = F.col("b.p") + F.col("b.n")
    return best.select(
        *by,
        "auroc",
        "ap",
        F.col("b.f1").alias("f1"),
        (-F.col("b.neg_threshold")).alias("threshold"),
        (F.col("b.fp") / rows).alias("fp_share"),
        ((F.col("b.p") - F.col("b.tp")) / rows).alias("fn_share"),
    )


def anomalous_only(px: DataFrame, image: str = "image_id", gt: str = "gt") -> DataFrame:
    """Pixels of images with at least one positive ground-truth pixel."""
    marked = px.where(F.col(gt) > 0).select(image).distinct()
    return px.join(marked, image, "left_semi")


def pixel_metrics(px: DataFrame, image: str = "image_id", score: str = "score", gt: str = "gt") -> DataFrame:
    """Pixel metrics over all images and over images with defects only (``scope``).

    Images are flagged once and pixels counted once per score; the counts, not the pixels, enter both scopes.
    """
    flagged = px.where(F.col(gt) > 0).select(F.col(image).alias("_image")).distinct().withColumn("_flag", F.lit(True))
    marked = px.join(flagged, F.col(image) == F.col("_image"), "left")
    rows = marked.select("_flag", F.col(score).alias("score"), F.col(gt).alias("is_anomaly"))
    scopes = F.when(F.col("_flag"), F.array(F.lit("all"), F.lit("anomalous"))).otherwise(F.array(F.lit("all")))
    counts = threshold_counts(rows, by=["_flag"]).withColumn("scope", F.explode(scopes))
    return summary_of(curve_of(counts.groupBy("scope", "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), ["scope"]), ["scope"])


def auroc_by_family(df: DataFrame, families: Sequence[str], score: str = "score", family: str = "family", good: str = "good") -> DataFrame:
    """AUROC per anomaly family; good rows count for every family: their counts are copied, not they."""
    targets = F.when(F.col(family) == good, F.array(*[F.lit(f) for f in families])).otherwise(F.array(family))
    rows = df.select(family, F.col(score).alias("score"), (F.col(family) != good).cast("int").alias("is_anomaly"))
    counts = threshold_counts(rows, by=[family]).select(F.explode(targets).alias(family), "threshold", "pos", "neg")
    counts = counts.groupBy(family, "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return curve_of(counts, [family]).groupBy(family).agg(_area().alias("auroc"))


def image_score(px: DataFrame, by: Sequence[str] = ("image_id",), score: str = "score") -> DataFrame:
    return px.groupBy(*by).agg(F.max(score).alias("score"))


def image_score_topk(px: DataFrame, k: int, by: Sequence[str] = ("image_id",), score: str = "score", tie: Sequence[str] = ()) -> DataFrame:
    """Mean of the k highest patch scores per image."""
    from strayfield.operators.ordering import top_per_key

    top = top_per_key(px, by, [F.col(score).desc(), *[F.col(c) for c in tie]], k)
    return top.groupBy(*by).agg(F.avg(score).alias("score"))


def rollup_instances(df: DataFrame, by: Sequence[str] = ("image_id",), score: str = "score", label: str = "is_anomaly") -> DataFrame:
    """Instances to images: highest score and whether any instance is anomalous."""
    return df.groupBy(*by).agg(F.max(score).alias("score"), F.max(label).alias(label))


def ensemble(
    df: DataFrame, item: Sequence[str], model: str = "model", score: str = "score", normalize: bool = True
) -> DataFrame:
    """Mean score over models, each model min-max scaled over all its rows first."""
    scaled = df
    if normalize:
        span = df.groupBy(model).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
        scaled = attach(df, span, [model]).withColumn(
            score, (F.col(score) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        )
    return scaled.groupBy(*item).agg(F.avg(score).alias("score"))


def latency(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
