"""Composed flows: component and texture maps to image scores, zero-shot batches to a results table, the refinement loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strayfield.operators import metrics, neighbours, outliers, sampling, scoremaps
from strayfield.operators.raster import PX
from strayfield.session import cut_lineage, drop_table, free_shuffles, written
from strayfield.sources.sinks import results_table


def component_maps(
    labels: DataFrame,
    normal: DataFrame,
    texture: DataFrame,
    classes: int,
    h: int,
    w: int,
    k: int = 5,
    quadrant_weight: float = scoremaps.QUADRANT_WEIGHT,
    ends: Sequence[float] = (0.9, 0.995),
) -> DataFrame:
    """Combined map ``(image_id, y, x, texture, component, score)`` of every image, one row per pixel of the frame.

    ``labels(image_id, y, x, label)`` are label maps and ``texture(image_id, y, x, st, ae)`` both texture maps, absent pixels zero. A missing component is
    drawn where the reference image has it, so the texture maps are filled first. The scale of the texture maps comes from quantiles
    over the pixels of the ``normal`` images alone.
    """
    return _combined(labels, normal, scoremaps.dense(texture, h, w, ["st", "ae"]), classes, h, w, k, quadrant_weight, ends)


def component_image_scores(
    labels: DataFrame,
    normal: DataFrame,
    texture: DataFrame,
    classes: int,
    h: int,
    w: int,
    k: int = 5,
    quadrant_weight: float = scoremaps.QUADRANT_WEIGHT,
    ends: Sequence[float] = (0.9, 0.995),
) -> DataFrame:
    """``combined_score`` of the ``component_maps``, ``(image_id, score)``, without a row for every pixel of the frame.

    Pixels that neither map has are alike: one more of them at ``y = -1`` stands for all of an image. A component is drawn on pixels
    of the texture maps and on others, so those come in with zeros.
    """
    sparse = texture.select(*PX, "st", "ae")
    zero = F.lit(0).cast("double")
    other = [F.lit(-1).cast(sparse.schema[c].dataType).alias(c) for c in ("y", "x")]
    nothing = [zero.cast(sparse.schema[c].dataType).alias(c) for c in ("st", "ae")]
    holes = sparse.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < h * w).select("image_id", *other, *nothing)
    maps = _combined(labels, normal, sparse.unionByName(holes), classes, h, w, k, quadrant_weight, ends, outer=True)
    return scoremaps.combined_score(maps)


def _combined(labels, normal, pixels, classes, h, w, k, quadrant_weight, ends, outer=False) -> DataFrame:
    scores = cut_lineage(scoremaps.component_scores(labels, normal, classes, h, w, k))
    component = scoremaps.component_map(labels, labels.withColumnRenamed("image_id", "ref_id"), scores, quadrant_weight)
    pixels = cut_lineage(pixels)
    good = cut_lineage(pixels.join(normal, "image_id", "left_semi").where("y >= 0").select("image_id", "st", "ae"))
    frame = good.agg(F.count_distinct("image_id") * h * w - F.count(F.lit(1))).first()[0] if outer else 0  # pixels that have no row
    st, ae = (scoremaps.exact_quantiles(good, c, ends, zeros=frame).toDF(f"{c}_start", f"{c}_end") for c in ("st", "ae"))
    if outer:
        component = cut_lineage(component)
        drawn = component.join(pixels.select("image_id").distinct(), "image_id", "left_semi").join(pixels.select(*PX), list(PX), "left_anti")
        drawn = drawn.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
        kinds = pixels.schema
        pixels = pixels.unionByName(drawn.select(*PX, *[F.lit(0).cast(kinds[c].dataType).alias(c) for c in ("st", "ae")]))
    return scoremaps.combine_pixels(pixels, st.crossJoin(ae), component).select(*PX, "texture", "component", "score")  # one row each


def zero_shot(items: DataFrame, images_per_batch: int, frac: float = 0.005, cap: int = 2048, item: str = "vec_id") -> DataFrame:
    """Image scores ``(image_id, score, is_anomaly)`` without training data, scaled to 0..1 over all images.

    ``items(item, image_id, vec, is_anomaly)``. Images are batched in the order of their ids; a batch is its own bank, with a number of
    neighbours that follows its size; an image scores as its worst item.
    """
    batches = sampling.batch_id(items.select("image_id").distinct(), images_per_batch, ["image_id"])
    rows = cut_lineage(items.join(batches, "image_id"))
    scored = neighbours.self_score(rows, "batch", frac, cap, item=item).select(F.col("query_id").alias(item), "score")
    images = metrics.rollup_instances(rows.drop("vec").join(scored, item))
    scaled = metrics.ensemble(images.withColumn("model", F.lit(0)), ["image_id", "is_anomaly"])
    return scaled.select("image_id", "score", "is_anomaly")


def report(scores: DataFrame, dataset: str = "dataset") -> DataFrame:
    """The results table of image scores: AUROC, AP and best F1 per data set, and their means."""
    wanted = ["auroc", "ap", "f1"]
    long = metrics.summary(scores, by=[dataset]).withColumnRenamed(dataset, "dataset").unpivot("dataset", wanted, "metric", "value")
    return results_table(long, wanted)


def refine(instances: DataFrame, proposals: DataFrame, step: float = 0.3) -> DataFrame:
    """The refinement loop with its repair: ``(image_id, instance_id, origin, area, scale)`` after the last repair.

    ``instances`` has these columns, one row per mask, ``origin`` a unique string; ``proposals(origin, part, area, scale)`` is what a segmenter finds
    inside a mask. Rounds of the z-score rule on sizes, with a width that shrinks by ``step``, are each followed by ``outliers.replace_outliers``;
    from the second repair on, small flagged instances go even without parts. One pass at full width ends it.
    """
    repairs, last = 0, None

    def refit(labelled: DataFrame) -> DataFrame:
        """Of a round only its result stays, until the next round has been written."""
        nonlocal repairs, last
        repairs += 1
        if last is not None:
            drop_table(last)
        with written() as made:
            fixed = outliers.replace_outliers(labelled, proposals, drop_small=repairs > 1)
            last = cut_lineage(fixed.withColumn("size", F.col("area") / F.col("scale")))
        del fixed
        for table in made:
            if table is not last:
                drop_table(table)
        free_shuffles(labelled.sparkSession)
        return last

    sized = instances.withColumn("size", F.col("area") / F.col("scale"))
    final = outliers.iterative_outliers(sized, step, "size", refit)
    return outliers.replace_outliers(cut_lineage(final), proposals, drop_small=repairs > 0)
