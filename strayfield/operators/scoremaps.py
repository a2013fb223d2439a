"""Label histograms, component deviation, and score maps: smoothing, pasting, combining."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strayfield.functions.arrays import doubles, norm
from strayfield.operators.neighbours import covariance, knn
from strayfield.operators.ordering import attach, top_per_key
from strayfield.operators.raster import PX, complement
from strayfield.session import parallelism

# fixed values of the component score
SMALL_COUNT, SMALL_STANDS_FOR = 50, 256.0 * 256.0
WHOLE_THRESHOLD, QUADRANT_THRESHOLD = 0.4, 0.7
QUADRANT_WEIGHT = 0.5
COMPONENT_WEIGHT = 0.15


def dense(px: DataFrame, h: int, w: int, values: Sequence[str], images: DataFrame | None = None) -> DataFrame:
    """Fill absent pixels with zeros."""
    holes = complement(px, h, w, images)
    zeros = holes.select(*PX, *[F.lit(0).cast(px.schema[v].dataType).alias(v) for v in values])
    return px.select(*PX, *values).unionByName(zeros)


# --- histograms ---------------------------------------------------------------------------------------------


def label_histogram(px: DataFrame, classes: int, frac: bool = False, size: int | None = None, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Counts of labels 1..classes per image (background left out), or their share of all ``size`` pixels."""
    counts = [F.sum((F.col("label") == c).cast("double")) for c in range(1, classes + 1)]
    if frac:
        counts = [c / F.lit(float(size)) for c in counts]
    return px.groupBy(*by).agg(F.array(*counts).alias("hist"))


def quadrant_histogram(px: DataFrame, classes: int, h: int, w: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Label counts of the four quadrants (top left, top right, bottom left, bottom right), one after the other."""
    quadrant = F.when(F.col("y") < h // 2, 0).otherwise(2) + F.when(F.col("x") < w // 2, 0).otherwise(1)
    counts = [
        F.sum(((F.col("_q") == q) & (F.col("label") == c)).cast("double")) for q in range(4) for c in range(1, classes + 1)
    ]
    return px.withColumn("_q", quadrant).groupBy(*by).agg(F.array(*counts).alias("hist"))


def histogram_distance(df: DataFrame, train: DataFrame, classes: int, item: str = "image_id", vec: str = "hist") -> DataFrame:
    """Mahalanobis distance to the training mean with a pseudo-inverse covariance; plain L2 for one class."""
    mean, cov = covariance(train, vec)
    mu = F.array(*[F.lit(float(m)) for m in mean])
    centred = F.zip_with(doubles(vec), mu, lambda a, b: a - b)
    if classes == 1:
        return df.select(item, norm(centred).alias("distance"))
    precision = np.linalg.pinv(np.atleast_2d(cov))
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in precision])  # classes x classes
    d = F.col("_d")
    product = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, d, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    quad = F.aggregate(F.zip_with(product, d, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.select(item, centred.alias("_d")).select(item, F.sqrt(F.greatest(quad, F.lit(0.0))).alias("distance"))


def component_score(hist: str | Column, ref: str | Column, classes: int, patches: int) -> Column:
    """Deviation per class as ``array<struct<score, sign>>``.

    Both sides get + 1, the difference is divided by the reference, and small references stand for a whole
    image. With one patch ``sign`` is 1 where there is more than the (replaced) reference, else -1; with
    several the largest patch deviation counts and the sign is -1.
    """

    def one(h: Column, n: Column) -> Column:
        base = n + 1
        replaced = F.when(base < SMALL_COUNT, F.lit(SMALL_STANDS_FOR)).otherwise(base)
        sign = F.when(h + 1 > replaced, 1).otherwise(-1) if patches == 1 else F.lit(-1)
        return F.struct((F.abs(h - n) / replaced).alias("score"), sign.alias("sign"))

    cells = F.zip_with(doubles(hist), doubles(ref), one)
    if patches == 1:
        return cells
    return F.array(
        *[
            F.struct(
                F.greatest(*[F.get(cells, p * classes + c)["score"] for p in range(patches)]).alias("score"), F.lit(-1).alias("sign")
            )
            for c in range(classes)
        ]
    )


def component_scores(px: DataFrame, normal: DataFrame, classes: int, h: int, w: int, k: int = 5) -> DataFrame:
    """Deviation of every image from the mean histograms of its ``k`` nearest normal images: ``(image_id, ref_id, whole, quadrant)``.

    ``px(image_id, y, x, label)`` are label maps, ``normal(image_id)`` names the normal images. Nearest is by whole-image histogram
    (ties by id), ``ref_id`` is the nearest one, and an image never is its own reference. With fewer than ``k`` other normal
    images the mean is over those there are; without any, the image has no row.
    """
    both = label_histogram(px, classes).join(quadrant_histogram(px, classes, h, w).withColumnRenamed("hist", "quad"), "image_id")
    hist = both.select("image_id", "hist")
    hits = knn(hist, hist.join(normal, "image_id", "left_semi"), k + 1, query_id="image_id", bank_id="image_id", vec="hist")
    hits = top_per_key(hits.where("query_id <> bank_id").drop("rn"), ["query_id"], [F.col("distance"), F.col("bank_id")], k)
    near = hits.join(both.select(F.col("image_id").alias("bank_id"), "hist", "quad"), "bank_id")

    def mean(col: str, n: int) -> Column:
        return F.array(*[F.avg(F.get(col, i)) for i in range(n)])

    refs = near.groupBy(F.col("query_id").alias("image_id")).agg(
        F.min_by("bank_id", F.struct("distance", "bank_id")).alias("ref_id"), mean("hist", classes).alias("_rh"), mean("quad", 4 * classes).alias("_rq")
    )
    return both.join(refs, "image_id").select(
        "image_id", "ref_id", component_score("hist", "_rh", classes, 1).alias("whole"), component_score("quad", "_rq", classes, 4).alias("quadrant")
    )


def component_map(px: DataFrame, refs_px: DataFrame, scores: DataFrame, quadrant_weight: float = QUADRANT_WEIGHT) -> DataFrame:
    """Map of missing and surplus components.

    ``px(image_id, y, x, label)`` is the observed label map, ``refs_px(ref_id, y, x, label)`` those of the
    normal images, ``scores(image_id, ref_id, whole, quadrant)`` carries both component scores. A missing
    component is drawn where the reference has it and hides what was observed there; a surplus one where
    it was observed. The quadrant pass draws on the reference only; weight 0 leaves it out, for categories whose parts
    may lie anywhere.
    """
    whole = F.get("whole", F.col("label") - 1)
    quadrant = F.get("quadrant", F.col("label") - 1)
    normal = refs_px.where("label > 0").join(scores, "ref_id")
    missing = normal.where((whole["sign"] == -1) & (whole["score"] > WHOLE_THRESHOLD)).select(*PX, whole["score"].alias("score"))
    seen = px.where("label > 0").join(scores, "image_id")
    surplus = seen.where((whole["sign"] == 1) & (whole["score"] > WHOLE_THRESHOLD)).select(*PX, whole["score"].alias("score"))
    surplus = surplus.join(missing.select(*PX), list(PX), "left_anti")
    parts = missing.unionByName(surplus)
    if quadrant_weight:
        part = quadrant["score"]
        parts = parts.unionByName(normal.where(part > QUADRANT_THRESHOLD).select(*PX, (part * F.lit(quadrant_weight)).alias("score")))
    return parts.groupBy(*PX).agg(F.sum("score").alias("score"))


# --- combining ------------------------------------------------------------------------------------------------


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], bins: int = 1024, zeros: int = 0) -> DataFrame:
    """Linear-interpolated quantiles ``q0, q1, ...`` in one row; NULLs are left out, and without values all are NULL. ``zeros`` more
    values are 0 without being rows: absent pixels.

    Nothing is sorted: passes of map-side counts over ``bins`` equal bins close in on the values of the ranks asked for. A
    bin's smallest and largest value are the next interval, so every pass splits it, and a rank is found when they are
    equal. The driver sees at most ``bins`` rows for each interval and pass.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where("v is not null")
    names = ", ".join(f"q{i} double" for i in range(len(qs)))
    values = values.withColumn("w", F.lit(1).cast("long"))
    if zeros:
        values = values.unionByName(df.sparkSession.range(1).select(F.lit(0.0).alias("v"), F.lit(zeros).cast("long").alias("w")))
    whole = values.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole["n"]:
        return df.sparkSession.createDataFrame([tuple(None for _ in qs)], names)
    at = [q * (whole["n"] - 1) for q in qs]
    ranks = {r for x in at for r in (math.floor(x), math.ceil(x))}
    spans = {(whole["lo"], whole["hi"], 0): ranks}  # smallest and largest value, rows before: ranks inside
    found: dict[int, float] = {}
    while spans:
        found |= {r: lo for (lo, hi, _), inside in spans.items() if lo == hi for r in inside}
        wide = [(k, inside) for k, inside in sorted(spans.items()) if k[0] < k[1]]
        if not wide:
            break
        which, slot = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, ((lo, hi, _), _ranks) in enumerate(wide):
            here = F.col("v").between(lo, hi)
            which = F.when(here, i).otherwise(which)
            slot = F.when(here, F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1)).cast("int")).otherwise(slot)
        counted = values.select(which.alias("i"), slot.alias("b"), "v", "w").where("i is not null").groupBy("i", "b").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        spans = {}
        rows = sorted(map(tuple, counted.collect()))
        for i, (key, inside) in enumerate(wide):
            before = key[2]
            for _, _, n, lo, hi in (r for r in rows if r[0] == i):
                mine = {r for r in inside if before <= r < before + n}
                if mine:
                    spans[(lo, hi, before)] = mine
                before += n
    mix = [found[math.floor(x)] * (1 - (x - math.floor(x))) + found[math.ceil(x)] * (x - math.floor(x)) for x in at]
    return df.sparkSession.createDataFrame([tuple(mix)], names)


def quantile_scale(value: str, start: Column, end: Column) -> Column:
    """0.1 * (m - start) / (end - start); left alone when the span is at most 1e-6."""
    v = F.col(value)
    return F.when(end - start > 1e-6, F.lit(0.1) * (v - start) / (end - start)).otherwise(v)


def combine_maps(st: DataFrame, ae: DataFrame, quantiles: DataFrame, component: DataFrame) -> DataFrame:
    """Quantile-scaled student and autoencoder maps summed, plus 0.15 of the component map.

    ``quantiles`` is one row ``st_start, st_end, ae_start, ae_end``.
    """
    both = st.select(*PX, F.col("score").alias("st")).join(ae.select(*PX, F.col("score").alias("ae")), list(PX))
    return combine_pixels(both, quantiles, component)


def combine_pixels(px: DataFrame, quantiles: DataFrame, component: DataFrame) -> DataFrame:
    """``combine_maps`` on one table ``(image_id, y, x, st, ae)``: no join of the two maps."""
    scaled = attach(px, quantiles, []).select(
        *PX,
        (quantile_scale("st", F.col("st_start"), F.col("st_end")) + quantile_scale("ae", F.col("ae_start"), F.col("ae_end"))).alias("texture"),
    )
    joined = scaled.join(component.select(*PX, F.col("score").alias("component")), list(PX), "left").na.fill(0.0, ["component"])
    return joined.withColumn("score", F.col("texture") + F.col("component") * F.lit(COMPONENT_WEIGHT))


def combined_score(maps: DataFrame) -> DataFrame:
    """Image score: largest texture value plus largest component value."""
    return maps.groupBy("image_id").agg((F.max("texture") + F.max("component")).alias("score"))


# --- smoothing --------------------------------------------------------------------------------------------------


def gaussian_kernel(sigma: float) -> np.ndarray:
    radius = int(4.0 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return g / g.sum()


def _reflect(i: np.ndarray, n: int) -> np.ndarray:
    m = np.mod(i, 2 * n)
    return np.where(m >= n, 2 * n - 1 - m, m)


def gaussian_smooth(
    px: DataFrame, h: int, w: int, sigma: float = 4.0, by: Sequence[str] = ("image_id",), value: str = "score", tile: int = 512
) -> DataFrame:
    """Gaussian blur with reflected borders. Images are cut into tiles with a halo of one kernel radius, so
    a task holds one bounded block whatever the image size; all-zero results stay absent."""
    by, kernel = list(by), gaussian_kernel(sigma)
    r = len(kernel) // 2

    def cover(axis: str, n: int) -> Column:
        last = (n - 1) // tile
        lo = F.greatest(F.floor((F.col(axis) - r) / F.lit(tile)), F.lit(0)).cast("int")
        hi = F.least(F.floor((F.col(axis) + r) / F.lit(tile)), F.lit(last)).cast("int")
        return F.explode(F.sequence(lo, hi))

    spread = px.select(*by, "y", "x", F.col(value).cast("double").alias("v"))
    spread = spread.withColumn("_ty", cover("y", h)).withColumn("_tx", cover("x", w))
    kinds = {f.name: f.dataType.simpleString() for f in px.schema.fields}

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["_ty"].iloc[0]) * tile, int(pdf["_tx"].iloc[0]) * tile
        y1, x1 = min(h, ty + tile), min(w, tx + tile)
        ya, xa = max(0, ty - r), max(0, tx - r)
        block = np.zeros((min(h, y1 + r) - ya, min(w, x1 + r) - xa))
        block[pdf["y"].to_numpy() - ya, pdf["x"].to_numpy() - xa] = pdf["v"].to_numpy()
        rows = block[_reflect(np.arange(ty - r, y1 + r), h) - ya]
        rows = sum(k * rows[i : i + y1 - ty] for i, k in enumerate(kernel))
        full = rows[:, _reflect(np.arange(tx - r, x1 + r), w) - xa]
        full = sum(k * full[:, i : i + x1 - tx] for i, k in enumerate(kernel))
        y, x = np.nonzero(full)
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in by}, "y": y + ty, "x": x + tx, value: full[y, x]})

    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + f", y int, x int, {value} double"
    return spread.groupBy(*by, "_ty", "_tx").applyInPandas(smooth, schema)


# --- pasting ------------------------------------------------------------------------------------------------------


def rotate_maps(px: DataFrame, h: int, w: int, keys: Sequence[str] = ("image_id", "instance_id")) -> DataFrame:
    """Rotate every instance map by its ``angle`` (degrees, about the centre, shape kept), bilinear; cells whose
    source lies outside are 0. Each target cell reads four source cells through one join."""
    keys = list(keys)
    still = px.where(F.col("angle") % 360 == 0).select(*keys, "y", "x", "score")
    turned = px.where(F.col("angle") % 360 != 0)
    cy, cx = (h - 1) / 2.0, (w - 1) / 2.0
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    cells = (
        turned.select(*keys, "angle")
        .distinct()
        .repartition(parallelism(px.sparkSession), *keys)  # few bytes that become h x w cells each: not merged by size
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
        # rounded, so that quarter turns hit the cells on the rim
        .withColumn("_sy", F.round(c * (F.col("y") - cy) + s * (F.col("x") - cx) + cy, 9))
        .withColumn("_sx", F.round(-s * (F.col("y") - cy) + c * (F.col("x") - cx) + cx, 9))
        .where(F.col("_sy").between(0, h - 1) & F.col("_sx").between(0, w - 1))
    )
    fy, fx = F.col("_sy") - F.floor("_sy"), F.col("_sx") - F.floor("_sx")
    taps = F.array(
        *[
            F.struct(
                (F.floor("_sy") + dy).cast("int").alias("sy"),
                (F.floor("_sx") + dx).cast("int").alias("sx"),
                ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("wt"),
            )
            for dy in (0, 1)
            for dx in (0, 1)
        ]
    )
    asked = cells.select(*keys, "y", "x", F.inline(taps)).where("wt > 0")
    source = turned.select(*keys, F.col("y").alias("sy"), F.col("x").alias("sx"), "score")
    # the cells look small before they are exploded, and must not be broadcast
    moved = asked.join(source.hint("merge"), [*keys, "sy", "sx"]).groupBy(*keys, "y", "x").agg(F.sum(F.col("score") * F.col("wt")).alias("score"))
    return still.unionByName(moved)


def _axis_scatter(df: DataFrame, axis: str, n_in: int, out: str) -> DataFrame:
    """Send each cell to the targets of a bilinear resize from ``n_in`` to ``df._n_<axis>`` cells (``wt_<axis>``)."""
    n = F.col(f"_n_{axis}")
    ratio = n / F.lit(float(n_in))
    lo = F.when(F.col(axis) == 0, F.lit(0)).otherwise(F.ceil((F.col(axis) - 0.5) * ratio - 0.5))
    hi = F.when(F.col(axis) == n_in - 1, n - 1).otherwise(F.floor((F.col(axis) + 1.5) * ratio - 0.5))
    lo, hi = F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, n - 1).cast("int")
    spread = df.withColumn(out, F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    src = F.least(F.greatest((F.col(out) + 0.5) / ratio - 0.5, F.lit(0.0)), F.lit(float(n_in - 1)))
    weight = F.greatest(1 - F.abs(src - F.col(axis)), F.lit(0.0))
    return spread.withColumn(f"wt_{axis}", weight).where(F.col(f"wt_{axis}") > 0)


def paste_instances(px: DataFrame, positions: DataFrame, size: int, input_h: int, input_w: int) -> DataFrame:
    """Merge instance score maps into their image canvas by maximum, floored at zero.

    ``px(image_id, instance_id, y, x, score)`` are ``size`` x ``size`` maps and ``positions`` has ``cx, cy``
    (fractions), ``scale`` and ``angle``. A map is turned back by its angle, resized to the instance and
    clipped to the canvas. Cells are scattered to their targets, so no map is assembled anywhere.
    """
    keys = ["image_id", "instance_id"]
    pos = positions.select(*keys, "cx", "cy", "scale", F.coalesce("angle", F.lit(0.0)).alias("angle"))
    turned = rotate_maps(px.join(pos.select(*keys, (-F.col("angle")).alias("angle")), keys), size, size)
    diagonal = F.lit(float(size)) / F.col("scale")
    placed = (
        turned.join(pos, keys)
        .withColumn("_n_x", (F.lit(float(size)) * diagonal / F.lit(float(input_w))).cast("int"))
        .withColumn("_n_y", (F.lit(float(size)) * diagonal / F.lit(float(input_h))).cast("int"))
        .withColumn("_ax", (F.col("cx") * size).cast("int") - F.floor(F.col("_n_x") / 2).cast("int"))
        .withColumn("_ay", (F.col("cy") * size).cast("int") - F.floor(F.col("_n_y") / 2).cast("int"))
    )
    spread = _axis_scatter(_axis_scatter(placed, "y", size, "_ty"), "x", size, "_tx")
    at_y, at_x = F.col("_ay") + F.col("_ty"), F.col("_ax") + F.col("_tx")
    resized = (
        spread.select(*keys, at_y.alias("y"), at_x.alias("x"), (F.col("score") * F.col("wt_y") * F.col("wt_x")).alias("score"))
        .where(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1))
        .groupBy(*keys, "y", "x")
        .agg(F.sum("score").alias("score"))
    )
    return resized.groupBy(*PX).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
