"""Shape, colour and position records of components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strayfield.operators.ordering import attach

ORDERS = [(p, q) for p in range(4) for q in range(4) if p + q <= 3]

# Central moments from raw ones, then scale-free ones and the seven Hu invariants: formulas as SQL text
MEANS = {"cx": "m10 / m00", "cy": "m01 / m00"}
CENTRAL = {
    "mu20": "m20 - cx * m10",
    "mu11": "m11 - cx * m01",
    "mu02": "m02 - cy * m01",
    "mu30": "m30 - 3 * cx * m20 + 2 * cx * cx * m10",
    "mu21": "m21 - 2 * cx * m11 - cy * m20 + 2 * cx * cx * m01",
    "mu12": "m12 - 2 * cy * m11 - cx * m02 + 2 * cy * cy * m10",
    "mu03": "m03 - 3 * cy * m02 + 2 * cy * cy * m01",
}
HU = [
    "n20 + n02",
    "(n20 - n02) * (n20 - n02) + 4 * n11 * n11",
    "(n30 - 3 * n12) * (n30 - 3 * n12) + (3 * n21 - n03) * (3 * n21 - n03)",
    "(n30 + n12) * (n30 + n12) + (n21 + n03) * (n21 + n03)",
    "(n30 - 3 * n12) * (n30 + n12) * ((n30 + n12) * (n30 + n12) - 3 * (n21 + n03) * (n21 + n03)) "
    "+ (3 * n21 - n03) * (n21 + n03) * (3 * (n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03))",
    "(n20 - n02) * ((n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03)) + 4 * n11 * (n30 + n12) * (n21 + n03)",
    "(3 * n21 - n03) * (n30 + n12) * ((n30 + n12) * (n30 + n12) - 3 * (n21 + n03) * (n21 + n03)) "
    "- (n30 - 3 * n12) * (n21 + n03) * (3 * (n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03))",
]


def moment_sums(value: float) -> list:
    """Raw moments as plain sums; ``value`` is what a set pixel is stored with."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = []
    for p, q in ORDERS:
        term = F.lit(1.0)
        for _ in range(p):
            term = term * x
        for _ in range(q):
            term = term * y
        sums.append((F.sum(term) * F.lit(value)).alias(f"m{p}{q}"))
    return sums


def _hu_columns(moments: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = moments.select("*", *[F.expr(e).alias(n) for n, e in MEANS.items()])
    out = out.select("*", *[F.expr(e).alias(n) for n, e in CENTRAL.items()])
    scale2, scale3 = F.col("m00") * F.col("m00"), F.col("m00") * F.col("m00") * F.sqrt("m00")
    out = out.select(
        "*",
        *[(F.col(f"mu{o}") / scale2).alias(f"n{o}") for o in ("20", "11", "02")],
        *[(F.col(f"mu{o}") / scale3).alias(f"n{o}") for o in ("30", "21", "12", "03")],
    )
    invariants = [F.expr(e) for e in HU]
    logs = [F.when(v == 0, F.lit(0.0)).otherwise(-F.signum(v) * F.log10(F.abs(v))) for v in invariants]
    return out.select(*keep, F.array(*logs).alias("shape"))


def hu_moments(px: DataFrame, by: Sequence[str] = ("image_id", "mask_id"), value: float = 255.0) -> DataFrame:
    """Seven Hu moments per mask as -sign * log10(|h|), 0 for 0, from ten raw moment sums."""
    return _hu_columns(px.groupBy(*by).agg(*moment_sums(value)), list(by))


def component_features(
    px: DataFrame, h: int, w: int, target: float = 64.0, by: Sequence[str] = ("image_id", "component_id"), value: float = 255.0
) -> DataFrame:
    """Area share, colour, box centre, shape and scale per component.

    ``px`` has ``a, b``: the colour planes of the pixel. One aggregation gives all sums.
    """
    area = F.count(F.lit(1))
    ratio = F.col("b").cast("double") / (F.col("a").cast("double") + F.lit(1e-7))
    agg = px.groupBy(*by).agg(
        (area / F.lit(float(h * w))).alias("area"),
        (F.sum(ratio * ratio) / (area + F.lit(1e-7))).alias("color"),
        F.array(
            (F.min("x") + (F.max("x") - F.min("x") + 1) / 2) / F.lit(float(w)),
            (F.min("y") + (F.max("y") - F.min("y") + 1) / 2) / F.lit(float(h)),
        ).alias("position"),
        F.lit(target).__truediv__(
            F.sqrt(
                F.pow((F.max("x") - F.min("x") + 1).cast("double"), 2) + F.pow((F.max("y") - F.min("y") + 1).cast("double"), 2)
            )
        ).alias("scale"),
        *moment_sums(value),
    )
    return _hu_columns(agg, [*by, "area", "color", "position", "scale"])


def collect_components(
    df: DataFrame, features: Sequence[str] = ("area", "color", "position"), image: str = "image_id", component: str = "component_id"
) -> DataFrame:
    """Component records of an image as one array per feature, in component order."""
    rows = F.array_sort(F.collect_list(F.struct(component, *features)))
    packed = df.groupBy(image).agg(rows.alias("_r"))
    return packed.select(image, *[F.col(f"_r.{f}").alias(f) for f in features])


def alignment(boxes: DataFrame, target: float, mode: str = "plain", by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Scale and normalised centre of boxes ``x, y, w, h`` on a ``canvas_w`` x ``canvas_h`` raster.

    ``plain``: target / diagonal. ``padded``: target / (diagonal + 1). ``relative``: target / largest
    diagonal of the image.
    """
    sized = boxes.withColumn("diagonal", F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")))
    if mode == "plain":
        scaled = sized.withColumn("scale", F.lit(target) / F.col("diagonal"))
    elif mode == "padded":
        scaled = sized.withColumn("scale", F.lit(target) / (F.col("diagonal") + 1))
    elif mode == "relative":
        widest = sized.groupBy(*by).agg(F.max("diagonal").alias("_max"))
        scaled = attach(sized, widest, by).withColumn("scale", F.lit(target) / F.col("_max")).drop("_max")
    else:
        raise ValueError(f"unknown mode {mode}")
    return scaled.withColumn("center_x", (F.col("x") + F.col("w") / 2) / F.col("canvas_w")).withColumn(
        "center_y", (F.col("y") + F.col("h") / 2) / F.col("canvas_h")
    )
