"""Operators on vectors and vector grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strayfield.functions.arrays import bind, doubles, mean_squared_difference, squared_distance, total
from strayfield.operators.neighbours import linear_map
from strayfield.operators.ordering import attach
from strayfield.operators.tiles import slide

CELL = ("image_id", "y", "x")
WIDE_DIMS = 100  # up to here one aggregate per dimension stays inside generated code


def offsets(k: int) -> Column:
    """The k x k neighbourhood as an array of (dy, dx, pos)."""
    r = (k - 1) // 2
    return F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((dy + r) * k + dx + r).alias("pos"))
            for dy in range(-r, k - r)
            for dx in range(-r, k - r)
        ]
    )


def inside(h: int, w: int) -> Column:
    return (F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w)


def patchify(px: DataFrame, h: int, w: int, k: int = 3, stride: int = 1, by: Sequence[str] = ("image_id",), vec: str = "vec") -> DataFrame:
    """Neighbourhood vectors: k x k cells around every ``stride``-th cell, channel-major, zeros outside.

    Each cell is sent to the at most k*k patches it belongs to, so absent cells cost nothing.
    """
    keys = [*by, "y", "x"]
    sent = (
        px.select(*by, "y", "x", doubles(vec).alias("v"), F.explode(offsets(k)).alias("o"))
        .select(*by, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "o.pos", "v")
        .where(inside(h, w) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0))
        .withColumn("y", (F.col("y") / stride).cast("int"))
        .withColumn("x", (F.col("x") / stride).cast("int"))
    )
    found = sent.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    channels = F.size(F.get(F.map_values("m"), 0))
    taps = F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda p: F.try_element_at("m", p))
    with_taps = found.withColumn("t", taps).withColumn("c", channels)
    patch = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("c") - 1),
            lambda c: F.transform(F.col("t"), lambda v: F.coalesce(F.get(v, c), F.lit(0.0))),
        )
    )
    return with_taps.select(*keys, patch.alias("vec"))


def axis_taps(spark, n_in: int, n_out: int) -> DataFrame:
    """Bilinear taps of one axis without corner alignment: ``(t, s, weight)``, two rows per target."""
    src = F.greatest((F.col("id") + 0.5) * F.lit(n_in / n_out) - 0.5, F.lit(0.0))
    lo = F.floor(src).cast("int")
    base = spark.range(n_out).select(F.col("id").cast("int").alias("t"), lo.alias("lo"), (src - lo).alias("f"))
    hi = F.least(F.col("lo") + 1, F.lit(n_in - 1))
    pair = F.array(
        F.struct(F.col("lo").alias("s"), (1 - F.col("f")).alias("weight")), F.struct(hi.alias("s"), F.col("f").alias("weight"))
    )
    return base.select("t", F.explode(pair).alias("p")).groupBy("t", "p.s").agg(F.sum("p.weight").alias("weight"))


def resize_grid(
    px: DataFrame, h_in: int, w_in: int, h_out: int, w_out: int, by: Sequence[str] = ("image_id",), value: str = "score"
) -> DataFrame:
    """Bilinear resize of a sparse grid. The tap tables have two rows per output row or column."""
    rows = axis_taps(px.sparkSession, h_in, h_out).toDF("ty", "y", "wy")
    cols = axis_taps(px.sparkSession, w_in, w_out).toDF("tx", "x", "wx")
    return (
        px.join(F.broadcast(rows), "y")
        .join(F.broadcast(cols), "x")
        .groupBy(*by, F.col("ty").alias("y"), F.col("tx").alias("x"))
        .agg(F.sum(F.col(value) * F.col("wy") * F.col("wx")).alias(value))
    )


def resize_nearest(
    px: DataFrame, h_in: int, w_in: int, h_out: int, w_out: int, by: Sequence[str] = ("image_id",), value: str = "label"
) -> DataFrame:
    """Nearest resize of a label map; output cell t reads input cell floor(t * in / out)."""

    def axis(n_in: int, n_out: int, t: str, s: str) -> DataFrame:
        return px.sparkSession.range(n_out).select(
            F.col("id").cast("int").alias(t), F.floor(F.col("id") * F.lit(n_in) / F.lit(n_out)).cast("int").alias(s)
        )

    return (
        px.join(F.broadcast(axis(h_in, h_out, "ty", "y")), "y")
        .join(F.broadcast(axis(w_in, w_out, "tx", "x")), "x")
        .select(*by, F.col("ty").alias("y"), F.col("tx").alias("x"), value)
    )


def merge_layers(layers: Sequence[DataFrame], keys: Sequence[str] = CELL, vec: str = "vec", mode: str = "concat") -> DataFrame:
    """Join the layers of a cell; ``concat`` along channels or ``stack`` as an array of vectors."""
    out = layers[0].select(*keys, F.col(vec).alias("_v0"))
    for i, layer in enumerate(layers[1:], 1):
        out = out.join(layer.select(*keys, F.col(vec).alias(f"_v{i}")), list(keys))
    parts = [F.col(f"_v{i}") for i in range(len(layers))]
    return out.select(*keys, (F.concat(*parts) if mode == "concat" else F.array(*parts)).alias(vec))


def concat_vectors(dfs: Sequence[DataFrame], keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Flatten and join several feature sets of the same items into one vector."""
    flat = [d.withColumn(vec, F.flatten(vec)) if d.schema[vec].dataType.simpleString().startswith("array<array") else d for d in dfs]
    return merge_layers(flat, keys, vec)


def avg_pool3(px: DataFrame, h: int, w: int, by: Sequence[str] = ("image_id",), value: str = "score") -> DataFrame:
    """3 x 3 average pool, stride 1; cells outside count as zeros."""
    summed = slide(px.withColumn(value, F.col(value).cast("double")), "sum", 3, h, w, by, value)
    return summed.withColumn(value, F.col(value) / F.lit(9.0))


def _reduce_vectors(df: DataFrame, by: Sequence[str], vec: str, how, dims: int | None) -> DataFrame:
    if dims is not None and dims <= WIDE_DIMS:
        return df.groupBy(*by).agg(F.array(*[how(F.get(vec, i).cast("double")) for i in range(dims)]).alias(vec))
    per_dim = df.select(*by, F.posexplode(vec).alias("pos", "v")).groupBy(*by, "pos").agg(how(F.col("v").cast("double")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return per_dim.groupBy(*by).agg(F.transform(ordered, lambda s: s["v"]).alias(vec))


def mean_vector(df: DataFrame, by: Sequence[str], vec: str = "vec", dims: int | None = None) -> DataFrame:
    """Mean vector per key; both forms combine map-side, so a hot key is no single-task sum."""
    return _reduce_vectors(df, by, vec, F.avg, dims)


def bundle_mean(df: DataFrame, by: Sequence[str] = ("instance_id",), vec: str = "vec", mode: str = "mean", dims: int | None = None) -> DataFrame:
    """One vector per instance from the vectors of its rotations."""
    return _reduce_vectors(df, by, vec, F.avg if mode == "mean" else F.max, dims)


def gaussian_weights(dims_in: int, dims_out: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims_out, dims_in))


def rand_projection(df: DataFrame, weights: np.ndarray, vec: str = "vec", out: str = "projected") -> DataFrame:
    return linear_map(df, vec, weights, out)


def dim_range(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Smallest and largest value per dimension, started at +999 and -999."""
    return (
        df.select(F.posexplode(vec).alias("dim", "v"))
        .groupBy("dim")
        .agg(
            F.least(F.lit(999.0), F.min(F.col("v").cast("double"))).alias("lo"),
            F.greatest(F.lit(-999.0), F.max(F.col("v").cast("double"))).alias("hi"),
        )
    )


def dim_histogram(df: DataFrame, ranges: DataFrame, bins: int, by: Sequence[str] = ("sample_id",), vec: str = "vec") -> DataFrame:
    """Equal-width histogram per dimension in [lo, hi]; values outside are left out, hi is in the last bin."""
    bounds = ranges.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("_r"))  # one entry per dimension
    cells = attach(df.select(*by, vec), bounds, []).select(
        *by, F.posexplode(F.arrays_zip(F.col(vec).alias("v"), F.col("_r").alias("r"))).alias("dim", "c")
    )
    v, lo, hi = F.col("c.v").cast("double"), F.col("c.r.lo"), F.col("c.r.hi")
    at = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    return (
        cells.where((v >= lo) & (v <= hi))
        .withColumn("bin", at.cast("int"))
        .groupBy(*by, "dim", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def density(hist: DataFrame) -> DataFrame:
    """Histogram counts summed over samples and scaled to unit L2 norm over the bins of a dimension."""
    summed = hist.groupBy("dim", "bin").agg(F.sum("n").cast("double").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("dim")))  # a dimension has `bins` rows
    return summed.select("dim", "bin", (F.col("n") / F.greatest(length, F.lit(1e-12))).alias("density"))


def bin_vectors(hist: DataFrame, by: Sequence[str], bins: int, value: str = "n") -> DataFrame:
    """Long histogram to one unit-length array per (key, dim); empty bins are 0."""
    found = hist.groupBy(*by, "dim").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col(value).cast("double")))).alias("m")
    )
    raw = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    arr = found.select(*by, "dim", raw.alias("h"))
    length = F.greatest(F.sqrt(total(F.transform("h", lambda x: x * x))), F.lit(1e-12))
    return arr.select(*by, "dim", bind(length, lambda n: F.transform("h", lambda x: x / n)).alias("h"))


def _projections(dens: DataFrame, bins: int, proj_dims: int) -> DataFrame:
    """The model: per projection the list of its density rows (projections * dims * bins numbers in all)."""
    rows = bin_vectors(dens, [], bins, "density").withColumn("proj", F.floor(F.col("dim") / proj_dims).cast("int"))
    return rows.groupBy("proj").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "h"))), lambda s: s["h"]).alias("model"))


def projection_score(hist: DataFrame, dens: DataFrame, bins: int, proj_dims: int, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Kernel-density scores (Gaussian, bandwidth 1) per projection, then their mean, std, min and low mean.

    The kernel sum runs inside one expression over the few density rows of a projection; no pairs are emitted.
    ``low_mean`` averages the ``int(0.1 * proj_dims)`` lowest projections, at least one.
    """
    model = _projections(dens, bins, proj_dims)
    rows = bin_vectors(hist, by, bins).withColumn("proj", F.floor(F.col("dim") / proj_dims).cast("int")).join(F.broadcast(model), "proj")
    exponents = F.transform("model", lambda m: squared_distance(F.col("h"), m) * F.lit(-0.5))
    lse = bind(F.array_max("e"), lambda top: top + F.log(total(F.transform("e", lambda e: F.exp(e - top)))))
    log_density = lse - F.log(F.size("model").cast("double")) - F.lit(bins / 2.0 * float(np.log(2 * np.pi)))
    scored = rows.withColumn("e", exponents).withColumn("ld", log_density)
    per_proj = scored.groupBy(*by, "proj").agg(F.avg("ld").alias("s"))
    low = max(1, int(proj_dims * 0.1))
    return per_proj.groupBy(*by).agg(
        F.avg("s").alias("mean"),
        F.stddev_pop("s").alias("std"),
        F.min("s").alias("min"),
        (total(F.slice(F.array_sort(F.collect_list("s")), 1, low)) / F.lit(float(low))).alias("low_mean"),
    )


def projection_kl(
    hist: DataFrame, dens: DataFrame, bins: int, proj_dims: int, by: Sequence[str] = ("sample_id",), symmetric: bool = False
) -> DataFrame:
    """Histogram divergence per sample: sum of t * (ln t - x) over bins, averaged over rows and projections.

    x is the raw (not logarithmic) sample histogram, as the score is defined; ``symmetric`` gives the mean of
    both Kullback-Leibler directions of the smoothed histograms instead.
    """
    model = bin_vectors(dens, [], bins, "density").withColumnRenamed("h", "t")
    rows = bin_vectors(hist, by, bins).join(F.broadcast(model), "dim")  # one row per projected dimension

    def one(x: Column, t: Column) -> Column:
        if symmetric:
            a, b = x + 1e-10, t + 1e-10
            return F.lit(0.5) * (a - b) * (F.log(a) - F.log(b))
        return F.when(t > 0, t * (F.log(t) - x)).otherwise(F.lit(0.0))

    term = total(F.zip_with("h", "t", one))
    per_proj = rows.groupBy(*by, F.floor(F.col("dim") / proj_dims).alias("proj")).agg((F.sum(term) / F.lit(float(proj_dims))).alias("kl"))
    return per_proj.groupBy(*by).agg(F.avg("kl").alias("kl"))


def diff_map(a: DataFrame, b: DataFrame, keys: Sequence[str] = CELL, vec: str = "vec") -> DataFrame:
    """Channel mean of the squared difference of two feature maps."""
    both = a.select(*keys, F.col(vec).alias("_a")).join(b.select(*keys, F.col(vec).alias("_b")), list(keys))
    return both.select(*keys, mean_squared_difference("_a", "_b").alias("score"))
