"""NULL keys are keys: no operator loses the rows of a NULL group. Limits and ties of the ordered operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayfield.operators import metrics as m
from strayfield.operators import neighbours as nn
from strayfield.operators import outliers as ol
from strayfield.operators import raster as rs
from strayfield.operators import sampling as sp
from strayfield.operators import windows as wn
from strayfield.operators.ordering import attach, framed, with_slice


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame([(k, i, float(i % 5)) for i, k in enumerate(["a", None, "b", None, "a", None])], "k string, id long, x double")


@pytest.mark.parametrize(
    "run",
    [
        lambda t: ol.zscore_outliers(t, "x", 2.0, by=["k"]),
        lambda t: wn.ema(t, "x", ["id"], 0.9, by=["k"]),
        lambda t: wn.greedy_batches(t.withColumn("n", F.lit(2)), 3, "id", by=["k"]),
        lambda t: attach(t, t.groupBy("k").agg(F.count("id").alias("n")), ["k"]),
        lambda t: nn.distance_sums(t.withColumn("vec", F.array("x", "id")), "k", "id"),
        lambda t: nn.pairwise(t.withColumn("vec", F.array("x", "id")), "k", "id"),
    ],
)
def test_null_keys_keep_their_rows(keyed, run):
    assert run(keyed).count() == 6


def test_null_key_of_error_shares_and_splits(keyed, spark):
    rows = keyed.withColumn("is_anomaly", (F.col("id") % 2).cast("int"))
    cut = rows.groupBy("k").agg(F.avg("x").alias("threshold"))
    assert m.error_shares(rows, cut, "x", "is_anomaly", by=["k"]).count() == 3
    assert sp.prefix_split(keyed, 0.5, ["id"], ["k"]).count() == 6


def test_area_of_billions(spark):
    n = 4_000_000_000
    counts = spark.createDataFrame([(1.0, n, 0), (0.0, 0, n)], "threshold double, pos long, neg long")
    curve = counts.withColumns({"tp": F.lit(n), "fp": F.when(F.col("threshold") == 0, n).otherwise(0), "p": F.lit(n), "n": F.lit(n)})
    assert curve.agg(m._area().alias("a")).first()["a"] == 1.0


def test_slices_are_even_and_split_ties(spark):
    rows = spark.range(300_000).withColumn("v", F.xxhash64("id"))
    sizes = [r["count"] for r in with_slice(rows, [], ["v"], slices=1100).groupBy("_slice").count().collect()]
    assert len(sizes) == 1100 and max(sizes) <= 2 * 300_000 / 1100
    ties = with_slice(spark.range(20_000).withColumn("v", F.lit(1)), [], ["v"], slices=20).groupBy("_slice").count().collect()
    assert len(ties) == 20 and max(r["count"] for r in ties) < 2_000


def test_frames_of_any_width(spark):
    got = framed(spark.range(50), ["id"], 30, {"s": F.sum("id")}, chunk=8).orderBy("id").toPandas()
    assert (got["s"] == pd.Series(range(50)).rolling(30, min_periods=1).sum()).all()


def test_greedy_batches_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, int(rng.integers(0, 6))) for k in ("a", None) for i in range(400)]
    got = wn.greedy_batches(spark.createDataFrame(rows, "k string, i long, n int"), 9, "i", by=["k"], chunk=3).collect()
    for key in ("a", None):
        state, batch, want = 0, 0, []
        for _, _, n in (r for r in rows if r[0] == key):
            want.append(batch)
            state += n
            if state >= 9:
                state, batch = 0, batch + 1
        assert [r.batch for r in sorted((r for r in got if r.k == key), key=lambda r: r.i)] == want


def test_batches_beyond_a_block(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((500, 3))
    table = spark.createDataFrame([(i, i // 400, p.tolist()) for i, p in enumerate(pts)], "vec_id long, batch int, vec array<double>")
    sums = nn.distance_sums(table, "batch", block_rows=64).toPandas().set_index("vec_id")["s"].sort_index()
    rows = nn.pairwise(table, "batch", block_rows=64).toPandas().set_index("vec_id")["distances"]
    for lo, hi in ((0, 400), (400, 500)):
        want = np.sqrt(((pts[lo:hi, None] - pts[None, lo:hi]) ** 2).sum(2))
        assert np.allclose(sums.loc[lo : hi - 1], want.sum(1)) and np.allclose(np.stack(rows.loc[list(range(lo, hi))]), want)


def test_inverted_lists_are_complete(spark):
    pts = np.random.default_rng(3).random((40, 4))
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, vec array<double>")
    got = nn.ann(table, table, 20, lists=16, probes=1).groupBy("query_id").count().collect()
    assert len(got) == 40 and all(r["count"] == 20 for r in got)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_kernels_of_any_size(spark, k):
    grid = np.random.default_rng(4).random((12, 12)) < 0.4
    px = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(grid))], "image_id int, y int, x int")
    a, b = k // 2, k - 1 - k // 2
    window = lambda y, x: grid[max(0, y - a) : y + b + 1, max(0, x - a) : x + b + 1]
    for run, fold in ((rs.dilate, np.any), (rs.erode, np.all)):
        want = {(y, x) for y in range(12) for x in range(12) if fold(window(y, x))}
        assert {(r.y, r.x) for r in run(px, k, 12, 12).collect()} == want


def test_windows_of_small_images(spark):
    assert rs.tile_windows(spark.createDataFrame([(0, 6, 6)], "image_id int, h int, w int"), 0.5).count() > 1
