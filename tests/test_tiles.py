"""Windowed raster work by tile: batches that cut through a tile, tiles with a rim, and how tasks are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayfield.operators import raster as rs, scoremaps as sm, tiles
from strayfield.session import configure


@pytest.fixture
def pixels(spark):
    rng = np.random.default_rng(5)
    cells = [(i, y, x, None if v < 0.1 else v) for i in (1, 2, 7, None) for y in range(20) for x in range(23) if (v := float(rng.random())) < 0.6]
    return spark.createDataFrame(cells, "image_id int, y int, x int, s double")


def _window(cells, how, k, h, w):
    found = {}
    values = {(i, y, x): s for i, y, x, s in cells}
    for i in {c[0] for c in cells}:
        for y in range(h):
            for x in range(w):
                near = [(i, y + a, x + b) for a in range(-(k // 2), k - k // 2) for b in range(-(k // 2), k - k // 2)]
                hit = [p in values or (how == "all" and not (0 <= p[1] < h and 0 <= p[2] < w)) for p in near]
                if all(hit) if how == "all" else any(hit):
                    known = [values[p] for p in near if values.get(p) is not None]
                    found[(i, y, x)] = None if how in ("any", "all") or not known else round({"max": max, "sum": sum}[how](known), 9)
    return found


@pytest.mark.parametrize("how", ["any", "all", "max", "sum"])
@pytest.mark.parametrize("k, tile, batch", [(3, 512, 10_000), (4, 6, 7), (5, 8, 100)])
def test_windows_equal_brute_force_across_tiles_and_batches(spark, pixels, how, k, tile, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = tiles.slide(pixels, how, k, 20, 23, ["image_id"], "s" if how in ("max", "sum") else None, tile).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = _window([tuple(r) for r in pixels.collect()], how, k, 20, 23)
    assert len(got) == len(want)
    assert {(r.image_id, r.y, r.x): round(r.s, 9) if "s" in r and r.s is not None else None for r in got} == want


@pytest.mark.parametrize("conn", [4, 8])
def test_components_do_not_depend_on_batches(spark, pixels, conn):
    whole = sorted(map(tuple, rs.components(pixels, 20, 23, conn).na.fill(-1).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        cut = sorted(map(tuple, rs.components(pixels, 20, 23, conn).na.fill(-1).collect()))
        assert len({t[0] for t in whole}) == 4 and cut == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_pixels_are_not_copied_for_each_cell_of_a_window(spark, pixels):
    for df in (rs.dilate(pixels, 5, 20, 23), rs.max_filter(pixels, 5, 20, 23, "s")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" not in plan and "Aggregate" not in plan


def test_images_that_become_many_cells_are_dealt_to_all_tasks(spark):
    px = spark.createDataFrame([(i, 0, 1, 1, 1.0, 30.0) for i in range(64)], "image_id int, instance_id int, y int, x int, score double, angle double")
    turned = sm.rotate_maps(px, 8, 8)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in turned and "BroadcastHashJoin" not in turned
    assert "REPARTITION_BY_NUM" in rs.complement(px, 8, 8)._jdf.queryExecution().toString()
    assert configure(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
