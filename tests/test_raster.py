"""Raster operators against small dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayfield.operators import raster as rs
from strayfield.operators import scoremaps as sm

H, W = 23, 31


@pytest.fixture(scope="module")
def images():
    return {i: np.random.default_rng(i).random((H, W)) < 0.45 for i in range(3)}


def table(spark, images):
    rows = [(i, int(y), int(x)) for i, m in images.items() for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "image_id long, y int, x int")


def dense(df, images):
    out = {i: np.zeros((H, W), bool) for i in images}
    for r in df.collect():
        assert not out[r["image_id"]][r["y"], r["x"]]
        out[r["image_id"]][r["y"], r["x"]] = True
    return out


def grow(m, r, full=False):
    p = np.pad(m, r, constant_values=full)
    parts = [p[dy : dy + H, dx : dx + W] for dy in range(2 * r + 1) for dx in range(2 * r + 1)]
    return np.logical_and.reduce(parts) if full else np.logical_or.reduce(parts)


def flood(m, conn):
    label = np.full((H, W), -1)
    near = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    for y in range(H):
        for x in range(W):
            if m[y, x] and label[y, x] < 0:
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < H and 0 <= b < W and m[a, b] and label[a, b] < 0:
                        label[a, b] = y * W + x
                        todo += [(a + dy, b + dx) for dy, dx in near]
    return label


def test_dilate_erode_and_duality(spark, images):
    px = table(spark, images)
    grown, shrunk = dense(rs.dilate(px, 5, H, W), images), dense(rs.erode(px, 3, H, W), images)
    other = dense(rs.complement(rs.dilate(rs.complement(px, H, W), 3, H, W), H, W), images)
    for i, m in images.items():
        assert (grown[i] == grow(m, 2)).all()
        assert (shrunk[i] == grow(m, 1, True)).all()
        assert (other[i] == shrunk[i]).all()


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("tile", [7, 1024])
def test_components(spark, images, conn, tile):
    runs = rs.components(table(spark, images), H, W, conn, tile=tile)
    got = {i: np.full((H, W), -1) for i in images}
    for r in runs.collect():
        got[r["image_id"]][r["y"], r["x0"] : r["x1"] + 1] = r["component"]
    for i, m in images.items():
        assert (got[i] == flood(m, conn)).all()


def fill(m):
    label = flood(~m, 4)
    edge = set(label[0]) | set(label[-1]) | set(label[:, 0]) | set(label[:, -1])
    return m | ~np.isin(label, list(edge | {-1}))


def denoise(m, f):
    label = flood(m, 8)
    ids, n = np.unique(label[m], return_counts=True)
    return np.isin(label, ids[n >= f * n.sum()]) & m


def test_fill_holes_and_noise(spark, images):
    px = table(spark, images)
    filled, clean = dense(rs.fill_holes(px, H, W), images), dense(rs.remove_noise(px, H, W, 0.05), images)
    for i, m in images.items():
        assert (filled[i] == fill(m)).all()
        assert (clean[i] == denoise(m, 0.05)).all()


def test_fuse_masks(spark):
    rng = np.random.default_rng(9)
    fg = np.zeros((H, W), bool)
    fg[5:15, 6:20] = True
    masks = []
    for _ in range(6):
        y, x = rng.integers(0, 15), rng.integers(0, 20)
        m = np.zeros((H, W), bool)
        m[y : y + 6, x : x + 8] = True
        masks.append(m)
    rows = [(0, k, int(y), int(x)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    got = dense(
        rs.fuse_masks(spark.createDataFrame(rows, "image_id long, mask_id int, y int, x int"), table(spark, {0: fg}), H, W, 0.6), {0: fg}
    )[0]
    wide = grow(fg, 2)
    keep = [m for m in masks if (m & wide).sum() / m.sum() >= 0.6]
    out = np.logical_or.reduce(keep)
    assert keep and out.mean() <= 0.5
    hc, wc = int(H * 0.01), int(W * 0.01)
    assert hc == wc == 0
    want = denoise(fill(grow(grow(out, 2), 2, True)), 0.01)
    assert (got == want).all()


def test_gaussian_tiles_agree(spark):
    m = np.random.default_rng(3).random((H, W))
    rows = [(0, y, x, float(m[y, x])) for y in range(H) for x in range(W)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, score double")
    k = sm.gaussian_kernel(1.5)
    r = len(k) // 2
    p = np.pad(m, r, mode="symmetric")
    want = sum(a * p[i : i + H] for i, a in enumerate(k))
    want = sum(a * want[:, i : i + W] for i, a in enumerate(k))
    assert k.sum() == pytest.approx(1)
    for tile in (9, 512):
        got = np.zeros((H, W))
        for q in sm.gaussian_smooth(px, H, W, 1.5, tile=tile).collect():
            got[q["y"], q["x"]] = q["score"]
        assert np.allclose(got, want)


def test_paste_rotated_by_quarter_turns(spark):
    n = 9
    m = np.random.default_rng(4).random((n, n))
    rows = [(0, 0, y, x, float(m[y, x])) for y in range(n) for x in range(n)]
    px = spark.createDataFrame(rows, "image_id long, instance_id int, y int, x int, score double")
    # array row 0 is the top; a positive angle turns back the other way
    for angle, want in ((0.0, m), (360.0, m), (180.0, np.rot90(m, 2)), (90.0, np.rot90(m, -1))):
        pos = spark.createDataFrame([(0, 0, 0.5, 0.5, 1.0, angle)], "image_id long, instance_id int, cx double, cy double, scale double, angle double")
        got = np.zeros((n, n))
        for r in sm.paste_instances(px, pos, n, n, n).collect():
            got[r["y"], r["x"]] = r["score"]
        assert np.allclose(got, want, atol=1e-6)


def test_pasting_clips_and_floors(spark):
    px = spark.createDataFrame([(0, 0, y, x, -1.0 if y == 0 else 2.0) for y in range(8) for x in range(8)], "image_id long, instance_id int, y int, x int, score double")
    pos = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, None)], "image_id long, instance_id int, cx double, cy double, scale double, angle double")
    out = sm.paste_instances(px, pos, 8, 8, 8)
    assert out.where((F.col("y") > 3) | (F.col("x") > 3) | (F.col("score") < 0)).isEmpty()
    assert out.count() == 16


def test_iou_is_symmetric(spark):
    from strayfield.operators.segmentation import iou

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 4, (300, 2))], "pred int, gt int")
    a = [r["iou"] for r in iou(df, 4).orderBy("class_id").collect()]
    b = [r["iou"] for r in iou(df, 4, "gt", "pred").orderBy("class_id").collect()]
    assert a == b


def test_quantiles(spark):
    v = np.random.default_rng(6).integers(0, 20, 101).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert list(sm.exact_quantiles(df, "v", [0.0, 0.33, 0.9, 1.0]).first()) == pytest.approx(np.quantile(v, [0, 0.33, 0.9, 1.0]).tolist())
