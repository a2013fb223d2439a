"""Block-distance operators against brute force, with blocks small enough that cells, blocks and chunks all occur."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayfield.operators import neighbours as nn
from strayfield.operators import pivots as pv
from strayfield.operators import outliers as ol
from strayfield.operators import sampling as sp
from strayfield.operators import selection as sel
from strayfield.operators.graph import connected_components


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, vec array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    parts = [rng.normal(c, 0.3, (60, 3)) for c in (0, 4, 9)]
    copies = np.tile([[4.0, 4.0, 4.0]], (90, 1))  # a third of all rows are one vector
    return np.concatenate([*parts, copies])


def brute(q, b, metric):
    diff = np.abs(q[:, None] - b[None])
    if metric == "l2sq":
        return (diff**2).sum(2)
    if metric == "l1":
        return diff.sum(2)
    if metric == "lp":
        return (diff**1.5).sum(2)
    qn, bn = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, b))
    return 1 - qn @ bn.T


@pytest.mark.parametrize("metric", ["l2sq", "l1", "lp", "cosine"])
def test_knn_with_cells(spark, cloud, metric):
    query = cloud[::5] + 0.05
    got = nn.knn(vectors(spark, query), vectors(spark, cloud), 7, metric, block_rows=40).toPandas()
    d = brute(query, cloud, metric)
    want = np.sort(d, axis=1)[:, :7]
    assert len(got) == len(query) * 7
    by_query = got.sort_values(["query_id", "rn"])["distance"].to_numpy().reshape(-1, 7)
    assert np.allclose(by_query, want, atol=1e-9)


def test_pivot_tree_of_several_levels(spark, monkeypatch):
    """Clustered vectors in 64 dimensions under a small fan: exact, several levels, few leaves visited, no table in a closure."""
    monkeypatch.setattr(pv, "FAN", 4)
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(c, 0.05, (25, 64)) for c in rng.normal(0, 1, (12, 64))])
    bank = vectors(spark, m)
    index = nn.index_bank(bank, block_rows=12)
    assert index.tree.levels and len(index.tree.top.pivot) <= 4
    assert sorted(r[0] for r in index.tree.placed.select("bank_id").collect()) == list(range(300))
    got = nn.search(vectors(spark, m[::3]), index, 3).toPandas().sort_values(["query_id", "rn"])["distance"].to_numpy().reshape(-1, 3)
    assert np.allclose(got, np.sort(brute(m[::3], m, "l2sq"), axis=1)[:, :3], atol=1e-9)
    seen = nn.leaves_visited(vectors(spark, m[::3]), index, 3).toPandas()
    assert seen["visited"].sum() * 3 < seen["leaves"].sum()


def test_knn_ties_go_to_lowest_ids(spark, cloud):
    got = nn.knn(vectors(spark, np.array([[4.0, 4.0, 4.0]])), vectors(spark, cloud), 5, block_rows=40).toPandas()
    assert got.sort_values("rn")["bank_id"].tolist() == [180, 181, 182, 183, 184]


def test_knn_mahalanobis(spark, cloud):
    got = nn.knn(vectors(spark, cloud[:20]), vectors(spark, cloud), 3, "mahalanobis").toPandas()
    inv = np.linalg.inv(np.cov(cloud.T))
    diff = cloud[:20, None] - cloud[None]
    want = np.sort(np.einsum("qbi,ij,qbj->qb", diff, inv, diff), axis=1)[:, :3]
    assert np.allclose(got.sort_values(["query_id", "rn"])["distance"].to_numpy().reshape(-1, 3), want, atol=1e-8)


def test_k_larger_than_bank_and_bad_arguments(spark, cloud):
    bank = vectors(spark, cloud[:4])
    assert nn.knn(bank, bank, 10).count() == 16
    with pytest.raises(ValueError):
        nn.knn(bank, bank, 0)
    with pytest.raises(ValueError):
        nn.knn(bank, bank, 1, "chebyshev")


def test_ann_recall(spark, cloud):
    data = vectors(spark, cloud)
    exact = set(map(tuple, nn.knn(data, data, 5).select("query_id", "distance").withColumn("distance", F.round("distance", 6)).collect()))
    near = set(map(tuple, nn.ann(data, data, 5, lists=8, probes=4).select("query_id", "distance").withColumn("distance", F.round("distance", 6)).collect()))
    assert len(exact & near) / len(exact) >= 0.9


def test_self_score_blocks(spark, cloud):
    df = vectors(spark, cloud).withColumn("g", F.when(F.col("vec_id") < 200, "a").otherwise("b"))
    got = nn.self_score(df, "g", frac=0.05, block_rows=30).toPandas().set_index("query_id")["score"]
    for ids in (np.arange(200), np.arange(200, 270)):
        d = np.sort(brute(cloud[ids], cloud[ids], "l2sq"), axis=1)[:, : max(1, int(0.05 * len(ids)))]
        assert np.allclose(got.loc[ids], d.mean(1), atol=1e-9)


@pytest.mark.parametrize("k, copies", [(2, 1), (7, 1), (7, 3), (40, 2)])
def test_nearest_sums_in_rounds(spark, k, copies):
    """Ties at the k-th distance, copies that count several times, a third of all rows equal, k beyond a block's rows."""
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.integers(0, 400, 60), np.full(30, 7)]).astype(float)
    rows = spark.createDataFrame([(1, i, [float(v)], k, 1 + i % copies) for i, v in enumerate(x)], "cell long, query_id long, vec array<double>, k long, w long")
    got = sel.nearest_sums(rows, block_rows=32).toPandas().sort_values("query_id")
    w = 1 + np.arange(len(x)) % copies
    near = [np.sort(np.repeat((v - x) ** 2, w))[:k] for v in x]
    assert np.allclose(got["total"], [n.sum() for n in near], atol=1e-6) and np.allclose(got["kth"], [n[-1] for n in near], atol=1e-6)


def test_mean_shift_of_nothing(spark):
    labels, centres = ol.mean_shift(vectors(spark, np.zeros((0, 2))), 1.0)
    assert labels.collect() == [] and centres.collect() == [] and labels.columns == ["vec_id", "label"]
    assert ol.bandwidth(vectors(spark, np.zeros((0, 2)))).first()["bandwidth"] is None


def test_grid_cells_hold_all_within_the_radius(spark):
    m = np.random.default_rng(8).normal(0, 2, (150, 4))
    points = vectors(spark, m)
    grid = ol.Grid(points, 0.9)
    cells = {r.vec_id: (r.c, set(r.a)) for r in points.select("vec_id", grid.cell().alias("c"), grid.around().alias("a")).collect()}
    assert len(grid.dims) == 3 and len({c for c, _ in cells.values()}) > 20
    for i, j in np.argwhere(np.sqrt(brute(m, m, "l2sq")) <= 0.9):
        assert cells[j][0] in cells[i][1]


def greedy(m, picks, anchor):
    out = []
    for _ in range(picks):
        free = [i for i in range(len(m)) if i not in out]
        i = max(free, key=lambda j: (anchor[j], -j))
        out.append(i)
        anchor = np.minimum(anchor, np.sqrt(((m - m[i]) ** 2).sum(1)))
    return out


def test_coreset_is_the_exact_greedy_one(spark):
    m = np.random.default_rng(4).random((150, 3))
    d = np.sqrt(brute(m, m, "l2sq"))
    got = sp.greedy_coreset(vectors(spark, m), 0.2, look=12).toPandas().sort_values("pick_no")["vec_id"].tolist()
    assert got == greedy(m, 30, np.sqrt((d * d).sum(1)))


@pytest.mark.parametrize("part_rows", [1000, 64, 24])
def test_two_level_coreset_covers(spark, part_rows):
    """One part (the greedy choice itself), several parts with one at the end, several at the end: size and cover radius."""
    m = np.random.default_rng(12).random((300, 3))
    d = np.sqrt(brute(m, m, "l2sq"))
    picks = sp.two_level_coreset(vectors(spark, m), 0.1, part_rows=part_rows).toPandas().sort_values("pick_no")
    assert picks["pick_no"].tolist() == list(range(30)) and picks["vec_id"].nunique() == 30
    exact = sp.approx_coreset(vectors(spark, m), 0.1, look=64).toPandas().sort_values("pick_no")["vec_id"].tolist()
    radius = sp.cover_radius(vectors(spark, m), spark.createDataFrame(picks)).first()["radius"]
    assert np.isclose(radius, d[:, picks["vec_id"]].min(1).max())
    assert radius <= 2 * d[:, exact].min(1).max()


def test_samplers_are_exact_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    a = sp.random_sample(df, 0.37, 1, "i")
    assert a.count() == 370 and a.distinct().count() == 370
    assert sorted(a.collect()) == sorted(sp.random_sample(df.repartition(13), 0.37, 1, "i").collect())
    assert sp.resample_to(df, 2345, 1, "i").count() == 2345
    with pytest.raises(ValueError):
        sp.random_sample(df, 1.0, 1, "i")


def flat_dbscan(m, eps, k):
    near = np.sqrt(brute(m, m, "l2sq")) <= eps
    core = near.sum(1) >= k
    label, no = np.full(len(m), -1), 0
    for i in range(len(m)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = no
                    if core[j]:
                        todo += [x for x in np.nonzero(near[j])[0] if label[x] < 0]
            no += 1
    return label


@pytest.mark.parametrize("block_rows", [25, 1000])
def test_dbscan(spark, cloud, block_rows):
    m = cloud.round(2)
    got = ol.dbscan(vectors(spark, m), 0.35, 5, block_rows=block_rows).toPandas().sort_values("vec_id")["label"].to_numpy()
    assert (got == flat_dbscan(m, 0.35, 5)).all()


def test_mean_shift(spark):
    x = np.concatenate([np.random.default_rng(5).normal(c, 0.1, 15) for c in (0, 3)])[:, None]
    labels, centres = ol.mean_shift(vectors(spark, x), 1.0)
    got = labels.toPandas().sort_values("vec_id")["label"].to_numpy()
    assert len(set(got[:15])) == 1 and len(set(got[15:])) == 1 and got[0] != got[20]
    assert sorted(round(c["centre"][0], 6) for c in centres.collect()) == pytest.approx([x[:15].mean(), x[15:].mean()], abs=1e-5)


def test_connected_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200, i) for i in range(201, 240)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_zscore_without_deviation(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, v double")
    assert {r["label"] for r in ol.zscore_outliers(df, "v").collect()} == {0}


def test_iterative_outliers(spark):
    v = np.concatenate([np.random.default_rng(7).normal(10, 1, 200), [100.0, 90.0]])
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(202), "area": v}))
    kept = ol.iterative_outliers(df, 0.3).toPandas()
    assert not {200, 201} & set(kept["i"])


@pytest.mark.parametrize("metric, p", [("l1", 1.0), ("lp", 1.5), ("lp", 0.7)])
def test_lower_bounds_spare_most_distances(monkeypatch, metric, p):
    """Bounds from matrix products are never above a distance, also far from the origin, and leave few pairs of unstructured rows."""
    rng = np.random.default_rng(5)
    for at, scale in ((0.0, 1.0), (1e6, 1e-2), (0.0, 1e-60)):
        b = at + scale * rng.normal(size=(900, 64))
        q = np.concatenate([at + scale * rng.normal(size=(50, 64)), b[:5]])
        b[17] = b[18]
        d = (np.abs(q[:, None] - b[None]) ** p).sum(2)
        low = nn.B.lower_bounds(q, b, p)
        assert (low <= d * (1 + 1e-12) + 1e-300).all()
    b = rng.normal(size=(4000, 64))
    q = b[:60] + 0.3 * rng.normal(size=(60, 64))
    d = (np.abs(q[:, None] - b[None]) ** p).sum(2)
    monkeypatch.setattr(nn.B, "distances", None)  # no whole matrix
    r, c = nn._candidates(q, b, metric, p, 1)
    assert {(i, j) for i, j in enumerate(d.argmin(1))} <= set(zip(r.tolist(), c.tolist())) and len(r) < 0.05 * d.size
    none = nn._candidates(q, b, metric, p, 1, np.zeros(len(q)))  # all rows lie beyond what is asked for
    assert len(none[0]) == 0


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_dbscan_on_a_grid(spark, monkeypatch, dims):
    """Dense cells need no blocks; clusters, borders and noise are those of all pairs, also where only inner points of two cells touch."""
    monkeypatch.setattr(ol, "_radius_join", None)
    rng = np.random.default_rng(dims)
    m = np.concatenate([rng.normal(0, 0.8, (150, dims)), rng.normal(6, 1.5, (60, dims)), rng.uniform(-12, 12, (40, dims)), np.full((9, dims), -9.0)])
    if dims == 2:  # two cells whose outermost points are over the radius apart, but not others
        m = np.concatenate([m, [[30.1, 30.1], [30.1, 30.6], [30.1, 30.35]], [[31.19, 31.19], [31.19, 30.75], [31.19, 31.0]]])
    m = np.round(m, 2)
    eps, least = 1.0, 4
    near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    root = np.where(core, np.arange(len(m)), len(m))
    while True:
        low = np.where(core, np.where(near & core[None], root[None], len(m)).min(1), len(m))
        if (low == root).all():
            break
        root = low
    found = np.where(near & core[None], root[None], len(m)).min(1)
    label = {r: i for i, r in enumerate(sorted(set(root[core])))}
    want = {(i, label.get(r, -1), int(c)) for i, (r, c) in enumerate(zip(found, core))}
    assert {tuple(r) for r in ol.dbscan(vectors(spark, m), eps, least).collect()} == want
