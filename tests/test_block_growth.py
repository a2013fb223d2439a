"""Small blocks don't make the pieces of a search grow with the square of its rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayfield import session
from strayfield.operators import blocks as B, neighbours as nn, pivots as T, sampling as sp


def test_a_cell_is_cut_into_a_bounded_number_of_pieces(spark):
    rows = spark.range(200).select(F.lit(0).alias("cell"), F.col("id").alias("query_id"))
    seen = B.block_join(
        rows, rows.withColumnRenamed("query_id", "bank_id"), lambda q, b: pd.DataFrame({"pairs": [len(q) * len(b)]}), "pairs long", 2, 2
    ).toPandas()["pairs"]
    assert seen.sum() == 200 * 200  # every pair, once
    assert len(seen) <= B.MOST_BLOCKS**2


def test_a_tree_of_small_blocks_has_a_bounded_number_of_leaves(spark):
    rng = np.random.default_rng(5)
    bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 8)))], "bank_id long, vec array<double>")
    tree = T.grow(bank, "l2sq", block_rows=2)
    assert tree.placed.count() == 1200
    assert tree.leaves() <= 3 * T.LEAVES


def test_distances_by_tiles_equal_the_plain_ones():
    rng = np.random.default_rng(6)
    for rows, columns in ((3, 20000), (70, 5), (1, 1)):
        q, b = rng.normal(size=(rows, 4)), rng.normal(size=(columns, 4))
        gap = np.abs(q[:, None, :] - b[None, :, :])
        assert np.allclose(B.distances(q, b, "l1"), gap.sum(2), rtol=1e-12)
        for p in (1.5, 2.5):
            assert np.allclose(B.distances(q, b, "lp", p), (gap**p).sum(2), rtol=1e-12)


def _unstructured(spark, rows: int, dims: int = 64):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(rows, dims)))], "vec_id long, vec array<double>")


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_queries_are_sent_to_packs_of_leaves(spark, metric):
    """Where nothing prunes, a query visits every leaf of small blocks, but its vector travels once for a full block."""
    rows = _unstructured(spark, 600)
    index = nn.index_bank(rows, metric, block_rows=2)
    assert index.tree.placed.count() == 600 and index.tree.leaves() > 20
    assert nn._bounded(rows.withColumnRenamed("vec_id", "query_id"), index, 3)[1].count() <= 600
    seen = nn.leaves_visited(rows, index, 3).toPandas()
    assert seen["visited"].mean() > 20
    m = np.stack(rows.toPandas()["vec"])
    d = np.sort(B.distances(m, m, metric), axis=1)[:, :3]
    hits = nn.search(rows, index, 3).toPandas().sort_values(["query_id", "rn"])
    assert np.allclose(hits["distance"].to_numpy().reshape(-1, 3), d, atol=1e-9)


def test_leaves_that_few_queries_visit_are_met_one_by_one():
    q = pd.DataFrame({"query_id": range(4), "leaves": [[1], [2], [2, 9], [7]]})
    b = pd.DataFrame({"bank_id": range(10), "leaf": [1] * 5 + [2] * 2 + [3] * 3})
    met = [(rows.tolist(), at.tolist()) for rows, at in nn._looked_at(q, b)]
    assert met == [([0], [0, 1, 2, 3, 4]), ([1, 2], [5, 6])]


@pytest.mark.parametrize("metric, p, k", [("l1", 1.0, 4), ("lp", 1.5, 4)])
def test_quick_bounds_spare_nearly_all_distances(monkeypatch, metric, p, k):
    """Quick bounds are never above a distance, at any scale, with outliers and copies, and unstructured rows need no whole matrix."""
    rng = np.random.default_rng(8)
    quick = {"l1": B.Steps, "lp": B.Powers}[metric]
    for at, scale in ((0.0, 1.0), (1e6, 1e-2), (0.0, 1e-60), (0.0, 1e9)):
        b = at + scale * rng.normal(size=(900, 64))
        b[3] = at + scale * 40.0 * rng.normal(size=64)
        q = np.concatenate([at + scale * rng.normal(size=(21, 64)), b[:5]])
        d = (np.abs(q[:, None] - b[None]) ** p).sum(2)
        bound = quick(b, p) if metric == "lp" else quick(b)
        limits = bound.of(q)
        if limits is None:
            assert at  # left to the other bounds
            continue
        for j in range(0, 900, 3):
            assert (limits[:, j] <= bound.level(d[:, j])).all()
    b, q = rng.normal(size=(6000, 64)), rng.normal(size=(40, 64))
    d = (np.abs(q[:, None] - b[None]) ** p).sum(2)
    monkeypatch.setattr(B, "distances", None)  # no whole matrix, not even for some rows
    monkeypatch.setattr(B, "lower_bounds", None)
    r, c = nn._candidates(q, b, metric, p, k, np.partition(d, 9, axis=1)[:, 9])
    want = {(i, j) for i, row in enumerate(np.argsort(d, axis=1)[:, :k]) for j in row}
    assert want <= set(zip(r.tolist(), c.tolist())) and len(r) < 0.15 * d.size


def test_self_score_meets_copies_of_a_vector_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    m = rng.integers(0, 4, size=(300, 2)).astype(float)  # 16 vectors at most
    df = spark.createDataFrame([(i, "a" if i % 3 else None, v.tolist()) for i, v in enumerate(m)], "vec_id long, g string, vec array<double>")
    sent = []
    plain = nn.nearest_sums
    monkeypatch.setattr(nn, "nearest_sums", lambda rows, *a, **kw: sent.append(rows.count()) or plain(rows, *a, **kw))
    got = nn.self_score(df, "g", frac=0.1).toPandas().set_index("query_id")["score"]
    assert sent[0] <= 32 and len(got) == 300
    for part in (np.arange(0, 300, 3), np.array([i for i in range(300) if i % 3])):
        d = np.sort(((m[part][:, None] - m[part][None]) ** 2).sum(2), axis=1)[:, : int(0.1 * len(part))]
        assert np.allclose(got.loc[part], d.mean(1))


def test_a_coreset_keeps_one_table_of_vectors(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    picks = sp.approx_coreset(_unstructured(spark, 120), 0.3, look=8)
    assert picks.count() == 36  # several rounds, each of which writes its state
    assert len(list(tmp_path.iterdir())) == 1
