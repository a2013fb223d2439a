"""On a line an order takes the place of distances."""

import numpy as np
import pytest

from strayfield.operators import outliers as ol, selection


def _points(spark, values):
    return spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(values)], "vec_id long, vec array<double>")


@pytest.mark.parametrize("values", [[4.0], [1.0, 1.0, 1.0, 9.0], [0.5, -2.0, 3.25, 3.25, 10.0, 0.5, 7.0], None])
@pytest.mark.parametrize("quantile", [0.3, 0.7, 1.0])
def test_bandwidth_on_a_line_equals_brute_force(spark, values, quantile):
    values = np.round(np.random.default_rng(3).normal(size=150), 1) if values is None else np.array(values)
    k = max(1, int(len(values) * quantile))
    want = np.sort(np.abs(values[:, None] - values[None, :]), axis=1)[:, k - 1].mean()
    assert ol.bandwidth(_points(spark, values), quantile).first()[0] == pytest.approx(want, abs=1e-12)


def test_bandwidth_on_a_line_compares_no_pairs(spark, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("pairs were compared")

    monkeypatch.setattr(ol, "nearest_sums", pairs)
    assert ol.bandwidth(_points(spark, range(100)), block_rows=8).first()[0] > 0


def test_a_null_on_a_line_is_near_nothing(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0)], "id long, value double")
    got = selection.kth_on_a_line(rows, spark.sql("select 2L k")).collect()
    assert sorted((r["value"], r["n"], r["d"]) for r in got) == [(1.0, 1, 3.0), (4.0, 1, 3.0)]


def test_stretches_hold_what_lies_within():
    rng = np.random.default_rng(4)
    b = np.unique(np.round(rng.uniform(-1, 3, 400), 2) / 10)
    q = np.concatenate([b, b + 0.1, [-9.0, 9.0], rng.uniform(-1, 1, 50)])
    lo, hi = ol._stretch(q, b, 0.1)
    for x, i, j in zip(q, lo, hi):
        inside = np.nonzero(np.abs(x - b) <= 0.1)[0]
        assert (j - i == len(inside)) and (not len(inside) or (i == inside[0] and j == inside[-1] + 1))
