"""Ordered operators against pandas, on data where one key holds half of all rows and values repeat."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayfield.operators import metrics as m
from strayfield.operators import windows as wn
from strayfield.operators.ordering import framed, row_index, running, top_per_key


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(0)
    n = 4000
    key = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 40, n).astype(str))
    value = np.where(rng.random(n) < 0.4, 1.0, rng.random(n).round(3))
    return pd.DataFrame({"key": key, "id": np.arange(n), "value": value})


@pytest.fixture(scope="module")
def table(spark, skewed):
    return spark.createDataFrame(skewed).repartition(7).cache()


def test_row_index(table, skewed):
    got = row_index(table, ["value", "id"], ["key"], slices=50).toPandas().sort_values("id")
    want = skewed.sort_values(["value", "id"]).groupby("key").cumcount() + 1
    assert (got["rn"].to_numpy() == want.sort_index().to_numpy()).all()


def test_row_index_descending_without_key(table, skewed):
    got = row_index(table, [-F.col("value"), "id"]).toPandas().sort_values("id")
    order = skewed.sort_values(["value", "id"], ascending=[False, True]).index
    want = pd.Series(np.arange(1, len(order) + 1), index=order).sort_index()
    assert (got["rn"].to_numpy() == want.to_numpy()).all()


def test_running(table, skewed):
    got = running(table, ["id"], {"s": "value"}, {"top": "value"}, ["key"], slices=30, totals_as={"s": "all"}).toPandas().sort_values("id")
    g = skewed.groupby("key")["value"]
    assert np.allclose(got["s"], g.cumsum())
    assert np.allclose(got["top"], g.cummax())
    assert np.allclose(got["all"], g.transform("sum"))


@pytest.mark.parametrize("chunk", [25, 64, 5000])
def test_framed_crosses_chunks(table, skewed, chunk):
    got = framed(table, ["id"], 20, {"a": F.avg("value")}, ["key"], chunk=chunk).toPandas().sort_values("id")
    want = skewed.groupby("key")["value"].rolling(20, min_periods=1).mean().reset_index(level=0, drop=True).sort_index()
    assert np.allclose(got["a"], want)


def test_top_per_key(table, skewed):
    got = top_per_key(table, ["key"], [F.col("value").desc(), F.col("id")], 3).toPandas()
    want = skewed.sort_values(["value", "id"], ascending=[False, True]).groupby("key").head(3)
    assert set(got["id"]) == set(want["id"])


@pytest.mark.parametrize("chunk", [7, 100])
def test_ema_links_chunks(spark, chunk):
    x = np.random.default_rng(1).random(300)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(300), "x": x}))
    got = wn.ema(df, "x", ["i"], 0.9, chunk=chunk).toPandas().sort_values("i")["ema"].to_numpy()
    e, want = 0.0, []
    for i, v in enumerate(x):
        d = min(1 - 1 / (i + 1), 0.9)
        e = e * d + v * (1 - d)
        want.append(e)
    assert np.allclose(got, want)


@pytest.mark.parametrize("chunk", [3, 50])
def test_greedy_batches_link_chunks(spark, chunk):
    n = np.random.default_rng(2).integers(1, 9, 120)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(120), "n": n}))
    got = wn.greedy_batches(df, 20, "i", chunk=chunk).toPandas().sort_values("i")["batch"].tolist()
    total, batch, want = 0, 0, []
    for c in n:
        want.append(batch)
        total += c
        if total >= 20:
            total, batch = 0, batch + 1
    assert got == want


def test_empty_input(spark):
    empty = spark.createDataFrame([], "key string, id long, value double")
    assert row_index(empty, ["id"], ["key"]).count() == 0
    assert running(empty, ["id"], {"s": "value"}).count() == 0


def test_metrics_by_hand(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)]
    df = spark.createDataFrame(rows, "score double, is_anomaly int")
    s = m.summary(df).first()
    assert s["auroc"] == pytest.approx(0.875)  # one tie counts half
    assert s["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert s["f1"] == pytest.approx(0.8) and s["threshold"] == pytest.approx(0.8)
    assert (s["fp_share"], s["fn_share"]) == (0.25, 0.0)


def test_auroc_edge_cases(spark):
    one_class = spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, is_anomaly int")
    assert m.auroc(one_class).first()["auroc"] is None
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0)] * 10, "score double, is_anomaly int")
    assert m.auroc(ties).first()["auroc"] == pytest.approx(0.5)


def test_auroc_is_invariant_under_monotone_maps(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"score": rng.random(500), "is_anomaly": rng.integers(0, 2, 500)}))
    a = m.auroc(df).first()["auroc"]
    assert m.auroc(df.withColumn("score", F.exp("score") * 7)).first()["auroc"] == pytest.approx(a)
