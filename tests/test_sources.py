"""File sources, sinks, named stages and multi-batch streams."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayfield.operators import neighbours as nn
from strayfield.operators import windows as wn
from strayfield.plans import stages as pl
from strayfield.sources import items as it
from strayfield.sources import sinks as sk
from strayfield.streaming import ops as so


def test_manifest_of_a_tree(spark, tmp_path):
    for name in ("gear/train/good/001_0.png", "gear/test/good/002_1.png", "gear/test/bad/003_2.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    rows = {r["image_id"]: r for r in it.scan_manifest(spark, str(tmp_path)).collect()}
    assert {k: (r["split"], r["defect"], r["instance_id"], r["is_anomaly"]) for k, r in rows.items()} == {
        "001": ("train", "good", 0, 0),
        "002": ("test", "good", 1, 0),
        "003": ("test", "bad", 2, 1),
    }
    assert rows["003"]["mask_path"] == f"{tmp_path}/gear/ground_truth/bad/003_mask.png"
    assert rows["001"]["mask_path"] is None


def test_list_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a\nb\nc\nd\n")
    lines = pl.load_dataset(spark, "list_file", str(tmp_path / "list.txt"))
    got = it.scan_list(lines, "i/{}.jpg", "l/{}.png", start=1, end=3).orderBy("line_no").collect()
    assert [(r["image"], r["label"]) for r in got] == [("i/b.jpg", "l/b.png"), ("i/c.jpg", "l/c.png")]
    assert it.scan_list(lines, "{}", "{}", first=3).count() == 3


def test_flags(spark):
    df = spark.createDataFrame([("good",), ("not_good",), ("bad",)], "defect string")
    got = df.select(it.anomaly_flag("defect").alias("a"), it.anomaly_flag("defect", "contains").alias("b")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 0), (1, 1)]


def test_out_path_and_reset(spark, tmp_path):
    root = str(tmp_path)
    assert sk.out_path(spark, root, "p", "g") == f"{root}/p/g"
    sk.reset_dir(spark, f"{root}/p/g")
    assert sk.out_path(spark, root, "p", "g") == f"{root}/p/g_0"
    assert sk.out_path(spark, root, "p", "g", "overwrite") == f"{root}/p/g"


def test_results_file(spark, tmp_path):
    df = spark.createDataFrame([("a", "auroc", 0.5), ("b", "auroc", 1.0)], "dataset string, metric string, value double")
    sk.write_results(sk.results_table(df, ["auroc"]), str(tmp_path / "out"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "out")).toPandas().set_index("dataset")["auroc"]
    assert float(back["Mean"]) == 0.75


def test_stages(spark):
    df = spark.range(5)
    double = lambda d: d.select((F.col("id") * 2).alias("id"))
    steps = [("x", double), ("y", double)]
    assert pl.run_stages(df, steps, until="x").agg(F.max("id")).first()[0] == 8
    assert pl.run_stages(df, steps).agg(F.max("id")).first()[0] == 16
    with pytest.raises(ValueError):
        pl.load_dataset(spark, "nothing", "/")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"user": rng.integers(0, 3, 90), "seq": np.arange(90), "v": rng.random(90)})
    pdf["vec"] = [list(r) for r in rng.random((90, 4))]
    for i in range(3):
        pdf.iloc[i * 30 : (i + 1) * 30].to_parquet(folder / f"part{i}.parquet")
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", "1").parquet(str(folder))
    return spark.read.parquet(str(folder)), stream


@pytest.fixture
def two_partitions(spark):
    """Each partition of a state starts a Python worker per batch; small streams need few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scores_over_batches_equal_batch(spark, parts, tmp_path):
    table, stream = parts
    bank = table.where("seq < 20").select("seq", "vec")
    so.run_available(stream, so.score_batch(bank, 3, str(tmp_path / "s"), query_id="seq", bank_id="seq"))
    got = spark.read.parquet(str(tmp_path / "s")).toPandas().sort_values("query_id")["score"]
    want = nn.knn_score(table, bank, 3, query_id="seq", bank_id="seq").toPandas().sort_values("query_id")["score"]
    assert np.allclose(got, want) and len(got) == 90


def test_meter_over_batches_equals_batch(spark, two_partitions, parts):
    table, stream = parts
    got = so.run_available(so.stream_meter(stream, "user", "v", "seq", "seq")).toPandas().sort_values("position")
    moving = wn.moving_avg(table, "v", ["seq"], 20, ["user"]).toPandas().sort_values("seq")["moving_avg"]
    best = wn.running_best(table, "v", "seq", ["user"]).toPandas().sort_values("seq")
    assert np.allclose(got["moving_avg"], moving)
    assert np.allclose(got["best"], best["best"]) and (got["best_at"].to_numpy() == best["best_at"].to_numpy()).all()


def test_profile_over_batches_equals_batch(spark, parts):
    table, stream = parts
    got = so.run_available(so.stream_profile(stream), mode="complete").toPandas().sort_values("dim")
    m = np.stack(table.toPandas()["vec"].to_numpy())
    assert np.allclose(got["lo"], m.min(0)) and np.allclose(got["hi"], m.max(0))


def test_stream_rollup_emits_closed_sessions_once(spark, tmp_path):
    """Append mode over several batches: a session appears when the watermark passes it; later rows for it are dropped."""
    parts = [
        [("a", "2024-01-01 00:00:00", 1.0, 0), ("a", "2024-01-01 00:00:20", 3.0, 1), ("b", "2024-01-01 00:00:10", 2.0, 0)],
        [("a", "2024-01-01 00:10:00", 5.0, 0)],
        [("b", "2024-01-01 00:10:05", 4.0, 0)],  # the watermark of the batch before closes the first sessions here
        [("a", "2024-01-01 00:00:30", 9.0, 1)],  # too late
        [("c", "2024-01-01 01:00:00", 7.0, 0)],
    ]
    for i, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, "image_id string, at string, score double, is_anomaly int").withColumn("ts", F.to_timestamp("at")).drop("at")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema("image_id string, score double, is_anomaly int, ts timestamp").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    got = so.run_available(so.stream_rollup(stream, "ts", "1 minute", "2 minutes")).collect()
    assert sorted((r.image_id, str(r.start), r.score, r.is_anomaly, r.instances) for r in got) == [
        ("a", "2024-01-01 00:00:00", 3.0, 1, 2),
        ("a", "2024-01-01 00:10:00", 5.0, 0, 1),
        ("b", "2024-01-01 00:00:10", 2.0, 0, 1),
        ("b", "2024-01-01 00:10:05", 4.0, 0, 1),
    ]


def _stream_of(spark, folder, frames, schema):
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", "1").parquet(folder)


def _meter_by_hand(batches, length):
    """Row by row over the batches, each taken in order."""
    state, out = {}, {}
    for batch in batches:
        for user, seq, v in sorted(batch, key=lambda r: (r[1])):
            last, best, at = state.get(user, ([], float("-inf"), -1))
            last = [*last, v][-length:]
            if v is not None and v > best:
                best, at = v, seq
            state[user] = (last, best, at)
            there = [x for x in last if x is not None]
            out[(user, seq)] = (sum(there) / len(there) if there else None, best, at)
    return out


def test_meter_takes_hot_null_and_out_of_order_rows(spark, two_partitions, tmp_path):
    """Rows of a batch in any order, a hot key beyond one Arrow batch, a NULL key, NULL values, ties of the best."""
    rng = np.random.default_rng(3)
    hot = [("hot", int(i), float(rng.integers(0, 500))) for i in rng.permutation(30_000)]
    batches = [
        [*hot[:20_000], ("x", 5, 1.0), ("x", 1, 9.0), (None, 2, 4.0), ("x", 7, None)],
        [*hot[20_000:], ("x", 3, 9.0), (None, 1, 6.0), ("y", 1, None)],
    ]
    stream = _stream_of(spark, str(tmp_path / "in"), batches, "user string, seq long, v double")
    got = so.run_available(so.stream_meter(stream, "user", "v", "seq", "seq", 5)).collect()
    want = _meter_by_hand(batches, 5)
    assert len(got) == len(want) == 30_007
    for r in got:
        avg, best, at = want[(r.key, r.position)]
        assert (r.moving_avg is None) == (avg is None) and (avg is None or np.isclose(r.moving_avg, avg))
        assert (r.best, r.best_at) == (best, at)


def test_meter_forgets_idle_keys(spark, two_partitions, tmp_path):
    """After an hour without rows before the watermark a key starts anew; one that goes on keeps its state."""
    at = lambda text: pd.Timestamp(text).to_pydatetime()
    batches = [
        [("a", at("2024-01-01 00:00"), 1, 8.0), ("b", at("2024-01-01 00:00"), 1, 8.0)],
        [("b", at("2024-01-01 00:50"), 2, 2.0)],
        [("c", at("2024-01-01 01:30"), 1, 1.0)],
        [("c", at("2024-01-01 01:31"), 2, 1.0)],
        [("a", at("2024-01-01 01:40"), 2, 2.0), ("b", at("2024-01-01 01:40"), 3, 2.0)],
    ]
    stream = _stream_of(spark, str(tmp_path / "in"), batches, "user string, ts timestamp, seq long, v double")
    got = so.run_available(so.stream_meter(stream, "user", "v", "seq", "seq", idle=("ts", "1 minute", 3_600_000))).collect()
    found = {(r.key, r.position): (r.moving_avg, r.best, r.best_at) for r in got}
    assert found[("a", 2)] == (2.0, 2.0, 2)
    assert found[("b", 3)] == (4.0, 8.0, 1)


def test_tree_of_files_is_listed_by_class_and_split(spark, tmp_path):
    names = ["cup/train/good/1_0.png", "cup/test/good/2_0.png", "cup/test/crack/3_1.png", "box/test/dent/4.png"]
    rows = spark.createDataFrame([(n, b"x") for n in names] + [(None, b"x"), ("box/test/dent/4.png", b"x")], "path string, content binary")
    assert sk.write_files(rows, str(tmp_path)) == 5
    assert sk.write_files(rows.where("false"), str(tmp_path)) == 0
    everything = {(r["class"], r.split, r.defect, r.image_id, r.instance_id) for r in it.scan_manifest(spark, str(tmp_path)).collect()}
    assert everything == {("cup", "train", "good", "1", 0), ("cup", "test", "good", "2", 0), ("cup", "test", "crack", "3", 1), ("box", "test", "dent", "4", None)}
    assert {r.image_id for r in it.scan_manifest(spark, str(tmp_path), splits=["test"]).collect()} == {"2", "3", "4"}
    chosen = it.scan_manifest(spark, str(tmp_path), classes=["cup", "none"], splits=["test"])
    assert {r.image_id for r in chosen.collect()} == {"2", "3"}
    with pytest.raises(Exception):
        it.scan_manifest(spark, str(tmp_path), classes=["none"]).collect()


def test_a_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """No file index: it would sit on the driver, and make a task of every four files. Hidden names and chosen folders as before."""
    rows = spark.range(900).select(F.format_string("/cup/%s/good/%04d_0.png", F.when(F.col("id") % 3 == 0, "train").otherwise("test"), "id").alias("path"), F.lit("x").alias("content"))
    assert sk.write_files(rows, str(tmp_path)) == 900
    (tmp_path / "cup" / "test" / ".part").write_text("x")
    (tmp_path / "cup" / "test" / "_SUCCESS").write_text("x")
    (tmp_path / "stray.png").write_text("x")
    found = it.scan_manifest(spark, f"file:{tmp_path}", splits=["test"])
    assert found.rdd.getNumPartitions() < 100
    got = {r["path"] for r in found.collect()}
    assert got == {f"{tmp_path}/cup/test/good/{i:04d}_0.png" for i in range(900) if i % 3}
    assert it.scan_manifest(spark, str(tmp_path)).count() == 901
    with pytest.raises(Exception):
        it.scan_manifest(spark, str(tmp_path), splits=["none"]).collect()
    with pytest.raises(Exception):
        it.scan_manifest(spark, f"{tmp_path}/nowhere").collect()
