"""The repair of the refinement loop and the composed flows on tables small enough to work out by hand."""

import numpy as np
from pyspark.sql import functions as F

from strayfield import session
from strayfield.operators import outliers as ol
from strayfield.operators import scoremaps
from strayfield.plans import flows as fw

MASKS = "image_id int, instance_id int, origin string, area double, scale double"
PARTS = "origin string, part int, area double, scale double"


def _rows(df):
    return sorted((r.image_id, r.instance_id, r.origin, r.area) for r in df.collect())


def _labelled(spark):
    rows = [(1, 0, "a", 10.0, 1.0, 0), (1, 1, "b", 40.0, 1.0, 1), (1, 2, "c", 10.0, 1.0, 0), (1, 3, "d", 1.0, 1.0, 1), (2, 0, "e", 1.0, 1.0, 1)]
    return spark.createDataFrame(rows, MASKS + ", label int")


def test_parts_replace_an_outlier_and_numbers_close_up(spark):
    parts = spark.createDataFrame([("b", 1, 12.0, 1.0), ("b", 2, 4.9, 1.0), ("b", 3, 10.0, 2.0), ("zz", 1, 9.0, 1.0)], PARTS)
    kept = ol.replace_outliers(_labelled(spark), parts, drop_small=False)
    # the mean is 10: b.1 and b.3 (10 / 2) reach half of it and get 4 and 5; b leaves, and the highest number fills its place
    assert _rows(kept) == [(1, 0, "a", 10.0), (1, 1, "b.3", 10.0), (1, 2, "c", 10.0), (1, 3, "d", 1.0), (1, 4, "b.1", 12.0), (2, 0, "e", 1.0)]
    # later repairs drop what is under a fifth of the mean: d, and e with its whole image
    small = ol.replace_outliers(_labelled(spark), parts, drop_small=True)
    assert _rows(small) == [(1, 0, "a", 10.0), (1, 1, "b.3", 10.0), (1, 2, "c", 10.0), (1, 3, "b.1", 12.0)]


def test_repair_without_inliers_or_rows_changes_nothing(spark):
    parts = spark.createDataFrame([("b", 1, 12.0, 1.0)], PARTS)
    flagged = _labelled(spark).withColumn("label", F.lit(1))
    assert len(_rows(ol.replace_outliers(flagged, parts, drop_small=True))) == 5
    assert _rows(ol.replace_outliers(flagged.where("false"), parts, drop_small=True)) == []


def test_component_map_covers_the_whole_frame(spark):
    """Image 3 lacks component 2, which its reference shows in 60 pixels: its component map lies where its own maps are empty."""
    px = [(i, y, x, 1) for i in (1, 2, 3) for y in range(8) for x in range(8)] + [(i, y, x, 2) for i in (1, 2) for y in range(8, 14) for x in range(10)]
    labels = spark.createDataFrame(px, "image_id int, y int, x int, label int")
    texture = spark.createDataFrame([(i, 0, 0, 1.0, 1.0) for i in (1, 2, 3)], "image_id int, y int, x int, st double, ae double")
    normal = spark.createDataFrame([(1,), (2,)], "image_id int")
    maps = fw.component_maps(labels, normal, texture, 2, 16, 16, 2, quadrant_weight=0.0)
    found = {r.image_id: (r.n, r.drawn) for r in maps.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("component") > 0.9).cast("int")).alias("drawn")).collect()}
    assert found == {1: (256, 0), 2: (256, 0), 3: (256, 60)}


def test_zero_shot_batches_are_their_own_banks(spark):
    items = [(i, i // 2, [float(v)], int(v > 4)) for i, v in enumerate([0, 0, 0, 9, 1, 1, 5, 5])]
    table = spark.createDataFrame(items, "vec_id int, image_id int, vec array<double>, is_anomaly int")
    scores = {r.image_id: (r.score, r.is_anomaly) for r in fw.zero_shot(table, 2, frac=0.75).collect()}
    # batch one has 0 0 0 9 and batch two 1 1 5 5; k is 3, the copy of itself included
    assert scores == {0: (0.0, 0), 1: (1.0, 1), 2: (16 / 3 / 54, 0), 3: (16 / 3 / 54, 1)}


def test_image_scores_without_absent_pixels(spark):
    """The same scores as from a row for every pixel: holes count in quantiles and maxima, full images have none, components lie beside textures."""
    rng = np.random.default_rng(3)
    labels = [(i, y, x, int(rng.integers(1, 3)) if i < 5 else 1) for i in range(7) for y in range(6) for x in range(6) if rng.random() < 0.7]
    texture = [(i, y, x, float(rng.normal()), float(rng.normal())) for i in range(7) for y in range(6) for x in range(6) if i == 2 or rng.random() < 0.4]
    px = spark.createDataFrame(labels, "image_id long, y int, x int, label int")
    maps = spark.createDataFrame([(i, y, x, st - (3.0 if i == 4 else 0.0), ae) for i, y, x, st, ae in texture], "image_id long, y int, x int, st double, ae double")
    normal = spark.range(5).select(F.col("id").alias("image_id"))
    want = scoremaps.combined_score(fw.component_maps(px, normal, maps, 2, 6, 6)).collect()
    got = fw.component_image_scores(px, normal, maps, 2, 6, 6).collect()
    assert {r.image_id: round(r.score, 9) for r in got} == {r.image_id: round(r.score, 9) for r in want} and len(got) == 7


def test_a_round_leaves_no_tables_but_the_last(spark, monkeypatch, tmp_path):
    """Tables of former rounds are deleted: those of a repair at once, a round's rows and labels when the next has been written."""
    rng = np.random.default_rng(3)
    masks = spark.createDataFrame([(i % 40, i // 40, f"m{i}", float(a), 1.0) for i, a in enumerate(np.exp(rng.normal(2.0, 1.0, 400)))], MASKS)
    part = masks.select("origin", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("part"), (F.col("area") * F.col("part") / 10).alias("area"), "scale")
    found = []
    plain = ol.replace_outliers
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(ol, "replace_outliers", lambda *a, **kw: found.append(len(list(tmp_path.iterdir()))) or plain(*a, **kw))
    assert fw.refine(masks, part, 0.3).count() > 0
    assert len(found) > 3 and max(found) <= 4
