"""Tables that several steps read are made once, and frames that leave a task are small."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strayfield.llm import license_scan as ls
from strayfield.operators import outliers as ol, pivots as T


def test_renumbering_makes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    df = spark.range(40).select((F.col("id") % 4).alias("image_id"), counted(F.floor(F.col("id") / 4).cast("int")).alias("instance_id"))
    bad = spark.createDataFrame([(0, 1), (0, 3), (2, 0)], "image_id long, instance_id int")
    out = ol.remove_and_renumber(df, bad).collect()
    assert seen.value <= 80  # once for its rows, and once more at most where a filter repeats the call
    ids = {i: sorted(r.new_id for r in out if r.image_id == i) for i in range(4)}
    assert ids == {0: list(range(8)), 1: list(range(10)), 2: list(range(9)), 3: list(range(10))}


def test_copyright_lines_are_looked_for_once(spark):
    df = spark.createDataFrame([(1, "Copyright 2020 A\n\nReleased under the MIT License."), (2, None)], "doc_id int, text string")
    out = ls.scanned(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("all rights reserved") == 1
    assert [r.notices for r in out.orderBy("doc_id").collect()] == [["MIT"], []]


def test_visits_leave_a_task_in_small_frames():
    children = T.Children(np.arange(64) + 1, np.zeros((64, 2)), np.ones(64), np.zeros(64), np.ones(64), np.ones(64, dtype=bool))
    part = pd.DataFrame({"query_id": np.arange(1000), "vec": [[0.0, 0.0]] * 1000})
    row, child = np.nonzero(np.ones((1000, 64), dtype=bool))
    frames = list(T._visits(part, row, child, children))
    assert max(map(len, frames)) <= T.PIECE
    whole = pd.concat(frames)
    assert [len(f) for f in T._visits(part, row[:0], child[:0], children)] == [0]  # a frame without rows, as the caller joins them
    assert len(whole) == 64_000 and not whole.duplicated(["query_id", "cell"]).any()
