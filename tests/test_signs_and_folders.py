"""Tables that come as a folder of part files, and values that round to zero from below."""

import math
import os
import shutil

import pytest

from strayfield.functions.scalar import signed_round
from strayfield.plans.registry import all_queries, all_sql
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The smallest tables, embeddings as a folder of three files."""
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in os.listdir(SMALL):
        if name != "embeddings.parquet":
            shutil.copy(f"{SMALL}/{name}", folder)
    spark.read.parquet(f"{SMALL}/embeddings.parquet").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["l2_stream_score", "l3_stream_profile", "l3_stream_histogram"])
def test_a_stream_reads_every_file_of_a_folder(spark, parts, name):
    assert compare(all_queries()[name](spark, parts).toPandas(), connect(SMALL).execute(all_sql()[name]).df()) is None


@pytest.fixture(scope="module")
def near_zero(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("near_zero"))
    rows = [(i, [-1e-7 if j < 40 else 0.5 + i % 3 for j in range(64)], i % 10) for i in range(32)] + [(i, [-1e-7] + [0.0] * 63, 1) for i in range(32, 48)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def _signed(value):
    """Numbers with their sign, so that -0.0 and 0.0 differ."""
    if hasattr(value, "__len__"):
        return tuple(_signed(v) for v in value)
    return (math.copysign(1.0, value), round(float(value), 6))


@pytest.mark.parametrize("name", ["d1_patchify", "d3_adaptive_pool", "d4_merge_layers", "d6_l2_normalize", "d8_concat_vectors", "d9_bundle_mean", "d10_standardize", "c13_random_project"])
def test_rounding_keeps_the_sign_of_zero(spark, near_zero, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{near_zero}/embeddings.parquet/*.parquet')")
    want = con.execute(all_sql()[name]).df()
    got = all_queries()[name](spark, near_zero).toPandas()[list(want.columns)]
    lines = lambda pdf: sorted(tuple(_signed(v) for v in row) for row in pdf.itertuples(index=False))
    assert lines(got) == lines(want)
    assert any(v == 0 and math.copysign(1.0, v) < 0 for col in want for row in want[col] if hasattr(row, "__len__") for v in row)


def test_signed_round(spark):
    df = spark.createDataFrame([(-1e-7,), (-0.0,), (0.0,), (1e-7,), (-2.5e-6,), (float("-inf"),), (None,)], "x double")
    got = [r[0] for r in df.select(signed_round("x", 6)).collect()]
    assert [math.copysign(1.0, v) for v in got[:4]] == [-1.0, -1.0, 1.0, 1.0] and got[:4] == [0.0] * 4
    assert got[4:] == [-3e-6, float("-inf"), None]
