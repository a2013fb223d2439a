"""What a coreset round sends to the driver doesn't grow with the number of partitions."""

import numpy as np

from strayfield.operators import sampling as sp


def _sent(spark):
    """Bytes of results by stage so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).resultSize() for i in range(stages.size())}


def test_a_coreset_round_sends_its_candidates_once(spark):
    rng, dims, look = np.random.default_rng(7), 256, 128
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1600, dims)))], "vec_id long, vec array<double>")
    df = df.repartition(8)
    before = set(_sent(spark))
    assert sp.greedy_coreset(df, 0.01, look=look).count() == 16
    assert max(size for stage, size in _sent(spark).items() if stage not in before) < 2 * (look + 1) * dims * 8
