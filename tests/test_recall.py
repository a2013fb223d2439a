"""Inverted lists are searched up to the wanted recall."""

import numpy as np

from strayfield.operators import neighbours as nn


def test_lists_are_searched_up_to_the_wanted_recall(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 24)))], "vec_id long, vec array<double>")
    truth = {(r["query_id"], r["bank_id"]) for r in nn.knn(df, df, 4).collect()}

    def recall(**kw):
        return len(truth & {(r["query_id"], r["bank_id"]) for r in nn.ann(df, df, 4, lists=16, probes=2, **kw).collect()}) / len(truth)

    assert recall(recall=0) < 0.9 <= recall()
