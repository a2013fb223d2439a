"""Named stages, dataset loaders and composable transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

Stage = Callable[[DataFrame], DataFrame]

STAGES: dict[str, Callable[..., Stage]] = {}
DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EMBEDDERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def stage(name: str) -> Callable[[Callable[..., Stage]], Callable[..., Stage]]:
    """Register a stage factory under a name."""

    def add(factory: Callable[..., Stage]) -> Callable[..., Stage]:
        STAGES[name] = factory
        return factory

    return add


def run_stages(df: DataFrame, stages: Sequence[tuple[str, Stage]], until: str | None = None) -> DataFrame:
    """Apply named stages in order, optionally stopping after one of them; the plan stays lazy."""
    for name, step in stages:
        df = df.transform(step)
        if name == until:
            break
    return df


def compose(*steps: Stage) -> Stage:
    return lambda df: reduce(lambda d, s: d.transform(s), steps, df)


def dataset(name: str) -> Callable:
    def add(loader: Callable[[SparkSession, str], DataFrame]):
        DATASETS[name] = loader
        return loader

    return add


def load_dataset(spark: SparkSession, name: str, root: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name}; known: {sorted(DATASETS)}")
    return DATASETS[name](spark, root)


def embedder(name: str) -> Callable:
    def add(fn: Callable[[np.ndarray], np.ndarray]):
        EMBEDDERS[name] = fn
        return fn

    return add


def embed(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray] | str, col: str, out: str = "vec") -> DataFrame:
    """Vectors from a user function on arrays, one call per Arrow batch. No model is shipped."""
    call = EMBEDDERS[fn] if isinstance(fn, str) else fn

    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(call(np.stack(s.to_numpy())))) if len(s) else pd.Series([], dtype=object)

    return df.withColumn(out, apply(F.col(col)))


@stage("identity")
def _identity() -> Stage:
    from strayfield.operators.sampling import identity

    return identity


@stage("coreset")
def _coreset(p: float, item: str = "vec_id") -> Stage:
    from strayfield.operators.sampling import approx_coreset

    return lambda df: df.join(approx_coreset(df, p, item=item).select(item), item, "left_semi")


@stage("random")
def _random(p: float, seed: int = 0, item: str = "vec_id") -> Stage:
    from strayfield.operators.sampling import random_sample

    return lambda df: random_sample(df, p, seed, item)


@stage("knn_score")
def _knn_score(bank: DataFrame, k: int, metric: str = "l2sq") -> Stage:
    from strayfield.operators.neighbours import knn_score

    return lambda df: knn_score(df, bank, k, metric)


@dataset("image_tree")
def _image_tree(spark: SparkSession, root: str) -> DataFrame:
    from strayfield.sources.items import scan_manifest

    return scan_manifest(spark, root)


@dataset("list_file")
def _list_file(spark: SparkSession, root: str) -> DataFrame:
    from strayfield.sources.items import read_list

    return read_list(spark, root)
