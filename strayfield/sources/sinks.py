"""Persisted results: vector banks, references, statistics, result tables, output folders."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from strayfield.session import parallelism


def save_bank(df: DataFrame, params: dict, path: str) -> None:
    """A vector bank and its parameters under one folder."""
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    row = df.sparkSession.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string")
    row.write.mode("overwrite").parquet(f"{path}/params")


def load_bank(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    params = spark.read.parquet(f"{path}/params").first()["params"]
    return spark.read.parquet(f"{path}/vectors"), json.loads(params)


def results_table(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``(dataset, metric, value)`` to one row per dataset plus ``Mean``, the mean of the dataset values."""
    wide = df.groupBy("dataset").pivot("metric", list(metrics)).agg(F.first("value"))
    mean = wide.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("Mean").alias("dataset"), *metrics)
    return wide.unionByName(mean)


def write_results(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)  # one row per dataset


def append_stats(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_reference(df: DataFrame, kind: str, path: str, category: str = "category") -> None:
    """Normal histograms, label maps or validation scores, one partition per category."""
    df.write.mode("overwrite").partitionBy(category).parquet(f"{path}/{kind}")


def load_reference(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{kind}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def out_path(spark: SparkSession, root: str, project: str, group: str, mode: str = "iterate") -> str:
    """Output folder ``root/project/group``; ``iterate`` appends ``_0``, ``_1``, ... until the name is free."""
    path = f"{root}/{project}/{group}"
    if mode == "overwrite":
        return path
    if mode != "iterate":
        raise ValueError(f"unknown mode {mode}")
    candidate, n = path, 0
    while exists(spark, candidate):
        candidate, n = f"{path}_{n}", n + 1
    return candidate


def reset_dir(spark: SparkSession, path: str) -> None:
    """Empty a folder of earlier results."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)
    fs.mkdirs(where)


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """One file per row, ``root/path`` with the bytes of ``content`` (NULL: empty), written by the tasks; returns how many.

    A task that runs again writes the same files. ``root`` is a folder all executors reach, as a path or a URI pyarrow knows.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(root)
        made: set[str] = set()
        for rows in batches:
            for name, data in zip(rows["path"], rows["content"]):
                target = f"{base}/{name.lstrip('/')}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(b"" if data is None else bytes(data))
            yield pd.DataFrame({"n": [len(rows)]})

    rows = df.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    # few bytes a row, but a file each: dealt to all tasks, however small the table
    rows = rows.repartition(parallelism(df.sparkSession), "path")
    return rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
