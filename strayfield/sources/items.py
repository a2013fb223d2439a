"""Item manifests: listing, path parsing, mask paths, flags, position records."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strayfield.functions.scalar import basename, parent_name, strip_extension
from strayfield.operators.ordering import as_col, row_index
from strayfield.operators.sets import union_rows
from strayfield.session import cut_lineage, parallelism

LISTED = 1 << 14  # entries of one frame that leaves a task


def scan_manifest(spark: SparkSession, root: str, classes: Sequence[str] = (), splits: Sequence[str] = ()) -> DataFrame:
    """One row per file of ``root/class/split/defect/file``; contents are never read.

    Tasks list the folders of a level side by side, and the paths stay in tables: neither the driver nor a file index holds them. With ``classes``
    or ``splits`` only the folders of these names are listed. Names that start with ``_`` (without ``=``) or ``.`` are left out, as Spark does. A choice that no
    folder fits is an error, as a missing root is.
    """
    files: list[DataFrame] = []
    start = root if "://" in root or root.startswith("file:") else os.path.abspath(root)
    level = spark.createDataFrame([(start,)], "path string")
    depth = 0
    while True:
        entries = cut_lineage(_listed(level))
        level = entries.where("folder").select("path")
        wanted = {0: classes, 1: splits}.get(depth)
        if wanted:
            level = level.where(basename("path").isin(list(wanted)))
        if depth >= (2 if splits else 1 if classes else 0):  # what lies beside the chosen folders is not listed
            files.append(entries.where("not folder").select("path"))
        depth += 1
        if not level.take(1):
            break
    if depth <= (2 if splits else 1 if classes else 0):
        raise FileNotFoundError(f"no folder of {root} fits classes {list(classes)} and splits {list(splits)}")
    return parse_manifest(union_rows(files))


def _listed(folders: DataFrame) -> DataFrame:
    """``(path, folder)``: the entries of every folder of ``folders(path)``; each folder is listed by one task."""

    def ls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                store, base = pafs.FileSystem.from_uri(path)
                scheme = "" if store.type_name == "local" or not path.endswith(base) else path[: len(path) - len(base)]
                found = [e for e in store.get_file_info(pafs.FileSelector(base)) if _shown(e.base_name)]
                for at in range(0, len(found), LISTED):
                    some = found[at : at + LISTED]
                    yield pd.DataFrame({"path": [scheme + e.path for e in some], "folder": [e.type == pafs.FileType.Directory for e in some]})

    tasks = parallelism(folders.sparkSession)
    return folders.repartition(tasks, "path").mapInPandas(ls, "path string, folder boolean")


def _shown(name: str) -> bool:
    return not (name.startswith(".") or name.startswith("_") and "=" not in name)


def parse_manifest(df: DataFrame, path: str = "path") -> DataFrame:
    parts = F.split(F.col(path), "/")
    return parse_item_path(df, path).select(
        F.element_at(parts, -4).alias("class"),
        F.element_at(parts, -3).alias("split"),
        "defect",
        "image_id",
        "instance_id",
        "path",
        mask_path(path).alias("mask_path"),
        anomaly_flag("defect").alias("is_anomaly"),
    )


def parse_item_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Image id before the first ``_`` of the file name, instance number after it, defect, 4-part name."""
    stem = strip_extension(basename(path))
    pieces = F.split(stem, "_")
    return df.select(
        "*",
        F.get(pieces, 0).alias("image_id"),
        F.get(pieces, 1).cast("int").alias("instance_id"),
        parent_name(path).alias("defect"),
        F.array_join(F.slice(F.split(F.col(path), "/"), -4, 4), "/").alias("image_name"),
    )


def mask_path(path: str | Column) -> Column:
    """Ground-truth mask of a test item: ``/test/`` -> ``/ground_truth/`` and ``<image id>_mask``; NULL for good."""
    col = as_col(path)
    image = F.regexp_extract(basename(col), r"^([^_.]+)", 1)
    moved = F.regexp_replace(F.regexp_replace(col, "/test/", "/ground_truth/"), r"[^/]*$", "")
    extension = F.regexp_extract(col, r"(\.[^.]*)$", 1)
    return F.when(parent_name(col) != "good", F.concat(moved, image, F.lit("_mask"), extension))


def scan_list(
    lines: DataFrame, image_layout: str, label_layout: str, start: int = 0, end: int | None = None, first: int | None = None
) -> DataFrame:
    """Map the lines of a list file to (image, label) paths; ``{}`` in a layout stands for the line.

    ``lines(line_no, value)`` in file order; ``[start:end]`` slices it, ``first`` keeps a leading number.
    """

    def fill(layout: str) -> Column:
        head, tail = layout.split("{}")
        return F.concat(F.lit(head), F.trim("value"), F.lit(tail))

    out = row_index(lines, ["line_no"], name="_rn").where(F.col("_rn") > start)
    if end is not None:
        out = out.where(F.col("_rn") <= end)
    if first is not None:
        out = out.where(F.col("_rn") <= start + first)
    return out.select("line_no", fill(image_layout).alias("image"), fill(label_layout).alias("label"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one list file; ``line_no`` grows in file order (splits of one file are read in order)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def anomaly_flag(defect: str | Column, mode: str = "exact") -> Column:
    """``exact``: defect differs from good. ``contains``: the name does not contain good."""
    col = as_col(defect)
    if mode == "exact":
        return (col != "good").cast("int")
    if mode == "contains":
        return (~F.contains(col, F.lit("good"))).cast("int")
    raise ValueError(f"unknown mode {mode}")


def load_positions(parts: Sequence[DataFrame], key: Sequence[str] = ("image_id", "instance_id")) -> DataFrame:
    """Merge position records; for a key in several parts the later part wins."""
    numbered = union_rows([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in numbered.columns if c not in key and c != "_part"]
    return numbered.groupBy(*key).agg(F.max_by(F.struct(*rest), "_part").alias("r")).select(*key, "r.*")
