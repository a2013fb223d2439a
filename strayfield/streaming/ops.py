"""Structured Streaming forms: roll-up, scoring, profiles and meters over arriving rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strayfield.operators.neighbours import index_bank, search
from strayfield.operators.ordering import as_col
from strayfield.session import shared_folder

CHUNK = 65_536  # rows of one output frame


def stream_rollup(
    sdf: DataFrame, ts: str, gap: str, watermark: str, by: Sequence[str] = ("image_id",), score: str = "score", label: str = "is_anomaly"
) -> DataFrame:
    """Arriving instances to images: highest score and any anomaly per key, closed by a pause of ``gap``.

    The state is one row per open session. In append mode a session is emitted once the watermark passes it.
    """
    return (
        sdf.withWatermark(ts, watermark)
        .groupBy(*by, F.session_window(ts, gap).alias("session"))
        .agg(F.max(score).alias("score"), F.max(label).alias(label), F.count(F.lit(1)).alias("instances"))
        .select(*by, F.col("session.start").alias("start"), "score", label, "instances")
    )


def score_batch(
    bank: DataFrame, k: int, out: str, metric: str = "l2sq", query_id: str = "vec_id", bank_id: str = "vec_id", vec: str = "vec", **kw
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that scores a micro-batch against a fixed bank, which is indexed once.

    Each batch owns one folder of ``out`` and overwrites it, so a replayed batch leaves no duplicates.
    """
    index = index_bank(bank, metric, bank_id=bank_id, vec=kw.pop("bank_vec", vec), **kw)

    def write(batch: DataFrame, batch_no: int) -> None:
        scores = search(batch, index, k, query_id, vec).groupBy("query_id").agg(F.avg("distance").alias("score"))
        scores.write.mode("overwrite").parquet(f"{out}/batch={batch_no}")

    return write


def stream_profile(sdf: DataFrame, vec: str = "vec", lo: float | None = None, hi: float | None = None, bins: int = 0) -> DataFrame:
    """Running minimum and maximum per dimension; with ``bins``, running histogram counts in the range [lo, hi]."""
    cells = sdf.select(F.posexplode(vec).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    if not bins:
        return cells.groupBy("dim").agg(F.least(F.lit(999.0), F.min("v")).alias("lo"), F.greatest(F.lit(-999.0), F.max("v")).alias("hi"))
    at = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return cells.where(F.col("v").between(lo, hi)).groupBy("dim", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


class _Meter(StatefulProcessor):
    """The last values of a key as a list, and its best value; a timer forgets a key that falls idle."""

    def __init__(self, kind: str, length: int, idle_ms: int | None):
        self.kind, self.length, self.idle_ms = kind, length, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "v double")
        self.best = handle.getValueState("best", "best double, best_at long, seen_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [(p["ord"].to_numpy(), p["position"].to_numpy(), p["v"].to_numpy(), p["at_ms"].to_numpy()) for p in rows]
        order, position, value, ms = (np.concatenate(c) for c in zip(*chunks))
        at = np.lexsort((position, order))
        position, value, seen = position[at], value[at], int(ms.max())
        had, top, top_at = [v for (v,) in self.last.get()], -np.inf, -1
        if self.best.exists():
            top, top_at, before = self.best.get()
            seen = max(seen, before)

        series = np.concatenate([np.asarray(had, dtype=float), value])
        averages = _trailing_mean(series, self.length)[len(had) :]
        with np.errstate(invalid="ignore"):
            best = np.fmax.accumulate(np.concatenate([[top], value]))
            improved = value > best[:-1]
        turn = np.maximum.accumulate(np.where(improved, np.arange(len(value)), -1))
        best_at = np.where(turn < 0, top_at, position[np.maximum(turn, 0)])

        self.last.put([(float(v),) for v in series[-self.length :]])
        self.best.update((float(best[-1]), int(best_at[-1]), seen))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(seen + self.idle_ms)
        for lo in range(0, len(value), CHUNK):
            part = slice(lo, lo + CHUNK)
            yield pd.DataFrame(
                {"key": pd.Series([key[0]] * len(value[part]), dtype=self.kind), "position": position[part], "moving_avg": averages[part], "best": best[1:][part], "best_at": best_at[part]}
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def _trailing_mean(series: np.ndarray, length: int) -> np.ndarray:
    """Mean of each value and the up to ``length - 1`` before it, NaN left out."""
    there = ~np.isnan(series)
    values, ones = (np.concatenate([np.zeros(length - 1), x]) for x in (np.where(there, series, 0.0), there))
    total, n = np.zeros(len(series)), np.zeros(len(series))
    for back in range(length):  # ``length`` vector additions, so no error builds up along the series
        total += values[back : back + len(series)]
        n += ones[back : back + len(series)]
    with np.errstate(invalid="ignore"):
        return total / n


def stream_meter(
    sdf: DataFrame,
    key: str,
    value: str | Column,
    order: str,
    position: str,
    length: int = 20,
    idle: tuple[str, str, int] | None = None,
) -> DataFrame:
    """Moving average of the last ``length`` values and the best value so far, per key.

    ``(key, position, moving_avg, best, best_at)`` per arriving row. The state of a key is a list of its last ``length``
    values and the best one. Rows of a micro-batch are taken by ``order`` and ``position``; rows that arrive in a later
    batch come after it, whatever their order. A key's rows of one micro-batch are held as four numbers each, and no longer than that
    batch, so the trigger's rate limit bounds a hot key. With ``idle=(ts, watermark, milliseconds)`` a key without rows for
    that long before the watermark is forgotten and starts anew; rows behind the watermark are dropped. A NULL key is a key; a NULL
    value takes a place among the last ones, is left out of their average and never is the best (minus infinity at -1 without any). The session needs the RocksDB state store (``configure`` sets it).
    """
    ms = F.lit(0).cast("long") if idle is None else F.unix_millis(idle[0])
    rows = sdf if idle is None else sdf.withWatermark(idle[0], idle[1])
    carried = [] if idle is None else [F.col(idle[0]).alias("ts")]
    rows = rows.select(
        F.col(key).alias("key"), F.col(order).alias("ord"), F.col(position).cast("long").alias("position"), as_col(value).cast("double").alias("v"), ms.alias("at_ms"), *carried
    )
    kind = rows.schema["key"].dataType.simpleString()
    meter = _Meter("Int64" if kind in ("tinyint", "smallint", "int", "bigint") else "object", length, None if idle is None else idle[2])
    return rows.groupBy("key").transformWithStateInPandas(
        meter,
        f"key {kind}, position long, moving_avg double, best double, best_at long",
        "append",
        "None" if idle is None else "EventTime",
    )


def read_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """A parquet table of ``folder`` as a file stream: one file, or a folder of part files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # a pattern matches either; a plain path to one file is refused by the stream source
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(f"{folder}/{{{table}}}.parquet")


def run_available(sdf: DataFrame, write: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame:
    """Process everything available now, and return what was written as a table.

    Without ``write`` every batch overwrites its own folder; in complete mode the last full result remains.
    """
    spark = sdf.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def default(batch: DataFrame, batch_no: int) -> None:
        part = 0 if mode == "complete" else batch_no
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={part}")

    query = (
        sdf.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(write or default)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch") if write is None else sdf
