"""Repeated passages by a distributed difference-cover suffix sort.

Every byte covered by a window of 400 bytes that also starts anywhere else is removed. Windows are compared by sorting
suffixes with the difference-cover algorithm: triples of the positions 1 and 2 mod 3 are sorted and named, the string of
names is sorted the same way, the remaining suffixes are merged in, and suffixes next to each other in the order are
compared over 400 bytes.

To distribute the sort, windows that can be equal must meet. The anchor of a window is the lowest of the hashed 16-grams
that start in its first 256 bytes (the rightmost of equals), so equal windows have it at the same place, and the 145
bytes from the anchor on lie inside every window that owns it. A run of windows with one anchor is a row: its core (those
145 bytes) and its span (all bytes of its windows), hashed. Then

* a core that occurs once settles its run: none of its windows occurs elsewhere;
* equal spans settle each other: all their windows do; one of them stands for the others below;
* runs whose core occurs with different spans are sorted. Their bytes, one row per run, are grouped by core, and a task
  sorts its groups in batches of bounded size. A core with more different spans than a batch holds (a passage that very
  many texts share) is instead spread window by window and counted by a 128-bit window hash, which splits over all tasks.

Hashes only ever bring rows together with others of equal core; equal windows always meet. Text travels twice, for the
runs to be sorted and for the result.

Edge cases: a NULL text is empty. Texts under 400 bytes lose nothing. Rows that repeat id and text are copies of each
other like any other equal texts. An empty table gives an empty result. Long texts are hashed in pieces of a million
windows. Removed bytes may cut a character, so what is kept is bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strayfield.session import cut_lineage, parallelism

WINDOW = 400
GRAM = 16  # bytes of an anchor
REACH = 256  # starts among which a window's anchor is chosen; a power of two
CORE = WINDOW - (REACH - 1)
PIECE = 1 << 20  # windows hashed at a time
BATCH = 1 << 20  # bytes sorted at a time
GROUP = 1500  # runs of a core that one task sorts

_U = np.uint64
_RANDOM = np.random.default_rng(20240311)
_BASES = [int(b) * 2 + 1 for b in _RANDOM.integers(2**61, 2**62, 2)]
_LOW = _U((1 << 21) - 1)
_ODD = _U(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _POWERS:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(PIECE + WINDOW + REACH, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


class Rolling:
    """Hashes of any range of a byte string, from one pass."""

    def __init__(self, data: np.ndarray, base: int = 0):
        up, self.down = _powers(_BASES[base])
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return (h ^ (h >> _U(29))) * _ODD


def runs(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """``start, windows, core, span`` of each run of windows that own one anchor."""
    found = []
    for at in range(0, max(0, len(data) - WINDOW + 1), PIECE):
        part = data[at : at + PIECE + WINDOW - 1]
        n = len(part) - WINDOW + 1
        h = Rolling(part)
        i = np.arange(len(part) - GRAM + 1)
        key = (h.of(i, i + GRAM) & ~_LOW) | (_LOW - i.astype(_U))  # of equal hashes the rightmost is the lowest
        step = 1
        while step < REACH:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        anchor = (_LOW - (key[:n] & _LOW)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        end = np.r_[start[1:], n]
        own = anchor[start]
        place = ((own - start).astype(_U) << _U(16)) | (end - start).astype(_U)
        span = h.of(start, end - 1 + WINDOW) ^ ((place + _U(1)) * _ODD)
        found.append((start + at, end - start, h.of(own, own + CORE).view(np.int64), span.view(np.int64)))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of ``s`` (positive numbers under 2**21, fewer than 2**21 of them), by difference cover."""
    n = len(s)
    if n < 4:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    t = np.r_[s, 0, 0, 0].astype(np.int64)
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.r_[one, two]
    triples = (t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2]
    unique, names = np.unique(triples, return_inverse=True)
    order12 = names if len(unique) == len(sample) else suffix_order(names + 1)
    rank = np.zeros(n + 4, np.int64)  # 0: past the end
    rank[sample] = order12 + 1
    by_one = lambda i: (t[i] << 21) | rank[i + 1]
    by_two = lambda i: (t[i] << 42) | (t[i + 1] << 21) | rank[i + 2]
    one, two = one[one < n], two
    zero = zero[np.argsort(by_one(zero), kind="stable")]
    one, two = one[np.argsort(rank[one])], two[np.argsort(rank[two])]
    real = np.sort(np.r_[rank[one], rank[two]])  # without the place past the end
    out = np.empty(n, np.int64)
    zero_one, zero_two = by_one(zero), by_two(zero)
    out[zero] = np.arange(len(zero)) + np.searchsorted(by_one(one), zero_one) + np.searchsorted(by_two(two), zero_two)
    out[one] = np.searchsorted(real, rank[one]) + np.searchsorted(zero_one, by_one(one))
    out[two] = np.searchsorted(real, rank[two]) + np.searchsorted(zero_two, by_two(two))
    return out


def repeated(parts: list[bytes]) -> list[np.ndarray]:
    """For each part, whether the window at each of its starts occurs at another start of any part."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    k = len(parts)
    text = np.insert(data.astype(np.int64) + k + 1, ends, np.arange(1, k + 1))  # each part ends with a symbol of its own
    first = starts + np.arange(k)
    counts = np.array([len(p) - WINDOW + 1 for p in parts])
    begin = np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())  # starts of windows
    rank = suffix_order(text)
    order = np.argsort(rank[begin])
    window = begin[order]
    # neighbours among windows are neighbours among suffixes, if they are equal: nothing shorter stands between them
    hashes = Rolling((text - k - 1).clip(0, 255).astype(np.uint8)) if len(text) <= PIECE + WINDOW else None
    same = hashes.of(window[:-1], window[:-1] + WINDOW) == hashes.of(window[1:], window[1:] + WINDOW) if hashes else np.ones(len(window) - 1, bool)
    near = np.flatnonzero(same)
    for i in range(0, len(near), 4096):
        at = near[i : i + 4096]
        offset = np.arange(WINDOW)
        same[at] = (text[window[at][:, None] + offset] == text[window[at + 1][:, None] + offset]).all(axis=1)
    hit = np.zeros(len(window), bool)
    hit[:-1] |= same
    hit[1:] |= same
    out = np.empty(len(window), bool)
    out[order] = hit
    return np.split(out, np.cumsum(counts)[:-1])


def stretches(flags: np.ndarray, start: int) -> list[tuple[int, int]]:
    """``(first window, windows)`` of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [(int(start + a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def _bytes(array: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.encode() if x else b"", np.uint8) for x in array.to_pylist()]


def covered(df: DataFrame, id: str, text: str) -> DataFrame:
    """``k1, k2, found``: for each text (by hashes of id and text) the stretches of windows that occur elsewhere."""
    keys = [F.xxhash64(F.col(f"`{id}`")).alias("k1"), F.xxhash64(F.col(f"`{text}`")).alias("k2")]
    texts = df.select(*keys, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where(F.octet_length("text") >= WINDOW)
    run = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("core", pa.int64()), ("span", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, data in enumerate(_bytes(batch.column(2))):
                start, n, core, span = runs(data)
                m = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.full(m, k1[i]), np.full(m, k2[i]), start, n.astype(np.int32), core, span), run)], schema=run)

    all_runs = texts.mapInArrow(cut, "k1 bigint, k2 bigint, start bigint, n int, core bigint, span bigint")
    # written, so that the join has a plain shuffle on both sides, which Spark can split at a hot core
    twice = cut_lineage(all_runs.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core"))
    shared = cut_lineage(all_runs.join(twice, "core", "left_semi"))
    spans = cut_lineage(shared.groupBy("core", "span").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "start", "n")).alias("one")))
    mixed = spans.groupBy("core").agg(F.min("times").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 and kinds > 1")
    settled = shared.join(spans.where("times > 1").select("core", "span"), ["core", "span"], "left_semi").select("k1", "k2", "start", F.col("n").cast("long").alias("n"))

    # one run of each span of a mixed core, with its bytes
    wanted = spans.join(mixed.select("core", "kinds"), "core").groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("core", (F.col("kinds") > GROUP).alias("many"), "one.start", "one.n")).alias("runs"))
    part = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("core", pa.int64()), ("many", pa.bool_()), ("start", pa.int64()), ("data", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, runs_of = (batch.column(i).to_pylist() for i in range(3))
            for a, b, wish, data in zip(k1, k2, runs_of, batch.column(3).to_pylist()):
                data = data.encode()
                rows = [(a, b, w["core"], w["many"], w["start"], data[w["start"] : w["start"] + w["n"] - 1 + WINDOW]) for w in wish]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), part)], schema=part)

    once = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "runs", "text")
    parts = cut_lineage(once.mapInArrow(fetch, "k1 bigint, k2 bigint, core bigint, many boolean, start bigint, data binary"))
    hit = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
    hit_ddl = "k1 bigint, k2 bigint, start bigint, n bigint"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups, then the group that is being read
        whole, size, core = 0, 0, None

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            found = [(a, b, s, n) for (a, b, start, _), flags in zip(rows, repeated([r[3] for r in rows])) for s, n in stretches(flags, start)] if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found) if found else [[]] * 4, hit)], schema=hit)

        for batch in batches:
            k1, k2, cores, starts, data = (batch.column(i).to_pylist() for i in range(5))
            for a, b, c, start, piece in zip(k1, k2, cores, starts, data):
                if c != core:
                    core, whole = c, len(held)
                if size + len(piece) + len(held) >= BATCH and whole:
                    yield settle(held[:whole])
                    held = held[whole:]
                    whole, size = 0, sum(len(r[3]) for r in held)
                held.append((a, b, start, piece))
                size += len(piece)
        if held:
            yield settle(held)

    few = parts.where("not many").select("k1", "k2", "core", "start", "data")
    sorted_hits = few.repartition(parallelism(df.sparkSession), "core").sortWithinPartitions("core").mapInArrow(sort, hit_ddl)

    each = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, start, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = np.frombuffer(piece, np.uint8)
                at = np.arange(len(data) - WINDOW + 1)
                columns = np.full(len(at), a), np.full(len(at), b), start + at, *(Rolling(data, k).of(at, at + WINDOW).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, each)], schema=each)

    windows = parts.where("many").select("k1", "k2", "start", "data").mapInArrow(spread, "k1 bigint, k2 bigint, start bigint, w1 bigint, w2 bigint")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w1", "w2")
    counted = windows.join(again, ["w1", "w2"], "left_semi").select("k1", "k2", "start", F.lit(1).cast("long").alias("n"))
    hits = settled.unionByName(sorted_hits).unionByName(counted)
    return hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("found"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((f["start"], f["start"] + f["n"] - 1 + WINDOW) for f in found or []):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def removed(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``spans`` (maximal removed runs, as ``start, end`` in bytes) and ``kept``
    (the remaining bytes)."""
    found = covered(df, id, text)
    own = df.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{id}`")).alias("k1"), F.xxhash64(F.col(f"`{text}`")).alias("k2"), F.col(f"`{text}`").alias("text"))
    kind = df.schema[id].dataType
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for whole, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (whole or "").encode()
                gone = merged(hits)
                edges = [0, *(x for run in gone for x in run), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, f.type) for x, f in zip((sizes, spans, kept), list(schema)[1:])]], schema=schema)

    joined = own.join(found, ["k1", "k2"], "left").select("id", "text", "found")
    out = joined.mapInArrow(drop, f"id {kind.simpleString()}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id)


def digest(removed_rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts and the SHA-256 of what is kept."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed_rows.select(F.col(f"`{id}`"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
