"""Near duplicates by SimHash and multi-index hashing.

A document's fingerprint has a bit set where over half of the hashes of its shingles (three words, repeats included) have
it. Two fingerprints link if at most three of their 64 bits differ. Then at most one bit differs in one of their two
halves, so each half is a table: a fingerprint stands in the bucket of its half, and the small ball of values within one
bit of it is enumerated and looked up there. Of two buckets the one with the clear bit looks up the other, so a pair of
buckets meets once, and a ball costs some sixteen keys. Each fetched match is verified over all 64 bits.

Equal fingerprints are one entry, so copies cost nothing. Buckets are cut into blocks of bounded size by a hash, and
a match is a pair of blocks: a row with two short lists, whatever the number of pairs between them. A task verifies a
block pair as one bit matrix and returns a spanning forest of the links it finds, so rows grow with the documents and not
with the pairs of a group, and no link is lost for the components.

Edge cases: NULL and texts without words have the fingerprint zero, which links like any other; fewer than three words are
one shingle. Rows that share an id are judged one by one. A component's id is its smallest id, NULLs aside; if it has
only NULL ids it is NULL. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strayfield.llm.components import components, forest
from strayfield.session import cut_lineage

SHINGLE = 3
SEED = 42
FAR = 3  # bits that may differ
HALF = 32
BLOCK = 1024  # fingerprints of a bucket that are verified together
_PASS = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _PASS):
        some = range(at, min(n, at + _PASS))
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in some), "<u8", len(some))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id, fp`` of every row, the fingerprint as a signed long."""
    kind = df.schema[id].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("fp", pa.int64())])

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    return df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(stamp, f"id {kind.simpleString()}, fp bigint")


def half(no: int) -> Column:
    """The lower (0) or upper (1) half of a fingerprint."""
    return (F.shiftrightunsigned("fp", HALF * no)).bitwiseAND(F.lit((1 << HALF) - 1))


def blocks(prints: DataFrame) -> DataFrame:
    """``no, key, block, fps``: the buckets of both tables in blocks of about ``BLOCK`` fingerprints at most."""
    entries = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("no"), half(i).alias("key")) for i in (0, 1)])).alias("e")).select("e.no", "e.key", "fp")
    crowded = entries.groupBy("no", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK)
    parted = entries.join(crowded, ["no", "key"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("c") / (BLOCK // 2)), F.lit(1)))
    return parted.groupBy("no", "key", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("block")).agg(F.array_sort(F.collect_list("fp")).alias("fps"))


def ball(key: Column) -> Column:
    """The values that have one more bit set than ``key``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda b: F.call_function("getbit", key, b) == 0)
    return F.transform(bits, lambda b: key.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))


def matches(table: DataFrame) -> DataFrame:
    """``a, b``: lists of fingerprints to verify against each other; a list against itself within a block."""
    buckets = table.select("no", "key").distinct()
    looked_up = buckets.select("no", F.col("key").alias("from"), F.explode(ball(F.col("key"))).alias("key")).join(buckets, ["no", "key"])
    x = table.select("no", F.col("key").alias("from"), F.col("fps").alias("a"))
    y = table.select("no", "key", F.col("fps").alias("b"))
    across = looked_up.join(x, ["no", "from"]).join(y, ["no", "key"]).select("a", "b")
    several = table.where("block > 0").select("no", "key").distinct()
    whole = table.join(several, ["no", "key"], "left_semi")
    left, right = whole.select("no", "key", F.col("block").alias("i"), F.col("fps").alias("a")), whole.select("no", "key", F.col("block").alias("j"), F.col("fps").alias("b"))
    between = left.join(right, ["no", "key"]).where("i < j").select("a", "b")
    within = table.where(F.size("fps") > 1).select(F.col("fps").alias("a"), F.col("fps").alias("b"))
    return across.unionByName(between).unionByName(within)


def links(pairs: DataFrame) -> DataFrame:
    """``u, v``: for each pair of lists a spanning forest of the fingerprints that differ in ``FAR`` bits at most."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            left, right = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                near = np.argwhere(np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= FAR)
                u, v = a[near[:, 0]], b[near[:, 1]]
                apart = u != v
                if apart.any():
                    u, v = forest(u[apart], v[apart])
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)

    alone = (F.size("a") == 1) & (F.size("b") == 1)
    close = F.bit_count(F.get("a", F.lit(0)).bitwiseXOR(F.get("b", F.lit(0)))) <= FAR  # most matches: two single entries
    return pairs.where(~alone | close).mapInArrow(verify, "u bigint, v bigint")


def labelled(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    rows = cut_lineage(fingerprints(df, id, text))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(matches(cut_lineage(blocks(prints)))))
    member = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut_lineage(member.join(least, "root").select("fp", "component_id"))
    hex = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of, "fp").select(F.col("id").alias(id), hex.alias("fingerprint"), "component_id")
