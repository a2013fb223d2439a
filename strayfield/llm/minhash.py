"""Near duplicates by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingles gives two signature values, its minimum and its maximum; both agree between two sets
with probability equal to their Jaccard similarity, so a signature needs half the hash evaluations. Five values make a
band, and documents that share a band are candidates: at similarity 0.75 one link in 50,000 shares none of 40 bands.

Equal shingle sets are one class, found by a digest; one member stands for it from there on, so copies cost nothing.
A band's bucket never becomes all pairs. First each member is confirmed against the bucket's first one, then, in buckets
whose members still hang in several components, against a second center. What is left is compared in blocks: a small bucket
is a group; large buckets that share members are one group, so that each set travels once and not once a band; a group is cut
into blocks of bounded size, and two blocks are one task's work. It counts the shingles that each pair shares, exactly and
over full sets, as a product of 0/1 matrices, and gives back a spanning forest of the links. So rows and bytes between tasks
follow the documents, not their pairs, and no link between different texts is lost to a center's choice. Members too many of
whose shingles occur in no set of the other block can't be linked with any of them and are left out of the product.

Edge cases: a text with fewer than five words has its whole word sequence as its one shingle; one without words, or NULL,
has none and is linked with nothing. A row with a NULL id can't be named: it is linked with nothing, its component is NULL,
and it is kept. Rows that share an id are one document, linked if one of its texts is. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strayfield.llm.common import fresh
from strayfield.llm.components import components, forest
from strayfield.session import cut_lineage

SHINGLE = 5
SIMILAR = 75  # percent
BANDS, ROWS = 40, 5
PERMUTATIONS = BANDS * ROWS // 2
SKETCH = 192  # signature values with one bit in the sketch
# Bits that may differ: at 0.75 an eighth of them do on average; this is seven standard deviations more.
FAR = int(SKETCH / 8 + 7 * (SKETCH * 7 / 64) ** 0.5)
CROWD = 64  # members of a bucket that is compared as a group of its own
BLOCK = 1 << 18  # shingles of a block of sets, about; a set counts for LEAST at least
LEAST = 128
FILTER = 1 << 26  # bits of a filter of ids, 8 MB
COLUMNS = 4096  # shingles that a product of two blocks takes at a time
CHUNK = 2048  # shingles hashed under all permutations at a time

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_U = np.uint64
_SPREAD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
_BAND_NO = np.arange(1, BANDS + 1, dtype=np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x * _SPREAD
    return x ^ (x >> _SHIFT)


def shingles(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    found = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and only ASCII white space splits
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))], np.uint64)
    n = len(found) - SHINGLE + 1
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    h = _stir(each[:n])
    for k in range(1, SHINGLE):
        h = _stir(h + each[k : k + n])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum, then maximum, of the hashes under each permutation."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        h = hashes[i : i + CHUNK, None] * _A + _B
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    h = _stir(_BAND_NO + rows[:, 0])
    for k in range(1, ROWS):
        h = _stir(h + rows[:, k])
    return h.view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """One bit of each of ``SKETCH`` signature values."""
    bits = (values[np.linspace(0, len(values) - 1, SKETCH).astype(int)] >> np.uint64(41)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signed(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id, n, set`` (128-bit digest of the shingle set), ``bands`` and ``sketch`` of every row."""
    kind = df.schema[id].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n", pa.int64()), ("set", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n": [], "set": [], "bands": [], "sketch": []}
            for whole in batch.column(1).to_pylist():
                hashes = shingles(whole)
                out["n"].append(len(hashes))
                out["set"].append(_digest(hashes))
                values = signature(hashes) if len(hashes) else None
                out["bands"].append(None if values is None else bands(values))
                out["sketch"].append(None if values is None else sketch(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[f.name], f.type) for f in schema if f.name != "id"]], schema=schema)

    ddl = f"id {kind.simpleString()}, n bigint, set binary, bands array<bigint>, sketch array<bigint>"
    return df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(sign, ddl)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter with one hash of the column ``rep``, as words of 64 bits: 16 bits for each id, ``FILTER`` bits at most.

    It only saves work: what passes is joined exactly afterwards, so at its bound it lets more through and nothing else.
    """
    size = min(FILTER, max(64, 1 << (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("rep"), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    words = ids.groupBy(F.expr(f"pmod(xxhash64(rep), {size}) div 64").alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def shingle_sets(df: DataFrame, id: str, text: str, near: DataFrame) -> DataFrame:
    """``id, hashes``: the full shingle set of every row whose id is in ``near(rep)``. The sets travel, not the texts."""
    kind = df.schema[id].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("hashes", pa.list_(pa.int64()))])
    wanted = id_filter(near)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy().view(np.uint64) & _U(len(wanted) * 64 - 1)
            keep = pa.array((wanted[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool))
            sets = [shingles(whole).view(np.int64) for whole in batch.column(1).filter(keep).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(sets, schema.field("hashes").type)], schema=schema)

    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{id}`")).alias("h"))
    found = rows.mapInArrow(collect, f"id {kind.simpleString()}, hashes array<bigint>")
    return found.join(near.withColumnRenamed("rep", "id"), "id", "left_semi")


def apart(a: Column, b: Column, bits: int) -> Column:
    """Bits in which two sketches differ."""
    return functools.reduce(lambda n, i: n + F.bit_count(a[i].bitwiseXOR(b[i])), range(1, bits // 64), F.bit_count(a[0].bitwiseXOR(b[0])))


def possible(a: str, b: str) -> Column:
    """Sizes and sketches of two documents allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * SIMILAR) & (apart(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), SKETCH) <= FAR)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose full sets are similar enough, as edges."""
    left = sets.select(F.col("id").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("long")
    similar = both * 100 >= (F.size("a") + F.size("b") - both) * SIMILAR
    return pairs.join(right, "v").join(left, "u").where(similar).select("u", "v").distinct()


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of ``a`` and of ``b`` (or of ``a`` again) that may be similar to one of the others, and how many hashes each two share."""
    sides = [a] if b is None else [a, b]
    sizes = [np.array([len(x) for x in s]) for s in sides]
    flat = [np.concatenate(s) for s in sides]
    owner = [np.repeat(np.arange(len(s)), n) for s, n in zip(sides, sizes)]
    while True:
        if b is None:
            values, times = np.unique(flat[0], return_counts=True)
            common = values[times > 1]
        else:
            common = np.intersect1d(*map(np.unique, flat))
        before = sum(map(len, flat))
        for i, n in enumerate(sizes):
            inside = np.isin(flat[i], common)
            held = np.bincount(owner[i][inside], minlength=len(n))
            enough = inside & (held * 100 >= n * SIMILAR)[owner[i]]
            flat[i], owner[i] = flat[i][enough], owner[i][enough]
        if sum(map(len, flat)) == before:
            break
    rows, index = zip(*[np.unique(o, return_inverse=True) for o in owner])
    place = [np.searchsorted(common, f) for f in flat]
    both = np.zeros((len(rows[0]), len(rows[-1])), np.float32)
    for at in range(0, len(common), COLUMNS):
        parts = []
        for i, r in enumerate(rows):
            here = (place[i] >= at) & (place[i] < at + COLUMNS)
            parts.append(np.zeros((len(r), min(COLUMNS, len(common) - at)), np.float32))
            parts[-1][index[i][here], place[i][here] - at] = 1
        both += parts[0] @ parts[-1].T
    return rows[0], rows[-1], both


def block_links(table: pa.Table) -> pa.Table:
    """``u, v``: a spanning forest of the links between two blocks of sets (``side`` 0 and 1), or within one."""
    side = table["side"].to_numpy()
    ids = table["rep"].to_numpy()
    sets = [x.values.to_numpy() for x in table["hashes"]]
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(second) == 0:
        second = None
    x, y, both = shared_counts([sets[i] for i in first], None if second is None else [sets[i] for i in second])
    x, y = first[x], (first if second is None else second)[y]
    n = np.array([len(s) for s in sets])
    i, j = np.nonzero(both * 100 >= (n[x][:, None] + n[y][None, :] - both) * SIMILAR)
    apart = ids[x[i]] != ids[y[j]]
    u, v = forest(ids[x[i[apart]]], ids[y[j[apart]]])
    return pa.table({"u": pa.array(u, table.schema.field("rep").type), "v": pa.array(v, table.schema.field("rep").type)})


def groups(rest: DataFrame) -> DataFrame:
    """``grp, rep``: the members ``key, rep`` of buckets in groups, each pair of a bucket together in one at least."""
    size = rest.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("low"))
    sized = cut_lineage(rest.join(size, "key"))
    lists = sized.where(F.col("c") <= CROWD).groupBy("key").agg(F.array_sort(F.collect_set("rep")).alias("reps")).select("reps").distinct()
    small = lists.select(F.concat(F.lit("b"), F.hex(F.xxhash64("reps")), F.lit(":"), F.array_min("reps").cast("string")).alias("grp"), F.explode("reps").alias("rep"))
    crowd = sized.where(F.col("c") > CROWD)
    root = components(crowd.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    large = crowd.select("rep").distinct().join(root, F.col("rep") == F.col("node"), "left").select(F.concat(F.lit("c"), F.coalesce("root", "rep").cast("string")).alias("grp"), "rep")
    return small.unionByName(large)


def compared(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the members ``key, rep`` of buckets, compared in blocks over full sets."""
    weighed = groups(rest).join(sets.groupBy(F.col("id").alias("rep")).agg(F.sum(F.greatest(F.size("hashes"), F.lit(LEAST))).alias("w")), "rep")
    member = cut_lineage(weighed)
    blocks = member.groupBy("grp").agg(F.ceil(F.sum("w") / F.lit(BLOCK)).cast("int").alias("nb"))
    placed = member.join(blocks, "grp").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = placed.select("grp", "rep", "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    tasks = dealt.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "rep")
    kind = sets.schema["id"].dataType.simpleString()
    held = tasks.join(sets.select(F.col("id").alias("rep"), "hashes"), "rep")
    return held.groupBy("grp", "i", "j").applyInArrow(block_links, f"u {kind}, v {kind}")


def _merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``rep, comp`` after joining the components that ``edges`` connect; only component ids enter the graph."""
    ends = edges.join(comp.select(F.col("rep").alias("u"), F.col("comp").alias("a")), "u").join(comp.select(F.col("rep").alias("v"), F.col("comp").alias("b")), "v")
    root = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = comp.join(root, comp["comp"] == root["node"], "left").select("rep", F.coalesce("root", "comp").alias("comp"))
    return cut_lineage(joined)


def labelled(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` and ``kept``."""
    all_rows = cut_lineage(signed(df, id, text))
    named = all_rows.where("n > 0 and id is not null")
    classes = cut_lineage(named.groupBy("set").agg(F.min("id").alias("rep")))
    reps = named.join(classes.select("set", F.col("rep").alias("id")), ["set", "id"]).select(F.col("id").alias("rep"), F.struct("n", "sketch").alias("of"), "bands")
    member = reps.select(F.explode("bands").alias("key"), "rep")
    size = member.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min_by("rep", F.xxhash64(F.lit(1), "rep")).alias("alt"))
    shared = cut_lineage(member.join(size.where("lo < hi"), "key").select("key", "rep", "lo", "alt"))
    facts = cut_lineage(reps.select("rep", "of").join(shared.select("rep").distinct(), "rep"))
    near = facts.select("rep")
    sets = cut_lineage(shingle_sets(df, id, text, near))

    def test(pairs: DataFrame) -> DataFrame:
        """Edges among ``u, v``, each pair tested once."""
        u, v = facts.select(F.col("rep").alias("u"), F.col("of").alias("x")), facts.select(F.col("rep").alias("v"), F.col("of").alias("y"))
        likely = cut_lineage(pairs.distinct().join(v, "v").join(u, "u").where(possible("x", "y")).select("u", "v"))
        return cut_lineage(confirmed(likely, sets))

    firsts = test(shared.where("rep > lo").select(F.col("lo").alias("u"), F.col("rep").alias("v")))
    comp = _merged(near.select("rep", F.col("rep").alias("comp")), firsts)

    def still_open(members: DataFrame) -> DataFrame:
        """The members ``key, rep, ...`` of buckets that hang in several components, with theirs."""
        mixed = members.join(comp, "rep")
        keys = mixed.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("two")).where("one < two").select("key")
        return mixed.join(keys, "key")

    mixed = cut_lineage(still_open(shared))
    center = comp.select(F.col("rep").alias("alt"), F.col("comp").alias("other"))
    across = mixed.where("alt <> rep and alt <> lo and rep <> lo").join(center, "alt").where("comp <> other")
    comp = _merged(comp, test(across.select(F.least("alt", "rep").alias("u"), F.greatest("alt", "rep").alias("v"))))
    rest = cut_lineage(still_open(mixed.where("rep <> lo and rep <> alt").select("key", "rep")).select("key", "rep"))
    comp = _merged(comp, cut_lineage(compared(rest, sets)))
    root = comp.where("comp <> rep")
    of_class = classes.join(root, "rep", "left").select("set", F.coalesce("comp", "rep").alias("root"))
    out = all_rows.select("id", F.col("n").alias("n_shingles"), "set").join(of_class, "set", "left")
    return out.select(
        F.col("id").alias(id),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id")).alias("component_id"),
        F.coalesce((F.col("n_shingles") == 0) | (F.col("root") == F.col("id")), F.lit(True)).alias("kept"),
    )


def deduplicated(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept: one document of each component."""
    lost = cut_lineage(labelled(df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text").where("not kept").select("id").distinct())
    (gone,) = fresh(df, "lost_id")
    return df.join(lost.withColumnRenamed("id", gone), F.col(f"`{id}`") == F.col(gone), "left_anti")
