"""Packing tokenised documents into sequences of bounded length by hierarchical best fit.

A document longer than a sequence is cut into full pieces and a rest. Each task packs the pieces it reads by best fit,
longest first. A bin that is nearly full is a sequence; the others become items of their own, with their pieces inside,
and move up a tree: fewer tasks, each with the items of several, pack them again by best fit. The tree ends when one task
holds what is left, or when a round no longer joins anything; then all bins left are sequences. No task holds more than
its own items: a round uses one task for each ``TASK_ITEMS`` of them, and a bin carries its pieces, so no join is needed.

Tokenising runs in Arrow batches over whole texts. Ids of a word are cached per worker up to ``CACHE`` words; the cache
changes nothing but speed.

Edge cases: a NULL text is empty, and an empty document is its end token alone. Repeated rows are packed one by one. An
empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strayfield.session import cut_lineage

LENGTH = 4096
END = 1  # the id that closes a document
NEARLY = LENGTH // 100  # a bin with no more room than that is full
TASK_ITEMS = 50_000
CACHE = 400_000
GAIN = 0.99  # a round that leaves more than this share of its items as bins ends the tree

# Characters up to U+017F by class; texts with others go to the tokenizer as they are.
LETTERS, DIGITS, GAPS = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{DIGITS}]|[^{GAPS}{LETTERS}{DIGITS}]+")
OTHER = re.compile(r"[^\x00-ſ]|İ|[\x1c-\x1f]|<\|")


class WordEncoder(dict):
    """Ids of texts as little-endian bytes, for a tokenizer whose words end at white space and at class changes.

    Maps a chunk between white space to the bytes of its ids. Chunks are independent of each other under this kind of
    pre-tokenizer, so joining them gives what the tokenizer gives for the text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level BPE
        others = [b for b in range(256) if b not in printable]
        self.byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.parts: dict[str, bytes] = {}

    def part(self, word: str) -> bytes:
        found = self.parts.get(word)
        if found is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte)
            if word.isascii() and not word.isalnum():
                mapped = word.translate(self.byte)
            found = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.parts) < CACHE:
                self.parts[word] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        found = b"".join(map(self.part, WORD.findall(chunk)))
        if len(self) < CACHE:
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def best_fit(lengths: list[int], room: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers, by best fit on falling lengths. Bins of equal room are kept together, and the least room
    that fits is the lowest bit of a mask."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = mask >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = by_room[free].pop()
            if not by_room[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            b, free = len(bins), room
            bins.append([i])
        if free > n:
            by_room.setdefault(free - n, []).append(b)
            mask |= 1 << (free - n)
    return bins


class Packer:
    """Collects items (their length and pieces) and turns them into rows of bins."""

    def __init__(self, level: int, schema: pa.Schema, last: bool = False):
        self.level, self.schema, self.last, self.made = level, schema, last, 0
        self.lengths: list[int] = []
        self.members: list[list[dict]] = []

    def add(self, length: int, members: list[dict]) -> None:
        self.lengths.append(length)
        self.members.append(members)

    def rows(self) -> pa.RecordBatch:
        first = self.level << 56 | TaskContext.get().partitionId() << 32
        out: dict[str, list] = {"bin": [], "used": [], "full": [], "pieces": []}
        for items in best_fit(self.lengths):
            pieces, at = [], 0
            for i in items:
                pieces += [m | {"offset": m["offset"] + at} for m in self.members[i]]
                at += self.lengths[i]
            out["bin"].append(first | self.made)
            out["used"].append(at)
            out["full"].append(self.last or LENGTH - at <= NEARLY)
            out["pieces"].append(pieces)
            self.made += 1
        self.lengths, self.members = [], []
        return pa.RecordBatch.from_pydict(out, self.schema)


def packed(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and the
    token ``ids`` if asked for. ``vocabulary`` is the path of the tokenizer's file on every executor."""
    id_type = df.schema[id].dataType
    names = f"id {id_type.simpleString()}, piece int, start bigint, length bigint, crc bigint, offset bigint" + ", ids binary" * with_ids
    bins_of = f"bin bigint, used bigint, full boolean, pieces array<struct<{', '.join(x.replace(' ', ':', 1) for x in names.split(', '))}>>"
    piece = pa.struct(
        [("id", to_arrow_type(id_type)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("offset", pa.int64())] + [("ids", pa.binary())] * with_ids
    )
    schema = pa.schema([("bin", pa.int64()), ("used", pa.int64()), ("full", pa.bool_()), ("pieces", pa.list_(piece))])

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = encoder(vocabulary).encode, Packer(0, schema), np.array([END], "<u4").tobytes()
        for batch in batches:
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(whole or "") + end
                for k in range(0, len(ids), 4 * LENGTH):
                    part = ids[k : k + 4 * LENGTH]
                    row = {"id": key, "piece": k // (4 * LENGTH), "start": k // 4, "length": len(part) // 4, "crc": zlib.crc32(part), "offset": 0}
                    packer.add(len(part) // 4, [row | {"ids": part} if with_ids else row])
            if len(packer.lengths) >= TASK_ITEMS:
                yield packer.rows()
        yield packer.rows()

    def again(level: int, last: bool):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(level, schema, last)
            for batch in batches:
                for row in batch.to_pylist():
                    packer.add(row["used"], row["pieces"])
            yield packer.rows()

        return pack

    bins = cut_lineage(df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(tokenised, bins_of))
    done, level, last = bins.where("full"), 0, False
    left, n = bins.where("not full"), bins.where("not full").count()
    while n:
        level, tasks = level + 1, -(-n // TASK_ITEMS)
        last = tasks == 1
        bins = cut_lineage(left.coalesce(tasks).mapInArrow(again(level, last), bins_of))
        done, left = done.unionByName(bins.where("full")), bins.where("not full")
        m = left.count()
        if m > GAIN * n:
            done, m = done.unionByName(left), 0
        n = m
    piece_rows = done.select("bin", F.explode("pieces").alias("p"))
    out = [F.col("p.id").alias(id), F.col("p.piece").alias("piece"), F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.col("p.crc").alias("ids_crc32"), F.col("bin").alias("sequence_id"), F.col("p.offset").alias("offset")]
    return piece_rows.select(*out, *[F.col("p.ids").alias("ids")] * with_ids)
