"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

The words of a source form one stream, cut into blocks of equal length. A source's target fixes how many blocks the
mixture draws from it: whole passes over all its blocks, then part of one more pass. The tree deals these quotas out to
the output shards: a node splits its shards in two halves and draws, source by source, how many of its blocks go to the
left half (hypergeometric, exact to a double's precision), so every shard of the tree ends with exact quotas whose sum is
the shard's size, distributed as if all drawn blocks had been shuffled together. A shard's blocks of a source are a run
of the source's permuted blocks, a keyed bijection computed row by row; runs are disjoint. In a shard the pieces are
ordered by a keyed hash, which is the local shuffle.

Sources are the entries of a mixture, so a row with one number per source is small; the table of documents is never
gathered by source: a source's stream runs through hash buckets.

Edge cases: a NULL text has no words and is never drawn. A NULL source is a source of its own and comes last. Sources
without words get target 0. Repeated rows are documents of their own. An empty table gives an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strayfield.llm.common import bucket_count, bucket_totals, fresh, lay_out, let, unit, words
from strayfield.session import cut_lineage

SHARDS = 16
WEIGHTS = (1, 2, 3)
PASSES = 3  # a document is taken at most so often
BLOCK_WORDS = 4096  # most words of a block
BLOCKS = 256  # a source and its target have so many blocks at least, if they have as many words
ROUNDS = 24  # of the keyed bijection
NO_LONGS = "array<bigint>"
MADE = frozenset(f"mix_{n}" for n in "row size source_size target shard order pass first words hash key bucket start rank of block blocks quota piece draw".split())


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``source, source_size`` (one row per source) with its ``target`` words.

    Weights repeat along the sources by code point, NULL last. A target stops at ``passes`` times its source; the excess
    is shared out again by weight. Sources are capped in the order of size / weight, so the level at which the sharing
    ends is the first at which the words left, spread over the weights left, stay within the next cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(passes))
    ratio = F.col("cap") / F.col("weight")
    rest = W.orderBy("ratio", "source").rowsBetween(W.unboundedPreceding, -1)
    filled = (
        sizes.withColumns({"weight": weight, "cap": cap})
        .withColumn("ratio", ratio)
        .withColumns({"cap_before": F.coalesce(F.sum("cap").over(rest), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(rest), F.lit(0.0))})
        .withColumns({"words": F.sum("source_size").over(W.partitionBy(F.lit(0))), "weights": F.sum("weight").over(W.partitionBy(F.lit(0)))})
        .withColumn("level", (F.col("words") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy(F.lit(0)))["level"]
    return filled.withColumn("level", level).select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def quotas(sources: DataFrame) -> DataFrame:
    """Adds ``block`` (words of a block), ``blocks`` of the source, and ``quota``: how many the mixture draws."""
    size = F.col("source_size")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.least(size, F.col("target")) / BLOCKS))).cast("long")
    blocks = sources.withColumn("block", block).withColumn("blocks", F.ceil(size / F.col("block")).cast("long"))
    share = F.coalesce(F.try_divide("target", size), F.lit(0.0))  # of the source; the last block may be short, so blocks are drawn in proportion
    return blocks.withColumn("quota", F.floor(share * F.col("blocks") + 0.5).cast("long"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items are marked when ``marked`` of ``total`` are: the value that ``u`` in [0, 1) picks.

    The probabilities are walked from the mode outwards by their ratios, ten standard deviations and ten more each way:
    what lies beyond is below the resolution of a double. Any fixed order of the values gives an exact draw.
    """

    def pick(p: Column) -> Column:
        big, k, n = (p[c].cast("double") for c in ("total", "marked", "drawn"))
        lo0, hi0 = F.greatest(F.lit(0).cast("long"), p["drawn"] + p["marked"] - p["total"]), F.least(p["drawn"], p["marked"])
        spread = F.sqrt(n * k / big * (1 - k / big) * (big - n) / F.greatest(big - 1, F.lit(1.0)))
        reach = (F.ceil(spread * 10) + 10).cast("long")
        mode = F.least(hi0, F.greatest(lo0, F.floor((n + 1) * (k + 1) / (big + 2)).cast("long")))
        rise = lambda x: (k - x) * (n - x) / ((x + 1) * (big - k - n + x + 1))

        def walk(m: Column) -> Column:
            up = F.when(hi0 > m, F.sequence(m, F.least(hi0, m + reach) - 1)).otherwise(F.array().cast(NO_LONGS))
            down = F.when(lo0 < m, F.sequence(m - 1, F.greatest(lo0, m - reach))).otherwise(F.array().cast(NO_LONGS))
            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"))
            add = lambda f: lambda a, x: let(f(a["w"], x.cast("double")), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s")))
            ups = F.aggregate(up, start, add(lambda w, x: w * rise(x)))["s"]
            downs = F.aggregate(down, start, add(lambda w, x: w / rise(x)))["s"] - 1

            def find(g: Column) -> Column:
                none = F.lit(-1).cast("long")
                seek = lambda f, at: lambda a, x: let(
                    f(a["w"], x.cast("double")),
                    lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"), F.when(a["k"] >= 0, a["k"]).when(g["t"] < a["s"] + w, at(x)).otherwise(none).alias("k")),
                )
                first = lambda s: F.struct(F.lit(1.0).alias("w"), s.alias("s"), none.alias("k"))
                above = F.aggregate(up, first(F.lit(1.0)), seek(lambda w, x: w * rise(x), lambda x: x + 1))["k"]
                below = F.aggregate(down, first(g["ups"]), seek(lambda w, x: w / rise(x), lambda x: x))["k"]
                hit = let(above, lambda a: F.when(a >= 0, a).otherwise(let(below, lambda b: F.when(b >= 0, b).otherwise(m))))
                return F.when(g["t"] < 1.0, m).otherwise(hit)

            return let(F.struct(ups.alias("ups"), downs.alias("downs")), lambda t: let(F.struct((u * (t["ups"] + t["downs"])).alias("t"), t["ups"].alias("ups")), find))

        return F.when((p["total"] <= 0) | (p["drawn"] <= 0) | (p["marked"] <= 0), F.lit(0).cast("long")).when(p["drawn"] >= p["total"], p["marked"]).otherwise(let(mode, walk))

    return let(F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn")), pick)


def split_quotas(sources: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``source, shard, first, past``: the run of a source's draws that each shard gets.

    ``sources`` has ``source`` and ``quota``. A node of the tree is a row with one number per source; every level is a
    narrow step that turns a node into its two halves.
    """
    entry = F.struct(F.col("source").isNull().alias("no"), F.col("source").alias("source"), F.col("quota").alias("q"))
    root = sources.agg(F.array_sort(F.collect_list(entry)).alias("all"))
    nodes = root.select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("all", lambda e: e["source"]).alias("names"), F.transform("all", lambda e: e["q"]).alias("q"), F.aggregate("all", F.lit(0).cast("long"), lambda n, e: n + e["q"]).alias("draws")
    )
    share = lambda at: F.floor(F.col("draws") * at / shards).cast("long")  # noqa: E731  draws in the shards before ``at``
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        here, left = share(F.col("hi")) - share(F.col("lo")), share(mid) - share(F.col("lo"))
        start = F.struct(here.alias("n"), left.alias("l"), F.array().cast(NO_LONGS).alias("out"))

        def deal(a: Column, e: Column) -> Column:
            u = unit(F.lit(seed), F.col("lo"), F.col("hi"), e["i"])
            drawn = hypergeometric(a["n"], e["q"], a["l"], u)
            return let(drawn, lambda x: F.struct((a["n"] - e["q"]).alias("n"), (a["l"] - x).alias("l"), F.concat(a["out"], F.array(x)).alias("out")))

        numbered = F.transform("q", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
        half = lambda lo, hi, q: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), q.alias("q"))
        whole = F.array(half(F.col("lo"), F.col("hi"), F.col("q")))
        halves = let(
            F.aggregate(numbered, start, deal)["out"],
            lambda l: F.array(half(F.col("lo"), mid, l), half(mid, F.col("hi"), F.zip_with("q", l, lambda q, x: q - x))),
        )
        nodes = nodes.select("names", "draws", F.explode(F.when(F.col("hi") - F.col("lo") <= 1, whole).otherwise(halves)).alias("h")).select(
            "h.lo", "h.hi", "names", "h.q", "draws"
        )
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip(F.col("names").alias("names"), F.col("q").alias("q"))).alias("e"))
    leaves = leaves.select("shard", F.col("e.names").alias("source"), F.col("e.q").alias("q"))
    past = F.sum("q").over(W.partitionBy("source").orderBy("shard"))
    return leaves.withColumn("past", past).select("source", "shard", (F.col("past") - F.col("q")).alias("first"), "past")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` in a keyed permutation of 0 .. n-1.

    Swap or not: each round pairs x with (k - x) mod n and swaps the pair or not by one hashed bit, so it is a bijection
    for every n, and needs neither a sort nor a table.
    """

    def step(at: Column, r: Column) -> Column:
        def pair(p: Column) -> Column:
            return F.when(F.xxhash64(*key, r, F.greatest(at, p)).bitwiseAND(F.lit(1)) == 1, p).otherwise(at)

        return let(F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n), pair)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def mixed(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The mixture: one row per piece, with all columns of ``df`` and

    ``mix_row`` (tells the rows of ``df`` apart), ``mix_size``, ``mix_source_size``, ``mix_target``, and for the piece
    ``mix_shard``, ``mix_order``, ``mix_pass``, ``mix_first`` (words of the document before it) and ``mix_words``.
    A document that is not drawn has one row with NULL in these five. Input columns of these names, and of the names
    in ``MADE``, give way; others that begin with ``mix_`` are kept.
    """
    own = [c for c in df.columns if c.lower() not in MADE]
    df = df.select(*[F.col(f"`{c}`") for c in own])
    buckets = bucket_count(df.count())
    hashed = F.xxhash64(F.lit(seed), F.col(f"`{id}`"), F.col(f"`{text}`"))
    sized = df.withColumns({"mix_size": F.size(words(F.col(f"`{text}`"))).cast("long"), "mix_hash": hashed, "mix_key": F.col(f"`{source}`").cast("string")})
    sized = sized.withColumn("mix_bucket", F.pmod(F.col("mix_hash"), F.lit(buckets)).cast("int"))
    totals = cut_lineage(bucket_totals(sized, "mix_key", "mix_size", "mix_bucket"))
    sizes = totals.groupBy(F.col("mix_key").alias("source")).agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(quotas(targets(sizes, weights, passes)))
    runs = cut_lineage(split_quotas(sources, shards, seed))

    laid = lay_out(sized, "mix_key", "mix_size", "mix_hash", totals, "mix_bucket", "mix_start", "mix_rank")
    laid = _with_source(laid, sources)
    blocks = F.sequence(F.floor(F.col("mix_start") / F.col("mix_block")), F.floor((F.col("mix_start") + F.col("mix_size") - 1) / F.col("mix_block")))
    drawn = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(passes - 1)),
            lambda e: F.filter(
                F.transform(blocks, lambda b: F.struct(e.alias("e"), b.alias("b"), (e * F.col("mix_blocks") + permuted(b, F.col("mix_blocks"), F.lit(seed), F.col("mix_key"), e)).alias("d"))),
                lambda p: p["d"] < F.col("mix_quota"),
            ),
        )
    )
    some = F.when((F.col("mix_size") > 0) & (F.col("mix_quota") > 0), drawn)
    pieces = laid.withColumn("mix_piece", F.explode_outer(some))
    start, block, b = F.col("mix_start"), F.col("mix_block"), F.col("mix_piece.b")
    first = F.greatest(b * block - start, F.lit(0).cast("long"))
    past = F.least((b + 1) * block - start, F.col("mix_size"))
    draw = F.col("mix_piece.d")
    pieces = pieces.withColumns({"mix_pass": F.col("mix_piece.e"), "mix_first": F.when(draw.isNotNull(), first), "mix_words": F.when(draw.isNotNull(), past - first), "mix_draw": draw})
    # a run is looked up by the cells of draws it touches: an equal join, of a small table with a few rows per run
    cell = F.lit(1 << 10)
    touched = runs.where("past > first").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("past") - 1) / cell))))
    touched = touched.select(F.col("source").alias("run_source"), F.col("shard").alias("mix_shard"), "first", "past", "cell")
    found = pieces.join(
        touched,
        F.col("mix_key").eqNullSafe(F.col("run_source")) & (F.floor(F.col("mix_draw") / cell) == F.col("cell")) & (F.col("mix_draw") >= F.col("first")) & (F.col("mix_draw") < F.col("past")),
        "left",
    )
    row = F.struct("mix_key", "mix_rank").alias("mix_row")
    order = F.when(F.col("mix_draw").isNotNull(), F.xxhash64(F.lit(seed), "mix_key", "mix_draw", "mix_rank")).alias("mix_order")
    return found.select(*[F.col(f"`{c}`") for c in own], row, "mix_size", "mix_source_size", "mix_target", "mix_shard", order, "mix_pass", "mix_first", "mix_words")


def _with_source(laid: DataFrame, sources: DataFrame) -> DataFrame:
    known = sources.select(F.col("source").alias("mix_of"), *[F.col(c).alias(f"mix_{c}") for c in ("source_size", "target", "block", "blocks", "quota")])
    return laid.join(known, F.col("mix_key").eqNullSafe(F.col("mix_of"))).drop("mix_of")


def taken(mix: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per document: ``size``, ``source_size``, ``target`` and the words ``taken``, repeats counted."""
    by = [F.col(f"`{id}`"), F.col("mix_row"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target")]
    return mix.groupBy(*by).agg(F.coalesce(F.sum("mix_words"), F.lit(0)).cast("long").alias("taken")).drop("mix_row")


def documents(mix: DataFrame, columns: list[str], text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The drawn pieces as documents with the given columns, but for names in ``MADE``; a whole document keeps its text byte for byte.

    A part keeps the white space between its words.
    """
    tokens = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    part = F.array_join(F.slice(tokens, (F.col("mix_first") + 1).cast("int"), F.col("mix_words").cast("int")), "")
    whole = F.col("mix_words") == F.col("mix_size")
    (piece,) = fresh(mix, "piece")
    columns = [c for c in columns if c.lower() not in MADE]
    drawn = mix.where("mix_words is not null").withColumn(piece, F.when(whole, F.col(f"`{text}`")).otherwise(part))
    new = {text: F.col(piece)}
    if n_chars in columns:
        new[n_chars] = F.length(piece).cast(mix.schema[n_chars].dataType)
    return drawn.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])
