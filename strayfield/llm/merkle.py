"""Merkle manifest of a table: a hash tree for each group, and one over the groups' roots.

``H`` is the lower-case hex SHA-256 of its inputs, concatenated; digests enter as hex text. A row's leaf is ``H`` of its
columns in order, each ``-`` if NULL, else its length in UTF-8 bytes, ``:`` and its value. While a group has several nodes,
every sixteen consecutive ones (fewer in the last run, even one) become their ``H``; the node that remains is the group's
root. The roots, ordered by group, give the root of the table in the same way.

A level is one slot pivot: the nodes under one parent are spread by conditional aggregates into sixteen slot columns, which
are combined map-side and shuffle by parent, so a group that holds most rows is spread like any other. The slot columns
in order are the parent's input; without a node's own column they are its siblings. Going down again, each node hands
its slots the way up: pairs of what stands left and right, one pair a level. A proof is these pairs in order; folding a leaf
through them must give the root. Levels grow with the logarithm of the rows; only the largest group's size reaches the driver.

Edge cases: a NULL group is a group of its own and the first one. NULL ids come first in their group; rows that share an id
follow each other by leaf, and rows that are equal in all hashed columns are equal leaves side by side, each with its own
proof. A lone row's leaf is its group's root, and a lone group's root that of the table; such a row has no siblings, and its
proof is ``H`` of nothing. An empty table gives an empty result. Columns that aren't hashed don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strayfield.operators.ordering import row_index
from strayfield.session import cut_lineage

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WAY = "array<struct<before:string,after:string>>"


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A value with its length, or ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return h(*[encoded(v) for v in values])


def leaves(df: DataFrame, id: str = "doc_id", group: str = "source", columns: Sequence[str] = COLUMNS, altered: dict[str, Column] | None = None) -> DataFrame:
    """``g, at, n, id, leaf, other``: every row's leaf at its place among the ``n`` of its group.

    ``other`` is the leaf after the columns in ``altered`` have changed, NULL if that leaves it as it is. ``g`` stands for
    the group: it sorts NULL first, then by bytes.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    key = own.get(group, F.col(f"`{group}`")).cast("string")
    g = F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), key))
    rows = df.select(g.alias("g"), F.col(f"`{id}`").alias("id"), leaf(list(own.values())).alias("leaf"), leaf([(altered or {}).get(c, v) for c, v in own.items()]).alias("other"))
    hashed = cut_lineage(rows.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))))
    placed = row_index(hashed, ["id", "leaf"], by=["g"], name="at")
    return cut_lineage(placed.join(hashed.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").withColumn("at", F.col("at") - 1))


def _slots(of: str = "") -> list[Column]:
    return [F.coalesce(F.col(f"s{k}{of}"), F.lit("")) for k in range(FANOUT)]


def raised(nodes: DataFrame, payload: Column, of: str = "") -> DataFrame:
    """The parents of a level: ``g, at, n, node`` and the slot columns ``s0`` to ``s15`` of ``payload``."""
    slot = F.col("at") % FANOUT
    spread = [F.max(F.when(slot == k, payload)).alias(f"s{k}") for k in range(FANOUT)]
    parents = nodes.groupBy("g", F.expr(f"at div {FANOUT}").alias("at"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n")).agg(*spread)
    return cut_lineage(parents.withColumn("node", h(*_slots(of))))


def levels(nodes: DataFrame, payload: Column, of: str = "") -> list[DataFrame]:
    """All levels above ``nodes`` (``g, at, n`` and a digest); a group takes part until one node of it remains."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    while most > 1:
        out.append(raised(out[-1].where("n > 1"), F.col("node")) if out else raised(nodes.where("n > 1"), payload, of))
        most = -(-most // FANOUT)
    return out


def handed_down(parents: DataFrame, of: str = "") -> DataFrame:
    """A row for each slot in use: ``g``, the child's place ``at``, its slot's content ``own``, ``subroot``, and its way up."""
    slots = _slots(of)
    side = lambda part: F.concat(*part) if part else F.lit("")
    each = [F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("own"), side(slots[:k]).alias("before"), side(slots[k + 1 :]).alias("after")) for k in range(FANOUT)]
    rows = parents.select("g", "at", "subroot", "way", F.explode(F.array(*each)).alias("c")).where("c.own is not null")
    step = F.array(F.struct("c.before", "c.after"))
    return rows.select("g", (F.col("at") * FANOUT + F.col("c.k")).alias("at"), "c.own", "subroot", F.concat(step, "way").alias("way"))


def ways(built: list[DataFrame], tops: DataFrame) -> DataFrame | None:
    """The lowest of the levels ``built``, with ``subroot`` and ``way`` from its nodes to the table's root.

    ``tops`` has ``g, subroot, way`` of each group's root.
    """
    above: DataFrame | None = None
    for level in reversed(built):
        here = level.where("n = 1").join(tops, "g")  # one row a group
        if above is not None:
            below = level.where("n > 1").join(handed_down(above).select("g", "at", "subroot", "way"), ["g", "at"])
            here = here.unionByName(below)
        above = cut_lineage(here)
    return above


def folded(start: Column, way: Column) -> Column:
    return F.aggregate(way, start, lambda acc, step: h(step["before"], acc, step["after"]))


def manifest(df: DataFrame, id: str = "doc_id", group: str = "source", columns: Sequence[str] = COLUMNS, altered: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``altered`` gives columns as they are found later; ``folded_root`` is what the found row folds to with its recorded
    siblings, and ``verified`` whether that is the recorded root.
    """
    base = leaves(df, id, group, columns, altered)
    entry = F.struct("leaf", "id", "other")
    built = levels(base, entry, ".leaf")
    subroots = base.where("n = 1").select("g", F.col("leaf").alias("subroot"))
    for level in built:
        subroots = subroots.unionByName(level.where("n = 1").select("g", F.col("node").alias("subroot")))
    subroots = cut_lineage(subroots)
    ranked = row_index(subroots, ["g"], name="at").withColumn("at", F.col("at") - 1)
    total = subroots.select(F.count(F.lit(1))).scalar()
    top = cut_lineage(ranked.select(F.lit("").alias("g"), "at", total.alias("n"), F.struct("subroot", F.col("g").alias("of")).alias("sub")))
    over = levels(top, F.col("sub"), ".subroot")
    none = F.array().cast(_WAY)
    if over:
        root = over[-1].select("node").scalar()
        apex = over[-1].select(F.lit("").alias("g"), F.lit("").alias("subroot"), none.alias("way"))
        tops = handed_down(ways(over, apex), ".subroot").select(F.col("own.of").alias("g"), F.col("own.subroot").alias("subroot"), "way")
    else:
        root = subroots.select("subroot").scalar()
        tops = subroots.select("g", "subroot", none.alias("way"))
    lone = base.where("n = 1").join(tops, "g").select("id", "leaf", "other", "subroot", "way")
    lowest = ways(built, tops)
    if lowest is not None:
        lone = lone.unionByName(handed_down(lowest, ".leaf").select("own.id", "own.leaf", "own.other", "subroot", "way"))
    siblings = F.array_join(F.transform("way", lambda s: F.concat(s["before"], s["after"])), "")
    out = lone.select(F.col("id").alias(id), "leaf", "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased(df: DataFrame, id: str = "doc_id", text: str = "text", each: int = 5) -> dict[str, Column]:
    """A change to look for: the text's A-Z in lower case, in rows whose decimal id has a CRC-32 that ``each`` divides."""
    hit = F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % each == 0
    column = F.col(f"`{text}`")
    return {text: F.when(hit, F.translate(column, UPPER, LOWER)).otherwise(column)}
