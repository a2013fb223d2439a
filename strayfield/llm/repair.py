"""Repair of conversations: the cheapest edits that give a well-formed one, by an auction shortest-path algorithm.

A well-formed conversation has role initials ``(s?(ua)+)?``. Rows are kept (K, cost 0), given the role user or assistant
that fits (R, 3) or deleted (D, 4; required for blank rows and duplicates); a user or assistant turn without text may be
inserted anywhere (I, 3); a truncated row that stays costs 3 more. Of the cheapest repairs the one whose edits, as text,
come first in ASCII order is taken. Rows are in order of turn (NULL first), then role, then the SHA-256 of the text.

Edits walk through a lattice: a layer for each gap between rows, four states (nothing yet; after a system turn; after a
user turn; after a whole pair). Given state and edit, the next node is fixed. The auction keeps a price for each node, never
above an arc's cost plus the price behind it, and a path from the start. Where the path's last node is priced below its
best arc the price rises and the path contracts, else it is extended along that arc, until it ends at the target. The prices
are then a dual optimum: cheapest paths consist of tight arcs alone, and every path of tight arcs to the target is cheapest.
The first of them in ASCII order is found by a search that tries tight arcs by label and leaves dead ends for good. Prices
start at the rows' unavoidable costs, so that they only rise by what is wrong with the order of roles.

A conversation of any length is solved in chunks of ``CHUNK`` rows. Chunks of one conversation run in parallel: each is
priced between its four entry and four exit states; the results are the arcs of a lattice of chunks, priced in turn in
groups of ``GROUP`` up to a single node; down again, each group passes its parts the price of every exit; and a chunk then
traces its tight arcs from every entry. Only the order of the result itself (the edits in one string, one hash over all
turns) is walked row by row: a sorted stream, of which a task holds one chunk's traces.

Edge cases: NULLs count as one space, in roles and texts; a NULL turn has no part in gaps; rows of a NULL conversation are a
conversation. Equal rows are duplicates of the first. A role of another initial, or an empty one, can't be kept. A
conversation without rows has zeros, no edits and the hash of nothing. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strayfield.llm.common import fresh
from strayfield.operators.ordering import row_index
from strayfield.session import cut_lineage, parallelism

CHUNK = 64  # rows of a chunk
GROUP = 64  # chunks, or groups, priced together
RETAG, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
STATES = 4
NEXT = (2, 2, 3, 2)  # state after a turn of the role that fits
ROLE = ("user", "user", "assistant", "user")  # the role that fits
END = (0, 2 * INSERT, INSERT, 0)  # what it costs to finish in each state: an open user turn is answered
CLOSING = ("", "II", "I", "")
_NONSPACE = r"[^\x20\x09-\x0D]"

Arc = tuple[int, str, int]  # cost, label, node


def row_arcs(symbol: str, at: int) -> list[list[Arc]]:
    """Arcs of the layer before a row, by label. The symbol is ``d`` for a row that must go, else its role's initial (``x``
    if it can't be kept), as a capital if the row is truncated."""
    arcs: list[list[Arc]] = []
    for q in range(STATES):
        here = [(DELETE, "D", (at + 1) * STATES + q), (INSERT, "I", at * STATES + NEXT[q])]
        if symbol != "d":
            extra, initial, fits = CUT_SHORT * symbol.isupper(), symbol.lower(), (at + 1) * STATES + NEXT[q]
            if initial == ROLE[q][0]:
                here.append((extra, "K", fits))
            elif initial == "s" and q == 0:
                here.append((extra, "K", (at + 1) * STATES + 1))
            here.append((RETAG + extra, "R", fits))
        arcs.append(here)
    return arcs


def part_arcs(costs: Sequence[int | None], at: int) -> list[list[Arc]]:
    """Arcs of a layer of the chunk lattice: ``costs`` of all (entry, exit), row by row, None where there is no way."""
    return [[(c, "", (at + 1) * STATES + r) for r in range(STATES) if (c := costs[q * STATES + r]) is not None] for q in range(STATES)]


class Lattice:
    """Layers of arcs, the last layer open."""

    def __init__(self, layers: Sequence, arcs: Callable[[object, int], list[list[Arc]]]):
        self.arcs = [a for at, layer in enumerate(layers) for a in arcs(layer, at)]
        self.size = len(layers)
        self.least = [min((c for q in range(STATES) for c, _, j in self.arcs[at * STATES + q] if j >= (at + 1) * STATES), default=0) for at in range(self.size)]

    def priced(self, exits: Sequence[int | None], entries: Sequence[int]) -> tuple[list[list[Arc]], list[float]]:
        """Arcs with the way out and nodes that can't get there left without arcs; prices that are exact at ``entries``.

        Prices stay right as lower bounds from one entry's auction to the next. An entry without a way out is priced inf.
        """
        target = (self.size + 1) * STATES
        way_out = [[(exits[q], "", target)] if exits[q] is not None else [] for q in range(STATES)]
        arcs = self.arcs + way_out
        into: list[list[int]] = [[] for _ in range(target + 1)]
        for i, out in enumerate(arcs):
            for _, _, j in out:
                into[j].append(i)
        reaches = {target}
        stack = [target]
        while stack:
            for i in into[stack.pop()]:
                if i not in reaches:
                    reaches.add(i)
                    stack.append(i)
        arcs = [[a for a in out if a[2] in reaches] for out in arcs]
        price: list[float] = [0.0] * (target + 1)
        bound = min((c for c in exits if c is not None), default=0)
        for at in range(self.size, -1, -1):
            bound += self.least[at] if at < self.size else 0
            for q in range(STATES):
                price[at * STATES + q] = bound if arcs[at * STATES + q] else float("inf")
        for entry in entries:
            if entry in reaches:
                auction(arcs, price, entry, target)
        return arcs, price

    def traced(self, arcs: list[list[Arc]], price: list[float], entry: int) -> tuple[str, int, int]:
        """The labels of the first cheapest path in ASCII order, its cost without the way out, and its exit state."""
        target = (self.size + 1) * STATES
        dead: set[int] = set()
        path, labels, at, cost = [entry], [], [0], 0
        while path[-1] != target:
            i = path[-1]
            tight = [a for a in arcs[i] if price[i] == a[0] + price[a[2]] and a[2] not in dead]
            if tight:
                c, label, j = min(tight, key=lambda a: a[1])
                path.append(j)
                labels.append(label)
                at.append(cost)
                cost += c
            else:
                dead.add(path.pop())
                labels.pop()
                cost = at.pop()
        return "".join(labels), at[-1], path[-2] % STATES


def auction(arcs: list[list[Arc]], price: list[float], source: int, target: int) -> None:
    """Raise ``price`` until a path of tight arcs leads from ``source`` to ``target``."""
    path = [source]
    while (i := path[-1]) != target:
        best, j = min((c + price[j], j) for c, _, j in arcs[i])
        if best > price[i]:
            price[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(j)


def between(lattice: Lattice) -> list[int | None]:
    """Costs of all (entry, exit), row by row."""
    out: list[list[int | None]] = []
    for r in range(STATES):
        price = lattice.priced([0 if q == r else None for q in range(STATES)], range(STATES))[1]
        out.append([None if price[q] == float("inf") else int(price[q]) for q in range(STATES)])
    return [out[r][q] for q in range(STATES) for r in range(STATES)]


def remaining(lattice: Lattice, exits: Sequence[int | None]) -> list[list[int | None]]:
    """For every layer behind a part the cost that remains from each state."""
    price = lattice.priced(exits, range(STATES * (lattice.size + 1) - 1, -1, -1))[1]
    cost = [None if p == float("inf") else int(p) for p in price]
    return [cost[at * STATES : (at + 1) * STATES] for at in range(1, lattice.size + 1)]


def traces(symbols: str, exits: Sequence[int | None], entries: Sequence[int]) -> list[dict | None]:
    lattice = Lattice(symbols, row_arcs)
    arcs, price = lattice.priced(exits, entries)
    out: list[dict | None] = [None] * STATES
    for q in entries:
        if price[q] != float("inf"):
            audit, cost, end = lattice.traced(arcs, price, q)
            out[q] = {"audit": audit, "cost": cost, "end": end}
    return out


_COSTS, _TRACES = pa.list_(pa.int64()), pa.list_(pa.struct([("audit", pa.string()), ("cost", pa.int64()), ("end", pa.int32())]))
_TRACES_DDL = "array<struct<audit:string,cost:bigint,end:int>>"


def _mapped(df: DataFrame, keep: str, out: dict[str, tuple[str, pa.DataType]], use: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Apply ``use`` to each row: it gets all columns, and gives the rows' values for ``keep`` and ``out``."""
    names = keep.split()
    kinds = {n: (df.schema[n].dataType.simpleString(), to_arrow_type(df.schema[n].dataType)) for n in names} | out
    schema = pa.schema([(n, arrow) for n, (_, arrow) in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [made for row in batch.to_pylist() for made in use(**row)]
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return df.mapInArrow(run, ", ".join(f"{n} {ddl}" for n, (ddl, _) in kinds.items()))


def _solved(chunks: DataFrame) -> DataFrame:
    """``g, chunk, traces``: how each chunk (``g, chunk, n, symbols``) of the ``n`` of a conversation is walked from each entry."""
    chunks = cut_lineage(chunks)
    found = {"traces": (_TRACES_DDL, _TRACES)}
    single = _mapped(chunks.where("n = 1"), "g chunk", found, lambda g, chunk, n, symbols: iter([(g, chunk, traces(symbols, END, [0]))]))
    most = chunks.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return single
    costs = {"costs": ("array<bigint>", _COSTS)}
    several = chunks.where("n > 1")
    level = _mapped(several, "g chunk n", costs, lambda g, chunk, n, symbols: iter([(g, chunk, n, between(Lattice(symbols, row_arcs)))]))
    grouped: list[DataFrame] = []
    while most > 1:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "costs"))), lambda x: x["costs"]).alias("parts")
        up = level.where("n > 1").groupBy("g", F.expr(f"chunk div {GROUP}").alias("chunk"), F.expr(f"(n + {GROUP - 1}) div {GROUP}").alias("n")).agg(parts)
        grouped.append(cut_lineage(up))
        level = cut_lineage(_mapped(grouped[-1], "g chunk n", costs, lambda g, chunk, n, parts: iter([(g, chunk, n, between(Lattice(parts, part_arcs)))])))
        most = -(-most // GROUP)
    above: DataFrame | None = None
    exits = {"exits": ("array<bigint>", _COSTS)}
    for groups in reversed(grouped):
        end = F.array(*[F.lit(c).cast("bigint") for c in END]).alias("exits")
        here = groups.where("n = 1").select("*", end)
        if above is not None:
            here = here.unionByName(groups.where("n > 1").join(above, ["g", "chunk"]))
        above = cut_lineage(
            _mapped(here, "g chunk", exits, lambda g, chunk, n, parts, exits: ((g, chunk * GROUP + i, left) for i, left in enumerate(remaining(Lattice(parts, part_arcs), exits))))
        )
    ways = several.join(above, ["g", "chunk"])
    return single.unionByName(_mapped(ways, "g chunk", found, lambda g, chunk, n, symbols, exits: iter([(g, chunk, traces(symbols, exits, range(STATES)))])))


def _stream(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in order, each chunk's traces and counts before them: ``g, chunk, pos`` (-1 for the traces) and the rest."""
    key = F.col(f"`{conv}`").cast("string")
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.when(key.isNull(), "-").otherwise(F.concat(F.lit("="), key)).alias("g"), F.col(f"`{turn}`").cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    ranked = row_index(rows.withColumn("digest", F.sha2("text", 256)), ["turn", "role", "digest"], by=["g"], name="pos")
    ranked = cut_lineage(ranked.withColumns({"pos": F.col("pos") - 1, "chunk": F.expr(f"(pos - 1) div {CHUNK}")}))
    first = ranked.groupBy("g", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    slim = ranked.select("g", "chunk", "pos", "role", "digest", (~F.col("text").rlike(_NONSPACE)).alias("blank"), F.coalesce(F.col("text").rlike(rf"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"), F.lit(False)).alias("open"))
    judged = slim.join(first, ["g", "role", "digest"], "left").withColumn("again", ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    short = F.col("open") & ~F.col("blank") & ~F.col("again")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("blank") | F.col("again"), "d").when(short, F.upper(known)).otherwise(known)
    counts = [F.sum(c.cast("bigint")).alias(n) for n, c in (("blank", F.col("blank")), ("duplicate", F.col("again")), ("truncated", short))]
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("s")))), lambda x: x["s"]), "").alias("symbols")
    chunks = cut_lineage(judged.groupBy("g", "chunk").agg(letters, *counts))
    sizes = chunks.groupBy("g").agg(F.max("chunk").alias("last"))
    solved = _solved(chunks.join(sizes, "g").select("g", "chunk", (F.col("last") + 1).alias("n"), "symbols"))
    heads = chunks.drop("symbols").join(solved, ["g", "chunk"]).withColumn("pos", F.lit(-1).cast("bigint"))
    both = ranked.drop("digest").unionByName(heads, allowMissingColumns=True)
    return both.repartition(parallelism(df.sparkSession), "g").sortWithinPartitions("g", "chunk", "pos")


class Walk:
    """One conversation as its rows pass by."""

    def __init__(self, g: str):
        self.g, self.state, self.cost, self.audit = g, 0, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = None
        self.labels: Iterator[str] = iter("")

    def chunk(self, head: dict) -> None:
        trace = head["traces"][self.state]
        self.cost += trace["cost"]
        self.audit.append(trace["audit"])
        self.labels = iter(trace["audit"])
        for n in ("blank", "duplicate", "truncated"):
            setattr(self, n, getattr(self, n) + head[n])

    def inserted(self) -> tuple[str, str, str]:
        role = ROLE[self.state]
        self.state = NEXT[self.state]
        return "I", role, ""

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        for label in self.labels:
            if label == "I":
                yield self.inserted()
                continue
            if label == "K" and role[:1] == "s":
                self.state = 1
                yield label, role, text
            elif label != "D":
                yield label, role if label == "K" else ROLE[self.state], text
                self.state = NEXT[self.state]
            return

    def closing(self) -> Iterator[tuple[str, str, str]]:
        self.cost += END[self.state]
        self.audit.append(CLOSING[self.state])
        for _ in CLOSING[self.state]:
            yield self.inserted()


def _walked(df: DataFrame, ddl: str, schema: pa.Schema, begin: Callable, each: Callable, end: Callable) -> DataFrame:
    """Walk the stream; ``each`` gets a conversation's repaired turns as they come, ``end`` its end; both give rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if walk is None or r["g"] != walk.g:
                    if walk is not None:
                        out += [x for made in walk.closing() for x in each(walk, held, made)] + list(end(walk, held))
                    walk = Walk(r["g"])
                    held = begin()
                if r["pos"] < 0:
                    walk.chunk(r)
                else:
                    out += [x for made in walk.row(r["turn"], r["role"], r["text"]) for x in each(walk, held, made)]
            yield _batch(out, schema)
        if walk is not None:
            yield _batch([x for made in walk.closing() for x in each(walk, held, made)] + list(end(walk, held)), schema)

    return df.mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _keys(df: DataFrame, conv: str) -> DataFrame:
    key = F.col(f"`{conv}`").cast("string")
    return df.select(F.col(f"`{conv}`").alias("conv"), F.when(key.isNull(), "-").otherwise(F.concat(F.lit("="), key)).alias("g")).distinct()


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of every repaired conversation: the id, ``at`` (from 0), ``edit`` (K, R or I), role and text."""
    schema = pa.schema([("g", pa.string()), ("at", pa.int64()), ("edit", pa.string()), ("made_role", pa.string()), ("made_text", pa.string())])

    def each(walk: Walk, held: list[int], made: tuple[str, str, str]) -> list[tuple]:
        held[0] += 1
        return [(walk.g, held[0] - 1, *made)]

    turns = _walked(_stream(df, conv, turn, role, text), "g string, at bigint, edit string, made_role string, made_text string", schema, lambda: [0], each, lambda walk, held: [])
    return turns.join(_keys(df, conv), "g").select(F.col("conv").alias(conv), "at", "edit", F.col("made_role").alias(role), F.col("made_text").alias(text))


def report(df: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: faults, the cheapest repair and a hash of its turns as ``role:text`` lines.

    ``ids`` is a table with the conversations to report, where some may have no rows in ``df``.
    """
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("g", pa.string()), *[(n, pa.int64()) for n in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def begin() -> list:
        return [hashlib.sha256(), False]

    def each(walk: Walk, held: list, made: tuple[str, str, str]) -> list[tuple]:
        held[0].update(("\n" * held[1] + f"{made[1]}:{made[2]}").encode())
        held[1] = True
        return []

    def end(walk: Walk, held: list) -> list[tuple]:
        gaps = 0 if walk.low is None else walk.high - walk.low + 1 - walk.distinct
        return [(walk.g, gaps, walk.blank, walk.duplicate, walk.truncated, walk.illegal, walk.cost, "".join(walk.audit), held[0].hexdigest())]

    ddl = "g string, " + ", ".join(f"{n} bigint" for n in counts) + ", audit string, repaired_sha256 string"
    found = _walked(_stream(df, conv, turn, role, text), ddl, schema, begin, each, end)
    out = _keys(df if ids is None else ids, conv).join(found, "g", "left")
    zero = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in counts]
    return out.select(F.col("conv").alias(conv), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``conv:turn``: of twenty, one row goes, one loses its text, one its sentence
    ends, one is repeated, one speaks as user. NULLs become one space, but for ids and turns."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    fault, copy = fresh(df, "fault", "copy")
    said = F.when(F.col(fault) == 1, "").when(F.col(fault) == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    times = F.when(F.col(fault) == 3, 2).otherwise(1)
    hurt = df.withColumn(fault, kind).where(F.col(fault) != 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), times)))
    return hurt.withColumns({role: F.when(F.col(fault) == 4, "user").otherwise(space(role)), text: said}).drop(fault, copy)
