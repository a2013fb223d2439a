"""Clustering, outlier rules, alignment and instance bookkeeping."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strayfield.functions.arrays import alignment_divergence, cosine
from strayfield.operators import blocks as B, pivots as T
from strayfield.operators.graph import connected_components
from strayfield.operators.neighbours import distance_sums, knn
from strayfield.operators.ordering import attach, row_index
from strayfield.operators.selection import kth_on_a_line, nearest_sums
from strayfield.operators.vectors import mean_vector
from strayfield.session import cut_lineage, drop_table


def zscore_outliers(df: DataFrame, col: str, b: float = 0.0, by: Sequence[str] = (), out: str = "label") -> DataFrame:
    """1 where z > 3 - b or z < -3 + b with the population deviation; 0 when there is no deviation."""
    stats = df.groupBy(*by).agg(F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd"))
    z = (F.col(col) - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0))
    label = F.when((z > 3.0 - b) | (z < -3.0 + b), 1).otherwise(0)
    return attach(df, stats, by).withColumn(out, label).drop("_mu", "_sd")


# --- radius work on blocks ------------------------------------------------------------------------------------


def _within(q: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Pairs at most ``eps`` apart; pairs too close to call in the matrix product are computed exactly."""
    d, limit = B.distances(q, b, "l2sq"), eps * eps
    hit = d <= limit
    r, c = np.nonzero(np.abs(d - limit) <= 1e-9 * (1.0 + limit))
    if len(r):
        hit[r, c] = np.sqrt(B.paired(q[r], b[c], "l2sq")) <= eps
    return hit


def _stretch(q: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """For each number of ``q``, the stretch ``[lo, hi)`` of the sorted different numbers ``b`` that ``_within`` finds."""
    lo, hi = np.searchsorted(b, q - eps, "left"), np.searchsorted(b, q + eps, "right")
    # both ends are settled by the distances themselves, which are off the sums by a rounding at most
    for end, step, inner in ((lo, -1, 0), (hi, 1, -1)):
        while True:
            out, last = end + (step + inner if step < 0 else 0), end + inner
            grow = (out >= 0) & (out < len(b))
            grow[grow] = np.abs(q[grow] - b[out[grow]]) <= eps
            shrink = ~grow & (last >= 0) & (last < len(b)) & (lo < hi)
            shrink[shrink] = np.abs(q[shrink] - b[last[shrink]]) > eps
            if not (grow.any() or shrink.any()):
                break
            end += step * grow - step * shrink
    return lo, hi


def _strips(q: np.ndarray, b: np.ndarray):
    step = max(1, B.TILE // max(1, len(b)))
    for lo in range(0, len(q), step):
        yield lo, q[lo : lo + step]


def _radius_join(queries: DataFrame, bank: DataFrame, eps: float, kernel, schema: str, block_rows: int) -> DataFrame:
    tree = T.grow(bank, "l2sq", block_rows=block_rows)
    return B.block_join(T.descend(queries, tree, T.within(eps)), tree.placed, kernel, schema, block_rows, block_rows)


def _weighted_points(df: DataFrame, item: str, vec: str) -> DataFrame:
    """Distinct vectors with their multiplicity, so copies of one vector cost nothing later on."""
    rows = df.select(F.col(item).alias("id"), F.transform(F.col(vec).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    return rows.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def dbscan(
    df: DataFrame, eps: float, min_samples: int, item: str = "vec_id", vec: str = "vec", block_rows: int = B.BLOCK_ROWS
) -> DataFrame:
    """DBSCAN: ``(item, label, core)``, noise is -1, clusters are numbered by their smallest core item.

    Blocks count neighbours and link core points by spanning forests (fewer links than points), the forests
    are joined by connected components, and border points take the first cluster in reach.
    """
    points = cut_lineage(_weighted_points(df, item, vec))
    if _on_a_grid(points, eps):
        return _numbered(df, points, *_grid_clusters(points, eps, min_samples), item, vec)
    kind = points.schema["id"].dataType.simpleString()
    as_query = points.select(F.col("id").alias("query_id"), "vec")
    as_bank = points.select(F.col("id").alias("bank_id"), "vec", "n")

    def count(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "n": np.zeros(0, dtype=np.int64)})
        qm, bm, n = B.matrix(q["vec"]), B.matrix(b["vec"]), b["n"].to_numpy(np.int64)
        near = np.concatenate([_within(part, bm, eps) @ n for _, part in _strips(qm, bm)])
        return pd.DataFrame({"query_id": q["query_id"], "n": near})

    near = _radius_join(as_query, as_bank, eps, count, f"query_id {kind}, n long", block_rows)
    core_ids = near.groupBy("query_id").agg(F.sum("n").alias("near")).where(F.col("near") >= min_samples)
    core = cut_lineage(points.join(core_ids.select(F.col("query_id").alias("id")), "id").select("id", "vec"))

    def forest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"u": q["query_id"][:0], "v": q["query_id"][:0]})
        qm, bm = B.matrix(q["vec"]), B.matrix(b["vec"])
        ids = np.concatenate([q["query_id"].to_numpy(), b["bank_id"].to_numpy()])
        label = np.arange(len(ids))
        for lo, part in _strips(qm, bm):
            r, c = np.nonzero(_within(part, bm, eps))
            r, c = r + lo, c + len(qm)
            while True:
                low = np.minimum(label[r], label[c])
                before = label.copy()
                # hook the roots of both ends, then shorten the chains
                np.minimum.at(label, label[r], low)
                np.minimum.at(label, label[c], low)
                while not np.array_equal(label, label[label]):
                    label = label[label]
                if np.array_equal(before, label):
                    break
        moved = np.nonzero(label != np.arange(len(ids)))[0]
        return pd.DataFrame({"u": ids[moved], "v": ids[label[moved]]})

    links = _radius_join(
        core.select(F.col("id").alias("query_id"), "vec"), core.select(F.col("id").alias("bank_id"), "vec"), eps, forest,
        f"u {kind}, v {kind}", block_rows,
    )
    roots = connected_components(links).withColumnRenamed("node", "id")
    labelled = cut_lineage(core.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))

    def adopt(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "root": q["query_id"][:0]})
        b = b.sort_values("root")
        qm, bm = B.matrix(q["vec"]), B.matrix(b["vec"])
        hits = np.concatenate([np.where(w.any(1), w.argmax(1), -1) for w in (_within(p, bm, eps) for _, p in _strips(qm, bm))])
        found = hits >= 0
        return pd.DataFrame({"query_id": q["query_id"][found], "root": b["root"].to_numpy()[hits[found]]})

    rest = points.join(labelled.select("id"), "id", "left_anti").select(F.col("id").alias("query_id"), "vec")
    border = _radius_join(rest, labelled.select(F.col("id").alias("bank_id"), "vec", "root"), eps, adopt, f"query_id {kind}, root {kind}", block_rows)
    border = border.groupBy(F.col("query_id").alias("id")).agg(F.min("root").alias("root"))
    return _numbered(df, points, labelled.select("id", "root"), border, item, vec)


def _numbered(df: DataFrame, points: DataFrame, core: DataFrame, border: DataFrame, item: str, vec: str) -> DataFrame:
    """Labels of all rows from the ``(id, root)`` of core and border points."""
    known = core.select("id", "root", F.lit(1).alias("core")).unionByName(border.select("id", "root", F.lit(0).alias("core")))
    numbers = row_index(core.select("root").distinct(), ["root"], name="_no").select("root", (F.col("_no") - 1).alias("label"))
    done = points.join(known.join(numbers, "root"), "id", "left").select(
        "vec", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("core", F.lit(0)).alias("core")
    )
    rows = df.select(item, F.transform(F.col(vec).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    return rows.join(done, "vec").select(item, "label", "core")


# --- clusters on a grid ---------------------------------------------------------------------------------------


def _on_a_grid(points: DataFrame, eps: float) -> bool:
    """Whether the points have one to three dimensions, and numbers that cells can tell apart."""
    far = F.aggregate("vec", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(F.coalesce(x, F.lit(float("nan"))))))
    small, large, most = points.agg(F.min(F.size("vec")), F.max(F.size("vec")), F.max(far)).first()
    return small == large and small in (1, 2, 3) and eps > 0 and most < 1e12 * eps


def _apart(a, b, dims: int):
    """The distance of two vectors as the plain formula has it."""
    gaps = [F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(dims)]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def _box(df: DataFrame, by: str, dims: int, *more) -> DataFrame:
    """The corners ``lo, hi`` of the points of each ``by``."""
    ends = [F.array(*[f(F.get("vec", F.lit(i))) for i in range(dims)]).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return df.groupBy(by).agg(*ends, *more)


def _gap(a: str, b: str, dims: int):
    """The least distance of a point in the box ``a`` to one in the box ``b``."""
    zero = F.lit(0.0)
    gaps = [F.greatest(zero, F.get(f"{a}_lo", F.lit(i)) - F.get(f"{b}_hi", F.lit(i)), F.get(f"{b}_lo", F.lit(i)) - F.get(f"{a}_hi", F.lit(i))) for i in range(dims)]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def _grid_clusters(points: DataFrame, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """``(id, root)`` of the core points and of the border points of ``points(id, vec, n)``, in one to three dimensions.

    Any two points of a cell are within ``eps``, so a cell of ``min_samples`` rows is all core, and the core points of a cell are one
    cluster. Only points of other cells, fewer than ``min_samples`` in each, count their neighbours or look for a cluster, in the
    cells around. Clusters are joined as cells: two cells are linked if their outermost core points are; all core points are
    met only for cells that are near enough and not yet joined, which are few unless whole dense cells lie just over ``eps`` apart.
    """
    dims = points.select(F.size("vec").alias("d")).first()["d"]
    side = 0.99 * eps / dims**0.5
    steps = [F.floor(F.get("vec", F.lit(i)) / F.lit(side)).cast("long") for i in range(dims)]
    shifts = itertools.product((-2, -1, 0, 1, 2), repeat=dims)
    around = F.array_distinct(F.array(*[F.xxhash64(*[s + F.lit(x).cast("long") for s, x in zip(steps, shift)]) for shift in shifts]))
    placed = points.select("id", "vec", "n", F.xxhash64(*steps).alias("cell"))
    # two cells that share a hash are one cell that is not tight: its points stand for themselves
    tight = (_apart("lo", "hi", dims) <= eps).alias("tight")
    cells = _box(placed, "cell", dims, F.sum("n").alias("rows")).select("cell", "rows", tight)
    placed = cut_lineage(placed.join(cells, "cell").select("*", (F.col("tight") & (F.col("rows") >= min_samples)).alias("full")))

    loose = placed.where("not full").select("id", "vec", F.explode(around).alias("cell"))
    bank = placed.select("cell", F.col("vec").alias("other"), "n")
    near = loose.join(bank, "cell").where(_apart("vec", "other", dims) <= eps).groupBy("id").agg(F.sum("n").alias("near"))
    more = near.where(F.col("near") >= min_samples).select("id", F.lit(True).alias("counted"))
    core = placed.join(more, "id", "left").where("full or counted")
    core = cut_lineage(core.select("id", "vec", "cell", F.when(F.col("tight"), F.col("cell")).otherwise(F.xxhash64("vec", F.lit(1))).alias("part")))

    # the parts: what is one cluster of itself, with its outermost points
    outer = [f("vec", F.get("vec", F.lit(i))) for i in range(dims) for f in (F.min_by, F.max_by)]
    parts = cut_lineage(_box(core, "part", dims, F.min("id").alias("root"), F.first("vec").alias("vec"), F.min("cell").alias("cell"), F.array_distinct(F.array(*outer)).alias("outer")))
    fields = ("part", "root", "lo", "hi", "outer")
    asked = parts.select(F.explode(around).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in fields])
    pairs = asked.join(parts.select("cell", *[F.col(c).alias(f"b_{c}") for c in fields]), "cell").where((F.col("a_root") < F.col("b_root")) & (_gap("a", "b", dims) <= eps))
    touch = F.exists("a_outer", lambda x: F.exists("b_outer", lambda y: _apart(x, y, dims) <= eps))
    pairs = cut_lineage(pairs.select("a_part", "a_root", "b_part", "b_root", touch.alias("touch")))
    first = cut_lineage(connected_components(pairs.where("touch").select(F.col("a_root").alias("u"), F.col("b_root").alias("v"))))

    def known(side: str) -> DataFrame:
        return first.select(F.col("node").alias(f"{side}_root"), F.col("root").alias(f"{side}_first"))

    open_pairs = pairs.where("not touch").join(known("a"), "a_root", "left").join(known("b"), "b_root", "left")
    joined = [F.coalesce(f"{x}_first", f"{x}_root") for x in ("a", "b")]
    open_pairs = cut_lineage(open_pairs.where(joined[0] != joined[1]).select("a_part", "b_part", "a_root", "b_root"))
    one, two = (core.select(F.col("part").alias(f"{x}_part"), F.col("vec").alias(f"{x}_vec")) for x in ("a", "b"))
    met = open_pairs.join(one, "a_part").join(two, "b_part").where(_apart("a_vec", "b_vec", dims) <= eps).select("a_root", "b_root").distinct()
    links = pairs.where("touch").select("a_root", "b_root").unionByName(met).toDF("u", "v")
    roots = connected_components(links)
    whole = parts.join(roots.withColumnRenamed("root", "low"), parts["root"] == roots["node"], "left").select("part", F.coalesce("low", "root").alias("root"))
    found = cut_lineage(core.join(whole, "part").select("id", "root", "cell", F.col("vec").alias("other")))

    rest = placed.join(found.select("id"), "id", "left_anti").select("id", "vec", F.explode(around).alias("cell"))
    border = rest.join(found.drop("id"), "cell").where(_apart("vec", "other", dims) <= eps).groupBy("id").agg(F.min("root").alias("root"))
    return found.select("id", "root"), border


def bandwidth(df: DataFrame, quantile: float = 0.3, item: str = "vec_id", vec: str = "vec", block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """One row: the mean distance of a row to its ``int(n * quantile)``-th nearest row, itself included; NULL without rows.

    The neighbours are never listed: rounds of distance bins close in on each row's distance (``selection.nearest_sums``),
    and copies of a vector count once with a weight. Vectors of one number need no distances, but an order (``selection.kth_on_a_line``).
    """
    sizes = df.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if tuple(sizes) == (1, 1):
        line = df.select(F.col(item).alias("id"), (F.get(vec, F.lit(0)).cast("double") + F.lit(0.0)).alias("value"))
        wanted = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * quantile)).cast("long").alias("k"))
        found = kth_on_a_line(line, wanted).where("d is not null")
        return found.agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("bandwidth"))
    points = cut_lineage(_weighted_points(df, item, vec))
    size = points.agg(F.sum("n").alias("all"))
    k = F.greatest(F.lit(1), F.floor(F.col("all") * quantile)).cast("long").alias("k")
    rows = attach(points, size, []).select(F.lit(0).alias("cell"), F.col("id").alias("query_id"), "vec", k, F.col("n").alias("w"))
    far = nearest_sums(rows, block_rows=block_rows).select(F.col("query_id").alias("id"), F.sqrt("kth").alias("d"))
    return far.join(points.select("id", "n"), "id").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("bandwidth"))


class Grid:
    """Square cells as wide as a radius over the widest of the first dimensions: what lies within the radius of a point
    lies in its cell or one beside it."""

    DIMS = 3

    def __init__(self, points: DataFrame, side: float):
        span = points.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg((F.max("v") - F.min("v")).alias("s"))
        self.dims = [r["i"] for r in span.where("s > 0").orderBy(F.col("s").desc(), "i").limit(self.DIMS).collect()]
        self.side = side * (1 + 1e-9)

    def _steps(self) -> list:
        return [F.floor(F.get("vec", F.lit(i)) / F.lit(self.side)).cast("long") for i in self.dims]

    def cell(self):
        return F.xxhash64(*self._steps()) if self.dims else F.lit(0).cast("long")

    def around(self):
        """The cells a point has to look at; two that share a hash are one."""
        if not self.dims:
            return F.array(F.lit(0).cast("long"))
        shifts = itertools.product((-1, 0, 1), repeat=len(self.dims))
        return F.array_distinct(F.array(*[F.xxhash64(*[s + F.lit(x).cast("long") for s, x in zip(self._steps(), shift)]) for shift in shifts]))


def mean_shift(
    df: DataFrame,
    width: float | None = None,
    item: str = "vec_id",
    vec: str = "vec",
    max_iter: int | None = None,
    block_rows: int = B.BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Flat-kernel mean shift: ``(item, label)`` and ``(label, centre, n)``, labels by descending ``n``.

    Every point is a seed. A step averages the points within the bandwidth of each seed; seeds that meet are
    merged (at nine decimals), settled seeds leave the loop, which runs until all have; ``max_iter`` rounds without
    that raise an error. Of the final centres, those within the
    bandwidth of a stronger kept one are dropped. Points lie in the cells of a grid as wide as the bandwidth, and a seed
    meets those of its own cell and the ones beside it; a crowded cell is cut into blocks. An empty table has no labels and
    no centres. Without a ``width`` it is the ``bandwidth`` of the rows.
    """
    points = cut_lineage(_weighted_points(df, item, vec))
    one = points.select(F.size("vec").alias("dims")).first()
    if one is None:
        none = df.select(item, F.lit(0).cast("long").alias("label")).where("false")
        return none, none.select("label", F.array().cast("array<double>").alias("centre"), F.col("label").alias("n"))
    dims = one["dims"]
    bw = bandwidth(df, 0.3, item, vec, block_rows).first()[0] if width is None else float(width)
    bank = points.select(F.xxhash64("vec").alias("bank_id"), "vec", "n")

    def average(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "n": np.zeros(0, dtype=np.int64), "s": pd.Series([], dtype=object)})
        qm, bm, w = B.matrix(q["vec"]), B.matrix(b["vec"]), b["n"].to_numpy(float)
        n, s = [], []
        if dims == 1:  # sums over a stretch of the sorted numbers are differences of running sums
            order = bm[:, 0].argsort()
            line, w = bm[order, 0], w[order].astype(np.longdouble)
            lo, hi = _stretch(qm[:, 0], line, bw)
            count, total = (np.concatenate([[np.longdouble(0)], np.cumsum(x)]) for x in (w, w * line))
            return pd.DataFrame({"query_id": q["query_id"], "n": (count[hi] - count[lo]).astype(np.int64), "s": list((total[hi] - total[lo]).astype(float)[:, None])})
        for _, part in _strips(qm, bm):
            hit = _within(part, bm, bw).astype(float) * w
            n.append(hit.sum(1))
            s.append(hit @ bm)
        return pd.DataFrame({"query_id": q["query_id"], "n": np.concatenate(n).astype(np.int64), "s": list(np.concatenate(s))})

    def seeds(rows: DataFrame) -> DataFrame:
        return rows.select("vec").distinct().select(F.xxhash64("vec").alias("query_id"), "vec")

    active, settled = seeds(points), []
    grid = Grid(points, bw)
    placed = cut_lineage(bank.withColumn("cell", grid.cell()))
    while True:
        visits = active.withColumn("cell", F.explode(grid.around()))
        part = B.block_join(visits, placed, average, "query_id long, n long, s array<double>", block_rows, block_rows)
        summed = part.groupBy("query_id").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", i)) for i in range(dims)]).alias("s"))
        moved = active.join(summed.where("n > 0"), "query_id").withColumn("to", F.transform("s", lambda x: F.round(x / F.col("n"), 9)))
        gap = F.sqrt(F.aggregate(F.zip_with("vec", "to", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
        moved = cut_lineage(moved.select("to", "n", (gap <= 1e-3 * bw).alias("done")))
        settled.append(moved.where("done").select(F.col("to").alias("vec"), "n"))
        if moved.where("not done").isEmpty():
            break
        if len(settled) == max_iter:
            raise RuntimeError(f"mean shift has not settled in {max_iter} rounds")
        active = seeds(moved.where("not done").select(F.col("to").alias("vec")))
    centres = settled[0]
    for s in settled[1:]:
        centres = centres.unionByName(s)
    centres = centres.groupBy("vec").agg(F.max("n").alias("n"))
    kept = _strongest(cut_lineage(row_index(centres, [-F.col("n"), *[-F.get("vec", F.lit(i)) for i in range(dims)]], name="rank")), bw, block_rows)
    named = row_index(kept, ["rank"], name="_no").select((F.col("_no") - 1).alias("label"), F.col("vec").alias("centre"), "n")
    named = cut_lineage(named)
    hits = knn(df, named, 1, query_id=item, bank_id="label", vec=vec, bank_vec="centre", block_rows=block_rows)
    return hits.select(F.col("query_id").alias(item), F.col("bank_id").alias("label")), named


def _strongest(centres: DataFrame, bw: float, block_rows: int) -> DataFrame:
    """Centres left when everything within ``bw`` of a stronger kept centre is dropped (rank 1 is strongest).

    In each round the centres without a stronger open one in reach are kept, and all they reach is closed.
    """

    def strongest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "top": np.zeros(0, dtype=np.int64)})
        b = b.sort_values("bank_id")
        qm, bm = B.matrix(q["vec"]), B.matrix(b["vec"])
        hits = np.concatenate([np.where(w.any(1), w.argmax(1), -1) for w in (_within(p, bm, bw) for _, p in _strips(qm, bm))])
        found = hits >= 0
        return pd.DataFrame({"query_id": q["query_id"][found], "top": b["bank_id"].to_numpy()[hits[found]]})

    def reach(q: DataFrame, b: DataFrame) -> DataFrame:
        part = _radius_join(
            q.select(F.col("rank").alias("query_id"), "vec"), b.select(F.col("rank").alias("bank_id"), "vec"), bw, strongest,
            "query_id long, top long", block_rows,
        )
        return part.groupBy(F.col("query_id").alias("rank")).agg(F.min("top").alias("top"))

    still_open, kept = centres, []
    while True:
        winners = cut_lineage(still_open.join(reach(still_open, still_open).where("top = rank").select("rank"), "rank"))
        kept.append(winners)
        covered = reach(still_open, winners).select("rank")
        still_open = cut_lineage(still_open.join(covered, "rank", "left_anti"))
        if still_open.isEmpty():
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


# --- rules ---------------------------------------------------------------------------------------------------


def refine_by_area(df: DataFrame, t: float = 0.2, area: str = "area", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Inliers whose area is off the inlier mean by more than ``t`` of it become outliers."""
    mean = df.where(F.col(label) == 0).groupBy(*by).agg(F.avg(area).alias("_mu"))
    off = F.abs(F.col(area) - F.col("_mu")) / F.nullif("_mu", F.lit(0.0)) > t
    return attach(df, mean, by, "left").withColumn(label, F.when((F.col(label) == 0) & off, 1).otherwise(F.col(label))).drop("_mu")


def refine_by_feature(
    df: DataFrame, t: float = 0.8, vec: str = "vec", label: str = "label", by: Sequence[str] = (), dims: int | None = None
) -> DataFrame:
    """Inliers whose cosine to the inlier centroid is below ``t`` become outliers."""
    centroid = mean_vector(df.where(F.col(label) == 0).select(*by, vec), by, vec, dims).withColumnRenamed(vec, "_c")
    far = cosine(vec, "_c") < t
    return attach(df, centroid, by, "left").withColumn(label, F.when((F.col(label) == 0) & far, 1).otherwise(F.col(label))).drop("_c")


def debris(df: DataFrame, t: float = 0.25, batch: str = "batch", item: str = "vec_id", vec: str = "vec") -> DataFrame:
    """Distance sum of every item within its batch, scaled to unit length over the batch, and the flag above ``t``."""
    sums = distance_sums(df, batch, item, vec)
    length = sums.groupBy(batch).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("_len"))
    share = F.col("s") / F.nullif("_len", F.lit(0.0))
    return attach(sums, length, [batch]).select(batch, item, share.alias("share"), (share > t).cast("int").alias("debris"))


def drop_debris(df: DataFrame, t: float = 0.25, batch: str = "batch", item: str = "vec_id", vec: str = "vec") -> DataFrame:
    return df.join(debris(df, t, batch, item, vec).where("debris = 1").select(item), item, "left_anti")


def scale_unit(df: DataFrame, col: str, out: str) -> DataFrame:
    """Min-max scaling over all rows; a constant column is left alone."""
    span = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    scaled = (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return attach(df, span, []).withColumn(out, F.when(F.col("_lo") != F.col("_hi"), scaled).otherwise(F.col(col))).drop("_lo", "_hi")


def iterative_outliers(
    df: DataFrame,
    step: float = 0.3,
    area: str = "area",
    refit: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Repeat the z-score rule on re-scaled areas with b = 2 - step * round until it finds nothing new.

    ``refit`` stands for the repair between rounds: it gets all rows with their ``label`` and returns the rows
    of the next round. By default flagged rows leave. The loop ends when no row, every row, or exactly the rows of the
    round before are flagged. The last pass uses b = 2. A round's table is deleted once the next one has been compared with it.
    """
    repair = refit or (lambda labelled: labelled.where("label = 0"))
    rows, before, last, round_no = df, None, None, 0
    while True:
        round_no += 1
        labelled = zscore_outliers(scale_unit(rows, area, "_unit"), "_unit", 2.0 - step * round_no)
        labelled = cut_lineage(labelled.drop("_unit"))
        flagged = labelled.where("label = 1")
        found = flagged.count()
        if found == 0 or found == labelled.count():
            break
        if before is not None and found == before.count() and flagged.exceptAll(before).isEmpty():
            break
        if last is not None:
            drop_table(last)
        before, last = flagged, labelled
        rows = repair(labelled).select(*df.columns)
    return zscore_outliers(scale_unit(labelled.drop("label"), area, "_unit"), "_unit", 2.0).drop("_unit")


def align_angle(
    reference: DataFrame, candidates: DataFrame, by: Sequence[str] = ("instance_id",), vec: str = "vec", ref_by: Sequence[str] = ()
) -> DataFrame:
    """Angle of every item whose vector is closest to the reference by KL divergence; it adds up modulo 360.

    ``candidates`` has ``candidate_angle`` and the item's current ``angle``.
    """
    ref = reference.select(*ref_by, F.col(vec).alias("_ref"))
    scored = attach(candidates, ref, ref_by).withColumn("_kl", alignment_divergence("_ref", vec))
    best = scored.groupBy(*by).agg(
        F.min_by("candidate_angle", F.struct("_kl", "candidate_angle")).alias("best_angle"), F.max(F.coalesce("angle", F.lit(0))).alias("_a")
    )
    return best.withColumn("angle", F.pmod(F.col("_a") + F.col("best_angle"), F.lit(360))).drop("_a")


def remove_and_renumber(df: DataFrame, bad: DataFrame, image: str = "image_id", instance: str = "instance_id") -> DataFrame:
    """Drop ``bad`` instances and close the gaps: the lowest free number goes to the highest id (``new_id``)."""
    # written once: each is read by several steps, and ``row_index`` reads its rows three times
    left = cut_lineage(df.join(bad.select(image, instance), [image, instance], "left_anti"))
    sizes = left.groupBy(image).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    slots = sizes.select(image, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(instance))
    gaps = cut_lineage(slots.join(left.select(image, instance).hint("merge"), [image, instance], "left_anti"))
    gaps = row_index(gaps, [instance], [image], "_rank").select(image, "_rank", F.col(instance).alias("new_id"))
    high = cut_lineage(attach(left.select(image, instance), sizes, [image]).where(F.col(instance) >= F.col("_n")).select(image, instance))
    high = row_index(high, [-F.col(instance)], [image], "_rank").join(gaps, [image, "_rank"]).select(image, instance, "new_id")
    return left.join(high, [image, instance], "left").withColumn("new_id", F.coalesce("new_id", F.col(instance)).cast("int"))


def replace_outliers(
    labelled: DataFrame, proposals: DataFrame, drop_small: bool, keep: float = 0.5, small: float = 0.2, image: str = "image_id", instance: str = "instance_id"
) -> DataFrame:
    """The repair of the refinement loop: flagged instances give way to the parts a segmenter proposes for them.

    ``labelled(image, instance, origin, area, scale, label)``; ``proposals(origin, part, area, scale)`` lists the parts of the mask
    ``origin``. Sizes are ``area / scale`` and are measured by the mean size of the unflagged. Parts of at least ``keep`` of it
    are taken, with new numbers after the image's last; their origin is ``<origin>.<part>``. A flagged instance goes if a part of it was taken or, with
    ``drop_small``, if it is under ``small`` of the mean. Then the numbers are closed up. Without unflagged rows nothing is taken or dropped.
    """
    mean = labelled.where("label = 0").agg(F.avg(F.col("area") / F.col("scale")).alias("_mu"))
    flagged = attach(labelled.where("label = 1"), mean, [])
    parts = proposals.select("origin", "part", F.col("area").alias("_area"), F.col("scale").alias("_scale"))
    taken = flagged.join(parts, "origin").where(F.col("_area") / F.col("_scale") >= keep * F.col("_mu"))
    taken = cut_lineage(taken.select(image, instance, "origin", "part", "_area", "_scale"))
    gone = taken.select(image, instance)
    if drop_small:
        gone = gone.unionByName(flagged.where(F.col("area") / F.col("scale") < small * F.col("_mu")).select(image, instance))
    last = labelled.groupBy(image).agg(F.max(instance).alias("_last"))
    new = attach(row_index(taken, ["origin", "part"], [image], "_rn"), last, [image]).select(
        image,
        (F.col("_last") + F.col("_rn")).cast(labelled.schema[instance].dataType).alias(instance),
        F.concat_ws(".", "origin", "part").alias("origin"),
        F.col("_area").alias("area"),
        F.col("_scale").alias("scale"),
    )
    rows = cut_lineage(labelled.select(*new.columns).unionByName(new))  # the renumbering reads it several times
    return remove_and_renumber(rows, cut_lineage(gone.distinct()), image, instance).drop(instance).withColumnRenamed("new_id", instance).select(*new.columns)


def next_free_id(df: DataFrame, image: str = "image_id", instance: str = "instance_id") -> DataFrame:
    """Smallest unused instance number of every image, from 0."""
    used = df.select(image, instance).distinct()
    open_ids = used.select(image, (F.col(instance) + 1).alias(instance)).unionByName(
        used.select(image, F.lit(0).cast(used.schema[instance].dataType).alias(instance)).distinct()
    )
    free = open_ids.join(used, [image, instance], "left_anti")
    return free.groupBy(image).agg(F.min(instance).alias("next_id"))
