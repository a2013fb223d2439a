"""Nearest-neighbour search and the scores built on it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window as W, functions as F

from strayfield.operators import blocks as B, pivots as T
from strayfield.operators.ordering import attach
from strayfield.operators.selection import nearest_sums
from strayfield.session import cut_lineage

MOST_KEPT = 0.2  # share of a matrix that is looked at pair by pair
WHOLE = 0.3  # share of a block's pairs from which on all are looked at together
PAIRS = 1 << 16  # pairs of vectors held at a time
METRICS = ("l2sq", "l1", "lp", "cosine", "mahalanobis")


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _candidates(
    q: np.ndarray, b: np.ndarray, metric: str, p: float, k: int, most: np.ndarray | None = None, below: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(row of q, row of b)`` that hold each row's ``k`` nearest and their ties; none beyond ``most`` need be among them.

    L1 and Minkowski distances have no matrix product, but lower bounds that are quick (``blocks.bounds_below``): the best bounds of ``k`` parts of
    the bank name rows whose distances limit the k-th one, and only pairs with a bound within that limit stay. Rows that keep many take their whole distances.
    """

    def nearest(rows: np.ndarray) -> np.ndarray:
        d = B.distances(rows, b, metric, p)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        return d <= (kth + 1e-9 * (1.0 + np.abs(kth)))[:, None]

    tried = ((bound, bound.of(q)) for bound in (B.bounds_below(b, metric, p) if below is None else below))
    bound, limits = next(((x, m) for x, m in tried if m is not None), (None, None))
    if limits is None:
        return np.nonzero(nearest(q))
    edges = [len(b) * i // k for i in range(k + 1)]
    seeds = [limits[:, lo:hi].argmin(1) + lo for lo, hi in zip(edges, edges[1:])]
    top = np.max([B.paired(q, b[at], metric, p) for at in seeds], axis=0)
    top = top if most is None else np.fmin(top, most)
    near = ~(limits > bound.level(top)[:, None])
    crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > MOST_KEPT * len(b) + k)
    if len(crowded):
        near[crowded] = nearest(q[crowded])
    return np.nonzero(near)


def _nearest_kernel(metric: str, p: float, k: int):
    """Exact top k inside one block; visitors that name ``leaves`` need no other rows than those."""

    def top(q: pd.DataFrame, b: pd.DataFrame, rows: np.ndarray) -> pd.DataFrame:
        qm, bm, bank_ids = B.matrix(q["vec"]), B.matrix(b["vec"]), b["bank_id"].to_numpy()
        kk = min(k, len(bm))
        # the second way down knows the k-th distance of the first; its root was taken, so there is room for rounding
        most = q["bound"].to_numpy(float) ** (p if metric == "lp" else 1.0) * (1.0 + T.SLACK) if "bound" in q and metric in ("l1", "lp") else None
        step = max(1, (B.STRIP if metric == "lp" else B.TILE) // len(bm))
        below = B.bounds_below(bm, metric, p)
        found = []
        for lo in range(0, len(qm), step):
            part = qm[lo : lo + step]
            r, c = _candidates(part, bm, metric, p, kk, None if most is None else most[lo : lo + step], below)
            exact = np.concatenate([np.zeros(0)] + [B.paired(part[r[at : at + PAIRS]], bm[c[at : at + PAIRS]], metric, p) for at in range(0, len(r), PAIRS)])
            found.append(_first(pd.DataFrame({"r": rows[r + lo], "bank_id": bank_ids[c], "distance": exact}), kk))
        return pd.concat(found, ignore_index=True)

    def kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "bank_id": b["bank_id"][:0], "distance": np.zeros(0)})
        found = [top(q.iloc[rows], b.iloc[at], rows) for rows, at in _looked_at(q, b)]
        if not found:
            return kernel(q[:0], b)
        hits = found[0] if len(found) == 1 else _first(pd.concat(found, ignore_index=True), k)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[hits["r"]], "bank_id": hits["bank_id"], "distance": hits["distance"]})

    return kernel


def _first(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    return hits.sort_values(["r", "distance", "bank_id"]).groupby("r", sort=False).head(k)


def _looked_at(q: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Visitors and rows of a block that meet, by leaf; all with all where most do."""
    everyone = np.arange(len(q)), np.arange(len(b))
    if "leaves" not in q:
        yield everyone
        return
    held, home, count = np.unique(b["leaf"].to_numpy(), return_inverse=True, return_counts=True)
    wanted = np.concatenate(q["leaves"].to_numpy())
    row, leaf = np.repeat(everyone[0], q["leaves"].str.len()), np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    here = held[leaf] == wanted
    row, leaf = row[here], leaf[here]
    if count[leaf].sum() > WHOLE * len(q) * len(b):
        yield everyone
        return
    for i in np.unique(leaf):
        yield row[leaf == i], np.flatnonzero(home == i)


def _merge(partial: DataFrame, k) -> DataFrame:
    # at most k rows per visited block and query
    w = W.partitionBy("query_id").orderBy("distance", "bank_id")
    return partial.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def _sides(query: DataFrame, bank: DataFrame, query_id: str, bank_id: str, vec: str, bank_vec: str):
    return (
        query.select(F.col(query_id).alias("query_id"), F.col(vec).alias("vec")),
        bank.select(F.col(bank_id).alias("bank_id"), F.col(bank_vec).alias("vec")),
    )


def covariance(bank: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of a vector column: per-task moment matrices, summed; dims^2 numbers return."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for pdf in batches:
            if len(pdf):
                m = B.matrix(pdf["v"])
                n += len(m)
                s = m.sum(0) if s is None else s + m.sum(0)
                ss = m.T @ m if ss is None else ss + m.T @ m
        if s is not None:
            cells = np.concatenate([[float(n)], s, ss.ravel()])
            yield pd.DataFrame({"i": np.arange(len(cells)), "v": cells})

    rows = (
        bank.select(F.col(vec).alias("v"))
        .mapInPandas(moments, "i long, v double")
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .orderBy("i")
        .collect()
    )
    flat = np.array([r["v"] for r in rows])
    n = flat[0]
    d = int(round((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2))
    mean = flat[1 : 1 + d] / n
    cov = (flat[1 + d :].reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)
    return mean, cov


def linear_map(df: DataFrame, vec: str, weights: np.ndarray, out: str) -> DataFrame:
    """``weights @ vec`` per row as Arrow batches; the dims x dims matrix travels with the task."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(B.matrix(v) @ weights.T)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out, apply(F.col(vec)))


@dataclass(frozen=True)
class Index:
    """A bank that is ready to be searched: its rows in the leaves of a pivot tree, written once when there are several."""

    tree: T.Tree
    whiten: np.ndarray | None
    block_rows: int

    @property
    def piece_rows(self) -> int:
        """Rows of a block or chunk: a query is copied once for each, so beyond ``MOST_BLOCKS`` in the whole bank they grow, until they are full."""
        return max(self.block_rows, min(B.BLOCK_ROWS, self.tree.rows // B.MOST_BLOCKS))


def index_bank(
    bank: DataFrame, metric: str = "l2sq", p: float = 1.5, bank_id: str = "vec_id", vec: str = "vec", block_rows: int = B.BLOCK_ROWS
) -> Index:
    """Count, sample and place a bank once, for any number of searches."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    b, whiten = bank.select(F.col(bank_id).alias("bank_id"), F.col(vec).alias("vec")), None
    if metric == "mahalanobis":
        whiten = np.linalg.inv(np.linalg.cholesky(covariance(b, "vec")[1]))
        b, metric = linear_map(b, "vec", whiten, "vec"), "l2sq"
    return Index(T.grow(b, metric, p, block_rows), whiten, block_rows)


def _queries(query: DataFrame, index: Index, query_id: str, vec: str) -> DataFrame:
    q = query.select(F.col(query_id).alias("query_id"), F.col(vec).alias("vec"))
    return q if index.whiten is None else linear_map(q, "vec", index.whiten, "vec")


def _bounded(q: DataFrame, index: Index, k: int, packed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The nearest leaves that hold ``k`` rows of each query, and the packs (else leaves) within the distance of the last of these ``k``."""
    tree, kernel, schema = index.tree, *_leaf_search(q, index, k)
    near = cut_lineage(T.descend(q, tree, T.until(k)))
    found = _merge(B.block_join(near, tree.placed, kernel, schema, index.piece_rows, index.piece_rows), k)
    far = F.max("distance")
    bound = {"l2sq": F.sqrt(far), "cosine": F.sqrt(2 * F.greatest(far, F.lit(0.0))), "l1": far}.get(tree.metric, F.pow(far, F.lit(1.0 / tree.p)))
    bounds = cut_lineage(found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, bound).alias("bound")))
    known = q.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return near, T.descend(known.select(*q.columns, "bound"), tree, T.within(), packed)


def _leaf_search(q: DataFrame, index: Index, k: int):
    schema = f"query_id {_type(q, 'query_id')}, bank_id {_type(index.tree.placed, 'bank_id')}, distance double"
    return _nearest_kernel(index.tree.metric, index.tree.p, k), schema


def search(query: DataFrame, index: Index, k: int, query_id: str = "vec_id", vec: str = "vec") -> DataFrame:
    """Exact k nearest rows of an indexed bank per query: ``(query_id, bank_id, distance, rn)``. Query ids are unique."""
    if k < 1:
        raise ValueError("k must be at least 1")
    q, tree = _queries(query, index, query_id, vec), index.tree
    kernel, schema = _leaf_search(q, index, k)
    if tree.top is None:
        return _merge(B.block_join(T.descend(q, tree, T.until(k)), tree.placed, kernel, schema, index.piece_rows, index.piece_rows), k)
    _, wide = _bounded(q, index, k)
    return _merge(B.block_join(wide, tree.packed(), kernel, schema, index.piece_rows, index.piece_rows, few_cells=True), k)


def leaves_visited(query: DataFrame, index: Index, k: int, query_id: str = "vec_id", vec: str = "vec") -> DataFrame:
    """``(query_id, visited, leaves)``: how many leaves an exact search of each query looks at, and how many there are."""
    q, total = _queries(query, index, query_id, vec), F.lit(index.tree.leaves())
    if index.tree.top is None:
        near = T.descend(q, index.tree, T.until(k)).select("query_id", "cell")
    else:
        first, wide = _bounded(q, index, k, packed=False)
        near = first.select("query_id", "cell").unionByName(wide.select("query_id", "cell")).distinct()
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("visited")).withColumn("leaves", total)


def knn(
    query: DataFrame,
    bank: DataFrame,
    k: int,
    metric: str = "l2sq",
    p: float = 1.5,
    query_id: str = "vec_id",
    bank_id: str = "vec_id",
    vec: str = "vec",
    bank_vec: str | None = None,
    block_rows: int = B.BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest bank rows per query: ``(query_id, bank_id, distance, rn)``.

    ``l2sq`` is squared, ``lp`` has no root, ``cosine`` is 1 - dot of unit vectors, and ``mahalanobis``
    whitens both sides with the inverse Cholesky factor of the bank covariance before ``l2sq``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    return search(query, index_bank(bank, metric, p, bank_id, bank_vec or vec, block_rows), k, query_id, vec)


def knn_score(query: DataFrame, bank: DataFrame, k: int, metric: str = "l2sq", **kw) -> DataFrame:
    """Anomaly score per query: mean of its k distances."""
    return knn(query, bank, k, metric, **kw).groupBy("query_id").agg(F.avg("distance").alias("score"))


def ann(
    query: DataFrame,
    bank: DataFrame,
    k: int,
    lists: int = 512,
    probes: int = 8,
    query_id: str = "vec_id",
    bank_id: str = "vec_id",
    vec: str = "vec",
    seed: int = 0,
    block_rows: int = B.BLOCK_ROWS,
    recall: float = 0.9,
) -> DataFrame:
    """Approximate kNN with inverted lists: k-means lists, and each query searches its ``probes`` nearest ones, or as many
    more as it takes to see ``k`` rows, and to reach ``recall`` (``_probes_for``); with ``recall=0`` no more than that."""
    q, b = _sides(query, bank, query_id, bank_id, vec, vec)
    model = KMeans(k=lists, seed=seed, maxIter=10, featuresCol="f", predictionCol="cell").fit(
        b.select(array_to_vector(F.col("vec").cast("array<double>")).alias("f"))
    )
    centres = np.array(model.clusterCenters())
    bare = B.Cells(centres, np.zeros(0), np.zeros(0), "l2sq", 2.0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in bare.strips(len(pdf)):
                yield pdf.iloc[at].assign(cell=bare.to_pivots(B.matrix(pdf.iloc[at]["vec"])).argmin(1).astype(np.int64))

    schema = f"bank_id {_type(b, 'bank_id')}, vec {_type(b, 'vec')}, cell long"
    placed = cut_lineage(b.mapInPandas(assign, schema))
    count = np.zeros(len(centres))
    for r in placed.groupBy("cell").count().collect():
        count[r["cell"]] = r["count"]
    cells = B.Cells(centres, count, np.zeros(len(centres)), "l2sq", 2.0)
    if recall > 0:
        probes = max(probes, _probes_for(recall, q, placed, cells, k, block_rows))
    visits = B.visit(q, cells, B.probe_reach(probes, k))
    out = f"query_id {_type(q, 'query_id')}, bank_id {_type(b, 'bank_id')}, distance double"
    return _merge(B.block_join(visits, placed, _nearest_kernel("l2sq", 2.0, k), out, block_rows, block_rows), k)


TRIED = 512  # queries whose true neighbours are looked up
MARGIN = 0.02  # above the wanted recall, some three deviations of what so many queries measure


def _probes_for(recall: float, q: DataFrame, placed: DataFrame, cells: B.Cells, k: int, block_rows: int) -> int:
    """How many lists a query has to search for ``recall``: of ``TRIED`` queries, taken by hash, all true neighbours are found by
    brute force, and it is told how far down its query's order of lists each of them lies. One count per list returns."""
    tried = cut_lineage(q.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED))
    schema = f"query_id {_type(q, 'query_id')}, bank_id {_type(placed, 'bank_id')}, distance double"
    whole = F.lit(0).alias("cell")
    near = B.block_join(tried.select("*", whole), placed.select("bank_id", "vec", whole), _nearest_kernel("l2sq", 2.0, k), schema, block_rows, block_rows)
    homes = _merge(near, k).select("query_id", "bank_id").join(placed.select("bank_id", "cell"), "bank_id").join(tried, "query_id")

    def depth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in cells.strips(len(pdf)):
                part = pdf.iloc[at]
                d = np.where(cells.count[None, :] > 0, cells.to_pivots(B.matrix(part["vec"])), np.inf)
                own = d[np.arange(len(d)), part["cell"].to_numpy()]
                yield pd.DataFrame({"depth": (d < own[:, None]).sum(1) + 1})

    found = homes.select("vec", "cell").mapInPandas(depth, "depth long").groupBy("depth").count().orderBy("depth").collect()
    total = sum(r["count"] for r in found)
    seen = 0
    for r in found:
        seen += r["count"]
        if seen >= min(1.0, recall + MARGIN) * total:
            return r["depth"]
    return 0


def self_score(
    df: DataFrame,
    group: str,
    frac: float = 0.005,
    cap: int = 2048,
    metric: str = "l2sq",
    item: str = "vec_id",
    vec: str = "vec",
    block_rows: int = B.BLOCK_ROWS,
) -> DataFrame:
    """Zero-shot score: every group is its own bank, self match included, k = int(min(cap, frac * n)), at least 1.

    Counts and sums travel, not neighbours (``selection.nearest_sums``). Copies of a vector in a group are one point with a weight. A NULL group is a group.
    """
    rows = df.select(F.xxhash64(F.col(group).isNull(), F.col(group)).alias("cell"), F.col(group).alias("g"), F.col(item).alias("query_id"), F.col(vec).alias("vec"))
    k = rows.groupBy("cell").agg(
        F.greatest(F.lit(1), F.least(F.lit(float(cap)), F.lit(frac) * F.count(F.lit(1))).cast("int")).alias("k"), F.first("g").alias(group)
    )
    points = cut_lineage(rows.groupBy("cell", "vec").agg(F.min("query_id").alias("query_id"), F.count(F.lit(1)).alias("w")))
    known = attach(points, k.select("cell", "k"), ["cell"])
    sums = nearest_sums(known.select("cell", "query_id", "vec", "k", "w"), metric, block_rows=block_rows).select("cell", F.col("query_id").alias("_point"), "total")
    scored = points.withColumnRenamed("query_id", "_point").join(sums, ["cell", "_point"]).select("cell", "vec", "total")
    each = rows.select("cell", "query_id", "vec").join(scored, ["cell", "vec"])
    return attach(each, k, ["cell"]).select("query_id", group, "k", (F.col("total") / F.col("k")).alias("score"))


def _in_batches(df: DataFrame, batch: str, item: str, vec: str, kernel, schema: str, block_rows: int) -> DataFrame:
    """Every item against its whole batch, block by block; a NULL batch is a batch like any other."""
    cell = F.xxhash64(F.col(batch).isNull(), F.col(batch)).alias("cell")
    rows = df.select(cell, F.col(item).alias("bank_id"), F.col(vec).alias("vec"))
    visits = df.select(cell, F.col(item).alias("query_id"), F.col(batch).alias("batch"), F.col(vec).alias("vec"))
    return B.block_join(visits, rows, kernel, schema, block_rows, block_rows)


def _block_distances(q: pd.DataFrame, b: pd.DataFrame, metric: str) -> Iterator[np.ndarray]:
    """Distances of strips of visitors to the rows of a block; near zero they are computed exactly."""
    rows, m = B.matrix(q["vec"]), B.matrix(b["vec"])
    step = max(1, B.TILE // max(1, len(m)))
    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step]
        d = B.distances(part, m, "l2sq" if metric == "l2" else metric)
        r, c = np.nonzero(d <= 1e-6 * (1.0 + np.abs(d).max()))
        d[r, c] = B.paired(part[r], m[c], "l2sq" if metric == "l2" else metric)
        yield from np.sqrt(np.maximum(d, 0.0)) if metric == "l2" else d


def pairwise(
    df: DataFrame, batch: str, item: str = "vec_id", vec: str = "vec", metric: str = "l2", block_rows: int = B.BLOCK_ROWS
) -> DataFrame:
    """Distance matrix of every batch as one row per item, its distances ordered by item id.

    Blocks of a batch give parts of a row in any task; a row of the matrix is all that has to fit together.
    """

    def kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({batch: q["batch"][:0], item: q["query_id"][:0], "ids": pd.Series([], dtype=object), "d": pd.Series([], dtype=object)})
        ids = b["bank_id"].tolist()
        return pd.DataFrame({batch: q["batch"], item: q["query_id"], "ids": [ids] * len(q), "d": list(_block_distances(q, b, metric))})

    schema = f"{batch} {_type(df, batch)}, {item} {_type(df, item)}, ids array<{_type(df, item)}>, d array<double>"
    parts = _in_batches(df, batch, item, vec, kernel, schema, block_rows)
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("ids", "d"), lambda z: F.struct(z["ids"].alias("i"), z["d"].alias("d")))))
    whole = parts.groupBy(batch, item).agg(F.array_sort(pairs).alias("p"))
    return whole.select(batch, item, F.transform("p", lambda z: z["d"]).alias("distances"))


def distance_sums(
    df: DataFrame, batch: str, item: str = "vec_id", vec: str = "vec", metric: str = "l2", block_rows: int = B.BLOCK_ROWS
) -> DataFrame:
    """Sum ``s`` of every item's distances within its batch, added up block by block without a matrix."""

    def kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({batch: q["batch"][:0], item: q["query_id"][:0], "s": np.zeros(0)})
        return pd.DataFrame({batch: q["batch"], item: q["query_id"], "s": [d.sum() for d in _block_distances(q, b, metric)]})

    schema = f"{batch} {_type(df, batch)}, {item} {_type(df, item)}, s double"
    return _in_batches(df, batch, item, vec, kernel, schema, block_rows).groupBy(batch, item).agg(F.sum("s").alias("s"))


def nearest_point(a: DataFrame, b: DataFrame, a_id: str, b_id: str, coords: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Closest point of ``b`` for every point of ``a`` by Euclidean distance, lowest id on ties."""
    as_vec = F.array(*[F.col(c).cast("double") for c in coords])
    hits = knn(a.withColumn("vec", as_vec), b.withColumn("vec", as_vec), 1, query_id=a_id, bank_id=b_id)
    return hits.select("query_id", "bank_id", F.sqrt("distance").alias("distance"))


def nearest_reference(hist: DataFrame, refs: DataFrame, k: int = 5, item: str = "image_id", vec: str = "hist") -> DataFrame:
    """k nearest reference histograms: their mean (``ref_hist``) and the closest item (``ref_id``)."""
    hits = knn(hist, refs, k, query_id=item, bank_id=item, vec=vec)
    with_hist = hits.join(refs.select(F.col(item).alias("bank_id"), F.col(vec).alias("_h")), "bank_id")
    mean = (
        with_hist.select("query_id", F.posexplode("_h").alias("pos", "v"))
        .groupBy("query_id", "pos")
        .agg(F.avg("v").alias("v"))
        .groupBy("query_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("ref_hist"))
    )
    closest = hits.where("rn = 1").select("query_id", F.col("bank_id").alias("ref_id"), "distance")
    return closest.join(mean, "query_id").withColumnRenamed("query_id", item)


def vq_assign(df: DataFrame, codebook: DataFrame, item: str = "vec_id", vec: str = "vec") -> DataFrame:
    """Nearest code per vector and the quantised vector."""
    hits = knn(df, codebook, 1, query_id=item, bank_id="code", vec=vec)
    coded = hits.select(F.col("query_id").alias(item), F.col("bank_id").alias("code"), "distance")
    return coded.join(codebook.select("code", F.col(vec).alias("quantised")), "code")


def vq_stats(assigned: DataFrame, dims: int, beta: float = 0.25) -> DataFrame:
    """Usage perplexity exp(-sum p ln(p + 1e-10)) and quantisation error mean((zq - z)^2) * (1 + beta)."""
    used = assigned.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("sq"))
    all_rows = used.agg(F.sum("n").alias("total"))
    share = attach(used, all_rows, []).withColumn("p", F.col("n") / F.col("total"))
    return share.agg(
        F.exp(-F.sum(F.col("p") * F.log(F.col("p") + F.lit(1e-10)))).alias("perplexity"),
        (F.sum("sq") / (F.sum("n") * F.lit(dims)) * F.lit(1.0 + beta)).alias("error"),
    )
