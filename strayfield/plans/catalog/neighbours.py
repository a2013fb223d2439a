"""Queries of the nearest-neighbour group."""

from pyspark.sql import functions as F

from strayfield.operators import neighbours as nn
from strayfield.plans.registry import query

# the check SQL may compare every pair: it runs on small tables in one process
_PAIRS = """
pairs as (
  select q.vec_id query_id, b.vec_id bank_id, {distance} distance
  from query_vec q cross join bank_vec b),
hits as (
  select *, row_number() over (partition by query_id order by distance, bank_id) rn from pairs
  qualify rn <= {k})"""

_DIFF = "list_sum(list_transform(list_zip(q.vec, b.vec), lambda p: {term}))"
L2SQ = _DIFF.format(term="(p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)")
L1 = _DIFF.format(term="abs(p[1]::double - p[2]::double)")
LP = _DIFF.format(term="power(abs(p[1]::double - p[2]::double), 1.5)")
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
COS = (
    f"1 - {_DOT.format(a='q.vec', b='b.vec')} / (sqrt({_DOT.format(a='q.vec', b='q.vec')}) * "
    f"sqrt({_DOT.format(a='b.vec', b='b.vec')}))"
)


def _hits_sql(distance: str, k: int, tail: str) -> str:
    return "with " + _PAIRS.format(distance=distance, k=k) + " " + tail


_LIST = "select query_id, bank_id, round(distance, 6) distance, rn from hits"


SMALL_BLOCK = 48  # several cells, blocks and chunks on any of the given tables


def _register(name: str, metric: str, distance: str, k: int) -> None:
    def build(t, block_rows: int):
        hits = nn.knn(t.query_vec, t.bank_vec, k, metric, block_rows=block_rows)
        return hits.select("query_id", "bank_id", F.round("distance", 6).alias("distance"), F.col("rn").cast("long").alias("rn"))

    query(name, _hits_sql(distance, k, _LIST))(lambda t: build(t, nn.B.BLOCK_ROWS))
    query(f"{name}_small_blocks", _hits_sql(distance, k, _LIST))(lambda t: build(t, SMALL_BLOCK))


_register("e1_knn_l2", "l2sq", L2SQ, 4)
_register("e2_knn_l1", "l1", L1, 4)
_register("e3_knn_minkowski", "lp", LP, 4)
_register("e4_knn_cosine", "cosine", COS, 4)


@query("e5_knn_mahalanobis")
def _(t):
    return nn.knn(t.query_vec, t.bank_vec, 4, "mahalanobis").withColumn("distance", F.round("distance", 6))


_PLANE = "select l_suppkey image_id, avg(l_quantity) x, avg(l_extendedprice) / 1000 y from lineitem group by 1"


@query(
    "e5_knn_mahalanobis_plane",
    f"""with plane as ({_PLANE}),
    c as (select covar_samp(x, x) xx, covar_samp(x, y) xy, covar_samp(y, y) yy from plane),
    pairs as (
      select a.image_id query_id, b.image_id bank_id,
        ((a.x - b.x) * (a.x - b.x) * yy - 2 * (a.x - b.x) * (a.y - b.y) * xy + (a.y - b.y) * (a.y - b.y) * xx)
          / (xx * yy - xy * xy) distance
      from plane a cross join plane b cross join c),
    hits as (select *, row_number() over (partition by query_id order by distance, bank_id) rn from pairs qualify rn <= 3)
    select query_id, round(sum(distance), 5) distance_sum from hits group by 1""",
)
def _(t):
    plane = t.sql(_PLANE).withColumn("vec", F.array("x", "y"))
    hits = nn.knn(plane, plane, 3, "mahalanobis", query_id="image_id", bank_id="image_id")
    return hits.groupBy("query_id").agg(F.round(F.sum("distance"), 5).alias("distance_sum"))


_CLUSTERED = "select vec_id, transform(embedding, (x, i) -> x * 0.2D + if(i = label * 6, 3D, 0D)) vec from embeddings"


@query("e1_knn_leaves", "select count(*) queries, true pruned from embeddings")
def _(t):
    """The vectors drawn to a centre for each label, in 64 dimensions: an exact search of every one of them looks at under a
    third of all leaves, on average."""
    clustered = t.sql(_CLUSTERED)
    seen = nn.leaves_visited(clustered, nn.index_bank(clustered, block_rows=SMALL_BLOCK // 4), 4)
    return seen.agg(F.count(F.lit(1)).alias("queries"), (F.sum("visited") * 3 < F.sum("leaves")).alias("pruned"))


@query("e6_ann_recall", "select count(*) queries, true all_complete, true recall_reached from query_vec")
def _(t):
    """Every query gets its k rows, and at least nine tenths of all true neighbours are found."""
    k = 4
    truth = nn.knn(t.query_vec, t.bank_vec, k).select("query_id", "bank_id", F.lit(1).alias("hit"))
    found = nn.ann(t.query_vec, t.bank_vec, k, lists=16, probes=8).select("query_id", "bank_id").join(truth, ["query_id", "bank_id"], "left")
    per_query = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return per_query.agg(F.count(F.lit(1)).alias("queries"), (F.min("n") == k).alias("all_complete"), (F.sum("hits") >= 0.9 * k * F.count(F.lit(1))).alias("recall_reached"))


@query("e6_ann_inverted_lists")
def _(t):
    hits = nn.ann(t.query_vec, t.bank_vec, 4, lists=16, probes=8)
    return hits.withColumn("distance", F.round("distance", 6))


@query("e7_knn_score", _hits_sql(L2SQ, 4, "select query_id, round(avg(distance), 6) score from hits group by 1"))
def _(t):
    return nn.knn_score(t.query_vec, t.bank_vec, 4).withColumn("score", F.round("score", 6))


_SELF_SCORE = (
    """with sized as (select source g, doc_id, cast(n_chars as double) n, cast(length(lang) as double) m from documents),
    ks as (select g, greatest(1, cast(floor(least(2048.0, 0.05 * count(*))) as int)) k from sized group by 1),
    pairs as (
      select a.g, a.doc_id query_id, b.doc_id bank_id, (a.n - b.n) * (a.n - b.n) + (a.m - b.m) * (a.m - b.m) distance
      from sized a join sized b on a.g = b.g),
    hits as (select *, row_number() over (partition by query_id order by distance, bank_id) rn from pairs)
    select h.g source, query_id, k, round(avg(distance), 4) score
    from hits h join ks on h.g = ks.g where rn <= k group by 1, 2, 3"""
)


def _self_scores(t, block_rows: int):
    docs = t.documents.select("source", "doc_id", F.array(F.col("n_chars").cast("double"), F.length("lang").cast("double")).alias("vec"))
    return nn.self_score(docs, "source", frac=0.05, item="doc_id", block_rows=block_rows).withColumn("score", F.round("score", 4))


@query("e8_self_score", _SELF_SCORE)
def _(t):
    return _self_scores(t, nn.B.BLOCK_ROWS)


@query("e8_self_score_small_blocks", _SELF_SCORE)
def _(t):
    """Several blocks in each source: rounds of distance bins instead of one matrix."""
    return _self_scores(t, SMALL_BLOCK)


@query(
    "e9_pairwise",
    f"""with d as (
      select q.image_id, q.vec_id, b.vec_id other, sqrt({L2SQ}) distance
      from query_vec q join query_vec b on q.image_id = b.image_id)
    select image_id, vec_id, round(list_sum(list(distance order by other)), 5) row_sum,
      round(list_max(list(distance)), 5) row_max, count(*) n from d group by 1, 2""",
)
def _(t):
    rows = nn.pairwise(t.query_vec, "image_id")
    return rows.select(
        "image_id",
        "vec_id",
        F.round(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x), 5).alias("row_sum"),
        F.round(F.array_max("distances"), 5).alias("row_max"),
        F.size("distances").cast("long").alias("n"),
    )


_NATION_PTS = "select s_suppkey point_id, cast(s_nationkey as double) x, s_acctbal / 100 y from supplier"
_CUSTOMER_PTS = "select c_custkey point_id, cast(c_nationkey as double) x, c_acctbal / 100 y from customer"


@query(
    "e13_nearest_point",
    f"""with a as ({_CUSTOMER_PTS}), b as ({_NATION_PTS}),
    pairs as (select a.point_id query_id, b.point_id bank_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) d
      from a cross join b)
    select query_id, arg_min(bank_id, struct_pack(d := d, i := bank_id)) bank_id, round(sqrt(min(d)), 5) distance
    from pairs group by 1""",
)
def _(t):
    hits = nn.nearest_point(t.sql(_CUSTOMER_PTS), t.sql(_NATION_PTS), "point_id", "point_id")
    return hits.withColumn("distance", F.round("distance", 5))


LINES = range(1, 8)  # all line numbers
_HIST = "select l_suppkey image_id, array({}) hist from lineitem group by 1".format(", ".join(f"sum(case when l_linenumber = {i} then 1 else 0 end)" for i in LINES))


@query(
    "e14_nearest_reference",
    f"""with h as (
      select l_suppkey image_id, {", ".join(f"sum(case when l_linenumber = {i} then 1 else 0 end)::double n{i}" for i in LINES)} from lineitem group by 1),
    pairs as (
      select q.image_id, r.image_id ref_id, {", ".join(f"r.n{i}" for i in LINES)}, {" + ".join(f"(q.n{i} - r.n{i}) * (q.n{i} - r.n{i})" for i in LINES)} distance
      from h q cross join h r),
    hits as (select *, row_number() over (partition by image_id order by distance, ref_id) rn from pairs qualify rn <= 5)
    select image_id, max(case when rn = 1 then ref_id end) ref_id, min(distance) distance, {", ".join(f"round(avg(n{i}), 6) h{i}" for i in LINES)}
    from hits group by 1""",
)
def _(t):
    hist = t.sql(_HIST)
    out = nn.nearest_reference(hist, hist, 5)
    return out.select("image_id", "ref_id", "distance", *[F.round(F.get("ref_hist", i - 1), 6).alias(f"h{i}") for i in LINES])


_CODES = "select label code, embedding vec from embeddings where vec_id in (select min(vec_id) from embeddings group by label)"


@query(
    "d18_vq_assign",
    f"""with codes as ({_CODES}),
    pairs as (select q.vec_id, b.code, {L2SQ} distance from query_vec q cross join codes b)
    select vec_id, arg_min(code, struct_pack(d := distance, c := code)) code, round(min(distance), 6) distance
    from pairs group by 1""",
)
def _(t):
    out = nn.vq_assign(t.query_vec, t.sql(_CODES))
    return out.select("vec_id", "code", F.round("distance", 6).alias("distance"))


@query(
    "d18_vq_stats",
    f"""with codes as ({_CODES}),
    pairs as (select q.vec_id, b.code, {L2SQ} distance from query_vec q cross join codes b),
    used as (select vec_id, arg_min(code, struct_pack(d := distance, c := code)) code, min(distance) distance from pairs group by 1),
    share as (select code, count(*) / sum(count(*)) over () p, sum(distance) sq, count(*) n from used group by 1)
    select round(exp(-sum(p * ln(p + 1e-10))), 6) perplexity, round(sum(sq) / (sum(n) * 64) * 1.25, 6) error from share""",
)
def _(t):
    out = nn.vq_stats(nn.vq_assign(t.query_vec, t.sql(_CODES)), dims=64, beta=0.25)
    return out.select(F.round("perplexity", 6).alias("perplexity"), F.round("error", 6).alias("error"))
