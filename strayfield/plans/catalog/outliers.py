"""Queries of the clustering, outlier and alignment group, and of named stages."""

import numpy as np
from pyspark.sql import functions as F

from strayfield.functions import arrays as ar
from strayfield.functions import scalar as sc
from strayfield.functions.scalar import signed_round
from strayfield.operators import outliers as ol
from strayfield.operators import sampling as sp
from strayfield.plans import stages as pl
from strayfield.plans.catalog.metrics import rounded
from strayfield.plans.catalog.neighbours import L2SQ, _hits_sql
from strayfield.plans.registry import query


@query(
    "g1_zscore_outliers",
    """with s as (select event_id, event_type, value, (value - avg(value) over (partition by event_type))
      / nullif(stddev_pop(value) over (partition by event_type), 0) z from events)
    select event_id, event_type, value, case when z > 2.5::double or z < -2.5::double then 1 else 0 end label from s""",
)
def _(t):
    return ol.zscore_outliers(t.events.select("event_id", "event_type", "value"), "value", 0.5, ["event_type"])


_PLANE = "select s_suppkey point_id, s_acctbal / 1000 v from supplier"
_POINTS = "select c_custkey point_id, c_acctbal / 100 px, cast(c_nationkey as double) py from customer"


@query(
    "g2_mean_shift",
    f"""with recursive p as materialized (select point_id, v + 0.0 v from ({_PLANE})),
    walk(seed, pos, n, done) as (
      select distinct v, v, 0::bigint, false from p
      union all
      select seed, pos2, n2, abs(pos2 - pos) <= 1e-3 * 1.0 from (
        select w.seed, w.pos, round(sum(p.v) / count(*), 9) pos2, count(*) n2 from walk w join p on abs(w.pos - p.v) <= 1.0 where not w.done group by 1, 2)),
    ends as (select pos centre, max(n) n from walk where done group by 1),
    ranked as (select *, row_number() over (order by n desc, centre desc) r from ends),
    kept(r, centre, n, have) as (
      select r, centre, n, [centre] from ranked where r = 1
      union all
      select r, centre, n, held from (
        select x.*, list_append(k.have, x.centre) held, row_number() over (order by x.r) first from ranked x, kept k
        where x.r > k.r and len(list_filter(k.have, lambda c: abs(c - x.centre) <= 1.0)) = 0) where first = 1),
    named as (select row_number() over (order by r) - 1 label, centre, n from kept)
    select point_id, arg_min(label, struct_pack(d := (v - centre) * (v - centre), l := label))::bigint label,
      round(arg_min(centre, struct_pack(d := (v - centre) * (v - centre), l := label)), 6) centre, arg_min(n, struct_pack(d := (v - centre) * (v - centre), l := label)) n
    from p cross join named group by 1""",
)
def _(t):
    points = t.sql(_PLANE).withColumn("vec", F.array("v"))
    labels, centres = ol.mean_shift(points, 1.0, "point_id")
    return labels.join(centres.select("label", F.round(F.get("centre", 0), 6).alias("centre"), "n"), "label")


@query(
    "g2_estimate_bandwidth",
    f"""with p as ({_PLANE}), n as (select greatest(1, floor(count(*) * 0.3::double)::int) k from p),
    d as (select a.point_id, abs(a.v - b.v) d, row_number() over (partition by a.point_id order by abs(a.v - b.v)) rn from p a cross join p b)
    select round(avg(d), 6) bandwidth from d, n where rn = k""",
)
def _(t):
    found = ol.bandwidth(t.sql(_PLANE).withColumn("vec", F.array("v")), 0.3, "point_id")
    return found.select(F.round("bandwidth", 6).alias("bandwidth"))


@query(
    "g2_estimate_bandwidth_small_blocks",
    f"""with p as ({_PLANE}), n as (select greatest(1, floor(count(*) * 0.3::double)::int) k from p),
    d as (select a.point_id, abs(a.v - b.v) d, row_number() over (partition by a.point_id order by abs(a.v - b.v)) rn from p a cross join p b)
    select round(avg(d), 6) bandwidth from d, n where rn = k""",
)
def _(t):
    """Several blocks: rounds of distance bins instead of one matrix."""
    found = ol.bandwidth(t.sql(_PLANE).withColumn("vec", F.array("v")), 0.3, "point_id", block_rows=64)
    return found.select(F.round("bandwidth", 6).alias("bandwidth"))


@query(
    "g3_dbscan",
    f"""with recursive p as ({_POINTS}),
    near as (select a.point_id a, b.point_id b from p a join p b on sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) <= 1.5),
    core as (select a id from near group by 1 having count(*) >= 6),
    links as (select a, b from near where a in (select id from core) and b in (select id from core)),
    walk as (select id, id root from core union select l.b, w.root from walk w join links l on l.a = w.id where w.root < l.b),
    roots as (select id, min(root) root from walk group by 1),
    num as (select root, row_number() over (order by root) - 1 label from (select distinct root from roots)),
    edge as (select n.a id, min(r.root) root from near n join roots r on r.id = n.b where n.a not in (select id from core) group by 1)
    select p.point_id, coalesce(num.label, -1)::bigint label, case when r.id is null then 0 else 1 end core
    from p left join roots r on r.id = p.point_id left join edge e on e.id = p.point_id left join num on num.root = coalesce(r.root, e.root)""",
)
def _(t):
    points = t.sql(_POINTS).withColumn("vec", F.array("px", "py"))
    return ol.dbscan(points, 1.5, 6, "point_id")


_LABELLED = "select l_suppkey image_id, l_orderkey instance_id, max(l_quantity) area, max(case when l_returnflag = 'R' then 1 else 0 end) label from lineitem group by 1, 2"


@query(
    "g4_refine_by_area",
    f"""with d as ({_LABELLED}), m as (select image_id, avg(area) mu from d where label = 0 group by 1)
    select d.image_id, instance_id, area, case when label = 0 and abs(area - mu) / mu > 0.2::double then 1 else label end label
    from d left join m on m.image_id = d.image_id""",
)
def _(t):
    return ol.refine_by_area(t.sql(_LABELLED), 0.2, by=["image_id"])


@query(
    "g5_refine_by_feature",
    """with c as (select list(m order by pos) c from (select pos, avg(v) m from (
      select unnest(range(64)) pos, unnest(vec)::double v from query_vec where is_anomaly = 0) group by 1)),
    s as (select vec_id, is_anomaly, list_sum(list_transform(list_zip(vec, c), lambda p: p[1]::double * p[2]::double))
      / sqrt(list_sum(list_transform(vec, lambda v: v::double * v::double))) / sqrt(list_sum(list_transform(c, lambda v: v * v))) cs from query_vec, c)
    select vec_id, case when is_anomaly = 0 and cs < 0.1::double then 1 else is_anomaly end label from s""",
)
def _(t):
    df = t.query_vec.select("vec_id", "vec", F.col("is_anomaly").alias("label"))
    return ol.refine_by_feature(df, 0.1, dims=64).select("vec_id", "label")


_DEBRIS = f"""with b as (select vec_id, vec, floor((row_number() over (order by vec_id) - 1) / 32)::bigint batch from query_vec),
  s as (select q.batch, q.vec_id, sum(sqrt({L2SQ})) s from b q join b on q.batch = b.batch group by 1, 2),
  sh as (select batch, vec_id, s / sqrt(sum(s * s) over (partition by batch)) share from s)"""


@query("g6_debris", _DEBRIS + " select batch, vec_id, round(share, 6) share, case when share > 0.18::double then 1 else 0 end debris from sh")
def _(t):
    return rounded(ol.debris(sp.batch_id(t.query_vec.select("vec_id", "vec"), 32, ["vec_id"]), 0.18))


@query("g6_drop_debris", _DEBRIS + " select vec_id from sh where not share > 0.18::double")
def _(t):
    return ol.drop_debris(sp.batch_id(t.query_vec.select("vec_id", "vec"), 32, ["vec_id"]), 0.18).select("vec_id")


def _unrolled_outliers(rounds: int) -> str:
    """The outlier loop with step 0.3, written out: round n flags |z| > 1 + 0.3 n, and the first round that flags no row
    or every row is the last."""
    z = "(area - avg(area) over ()) / nullif(stddev_pop(area) over (), 0)"
    parts = ["r1 as (select event_id, value area from events)"]
    for n in range(1, rounds + 1):
        parts.append(f"s{n} as materialized (select event_id, area, case when abs(z) > {1 + 0.3 * n:.1f}::double then 1 else 0 end f from (select *, {z} z from r{n}))")
        parts.append(f"a{n} as materialized (select coalesce(sum(f), 0) f, count(*) n from s{n})")
        parts.append(f"r{n + 1} as (select event_id, area from s{n}, a{n} where s{n}.f = 0 and a{n}.f > 0 and a{n}.f < a{n}.n)")
    ends = " union all ".join(f"select event_id, area from s{n}, a{n} where a{n}.f = 0 or a{n}.f = a{n}.n" for n in range(1, rounds + 1))
    return f"with {', '.join(parts)}, last as ({ends}) select event_id, area, case when abs({z}) > 1 then 1 else 0 end label from last"


@query("g7_iterative_outliers", _unrolled_outliers(14))
def _(t):
    return ol.iterative_outliers(t.events.select("event_id", F.col("value").alias("area")), 0.3)


_ANGLES = "select label instance_id, vec_id candidate_angle, vec, 90 angle from query_vec"


@query(
    "g8_align_angle",
    """with r as (select vec ref from query_vec order by vec_id limit 1),
    c as (select label instance_id, vec_id * 30 % 360 cand, vec_id, list_transform(vec, lambda v: exp(v::double)) e, vec, ref from query_vec, r),
    d as (select *, list_transform(e, lambda v: v / list_sum(e)) q, ln(list_sum(e)) lq,
      ln(list_sum(list_transform(ref, lambda v: exp(v::double)))) lr from c),
    k as (select instance_id, cand, list_sum(list_transform(list_zip(q, vec, ref), lambda p: p[1] * ((p[2]::double - lq) - (p[3]::double - lr)))) kl from d),
    b as (select instance_id, arg_min(cand, struct_pack(k := kl, c := cand)) best_angle from k group by 1)
    select instance_id, best_angle, (90 + best_angle) % 360 angle from b""",
)
def _(t):
    ref = t.query_vec.orderBy("vec_id").limit(1).select("vec")
    cand = t.query_vec.select(F.col("label").alias("instance_id"), (F.col("vec_id") * 30 % 360).alias("candidate_angle"), "vec", F.lit(90).alias("angle"))
    return ol.align_angle(ref, cand)


@query(
    "g9_sorted_l1",
    """select vec_id, round(list_sum(list_transform(list_zip(list_sort(list_transform(vec[1:32], lambda v: v::double)),
      list_sort(list_transform(vec[33:64], lambda v: v::double))), lambda p: abs(p[1] - p[2]))), 6) distance from query_vec""",
)
def _(t):
    return t.query_vec.select("vec_id", F.round(ar.sorted_l1(F.slice("vec", 1, 32), F.slice("vec", 33, 32)), 6).alias("distance"))


_IDS = """select l_suppkey image_id, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) - 1 as int) instance_id,
  l_returnflag flag, l_quantity area from (select l_suppkey, l_orderkey, l_linenumber, max(l_returnflag) l_returnflag, max(l_quantity) l_quantity
  from lineitem group by 1, 2, 3)"""


@query(
    "g10_remove_and_renumber",
    f"""with d as ({_IDS}), l as (select * from d where flag <> 'R'),
    n as (select image_id, count(*) n from l group by 1),
    gaps as (select image_id, s, row_number() over (partition by image_id order by s) rk from (
      select image_id, unnest(range(n))::int s from n) g where not exists (select 1 from l where l.image_id = g.image_id and l.instance_id = g.s)),
    hi as (select l.image_id, instance_id, row_number() over (partition by l.image_id order by instance_id desc) rk
      from l join n on n.image_id = l.image_id where instance_id >= n)
    select l.image_id, l.instance_id, flag, area, coalesce(gaps.s, l.instance_id)::int new_id from l
    left join hi on hi.image_id = l.image_id and hi.instance_id = l.instance_id
    left join gaps on gaps.image_id = hi.image_id and gaps.rk = hi.rk""",
)
def _(t):
    d = t.sql(_IDS)
    return ol.remove_and_renumber(d, d.where("flag = 'R'"))


@query(
    "g11_next_free_id",
    f"""with d as (select * from ({_IDS}) where flag <> 'R'),
    c as (select image_id, instance_id + 1 i from d union select image_id, 0 from d)
    select image_id, min(i) next_id from c where not exists (select 1 from d where d.image_id = c.image_id and d.instance_id = c.i) group by 1""",
)
def _(t):
    return ol.next_free_id(t.sql(_IDS).where("flag <> 'R'"))


# --- K: scalar functions ---------------------------------------------------------------------------------------


@query(
    "k_scalar_functions",
    """select event_id, strftime(ts, '%Y-%m-%d_%H_%M_%S') stamp, round(epoch_us(ts) / 1e6 - epoch_us(timestamp '2024-01-01') / 1e6, 6) since,
      round(1 / (1 + exp(-value)), 6) sigmoid, greatest(least(value, 10.0::double), 2.0::double) clipped,
      case when value = 5 then 0 else -round(sign(value - 5) * log10(abs(value - 5)), 6) end signed_log,
      lpad(cast(event_id as varchar), 8, '0') padded, event_type || '_' || user_id joined,
      cast(json_extract(props, '$.k') as bigint) k from events""",
)
def _(t):
    return t.events.select(
        "event_id",
        sc.stamp("ts").alias("stamp"),
        F.round(sc.seconds_between(F.lit("2024-01-01").cast("timestamp"), F.col("ts").cast("timestamp")), 6).alias("since"),
        F.round(sc.sigmoid("value"), 6).alias("sigmoid"),
        sc.clip("value", 2.0, 10.0).alias("clipped"),
        F.round(sc.signed_log10(F.col("value") - 5), 6).alias("signed_log"),
        sc.zero_pad("event_id", 8).alias("padded"),
        sc.join_ids(F.array("event_type", F.col("user_id").cast("string"))).alias("joined"),
        sc.json_field("props", "k").alias("k"),
    )


# --- M: named stages ----------------------------------------------------------------------------------------------


@query("m1_named_stages", _hits_sql(L2SQ, 4, "select query_id, round(avg(distance), 6) score from hits group by 1"))
def _(t):
    stages = [("sampler", pl.STAGES["identity"]()), ("scorer", pl.STAGES["knn_score"](t.bank_vec, 4))]
    return rounded(pl.run_stages(t.query_vec, stages))


@query(
    "m3_embed",
    "select vec_id, list_transform(vec, lambda v: round(v::double * 2 + 1, 6)) out from query_vec",
)
def _(t):
    out = pl.embed(t.query_vec.select("vec_id", "vec"), lambda m: m.astype(np.float64) * 2 + 1, "vec", "out")
    return out.select("vec_id", F.transform("out", lambda x: signed_round(x, 6)).alias("out"))


@query("m4_compose", "select event_id, value * 2 + 1 v from events where event_type = 'error'")
def _(t):
    steps = pl.compose(
        lambda d: d.where("event_type = 'error'"), lambda d: d.withColumn("v", F.col("value") * 2), lambda d: d.select("event_id", (F.col("v") + 1).alias("v"))
    )
    return steps(t.events)
