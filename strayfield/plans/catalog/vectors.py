"""Queries of the vector and segmentation groups."""

import numpy as np
from pyspark.sql import functions as F

from strayfield.functions import arrays as ar
from strayfield.functions.scalar import signed_round
from strayfield.operators import segmentation as sg
from strayfield.operators import vectors as vx
from strayfield.plans.catalog.metrics import rounded
from strayfield.plans.registry import query


def rounded_list(col, digits=6):
    return F.transform(col, lambda x: signed_round(x, digits)).alias("vec")


def _each(term: str, digits: int = 6) -> str:
    return f"list_transform({{vec}}, lambda v: round({term}, {digits}))"


# --- D -------------------------------------------------------------------------------------------------


@query(
    "d1_patchify",
    """with o as (select * from (select unnest(range(3)) - 1 dy) a cross join (select unnest(range(3)) - 1 dx) b),
    g as (select image_id, y, x, vec v from grid_vec),
    t as (select distinct image_id, g.y - o.dy y, g.x - o.dx x from g cross join o
      where g.y - o.dy between 0 and 3 and g.x - o.dx between 0 and 3),
    taps as (
      select t.image_id, t.y, t.x, list(coalesce(g.v, list_transform(range(64), lambda i: 0::float)) order by o.dy, o.dx) l
      from t cross join o left join g on g.image_id = t.image_id and g.y = t.y + o.dy and g.x = t.x + o.dx group by 1, 2, 3)
    select image_id, cast(y as int) y, cast(x as int) x,
      flatten(list_transform(range(64), lambda c: list_transform(l, lambda v: round(v[c + 1]::double, 6)))) vec from taps""",
)
def _(t):
    return vx.patchify(t.grid_vec, 4, 4).select("image_id", "y", "x", rounded_list("vec"))


@query(
    "d2_resize_grid",
    """with ax as (select i t, greatest((i + 0.5) * 32 / 20 - 0.5, 0)::double src from (select unnest(range(20))::int i)),
    tap as (
      select t, floor(src)::int s, 1 - (src - floor(src)) wt from ax union all
      select t, least(floor(src)::int + 1, 31), src - floor(src) from ax)
    select image_id, r.t y, c.t x, round(sum(score * r.wt * c.wt), 4) score
    from score_px p join tap r on p.y = r.s join tap c on p.x = c.s group by 1, 2, 3""",
)
def _(t):
    px = t.score_px.select("image_id", "y", "x", "score")
    return rounded(vx.resize_grid(px, 32, 32, 20, 20), 4)


@query(
    "d2b_resize_nearest",
    """with ax as (select unnest(range(20))::int t), m as (select t, floor(t * 32 / 20)::int s from ax)
    select image_id, r.t y, c.t x, label from label_map_px p join m r on p.y = r.s join m c on p.x = c.s""",
)
def _(t):
    return vx.resize_nearest(t.label_map_px, 32, 32, 20, 20)


_POOL = (
    "list_transform(range(10), lambda i: round(list_sum(list_transform(vec[(floor(i * 64 / 10))::int + 1 : (ceil((i + 1) * 64 / 10))::int], "
    "lambda v: v::double)) / ((ceil((i + 1) * 64 / 10))::int - (floor(i * 64 / 10))::int), 6))"
)


@query("d3_adaptive_pool", f"select vec_id, {_POOL} vec from query_vec")
def _(t):
    return t.query_vec.select("vec_id", rounded_list(ar.adaptive_pool("vec", 10)))


@query(
    "d4_merge_layers",
    """select image_id, y, x, list_concat(list_transform(vec[1:24], lambda v: round(v::double, 6)),
      list_transform(vec[25:64], lambda v: round(v::double * 2, 6))) vec from grid_vec""",
)
def _(t):
    low = t.grid_vec.withColumn("vec", ar.doubles(F.slice("vec", 1, 24)))
    high = t.grid_vec.withColumn("vec", F.transform(F.slice("vec", 25, 40), lambda v: v.cast("double") * 2))
    return vx.merge_layers([low, high]).select("image_id", "y", "x", rounded_list("vec"))


@query(
    "d5_avg_pool3",
    """with o as (select * from (select unnest(range(3)) - 1 dy) a cross join (select unnest(range(3)) - 1 dx) b),
    s as (select image_id, y + dy y, x + dx x, score from score_px cross join o)
    select image_id, y::int y, x::int x, round(sum(score) / 9, 4) score from s where y between 0 and 31 and x between 0 and 31 group by 1, 2, 3""",
)
def _(t):
    return rounded(vx.avg_pool3(t.score_px, 32, 32), 4)


@query(
    "d6_l2_normalize",
    "select vec_id, list_transform(vec, lambda v: round(v::double / "
    "sqrt(list_sum(list_transform(vec, lambda u: u::double * u::double))), 6)) vec from query_vec",
)
def _(t):
    return t.query_vec.select("vec_id", rounded_list(ar.l2_normalize("vec")))


_MEAN = "select {key}, unnest(range(64)) pos, unnest(vec)::double v from query_vec"


@query(
    "d7_mean_vector",
    f"""with e as ({_MEAN.format(key='label')}), m as (select label, pos, avg(v) v from e group by 1, 2)
    select label, list(round(v, 6) order by pos) vec from m group by 1""",
)
def _(t):
    return vx.mean_vector(t.query_vec, ["label"], dims=64).select("label", rounded_list("vec"))


@query(
    "d8_concat_vectors",
    "select vec_id, list_concat(list_transform(vec, lambda v: round(v::double, 6)), [label::double, (vec_id % 7)::double]) vec from query_vec",
)
def _(t):
    extra = t.query_vec.select("vec_id", F.array(F.col("label").cast("double"), (F.col("vec_id") % 7).cast("double")).alias("vec"))
    both = vx.concat_vectors([t.query_vec.select("vec_id", ar.doubles("vec").alias("vec")), extra], ["vec_id"])
    return both.select("vec_id", rounded_list("vec"))


@query(
    "d9_bundle_mean",
    f"""with e as ({_MEAN.format(key='image_id')}), m as (select image_id, pos, avg(v) v, max(v) mx from e group by 1, 2)
    select image_id, list(round(v, 6) order by pos) vec, list(round(mx, 6) order by pos) vec_max from m group by 1""",
)
def _(t):
    mean = vx.bundle_mean(t.query_vec, ["image_id"]).select("image_id", rounded_list("vec"))
    top = vx.bundle_mean(t.query_vec, ["image_id"], mode="max", dims=64)
    return mean.join(top.select("image_id", rounded_list("vec").alias("vec_max")), "image_id")


@query(
    "d10_standardize",
    """select vec_id, list_transform(vec, lambda v, i: round((v::double - (0.4 + i / 256)::double) / (0.2 + i / 512)::double, 6)) vec,
      list_transform(vec, lambda v: round(v::double, 6)) back from query_vec""",
)
def _(t):
    mean, std = (F.array(*[F.lit(a + i / b) for i in range(1, 65)]) for a, b in ((0.4, 256), (0.2, 512)))
    z = t.query_vec.select("vec_id", ar.standardize("vec", mean, std).alias("z"))
    back = ar.destandardize("z", mean, std)  # the last bits that the way there and back loses would pull halves down
    return z.select("vec_id", rounded_list("z"), rounded_list(rounded_list(back, 14)).alias("back"))


# all 64 numbers of a vector, pooled to ten logits
_POOLED = _POOL.replace("round(", "(", 1).replace(", 6))", "))")
_LOGITS = f"select image_id, y, x, gt, list_transform({_POOLED}, lambda v: exp(v * 20)) e from prob_px"
_PROBS = f"select image_id, y, x, gt, list_transform(e, lambda v: v / list_sum(e)) p from ({_LOGITS})"


def probs(t):
    """Pixels with softmaxed probabilities ``p`` and the logits they come from."""
    logits = F.transform(ar.adaptive_pool("vec", 10), lambda v: v * 20)
    return t.prob_px.select("image_id", "y", "x", "gt", logits.alias("logits")).withColumn("p", ar.softmax("logits"))


@query(
    "d11_softmax_argmax",
    f"""select image_id, y, x, list_transform(p, lambda v: round(v, 6)) vec, (list_position(p, list_max(p)) - 1)::int label,
      round(list_max(p), 6) confidence from ({_PROBS})""",
)
def _(t):
    return probs(t).select(
        "image_id", "y", "x", rounded_list("p"), ar.argmax("p").alias("label"), F.round(F.array_max("p"), 6).alias("confidence")
    )


@query(
    "d12_rand_projection",
    """select vec_id, list_transform(range(6), lambda i: round(list_sum(list_transform(vec,
      lambda v, j: v::double * sin((i * 64 + j)::double))), 6)) projected from query_vec""",
)
def _(t):
    weights = np.sin(np.arange(1, 6 * 64 + 1, dtype=float).reshape(6, 64))
    out = vx.rand_projection(t.query_vec, weights)
    return out.select("vec_id", rounded_list("projected").alias("projected"))


_SEEDED = vx.gaussian_weights(64, 6, seed=1)
_MATRIX = ", ".join("[" + ", ".join(f"{float(w)!r}::double" for w in row) + "]" for row in np.asarray(_SEEDED).reshape(6, 64))


@query(
    "d12_rand_projection_seeded",
    f"""with w as (select [{_MATRIX}] w)
    select vec_id, list_transform(w, lambda r: round(list_sum(list_transform(list_zip(r, vec), lambda p: p[1] * p[2]::double)), 6)) projected from query_vec, w""",
)
def _(t):
    out = vx.rand_projection(t.query_vec, _SEEDED)
    return out.select("vec_id", rounded_list("projected").alias("projected"))


_DIMS = "dims as (select image_id sample_id, unnest(range(64))::int dim, unnest(vec)::double v from grid_vec)"
_RANGES = "rng as (select dim, least(999, min(v))::double lo, greatest(-999, max(v))::double hi from dims group by 1)"
_BINS = """hist as (select sample_id, d.dim, least(floor((v - lo) / (hi - lo) * 5), 4)::int bin, count(*) n
  from dims d join rng r on d.dim = r.dim group by 1, 2, 3)"""
_DENS = """summed as (select dim, bin, sum(n)::double n from hist group by 1, 2),
  dens as (select dim, bin, n / sqrt(sum(n * n) over (partition by dim)) density from summed)"""
_UNIT_ROWS = """grid as (select sample_id, dim, bin from (select distinct sample_id, dim from hist) cross join (select unnest(range(5))::int bin)),
  units as (select g.sample_id, g.dim, g.bin, coalesce(n, 0)
      / sqrt(sum(coalesce(n, 0) * coalesce(n, 0)) over (partition by g.sample_id, g.dim)) h
    from grid g left join hist s on s.sample_id = g.sample_id and s.dim = g.dim and s.bin = g.bin),
  model as (select m.dim, m.bin, coalesce(density, 0) g
    from (select dim, bin from (select distinct dim from dens) cross join (select unnest(range(5))::int bin)) m
    left join dens d on d.dim = m.dim and d.bin = m.bin)"""


def _hist(t):
    px = t.grid_vec.select(F.col("image_id").alias("sample_id"), "vec")
    return vx.dim_histogram(px, vx.dim_range(px), 5)


@query("d13_dim_range", f"with {_DIMS}, {_RANGES} select dim, round(lo, 6) lo, round(hi, 6) hi from rng")
def _(t):
    return rounded(vx.dim_range(t.grid_vec))


@query("d14_dim_histogram", f"with {_DIMS}, {_RANGES}, {_BINS} select * from hist")
def _(t):
    return _hist(t)


@query("d15_density", f"with {_DIMS}, {_RANGES}, {_BINS}, {_DENS} select dim, bin, round(density, 6) density from dens")
def _(t):
    return rounded(vx.density(_hist(t)))


@query(
    "f31_projection_score",
    f"""with {_DIMS}, {_RANGES}, {_BINS}, {_DENS}, {_UNIT_ROWS},
    sq as (select sample_id, u.dim, m.dim mdim, sum((h - g) * (h - g)) d from units u join model m
      on u.bin = m.bin and floor(u.dim / 2) = floor(m.dim / 2) group by 1, 2, 3),
    ld as (select sample_id, dim, ln(sum(exp(-0.5 * d))) - ln(2) - 2.5 * ln(2 * pi()) v from sq group by 1, 2),
    pr as (select sample_id, floor(dim / 2) proj, avg(v) s from ld group by 1, 2)
    select sample_id, round(avg(s), 6) mean, round(stddev_pop(s), 6) std, round(min(s), 6) min, round(min(s), 6) low_mean from pr group by 1""",
)
def _(t):
    hist = _hist(t)
    return rounded(vx.projection_score(hist, vx.density(hist), 5, 2))


@query(
    "f32_projection_kl",
    f"""with {_DIMS}, {_RANGES}, {_BINS}, {_DENS}, {_UNIT_ROWS},
    pr as (select sample_id, floor(u.dim / 2) proj, sum(case when g > 0 then g * (ln(g) - h) else 0 end) / 2 kl
      from units u join model m on u.dim = m.dim and u.bin = m.bin group by 1, 2)
    select sample_id, round(avg(kl), 6) kl from pr group by 1""",
)
def _(t):
    hist = _hist(t)
    return rounded(vx.projection_kl(hist, vx.density(hist), 5, 2))


@query(
    "d20_diff_map",
    """with m as (select image_id, y, x, vec[1:32] a, vec[33:64] b from grid_vec)
    select image_id, y, x, round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) / 32, 6) score from m""",
)
def _(t):
    a = t.grid_vec.withColumn("vec", F.slice("vec", 1, 32))
    b = t.grid_vec.withColumn("vec", F.slice("vec", 33, 32))
    return rounded(vx.diff_map(a, b))


_SMALL_TOP = "list_transform(list_sort(list_transform(vec, lambda v: v::double){order})[1:5], lambda v: round(v, 6))"


@query(
    "h1_topk_values",
    f"select vec_id, {_SMALL_TOP.format(order='')} low, {_SMALL_TOP.format(order=chr(44) + ' ' + chr(39) + 'desc' + chr(39))} high from query_vec",
)
def _(t):
    return t.query_vec.select(
        "vec_id", rounded_list(ar.topk_values("vec", 5)).alias("low"), rounded_list(ar.topk_values("vec", 5, smallest=False)).alias("high")
    )


# --- F: segmentation -------------------------------------------------------------------------------------

_PRED = f"select image_id, y, x, gt, (list_position(p, list_max(p)) - 1)::int pred from ({_PROBS})"
_LINE_PRED = "select l_linenumber % 5 gt, case when l_quantity > 40 then 255 else l_linenumber % 5 end truth, cast((l_linenumber + l_suppkey) % 5 as int) pred from lineitem"
_IOU = """with px as (select pred, truth gt from ({src}) where truth <> 255), k as (select unnest(range(5))::int class_id),
  c as (select class_id, (select count(*) from px where pred = class_id and gt = class_id) i,
    (select count(*) from px where pred = class_id) o, (select count(*) from px where gt = class_id) g from k)"""


@query(
    "f15_iou",
    _IOU.format(src=_LINE_PRED)
    + " select class_id, i intersection, o + g - i as \"union\", g target, round(i / (o + g - i + 1e-10), 6) iou from c",
)
def _(t):
    px = t.sql(_LINE_PRED).select("pred", F.col("truth").alias("gt"))
    return rounded(sg.iou(px, 5))


@query("f15_mean_iou", _IOU.format(src=_LINE_PRED) + " select round(avg(i / (o + g - i + 1e-10)), 6) miou from c")
def _(t):
    return rounded(sg.mean_iou(t.sql(_LINE_PRED).select("pred", F.col("truth").alias("gt")), 5))


@query(
    "f16_topk_accuracy",
    f"""with r as (select len(list_filter(p, lambda v, i: v > p[gt + 1] or (v = p[gt + 1] and i - 1 < gt))) above from ({_PROBS}))
    select round(avg(case when above < 1 then 100.0::double else 0 end), 6) top1,
      round(avg(case when above < 5 then 100.0::double else 0 end), 6) top5 from r""",
)
def _(t):
    return rounded(sg.topk_accuracy(probs(t), [1, 5], "p"))


@query(
    "f17_class_confidence",
    f"""with k as (select unnest(range(12))::int class_id), m as (select gt, avg(p[gt + 1]) c from ({_PROBS}) group by 1)
    select class_id, round(coalesce(c, 0), 6) confidence from k left join m on gt = class_id""",
)
def _(t):
    return rounded(sg.class_confidence(probs(t), 12, "p"))


@query(
    "f18_entropy_confidence",
    f"""select image_id, round(avg((1 + list_sum(list_transform(p, lambda v: v * ln(v + 1e-10))) / ln(10)) * list_max(p)), 6) confidence
    from ({_PROBS}) group by 1""",
)
def _(t):
    return rounded(sg.entropy_confidence(probs(t), probs="p"))


@query(
    "f19_class_counts",
    f"""with k as (select unnest(range(19))::int class_id), m as (select truth, count(*) n from ({_LINE_PRED}) where truth <> 255 group by 1)
    select class_id, coalesce(n, 0) n from k left join m on truth = class_id""",
)
def _(t):
    return sg.class_counts(t.sql(_LINE_PRED), 19, "truth")


@query(
    "f20_presence",
    """with k as (select unnest(range(8))::int class_id), i as (select distinct image_id from label_map_px),
    m as (select image_id, label, count(*) n from label_map_px group by 1, 2)
    select i.image_id, class_id, case when coalesce(n, 0) >= 0.08::double * 1024 then 1 else 0 end present
    from i cross join k left join m on m.image_id = i.image_id and label = class_id""",
)
def _(t):
    return sg.presence(t.label_map_px, 8, 0.08, 1024)


@query(
    "f21_hard_examples",
    f"""with v as (select image_id, y, x, gt, p[gt + 1] tp, row_number() over (order by p[gt + 1], image_id, y, x) rn, count(*) over () n from ({_PROBS}))
    select image_id, y, x, gt, round(tp, 6) true_prob from v
    where n < 100 or tp <= greatest(0.05::double, (select max(tp) from v where rn = least(100, n)))""",
)
def _(t):
    out = sg.hard_examples(probs(t), 0.05, 100, ["image_id", "y", "x"], "p")
    return rounded(out.select("image_id", "y", "x", "gt", "true_prob"))


@query(
    "f22_weighted_loss",
    """with i as (select l_orderkey, avg(l_discount) l, max(l_tax) h from lineitem group by 1) select round(avg(l * h), 8) loss from i""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_discount").alias("loss"), F.col("l_tax").alias("hardness"))
    return rounded(sg.weighted_loss(rows, ["l_orderkey"]), 8)


@query(
    "f23_seg_quality",
    f"""with px as (select image_id, gt, p, ln(list_sum(list_transform(p, lambda v: exp(v)))) - p[gt + 1] ce,
      list_sum(list_transform(p, lambda v: -v * ln(v + 1e-5))) h from ({_PROBS})),
    im as (select image_id, count(*) n, avg(ce) ce, avg(h) / 10 h, sum(p[gt + 1]) hit from px group by 1),
    ex as (select image_id, gt, unnest(range(10))::int c, unnest(p) v from px),
    cl as (select image_id, c, sum(v) p, sum(case when gt = c then 1.0::double else 0 end) t, sum(case when gt = c then v else 0 end) i from ex group by 1, 2),
    w as (select *, (1 / (t + 1e-5)) / sum(1 / (t + 1e-5)) over (partition by image_id) w,
      sqrt(sum(p * p) over (partition by image_id)) pl, sqrt(sum(t * t) over (partition by image_id)) tl from cl)
    select w.image_id, round(max(ce), 6) cross_entropy, round(sum(w * (1 - (2 * i + 1e-5) / (p + t + 1e-5 + 1e-5))) / 10, 6) balanced_dice,
      round(-ln(2 * max(hit) / (max(hit) + max(n) * 10 + 1e-6)), 6) dice_log, round(sum(abs(t - p) / n), 6) hist_l1,
      round(sum(abs(t / tl - p / pl)) / 10, 6) unit_hist_l1, round(max(h), 6) entropy
    from w join im on w.image_id = im.image_id group by 1""",
)
def _(t):
    return rounded(sg.seg_quality(probs(t), 10))


@query(
    "j22_merge_tiles",
    f"""with s as (select * from (values (0), (2)) s(t)), tl as (
      select image_id, y, x, gt, ty.t ty, tx.t tx, list_transform({_POOLED}, lambda v: exp(v * (20 + ty.t + tx.t))) e
      from prob_px join s ty on y >= ty.t and y < ty.t + 3 join s tx on x >= tx.t and x < tx.t + 3),
    ex as (select image_id, y, x, unnest(range(10))::int c, unnest(list_transform(e, lambda v: v / list_sum(e))) v from tl),
    sm as (select image_id, y, x, c, sum(v) v from ex group by 1, 2, 3, 4)
    select image_id, y, x, list(round(v, 6) order by c) vec, arg_max(c, struct_pack(v := v, c := -c))::int label from sm group by 1, 2, 3""",
)
def _(t):
    tiles = sg.tile_pixels(t.prob_px, 4, 4, 3).withColumn(
        "logits", F.transform(ar.adaptive_pool("vec", 10), lambda v: v * (20 + F.col("ty") + F.col("tx")))
    )
    return sg.merge_tiles(tiles, 10).select("image_id", "y", "x", rounded_list("probs"), "label")
