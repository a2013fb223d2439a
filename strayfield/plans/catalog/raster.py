"""Queries of the raster, mask and score-map groups."""

from pyspark.sql import functions as F

from strayfield.operators import filters as fl
from strayfield.operators import metrics as m
from strayfield.operators import raster as rs
from strayfield.operators import scoremaps as sm
from strayfield.operators import shapes as sh
from strayfield.plans.catalog.metrics import rounded
from strayfield.plans.registry import query
from strayfield.session import cut_lineage
from strayfield.sources.tables import SIDE

S = SIDE

# --- overlaps ---------------------------------------------------------------------------------------------

_FG = """ov as (
  select m.image_id, m.mask_id, count(*) area, count(f.y) overlap
  from mask_px m left join fg_px f on m.image_id = f.image_id and m.y = f.y and m.x = f.x group by 1, 2),
  fa as (select image_id, count(*) fg_area from fg_px group by 1),
  rt as (select ov.image_id, mask_id, area, overlap, overlap / area own, overlap / coalesce(fg_area, 1) fg,
    overlap / least(area, coalesce(fg_area, 1)) mn from ov left join fa on ov.image_id = fa.image_id)"""

_PAIRS = """ar as (select image_id, mask_id, count(*) area from mask_px group by 1, 2),
  pr as (select a.image_id, a.mask_id i, b.mask_id j, count(*) overlap from mask_px a join mask_px b
    on a.image_id = b.image_id and a.y = b.y and a.x = b.x and a.mask_id < b.mask_id group by 1, 2, 3),
  rp as (select pr.image_id, i, j, overlap / x.area of_i, overlap / z.area of_j, overlap / least(x.area, z.area) of_min
    from pr join ar x on x.image_id = pr.image_id and x.mask_id = i join ar z on z.image_id = pr.image_id and z.mask_id = j)"""


@query("b12_filter_overlap", f"with {_FG} select m.* from mask_px m join rt on m.image_id = rt.image_id and m.mask_id = rt.mask_id where own > 0.6")
def _(t):
    return fl.filter_overlap(t.mask_px, t.fg_px, 0.6)


@query("e10_overlap_foreground", f"with {_FG} select image_id, mask_id, area, overlap, round(mn, 6) ratio from rt")
def _(t):
    return rounded(rs.foreground_overlap(t.mask_px, t.fg_px, "min"))


@query("e10_overlap_pairs", f"with {_PAIRS} select image_id, i, j, round(of_i, 6) of_i, round(of_j, 6) of_j, round(of_min, 6) of_min from rp")
def _(t):
    return rounded(rs.overlap_ratios(t.mask_px))


@query(
    "e11_with_truth",
    """select s.image_id, s.y, s.x, score, case when f.y is null then 0 else 1 end gt
    from score_px s left join fg_px f on s.image_id = f.image_id and s.y = f.y and s.x = f.x""",
)
def _(t):
    return rs.with_truth(t.score_px.select("image_id", "y", "x", "score"), t.fg_px)


_POS = "select l_orderkey image_id, l_suppkey instance_id, max(l_discount) cx, case when max(l_tax) > 0.04 then max(l_quantity) end angle from lineitem group by 1, 2"


@query(
    "e12_with_position",
    f"""with p as ({_POS}) select l_orderkey image_id, l_suppkey instance_id, l_extendedprice score, cx, coalesce(angle, 0) angle
    from lineitem join p on p.image_id = l_orderkey and p.instance_id = l_suppkey""",
)
def _(t):
    scored = t.sql("select l_orderkey image_id, l_suppkey instance_id, l_extendedprice score from lineitem")
    return rs.with_position(scored, t.sql(_POS))


_BOXES = "select s_suppkey image_id, case when s_suppkey > 1 then s_suppkey - 1 else 1 end source_id, 4 y0, cast(s_nationkey as int) x0, 20 y1, cast(s_nationkey + 8 as int) x1 from supplier"


@query(
    "e16_paste_box",
    f"""with b as ({_BOXES})
    select p.image_id, p.y, p.x, p.label from label_map_px p left join b on p.image_id = b.image_id
      where not (p.y >= y0 and p.y < y1 and p.x >= x0 and p.x < x1)
    union all select b.image_id, p.y, p.x, p.label from label_map_px p join b on p.image_id = b.source_id
      where p.y >= y0 and p.y < y1 and p.x >= x0 and p.x < x1""",
)
def _(t):
    return rs.paste_box(t.label_map_px, t.label_map_px, t.sql(_BOXES))


@query(
    "e16_copy_paste",
    f"""with b as (select image_id, source_id from ({_BOXES})),
    o as (select b.image_id, p.y, p.x, p.label from label_map_px p join b on p.image_id = b.source_id where label in (2, 5))
    select image_id, y, x, label from o union all
    select p.* from label_map_px p where not exists (select 1 from o where o.image_id = p.image_id and o.y = p.y and o.x = p.x)""",
)
def _(t):
    pairs = t.sql(_BOXES).select("image_id", "source_id")
    return rs.copy_paste(t.label_map_px, t.label_map_px, pairs, [2, 5])


# --- morphology ---------------------------------------------------------------------------------------------

_OFF = "o as (select * from (select unnest(range(3))::int - 1 dy) a cross join (select unnest(range(3))::int - 1 dx) b)"
_IN = "y between 0 and 31 and x between 0 and 31"
_DIL = """dil as (select distinct * from (select image_id, y + dy y, x + dx x from fg_px cross join o) where y between 0 and 31 and x between 0 and 31)"""


def _erode(src: str, name: str) -> str:
    return f"""{name} as (
      select image_id, y, x from (select image_id, y + dy y, x + dx x from {src} cross join o) where {_IN}
      group by 1, 2, 3 having count(*) = (least(y + 1, 31) - greatest(y - 1, 0) + 1) * (least(x + 1, 31) - greatest(x - 1, 0) + 1))"""


@query("j2_dilate", f"with {_OFF}, {_DIL} select * from dil")
def _(t):
    return rs.dilate(t.fg_px, 3, S, S)


@query("j2_erode", f"with {_OFF}, {_erode('fg_px', 'ero')} select * from ero")
def _(t):
    return rs.erode(t.fg_px, 3, S, S)


@query("j3_closing", f"with {_OFF}, {_DIL}, {_erode('dil', 'ero')} select * from ero")
def _(t):
    return rs.closing(t.fg_px, 3, S, S)


@query(
    "j3_opening",
    f"with {_OFF}, {_erode('label_map_px', 'ero')} select distinct * from (select image_id, y + dy y, x + dx x from ero cross join o) where {_IN}",
)
def _(t):
    return rs.opening(t.label_map_px, 3, S, S)


_GRID = "grid as (select i.image_id, y, x from (select distinct image_id from {src}) i cross join (select unnest(range(32))::int y) cross join (select unnest(range(32))::int x))"


@query(
    "j1_orient_mask",
    f"""with sh as (select image_id, count(*) / 1024 share from label_map_px group by 1), {_GRID.format(src='label_map_px')}
    select g.image_id, g.y, g.x from grid g join sh on g.image_id = sh.image_id
      left join label_map_px p on p.image_id = g.image_id and p.y = g.y and p.x = g.x
    where (share > 0.5 and p.label is null) or (share <= 0.5 and p.label is not null)""",
)
def _(t):
    return rs.orient_mask(t.label_map_px, S, S)


@query(
    "j1_orient_background",
    f"""with sh as (select image_id, count(*) / 1024 share from label_map_px group by 1), {_GRID.format(src='label_map_px')}
    select g.image_id, g.y, g.x from grid g join sh on g.image_id = sh.image_id
      left join label_map_px p on p.image_id = g.image_id and p.y = g.y and p.x = g.x
    where (share < 0.5 and p.label is null) or (share >= 0.5 and p.label is not null)""",
)
def _(t):
    return rs.orient_mask(t.label_map_px, S, S, background=True)


@query("j4_clear_border", "select * from mask_px where y between 2 and 29 and x between 2 and 29")
def _(t):
    return rs.clear_border(t.mask_px, S, S, 0.0625)


@query(
    "j31_outline",
    """select p.* from fg_px p where (select count(*) from fg_px n where n.image_id = p.image_id
      and abs(n.y - p.y) + abs(n.x - p.x) = 1) < 4""",
)
def _(t):
    return rs.outline(t.fg_px)


# --- runs and components ------------------------------------------------------------------------------------


def _runs(src: str, name: str = "runs") -> str:
    return f"""{name} as (
      select image_id, y, min(x) x0, max(x) x1, image_id * 1024 + y * 32 + min(x) id
      from (select image_id, y, x, x - row_number() over (partition by image_id, y order by x) g from {src}) group by image_id, y, g)"""


def _comp(src: str, slack: int, name: str = "comp") -> str:
    return f"""{_runs(src, name + '_runs')},
    {name}_walk as (
      select id, id root from {name}_runs
      union
      select b.id, w.root from {name}_walk w join {name}_runs a on a.id = w.id
        join {name}_runs b on b.image_id = a.image_id and abs(b.y - a.y) = 1 and b.x0 <= a.x1 + {slack} and b.x1 >= a.x0 - {slack}
      where w.root < b.id),
    {name} as (select r.*, m.root, m.root % 1024 component from {name}_runs r
      join (select id, min(root) root from {name}_walk group by 1) m on m.id = r.id)"""


@query("j11_to_runs", f"with {_runs('fg_px')} select image_id, y, x0, x1 from runs")
def _(t):
    return rs.to_runs(t.fg_px)


@query("j11_from_runs", "select * from fg_px")
def _(t):
    return rs.from_runs(rs.to_runs(t.fg_px))


@query("j10_components", f"with recursive {_comp('fg_px', 0)} select image_id, y, x0, x1, component from comp")
def _(t):
    return rs.components(t.fg_px, S, S, 4)


@query(
    "j10_component_stats",
    f"""with recursive {_comp('fg_px', 1)} select image_id, component, sum(x1 - x0 + 1)::bigint area, min(y) y0, min(x0) x0, max(y) y1, max(x1) x1
    from comp group by 1, 2""",
)
def _(t):
    return rs.component_stats(rs.components(t.fg_px, S, S, 8))


@query(
    "j10_components_tiled",
    f"with recursive {_comp('fg_px', 1)} select image_id, component, sum(x1 - x0 + 1)::bigint area from comp group by 1, 2",
)
def _(t):
    stats = rs.component_stats(rs.components(t.fg_px, S, S, 8, tile=16))
    return stats.select("image_id", "component", "area")


@query(
    "j5_fill_holes",
    f"""with recursive {_GRID.format(src='label_map_px')},
    back as (select image_id, y, x from grid except select image_id, y, x from label_map_px), {_comp('back', 0)},
    hole as (select root from comp group by 1 having min(y) > 0 and max(y) < 31 and min(x0) > 0 and max(x1) < 31)
    select image_id, y, x from label_map_px union all
    select image_id, y, unnest(range(x0, x1 + 1))::int from comp where root in (select root from hole)""",
)
def _(t):
    return rs.fill_holes(t.label_map_px, S, S)


@query(
    "j6_remove_noise",
    f"""with recursive {_comp('fg_px', 1)},
    ar as (select image_id, root, sum(x1 - x0 + 1) area from comp group by 1, 2),
    kp as (select root from (select *, sum(area) over (partition by image_id) total from ar) where area >= total * 0.01)
    select image_id, y, unnest(range(x0, x1 + 1))::int x from comp where root in (select root from kp)""",
)
def _(t):
    return rs.remove_noise(t.fg_px, S, S)


# --- masks ----------------------------------------------------------------------------------------------------


@query("j7_fuse_masks")
def _(t):
    return rs.fuse_masks(t.mask_px, t.fg_px, S, S, t=0.95)


@query(
    "j8_dedupe_masks",
    f"""with {_PAIRS}, lo as (select distinct image_id, case when of_i > 0.21 and of_j > 0.15 then j
      when of_i <= 0.21 and of_j > 0.21 and of_i > 0.15 then i end mask_id from rp)
    select m.* from mask_px m where not exists (select 1 from lo where lo.image_id = m.image_id and lo.mask_id = m.mask_id)""",
)
def _(t):
    return rs.dedupe_masks(t.mask_px, 0.21, 0.15)


@query(
    "j9_drop_whole_masks",
    f"""with {_FG} select image_id, mask_id, area, row_number() over (partition by image_id order by area desc, mask_id) rank
    from rt where fg <= 0.17""",
)
def _(t):
    return rs.drop_whole_masks(t.mask_px, t.fg_px, 0.17)


@query(
    "j12_split_labels",
    "select image_id, y, x, label mask_id from (select *, count(*) over (partition by image_id, label) n from label_map_px) where n > 60",
)
def _(t):
    return rs.split_labels(t.label_map_px, 60)


@query(
    "j12_merge_masks",
    """with ar as (select image_id, mask_id, count(*) area, row_number() over (partition by image_id order by mask_id) label
      from mask_px group by 1, 2)
    select m.image_id, y, x, arg_min(label, struct_pack(a := area, b := -label))::int label
    from mask_px m join ar on ar.image_id = m.image_id and ar.mask_id = m.mask_id group by 1, 2, 3""",
)
def _(t):
    return rs.merge_masks(t.mask_px)


@query(
    "j13_apply_mask",
    """select s.image_id, s.y, s.x, case when f.y is null then 7.0::double else score end score
    from score_px s left join fg_px f on s.image_id = f.image_id and s.y = f.y and s.x = f.x""",
)
def _(t):
    return rs.apply_mask(t.score_px, t.fg_px, ["score"], [7.0])


_COLORS = "select l_orderkey image_id, cast(l_quantity as int) - 1 r, cast(l_linenumber as int) - 1 g, cast(l_suppkey as int) - 1 b from lineitem"


@query("f29_mean_color", f"select floor(avg(r))::int r, floor(avg(g))::int g, floor(avg(b))::int b from ({_COLORS}) where r <> 0 or g <> 0 or b <> 0")
def _(t):
    return rs.mean_color(t.sql(_COLORS), ["r", "g", "b"])


_SCALES = "select l_suppkey image_id, l_linenumber instance_id, 1 + max(l_tax) + l_linenumber / 10.0 scale from lineitem group by 1, 2"


@query(
    "f28_instance_area",
    """with s as (select l_suppkey image_id, l_linenumber instance_id, (1 + max(l_tax) + l_linenumber / 10.0::double)::double scale from lineitem group by 1, 2),
    a as (select m.image_id, m.mask_id instance_id, count(*) area, count(*) / max(scale) sa from mask_px m
      join s on s.image_id = m.image_id and s.instance_id = m.mask_id group by 1, 2)
    select image_id, instance_id, area, round(sa, 6) scaled_area, round((sa - min(sa) over ()) / (max(sa) over () - min(sa) over ()), 6) norm_area,
      round(avg(sa) over (), 6) mean_area from a""",
)
def _(t):
    pos = t.lineitem.groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("instance_id")).agg(
        (1 + F.max("l_tax") + F.first("l_linenumber") / 10.0).alias("scale")
    )
    return rounded(rs.instance_area(t.mask_px.withColumnRenamed("mask_id", "instance_id"), pos))


_CANVAS = "select s_suppkey image_id, cast(40 + s_nationkey as int) h, cast(50 + s_nationkey * 2 as int) w from supplier"


@query(
    "j21_tile_windows",
    f"""with c as (select *, floor(h * 0.6::double)::int size from ({_CANVAS})), st as (select *, size // 10 step from c),
    n as (select *, greatest(0, ceil((h - size) / step)::int) nr, greatest(0, ceil((w - size) / step)::int) nc from st),
    r as (select *, unnest(range(nr))::int r from n), cc as (select *, unnest(range(nc + 1))::int c from r)
    select image_id, r * (nc + 1) + c window_id, r * step y, case when c < nc then c * step else w - size end x, size from cc
    union all select image_id, nr * (nc + 1), h - size, w - size, size from n""",
)
def _(t):
    return rs.tile_windows(t.sql(_CANVAS), 0.6)


# --- per-region overlap ------------------------------------------------------------------------------------------

_FULL = f"""{_GRID.format(src='score_px')},
  full_px as (select g.image_id, g.y, g.x, coalesce(score, 0) score, coalesce(gt, 0) gt
    from grid g left join score_px s on s.image_id = g.image_id and s.y = g.y and s.x = g.x)"""
_PRO = f"""with recursive {_FULL}, pos_px as (select image_id, y, x from full_px where gt = 1), {_comp('pos_px', 1)},
  sp as (select min(score) lo, max(score) hi from full_px),
  o as (select * from (select unnest(range(5))::int - 2 dy) a cross join (select unnest(range(5))::int - 2 dx) b),
  grown as (select image_id, y + dy y, x + dx x, max(score) score from full_px cross join o group by 1, 2, 3),
  ar as (select root, sum(x1 - x0 + 1) area from comp group by 1),
  cp as (select image_id, y, unnest(range(x0, x1 + 1)) x, root from comp),
  hb as (select least(200, ceil((score - lo) / ((hi - lo) / 200)))::int b, sum(1 / area) share
    from cp join ar on ar.root = cp.root join grown g on g.image_id = cp.image_id and g.y = cp.y and g.x = cp.x, sp group by 1),
  cb as (select least(200, ceil((score - lo) / ((hi - lo) / 200)))::int b, count(*) fp from full_px, sp where gt = 0 group by 1),
  th as (select unnest(range(200))::int i),
  cv as (select i, (select coalesce(sum(share), 0) from hb where b > i) / (select count(*) from ar) pro,
    (select coalesce(sum(fp), 0) from cb where b > i) / (select sum(fp) from cb) fpr from th)"""


@query("f13_pro_curve", _PRO + " select round(lo + i * ((hi - lo) / 200), 4) threshold, round(pro, 6) pro, round(fpr, 6) fpr from cv, sp")
def _(t):
    full = sm.dense(t.score_px, S, S, ["score", "gt"])
    out = rs.pro_curve(full, S, S)
    return out.select(F.round("threshold", 4).alias("threshold"), F.round("pro", 6).alias("pro"), F.round("fpr", 6).alias("fpr"))


@query(
    "f13_pro_score",
    _PRO
    + """, kp as (select i, pro, fpr / max(fpr) over () fpr from cv where fpr < 0.3::double)
    select round(sum((fpr - f0) * (pro + p0) / 2), 6) pro_auc
    from (select *, lag(fpr) over (order by i desc) f0, lag(pro) over (order by i desc) p0 from kp)""",
)
def _(t):
    return rounded(rs.pro_score(sm.dense(t.score_px, S, S, ["score", "gt"]), S, S))


# --- histograms and score maps -----------------------------------------------------------------------------------


def _hist_sql(frac: str = "") -> str:
    return "[" + ", ".join(f"count(*) filter (label = {c})::double{frac}" for c in range(1, 6)) + "]"


def _quad_sql() -> str:
    cells = []
    for ys in ("y < 16", "y >= 16"):
        for xs in ("x < 16", "x >= 16"):
            cells += [f"count(*) filter (label = {c} and {ys} and {xs})::double" for c in range(1, 6)]
    return "[" + ", ".join(cells) + "]"


@query("f24_label_histogram", f"select image_id, {_hist_sql()} hist, {_hist_sql(' / 1024')} share from label_map_px group by 1")
def _(t):
    counts = sm.label_histogram(t.label_map_px, 5)
    share = sm.label_histogram(t.label_map_px, 5, frac=True, size=S * S).withColumnRenamed("hist", "share")
    return counts.join(share, "image_id")


@query("f25_quadrant_histogram", f"select image_id, {_quad_sql()} hist from label_map_px group by 1")
def _(t):
    return sm.quadrant_histogram(t.label_map_px, 5, S, S)


@query(
    "f26_histogram_distance_one",
    """with h as (select image_id, count(*) filter (label = 1)::double v from label_map_px group by 1)
    select image_id, round(abs(v - avg(v) over ()), 6) distance from h""",
)
def _(t):
    hist = sm.label_histogram(t.label_map_px, 1)
    return rounded(sm.histogram_distance(hist, hist, 1))


@query(
    "f26_histogram_distance",
    """with h as (select image_id, count(*) filter (label = 1)::double a, count(*) filter (label = 2)::double b from label_map_px group by 1),
    c as (select avg(a) ma, avg(b) mb, covar_samp(a, a) aa, covar_samp(a, b) ab, covar_samp(b, b) bb from h)
    select image_id, round(sqrt(((a - ma) * (a - ma) * bb - 2 * (a - ma) * (b - mb) * ab + (b - mb) * (b - mb) * aa) / (aa * bb - ab * ab)), 5) distance
    from h, c""",
)
def _(t):
    hist = sm.label_histogram(t.label_map_px, 2)
    return rounded(sm.histogram_distance(hist, hist, 2), 5)


# reference histogram of an image: mean of its 3 nearest images, and the closest other labels come from ref_id
_NORMAL = f"""h as (select image_id, {_hist_sql()} hist, {_quad_sql()} quad from component_px group by 1),
  pr as (select a.image_id, b.image_id ref_id, b.hist, b.quad,
    list_sum(list_transform(list_zip(a.hist, b.hist), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) d from h a join h b on a.image_id <> b.image_id
    join normal_image n on n.image_id = b.image_id),
  nn as (select *, row_number() over (partition by image_id order by d, ref_id) rn from pr qualify rn <= 3),
  rf as (select image_id, max(case when rn = 1 then ref_id end) ref_id,
    list_transform(range(5), lambda i: list_sum(list_transform(list(hist), lambda l: l[i + 1])) / 3) rh,
    list_transform(range(20), lambda i: list_sum(list_transform(list(quad), lambda l: l[i + 1])) / 3) rq from nn group by 1),
  dv as (select h.image_id, ref_id, unnest(range(5))::int + 1 label,
    unnest(list_transform(list_zip(hist, rh), lambda p: abs(p[1] - p[2]) / case when p[2] + 1 < 50 then 65536 else p[2] + 1 end)) whole,
    unnest(list_transform(list_zip(hist, rh), lambda p: case when p[1] + 1 > (case when p[2] + 1 < 50 then 65536 else p[2] + 1 end) then 1 else -1 end)) sign,
    unnest(list_transform(range(5), lambda c: list_max(list_transform(range(4), lambda q:
      abs(quad[q * 5 + c + 1] - rq[q * 5 + c + 1]) / case when rq[q * 5 + c + 1] + 1 < 50 then 65536 else rq[q * 5 + c + 1] + 1 end)))) quadrant
    from h join rf on h.image_id = rf.image_id)"""


def _scores(t):
    """Component scores of every image against the mean of its three nearest other normal images."""
    return sm.component_scores(t.component_px, t.normal_image, 5, S, S, 3)


@query(
    "f27_component_score",
    f"with {_NORMAL} select image_id, ref_id, label, round(whole, 6) whole, sign, round(quadrant, 6) quadrant from dv",
)
def _(t):
    rows = _scores(t).select("image_id", "ref_id", F.posexplode(F.arrays_zip("whole", "quadrant")).alias("p", "c"))
    return rounded(
        rows.select(
            "image_id",
            "ref_id",
            (F.col("p") + 1).alias("label"),
            F.col("c.whole.score").alias("whole"),
            F.col("c.whole.sign").alias("sign"),
            F.col("c.quadrant.score").alias("quadrant"),
        )
    )


@query(
    "j19_component_map",
    f"""with {_NORMAL},
    ms as (select dv.image_id, y, x, whole score from dv join component_px n on n.image_id = dv.ref_id and n.label = dv.label where sign = -1 and whole > 0.4),
    mo as (select dv.image_id, y, x, whole score from dv join component_px n on n.image_id = dv.image_id and n.label = dv.label
      where sign = 1 and whole > 0.4 and not exists (select 1 from ms where ms.image_id = dv.image_id and ms.y = n.y and ms.x = n.x)),
    qd as (select dv.image_id, y, x, quadrant * 0.5 score from dv join component_px n on n.image_id = dv.ref_id and n.label = dv.label where quadrant > 0.7)
    select image_id, y, x, round(sum(score), 6) score from (select * from ms union all select * from mo union all select * from qd) group by 1, 2, 3""",
)
def _(t):
    refs = t.component_px.withColumnRenamed("image_id", "ref_id")
    return rounded(sm.component_map(t.component_px, refs, _scores(t)))


_MAPS = """select l_suppkey image_id, cast(l_partkey % 32 as int) y, cast(l_quantity as int) % 32 x, max({v}) score from lineitem group by 1, 2, 3"""
_ALL_MAPS = _MAPS.replace("max({v}) score", "max(l_extendedprice) st, max(l_quantity * l_tax) ae, max(l_discount) cm")
_ST, _AE, _CM = (_MAPS.format(v=v) for v in ("l_extendedprice", "l_quantity * l_tax", "l_discount"))


@query(
    "j20_combine_maps",
    f"""with st as ({_ST}), ae as ({_AE}), cm as (select * from ({_CM}) where score > 0.05),
    q as (select (select quantile_cont(score, 0.9) from st) ss, (select quantile_cont(score, 0.995) from st) se,
      (select quantile_cont(score, 0.9) from ae) a1, (select quantile_cont(score, 0.995) from ae) a2),
    tx as (select st.image_id, st.y, st.x, 0.1::double * (st.score - ss) / (se - ss) + 0.1::double * (ae.score - a1) / (a2 - a1) texture
      from st join ae on st.image_id = ae.image_id and st.y = ae.y and st.x = ae.x, q)
    select tx.image_id, tx.y, tx.x, round(texture, 5) texture, coalesce(cm.score, 0) component, round(texture + 0.15::double * coalesce(cm.score, 0), 5) score
    from tx left join cm on cm.image_id = tx.image_id and cm.y = tx.y and cm.x = tx.x""",
)
def _(t):
    pixels = cut_lineage(t.sql(_ALL_MAPS))  # all three maps from one aggregate, read for the quantiles and the join
    cm = pixels.select("image_id", "y", "x", F.col("cm").alias("score")).where("score > 0.05")
    ends = [sm.exact_quantiles(pixels, c, [0.9, 0.995]).toDF(f"{c}_start", f"{c}_end") for c in ("st", "ae")]
    return rounded(sm.combine_pixels(pixels, ends[0].crossJoin(ends[1]), cm), 5)  # one row each


@query(
    "j20_combined_score",
    f"""with st as ({_ST}), cm as (select * from ({_CM}) where score > 0.05)
    select st.image_id, round(max(st.score / 1000) + max(coalesce(cm.score, 0)), 5) score from st
    left join cm on cm.image_id = st.image_id and cm.y = st.y and cm.x = st.x group by 1""",
)
def _(t):
    st = t.sql(_ST).select("image_id", "y", "x", (F.col("score") / 1000).alias("texture"))
    cm = t.sql(_CM).where("score > 0.05").withColumnRenamed("score", "component")
    maps = st.join(cm, ["image_id", "y", "x"], "left").na.fill(0.0, ["component"])
    return rounded(sm.combined_score(maps), 5)


@query(
    "j15_gaussian_smooth",
    """with k as (select i, exp(-0.5 * power(i / 4.0::double, 2)) g from (select unnest(range(-16, 17)) i)),
    tp as (select t, case when m >= 32 then 63 - m else m end s, sum(g) / (select sum(g) from k) wt
      from (select t, g, (t + i + 64) % 64 m from (select unnest(range(32)) t) cross join k) group by 1, 2),
    a as (select image_id, t y, x, sum(score * wt) v from score_px join tp on y = s group by 1, 2, 3)
    select image_id, y::int y, t::int x, round(sum(v * wt), 4) score from a join tp on x = s group by 1, 2, 3""",
)
def _(t):
    return rounded(sm.gaussian_smooth(t.score_px, S, S), 4)


_PASTE_POS = (
    "select l_suppkey image_id, l_linenumber instance_id, max(l_discount) * 8 cx, max(l_tax) * 10 cy, "
    "1.0 + l_linenumber * 0.25 scale, cast(0.0 as double) angle from lineitem group by 1, 2"
)


_PASTED = """with pos as (select l_suppkey image_id, l_linenumber instance_id, max(l_discount) * 8 cx, max(l_tax) * 10 cy,
      1.0::double + l_linenumber * 0.25::double scale from lineitem group by 1, 2),
    px as (select l_suppkey image_id, l_linenumber instance_id, cast(l_partkey % 32 as int) y, cast(l_quantity as int) % 32 x,
      max(ln(l_extendedprice)) score from lineitem group by 1, 2, 3, 4),
    gm as (select *, floor(32 * (32 / scale) / 40)::int nx, floor(32 * (32 / scale) / 36)::int ny,
      floor(cx * 32)::int ccx, floor(cy * 32)::int ccy from pos),
    ty as (select *, unnest(range(ny))::int t from gm),
    wy as (select image_id, instance_id, t, least(greatest((t + 0.5::double) * 32 / ny - 0.5::double, 0), 31) src, ccy - ny // 2 + t pos from ty),
    tx as (select *, unnest(range(nx))::int t from gm),
    wx as (select image_id, instance_id, t, least(greatest((t + 0.5::double) * 32 / nx - 0.5::double, 0), 31) src, ccx - nx // 2 + t pos from tx),
    rz as (select px.image_id, px.instance_id, wy.pos y, wx.pos x, sum(score * (1 - abs(wy.src - px.y)) * (1 - abs(wx.src - px.x))) score
      from px join wy on wy.image_id = px.image_id and wy.instance_id = px.instance_id and abs(wy.src - px.y) < 1
        join wx on wx.image_id = px.image_id and wx.instance_id = px.instance_id and abs(wx.src - px.x) < 1
      where wy.pos between 0 and 31 and wx.pos between 0 and 31 group by 1, 2, 3, 4)"""


def _pasted(t):
    px = t.lineitem.groupBy(
        F.col("l_suppkey").alias("image_id"),
        F.col("l_linenumber").alias("instance_id"),
        (F.col("l_partkey") % 32).cast("int").alias("y"),
        (F.col("l_quantity").cast("int") % 32).alias("x"),
    ).agg(F.max(F.log("l_extendedprice")).alias("score"))
    return sm.paste_instances(px, t.sql(_PASTE_POS).withColumn("scale", F.col("scale").cast("double")), S, 36, 40)


@query("j16_paste_instances", _PASTED + " select image_id, y, x, round(max(score), 3) score from rz group by 1, 2, 3")
def _(t):
    return rounded(_pasted(t), 3)


@query(
    "p3_rollup_with_map",
    _PASTED
    + """, map as (select image_id, y, x, max(score) score from rz group by 1, 2, 3),
    m as (select image_id, count(*) n, max(score) top from map group by 1),
    r as (select l_suppkey image_id, max(l_extendedprice) score, max(case when l_returnflag = 'R' then 1 else 0 end) is_anomaly from lineitem group by 1)
    select r.image_id, score, is_anomaly, coalesce(n, 0) map_pixels, round(coalesce(top, 0), 3) map_top from r left join m on r.image_id = m.image_id""",
)
def _(t):
    """Instances rolled up to images, each with its merged score map: F3 beside J16."""
    inst = t.lineitem.select(
        F.col("l_suppkey").alias("image_id"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_anomaly")
    )
    maps = _pasted(t).groupBy(F.col("image_id").alias("map_of")).agg(F.count(F.lit(1)).alias("map_pixels"), F.max("score").alias("map_top"))
    both = m.rollup_instances(inst).join(maps, F.col("image_id") == F.col("map_of"), "left").drop("map_of")
    return rounded(both.na.fill({"map_pixels": 0, "map_top": 0.0}), 3)


@query("j16_paste_rotated")
def _(t):
    px = t.score_px.select("image_id", F.lit(0).alias("instance_id"), "y", "x", "score")
    pos = t.score_px.select("image_id").distinct().select(
        "image_id", F.lit(0).alias("instance_id"), F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.lit(1.0).alias("scale"),
        (F.col("image_id") % 4 * 30).cast("double").alias("angle"),
    )
    return rounded(sm.paste_instances(px, pos, S, S, S), 4)


# --- shapes ---------------------------------------------------------------------------------------------------

_MOMENTS = ", ".join(
    "sum(" + " * ".join(["1.0::double"] + ["x::double"] * p + ["y::double"] * q) + f") * 255 m{p}{q}" for p, q in sh.ORDERS
)
_HU_CHAIN = f"""m1 as (select *, {', '.join(f'{e} {n}' for n, e in sh.MEANS.items())} from m0),
  m2 as (select *, {', '.join(f'{e} {n}' for n, e in sh.CENTRAL.items())} from m1),
  m3 as (select *, {', '.join(f'mu{o} / (m00 * m00) n{o}' for o in ('20', '11', '02'))},
    {', '.join(f'mu{o} / (m00 * m00 * sqrt(m00)) n{o}' for o in ('30', '21', '12', '03'))} from m2),
  hu as (select *, list_transform([{', '.join(sh.HU)}], lambda v: case when v = 0 then 0 else -sign(v) * log10(abs(v)) end) shape from m3)"""


@query(
    "d21_hu_moments",
    f"""with m0 as (select image_id, mask_id, {_MOMENTS} from mask_px group by 1, 2), {_HU_CHAIN}
    select image_id, mask_id, list_transform(shape[1:4], lambda v: round(v, 4)) shape from hu""",
)
def _(t):
    out = sh.hu_moments(t.mask_px)
    return out.select("image_id", "mask_id", F.transform(F.slice("shape", 1, 4), lambda v: F.round(v, 4)).alias("shape"))


_COLOR_PX = """select l_suppkey image_id, l_linenumber component_id, cast(l_partkey % 32 as int) y, cast(l_quantity as int) % 32 x,
  max(l_tax) * 100 + 1 a, max(l_discount) * 100 b from lineitem group by 1, 2, 3, 4"""
_COMPONENT = f"""with px as ({_COLOR_PX}), m0 as (select image_id, component_id, count(*) / 1024 area,
  sum((b / (a + 1e-7)) * (b / (a + 1e-7))) / (count(*) + 1e-7) color,
  [(min(x) + (max(x) - min(x) + 1) / 2) / 32, (min(y) + (max(y) - min(y) + 1) / 2) / 32] pos,
  64 / sqrt(power(max(x) - min(x) + 1, 2) + power(max(y) - min(y) + 1, 2)) scale, {_MOMENTS} from px group by 1, 2), {_HU_CHAIN}"""


@query(
    "d22_component_features",
    _COMPONENT
    + """ select image_id, component_id, round(area, 6) area, round(color, 6) color, list_transform(pos, lambda v: round(v, 6)) position,
      round(scale, 6) scale, list_transform(shape[1:4], lambda v: round(v, 4)) shape from hu""",
)
def _(t):
    out = sh.component_features(t.sql(_COLOR_PX), S, S)
    return rounded(out).withColumn("position", F.transform("position", lambda v: F.round(v, 6))).withColumn(
        "shape", F.transform(F.slice("shape", 1, 4), lambda v: F.round(v, 4))
    )


@query(
    "d23_collect_components",
    _COMPONENT
    + """ select image_id, list(round(area, 6) order by component_id) area, list(round(color, 6) order by component_id) color,
      list(list_transform(pos, lambda v: round(v, 6)) order by component_id) position from hu group by 1""",
)
def _(t):
    out = rounded(sh.component_features(t.sql(_COLOR_PX), S, S)).withColumn("position", F.transform("position", lambda v: F.round(v, 6)))
    return sh.collect_components(out)


_ALIGN = "select l_orderkey image_id, l_linenumber instance_id, max(l_discount) * 100 x, max(l_tax) * 100 y, max(l_quantity) w, max(l_suppkey) h, 64 canvas_w, 128 canvas_h from lineitem group by 1, 2"


@query(
    "d24_alignment",
    f"""with b as ({_ALIGN}), d as (select *, sqrt(w * w + h * h) dg from b)
    select image_id, instance_id, round(256 / dg, 6) scale, round(256 / (dg + 1), 6) padded,
      round(256 / max(dg) over (partition by image_id), 6) relative, round((x + w / 2) / 64, 6) center_x, round((y + h / 2) / 128, 6) center_y from d""",
)
def _(t):
    boxes, keys = t.sql(_ALIGN), ["image_id", "instance_id"]
    plain = sh.alignment(boxes, 256.0).select(*keys, "scale", "center_x", "center_y")
    padded = sh.alignment(boxes, 256.0, "padded").select(*keys, F.col("scale").alias("padded"))
    relative = sh.alignment(boxes, 256.0, "relative").select(*keys, F.col("scale").alias("relative"))
    return rounded(plain.join(padded, keys).join(relative, keys))
