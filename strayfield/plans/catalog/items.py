"""Queries of the manifest, filter, sampling, window and set groups."""

import uuid

from pyspark.sql import functions as F

from strayfield.functions.scalar import signed_round
from strayfield.operators import filters as fl
from strayfield.operators import sampling as sp
from strayfield.operators import sets as st
from strayfield.operators import windows as wn
from strayfield.operators.ordering import row_index
from strayfield.plans.catalog.metrics import rounded
from strayfield.plans.registry import query
from strayfield.session import shared_folder
from strayfield.sources import items as it
from strayfield.sources import sinks as sk

# --- A: manifests, sources, sinks -------------------------------------------------------------------

_NAME = "regexp_extract(path, '([^/]+)$', 1)"
_PARTS = "string_split(path, '/')"
_MASK = (
    f"case when {_PARTS}[-2] <> 'good' then concat(regexp_replace(replace(path, '/test/', '/ground_truth/'), '[^/]*$', ''), "
    f"string_split({_NAME}, '_')[1], '_mask.png') end"
)


@query(
    "a1_scan_manifest",
    f"""select {_PARTS}[-4] class, {_PARTS}[-3] split, {_PARTS}[-2] defect, string_split({_NAME}, '_')[1] image_id,
      cast(regexp_extract({_NAME}, '_([0-9]+)', 1) as int) instance_id, path, {_MASK} mask_path,
      case when {_PARTS}[-2] <> 'good' then 1 else 0 end is_anomaly from manifest_path""",
)
def _(t):
    return it.parse_manifest(t.manifest_path).orderBy("path")


@query(
    "a1_scan_tree",
    f"""select {_PARTS}[-4] class, {_PARTS}[-3] split, {_PARTS}[-2] defect, string_split({_NAME}, '_')[1] image_id,
      cast(regexp_extract({_NAME}, '_([0-9]+)', 1) as int) instance_id, path, {_MASK} mask_path,
      case when {_PARTS}[-2] <> 'good' then 1 else 0 end is_anomaly from manifest_path where {_PARTS}[-3] = 'test'""",
)
def _(t):
    """A tree of real files, one per part, and the listing of its test folders."""
    root = f"{shared_folder(t.spark)}/tree-{uuid.uuid4().hex}"
    sk.write_files(t.manifest_path.withColumn("content", F.col("image_key").cast("string")), root)
    found = it.scan_manifest(t.spark, f"{root}/data", splits=["test"])
    below = [F.regexp_replace(c, "^.*/tree-[0-9a-f]+", "").alias(c) for c in ("path", "mask_path")]
    return found.select(*[c for c in found.columns if c not in ("path", "mask_path")], *below)


@query(
    "a2_parse_item_path",
    f"""select path, string_split({_NAME}, '_')[1] image_id, cast(regexp_extract({_NAME}, '_([0-9]+)', 1) as int) instance_id,
      {_PARTS}[-2] defect, array_to_string({_PARTS}[-4:], '/') image_name from manifest_path""",
)
def _(t):
    return it.parse_item_path(t.manifest_path.select("path"))


@query("a3_mask_path", f"select path, {_MASK} mask_path from manifest_path")
def _(t):
    return t.manifest_path.select("path", it.mask_path("path").alias("mask_path"))


@query(
    "a4_scan_list",
    """select doc_id line_no, concat('img/', source, '.jpg') image, concat('gt/', source, '.png') label from (
      select doc_id, source, row_number() over (order by doc_id) rn from documents) where rn > 20""",
)
def _(t):
    lines = t.documents.select(F.col("doc_id").alias("line_no"), F.col("source").alias("value"))
    return it.scan_list(lines, "img/{}.jpg", "gt/{}.png", start=20)


@query(
    "a5_anomaly_flag",
    """select image_id, case when defect <> 'good' then 1 else 0 end exact,
      case when contains(defect, 'good') then 0 else 1 end has_other from manifest_item""",
)
def _(t):
    return t.manifest_item.select(
        "image_id", it.anomaly_flag("defect").alias("exact"), it.anomaly_flag("defect", "contains").alias("has_other")
    )


@query(
    "a6_load_positions",
    """with a as (select image_id, instance_id, max(cx) cx, max(cy) cy, max(scale) scale from instance_rec group by 1, 2),
    b as (select image_id, instance_id, max(cx + 1) cx, max(cy + 1) cy, max(scale) scale from instance_rec where area > 25 group by 1, 2)
    select a.image_id, a.instance_id, round(coalesce(b.cx, a.cx), 6) cx, round(coalesce(b.cy, a.cy), 6) cy,
      coalesce(b.scale, a.scale) scale from a left join b on a.image_id = b.image_id and a.instance_id = b.instance_id""",
)
def _(t):
    first = t.instance_rec.select("image_id", "instance_id", "cx", "cy", "scale")
    later = t.instance_rec.where("area > 25").select(
        "image_id", "instance_id", (F.col("cx") + 1).alias("cx"), (F.col("cy") + 1).alias("cy"), "scale"
    )
    return rounded(it.load_positions([first, later]))


@query("a7_bank_roundtrip", "select vec_id, label, len(vec) dims from bank_vec")
def _(t):
    folder = f"{shared_folder(t.spark)}/bank-{uuid.uuid4().hex}"
    sk.save_bank(t.bank_vec, {"metric": "l2sq", "k": 3}, folder)
    bank, _params = sk.load_bank(t.spark, folder)
    return bank.select("vec_id", "label", F.size("vec").cast("long").alias("dims"))


@query(
    "a8_results_table",
    """with v as (select dataset, round(avg(score), 4) avg_score, max(score) max_score from image_score group by 1)
    select dataset, avg_score, max_score from v union all
    select 'Mean', round(avg(avg_score), 4), round(avg(max_score), 4) from v""",
)
def _(t):
    long = t.image_score.groupBy("dataset").agg(F.round(F.avg("score"), 4).alias("avg_score"), F.max("score").alias("max_score"))
    long = long.unpivot("dataset", ["avg_score", "max_score"], "metric", "value")
    return rounded(sk.results_table(long, ["avg_score", "max_score"]), 4)


@query("a9_append_stats", "select event_type, count(*) n, 2 parts from events group by 1")
def _(t):
    folder = f"{shared_folder(t.spark)}/stats-{uuid.uuid4().hex}"
    sk.reset_dir(t.spark, folder)
    stats = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    sk.append_stats(stats.withColumn("part", F.lit(1)), folder)
    sk.append_stats(stats.withColumn("part", F.lit(2)), folder)
    back = t.spark.read.parquet(folder)
    return back.groupBy("event_type").agg(F.max("n").alias("n"), F.countDistinct("part").cast("int").alias("parts"))


@query("a11_save_reference", "select dataset, count(*) n, sum(score) total from image_score group by 1")
def _(t):
    folder = f"{shared_folder(t.spark)}/reference-{uuid.uuid4().hex}"
    sk.save_reference(t.image_score, "scores", folder, "dataset")
    back = sk.load_reference(t.spark, "scores", folder)
    return back.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


# --- B: filters ---------------------------------------------------------------------------------------


@query("b1_filter_classes", "select * from manifest_item where class in ('brand11', 'brand23')")
def _(t):
    return fl.filter_classes(t.manifest_item, ["brand11", "brand23"])


@query("b2_pending", "select image_id from manifest_item where image_id not in (select l_partkey from lineitem where l_quantity > 45)")
def _(t):
    done = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("image_id"))
    return fl.pending(t.manifest_item.select("image_id"), done, ["image_id"])


@query("b3_with_partner", "select image_id from manifest_item where image_id in (select l_partkey from lineitem where l_quantity > 45)")
def _(t):
    other = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("image_id"))
    return fl.with_partner(t.manifest_item.select("image_id"), other, ["image_id"])


_ORDER_PX = "select l_orderkey image_id, l_linenumber y, l_suppkey x, case when l_returnflag = 'R' then 1 else 0 end gt from lineitem"


@query("b4_anomalous_only", f"with px as ({_ORDER_PX}) select * from px where image_id in (select image_id from px where gt > 0)")
def _(t):
    return fl.anomalous_only(t.sql(_ORDER_PX))


_MD5 = "md5(concat('{seed}|', {cols}))"


@query(
    "b5_anomalous_items",
    "select * from manifest_item where split = 'test' and defect <> 'good' "
    f"order by {_MD5.format(seed=7, cols='image_id')}, image_id limit 25",
)
def _(t):
    return fl.anomalous_items(t.manifest_item, 25, 7, "image_id")


_BOXES = (
    "select l_orderkey image_id, l_linenumber instance_id, max(l_quantity) area, max(l_quantity) w, "
    "max(l_discount * 100) h, 49.0 canvas_w from lineitem group by 1, 2"
)


@query(
    "b6_filter_instances",
    f"""with b as (select l_orderkey image_id, l_linenumber instance_id, max(l_quantity) area, max(l_quantity) w,
      max(l_discount * 100) h, cast(49.0 as double) canvas_w from lineitem group by 1, 2),
    s as (select *, sum(area) over (partition by image_id) total, 256.0::double / sqrt(w * w + h * h) sc from b)
    select image_id, instance_id, area, w, h, canvas_w from s where area >= 0.05::double * total and w <= canvas_w * 0.97::double
      and floor(w * sc) > 0 and floor(h * sc) > 0""",
)
def _(t):
    boxes = t.sql(_BOXES).withColumn("canvas_w", F.col("canvas_w").cast("double"))
    return fl.filter_instances(boxes, min_frac=0.05)


@query(
    "b7_split_by_index",
    """select doc_id, case when doc_id in (select doc_id from labels) then 'supervised' else 'unsupervised' end part from documents""",
)
def _(t):
    inside, outside = fl.split_by_index(t.documents.select("doc_id"), t.labels, "doc_id")
    return st.union_rows([inside.withColumn("part", F.lit("supervised")), outside.withColumn("part", F.lit("unsupervised"))])


@query(
    "b8_drop_small_labels",
    "select *  exclude n from (select *, count(*) over (partition by image_id, label) n from label_map_px) where n > 100",
)
def _(t):
    return fl.drop_small_labels(t.label_map_px, min_px=100)


@query(
    "b8_drop_small_fraction",
    "select * exclude n from (select *, count(*) over (partition by image_id, label) n from label_map_px) where n / 1024 > 0.1::double",
)
def _(t):
    return fl.drop_small_labels(t.label_map_px, min_frac=0.1, size=1024)


_EVENT_PROB = "select event_id, value / (1 + value) confidence, cast(user_id % 5 as int) label, value loss from events"


@query(
    "b9_pseudo_label_gate",
    f"""with p as ({_EVENT_PROB}) select event_id, confidence, loss, case when confidence >= 0.9::double then 1 else 0 end kept,
      case when confidence >= 0.9::double then label else 255 end label from p""",
)
def _(t):
    return fl.pseudo_label_gate(t.sql(_EVENT_PROB), 0.9)


@query(
    "b9_gate_loss",
    f"""with p as ({_EVENT_PROB}) select round(avg(case when confidence >= 0.9::double then loss else 0 end), 5) loss,
      round(avg(case when confidence >= 0.9::double then 1.0::double else 0 end), 6) kept_ratio from p""",
)
def _(t):
    out = fl.gate_loss(fl.pseudo_label_gate(t.sql(_EVENT_PROB), 0.9))
    return out.select(F.round("loss", 5).alias("loss"), F.round("kept_ratio", 6).alias("kept_ratio"))


_IGNORED = "select event_id, case when value > 20 then 255 else cast(user_id % 5 as int) end label from events"


@query("b10_ignore_label", f"select * from ({_IGNORED}) where label <> 255")
def _(t):
    return fl.ignore_label(t.sql(_IGNORED))


@query("b11_count_violations", "select l_orderkey image_id, count(*) n from lineitem group by 1 having count(*) <> 4")
def _(t):
    return fl.count_violations(t.lineitem.withColumnRenamed("l_orderkey", "image_id"), 4)


@query("f33_instance_count", "select l_orderkey image_id, count(*) n from lineitem group by 1")
def _(t):
    return fl.instance_count(t.lineitem.withColumnRenamed("l_orderkey", "image_id"))


# --- C: sampling ----------------------------------------------------------------------------------------


@query(
    "c1_k_shot",
    f"""with ids as (select distinct class, defect, image_id from manifest_item),
    r as (select *, row_number() over (partition by class, defect order by {_MD5.format(seed=3, cols='image_id')}, image_id) rn from ids)
    select m.* from manifest_item m join r on m.image_id = r.image_id where rn <= 4""",
)
def _(t):
    return sp.k_shot(t.manifest_item, 4, 3)


@query(
    "c2_prefix_split",
    """with r as (select *, row_number() over (partition by class, defect order by image_id) rn,
      count(*) over (partition by class, defect) n from manifest_item)
    select * exclude (rn, n), case when rn <= floor(n * 0.8::double) then 'train' else 'val' end part from r""",
)
def _(t):
    return sp.prefix_split(t.manifest_item, 0.8, ["class", "defect"], ["image_id"])


@query("c3_cap", f"select doc_id from documents order by {_MD5.format(seed=5, cols='doc_id')}, doc_id limit 400")
def _(t):
    return sp.cap(t.documents.select("doc_id"), 400, 5, "doc_id")


@query(
    "c4_random_sample",
    f"""select doc_id from (select doc_id, row_number() over (order by {_MD5.format(seed=5, cols='doc_id')}, doc_id) rn,
      count(*) over () n from documents) where rn <= floor(n * 0.3::double)""",
)
def _(t):
    return sp.random_sample(t.documents.select("doc_id"), 0.3, 5, "doc_id")


_UNIT = "cast(concat('0x', substr({h}, 1, 13)) as bigint) / cast(power(16::double, 13) as double)"


@query(
    "c5_draw",
    f"""with r as (select doc_id, row_number() over (order by doc_id) rn, count(*) over () n from documents),
    d as (select range draw_no, {_UNIT.format(h="md5(concat('11|', range))")} u from range(8))
    select d.draw_no, r.doc_id from d join r on r.rn = cast(floor(d.u * r.n) as bigint) + 1""",
)
def _(t):
    return sp.draw(t.documents.select("doc_id"), 8, 11, "doc_id").select("draw_no", "doc_id")


@query(
    "c5_draw_one",
    f"select doc_id, 0::bigint draw_no from documents order by {_MD5.format(seed=11, cols='doc_id')}, doc_id limit 1",
)
def _(t):
    return sp.draw(t.documents.select("doc_id"), 1, 11, "doc_id", replace=False)


@query(
    "c6_resample_to",
    """with c as (select cast(ceil(5000.0 / count(*)) as int) c from labels),
    x as (select doc_id, unnest(range(c))::int copy from labels, c),
    r as (select *, row_number() over (order by md5(concat('2|', doc_id, '|', copy)), doc_id, copy) rn from x)
    select doc_id, copy from r where rn <= 5000""",
)
def _(t):
    return sp.resample_to(t.labels.select("doc_id"), 5000, 2, "doc_id")


@query("c8_replicate", "select image_id, unnest(range(10))::int copy from manifest_item")
def _(t):
    return sp.replicate(t.manifest_item.select("image_id"), 10)


@query("c8_rotations", "select image_id, (unnest(range(12)) * 30)::int angle from manifest_item")
def _(t):
    return sp.rotations(t.manifest_item.select("image_id"), 30)


@query(
    "c9_weighted_sample",
    f"""with m as (select image_id, mask_id, count(*) area from mask_px group by 1, 2),
    k as (select *, -ln({_UNIT.format(h="md5(concat('4|', image_id, '|', mask_id))")}) / power(area, 0.5) key from m),
    r as (select *, row_number() over (partition by image_id order by key, mask_id) rn from k)
    select image_id, mask_id, area, rn from r where rn <= 3""",
)
def _(t):
    areas = t.mask_px.groupBy("image_id", "mask_id").agg(F.count(F.lit(1)).alias("area"))
    out = sp.weighted_sample(areas, "area", 3, 4, "mask_id", ["image_id"])
    return out.withColumn("rn", F.col("rn").cast("long"))


_CORESET = """with recursive pts as ({pts}),
  d as materialized (select a.vec_id a, b.vec_id b, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec),
      lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))) dist from pts a cross join pts b),
  start as ({start}),
  np as (select cast(floor(count(*) * 0.1::double) as int) picks from pts),
  walk as (
    select 0 pick_no, id, anchor, (select arg_min(id, struct_pack(x := -anchor, y := id)) from start) pick from start
    union all
    select pick_no + 1, id, lowered, first_value(id) over (order by -lowered, id) pick
    from (select w.pick_no, w.id, least(w.anchor, d.dist) lowered from walk w join d on d.a = w.id and d.b = w.pick
          where w.pick_no + 1 < (select picks from np)))
  select distinct pick_no::bigint pick_no, pick vec_id from walk"""


@query(
    "c11_greedy_coreset",
    _CORESET.format(
        pts="select vec_id, vec from query_vec", start="select a id, sqrt(sum(dist * dist)) anchor from d group by 1"
    ),
)
def _(t):
    return sp.greedy_coreset(t.query_vec, 0.1, look=256)


@query(
    "c12_approx_coreset",
    _CORESET.format(
        pts="select vec_id, vec from query_vec",
        start="select a id, avg(dist) anchor from d where b in "
        "(select vec_id from query_vec order by md5(concat('6|', vec_id)), vec_id limit 10) group by 1",
    ),
)
def _(t):
    return sp.approx_coreset(t.query_vec, 0.1, 10, 6, look=256)


@query(
    "c12_two_level_cover",
    "select count(*) n_rows, cast(floor(count(*) * 0.1::double) as bigint) picks, true covered from query_vec",
)
def _(t):
    """The two-level coreset has its exact size, and its cover radius is at most twice that of the greedy one."""
    two = sp.two_level_coreset(t.query_vec, 0.1, 10, 6, part_rows=64)
    one = sp.approx_coreset(t.query_vec, 0.1, 10, 6, look=256)
    radius = [sp.cover_radius(t.query_vec, picks).scalar() for picks in (two, one)]
    rows = t.query_vec.agg(F.count(F.lit(1)).alias("n_rows"))
    return two.agg(F.count(F.lit(1)).alias("picks")).select(rows.scalar().alias("n_rows"), "picks", (radius[0] <= 2 * radius[1]).alias("covered"))


@query(
    "c13_random_project",
    """select vec_id, list_transform(range(4), lambda i: round(list_sum(list_transform(vec,
      lambda v, j: v::double * cos((i * 64 + j - 1)::double) / 8)), 6)) vec from query_vec""",
)
def _(t):
    import numpy as np

    weights = np.cos(np.arange(4 * 64, dtype=float).reshape(4, 64)) / 8
    out = sp.random_project(t.query_vec.select("vec_id", "vec"), weights)
    return out.withColumn("vec", F.transform("vec", lambda x: signed_round(x, 6)))


@query(
    "c14_sample_from_bank",
    """with shown as (
      select image_id, class_id, case when count(*) filter (label - 1 = class_id) >= 0.05::double * 1024 then 1 else 0 end present
      from label_map_px, range(5) c(class_id) group by 1, 2),
    w as (select class_id, exp(power(1 - avg(present), 1 / 3::double)) w from shown group by 1),
    chance as (select class_id, sum(w) over (order by class_id) / sum(w) over () past from w),
    tries as (select range draw_no, ('0x' || substr(md5('9|class|' || range), 1, 13))::bigint / 4503599627370496::double u,
      ('0x' || substr(md5('9|image|' || range), 1, 13))::bigint / 4503599627370496::double v from range(200)),
    chosen as (select draw_no, v, coalesce(min(class_id) filter (past > u), max(class_id)) class_id from tries, chance group by 1, 2),
    own as (select class_id, image_id, row_number() over (partition by class_id order by image_id) rn, count(*) over (partition by class_id) n from shown where present = 1),
    everyone as (select image_id, row_number() over (order by image_id) rn, count(*) over () n from (select distinct image_id from shown))
    select draw_no, c.class_id::int class_id, o.image_id from chosen c join own o on o.class_id = c.class_id and o.rn = floor(v * o.n) + 1
    union all
    select draw_no, c.class_id::int, e.image_id from chosen c join everyone e on e.rn = floor(v * e.n) + 1 where c.class_id not in (select class_id from own)""",
)
def _(t):
    from strayfield.operators.segmentation import presence

    shown = presence(t.label_map_px.withColumn("label", F.col("label") - 1), 5, 0.05, 1024)
    conf = shown.groupBy("class_id").agg(F.avg("present").alias("conf"))
    return sp.sample_from_bank(shown, conf, 200, 9, smooth=True)


@query("c15_batch_id", "select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 32) as bigint) batch from documents")
def _(t):
    return sp.batch_id(t.documents.select("doc_id"), 32, ["doc_id"])


@query(
    "c16_greedy_batches",
    """with recursive src as (
      select n_regionkey class, s_suppkey image_id, s_acctbal, 1 + s_suppkey % 5 n
      from supplier join nation on s_nationkey = n_nationkey),
    r as (select *, row_number() over (partition by class order by image_id) rn from src),
    walk as (
      select class, image_id, n, rn, 0::bigint batch, n cnt from r where rn = 1
      union all
      select r.class, r.image_id, r.n, r.rn, case when w.cnt >= 12 then w.batch + 1 else w.batch end,
        case when w.cnt >= 12 then r.n else w.cnt + r.n end
      from walk w join r on r.class = w.class and r.rn = w.rn + 1)
    select class, image_id, n, batch from walk""",
)
def _(t):
    src = t.sql(
        "select n_regionkey class, s_suppkey image_id, 1 + s_suppkey % 5 n from supplier join nation on s_nationkey = n_nationkey"
    )
    return wn.greedy_batches(src, 12, "image_id", by=["class"])


@query("c18_identity", "select * from region")
def _(t):
    return sp.identity(t.region)


# --- H: windows -----------------------------------------------------------------------------------------


@query(
    "h2_topk",
    """select user_id, event_id, value, rn from (select user_id, event_id, value,
      row_number() over (partition by user_id order by value desc, event_id) rn from events) where rn <= 5""",
)
def _(t):
    out = wn.topk(t.events.select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 5)
    return out.withColumn("rn", F.col("rn").cast("long"))


@query(
    "h3_moving_avg",
    """select event_id, user_id, round(avg(ln(1 + value)) over (partition by user_id order by ts, event_id
      rows between 19 preceding and current row), 5) moving_avg from events""",
)
def _(t):
    out = wn.moving_avg(t.events.select("event_id", "user_id", "ts", F.log1p("value").alias("value")), "value", ["ts", "event_id"], 20, ["user_id"])
    return rounded(out.select("event_id", "user_id", "moving_avg"), 5)


@query(
    "h3_running_avg",
    """select event_id, round(sum(ln(1 + value) * user_id) over (partition by event_type order by ts, event_id)
      / sum(user_id) over (partition by event_type order by ts, event_id), 5) running_avg from events""",
)
def _(t):
    src = t.events.select("event_id", "event_type", "ts", F.log1p("value").alias("value"), "user_id")
    out = wn.running_avg(src, "value", ["ts", "event_id"], "user_id", ["event_type"])
    return rounded(out.select("event_id", "running_avg"), 5)


@query(
    "h4_ema",
    """with recursive r as (select user_id, event_id, ln(1 + value) "value", row_number() over (partition by user_id order by ts, event_id) - 1 i from events),
    walk as (
      select user_id, event_id, i, value ema from r where i = 0
      union all
      select r.user_id, r.event_id, r.i, w.ema * least(1 - 1 / (r.i + 1)::double, 0.9::double)
        + r.value * (1 - least(1 - 1 / (r.i + 1)::double, 0.9::double))
      from walk w join r on r.user_id = w.user_id and r.i = w.i + 1)
    select event_id, round(ema, 5) ema from walk""",
)
def _(t):
    out = wn.ema(t.events.select("event_id", "user_id", "ts", F.log1p("value").alias("value")), "value", ["ts", "event_id"], 0.9, by=["user_id"])
    return rounded(out.select("event_id", "ema"), 5)


@query(
    "h5_running_best",
    """with b as (select *, max(value) over (partition by event_type order by event_id) best from events)
    select event_id, best, min(case when value = best then event_id end) over (partition by event_type, best order by event_id) best_at from b""",
)
def _(t):
    out = wn.running_best(t.events.select("event_id", "event_type", "value"), "value", "event_id", ["event_type"])
    return out.select("event_id", "best", "best_at")


@query(
    "h6_area_rank",
    """with m as (select image_id, mask_id, count(*) area from mask_px group by 1, 2)
    select *, row_number() over (partition by image_id order by area desc, mask_id) rank from m""",
)
def _(t):
    return wn.area_rank(t.mask_px)


@query(
    "h7_boundary_groups",
    """with f as (select event_id, event_type, user_id % 3 part, case when lag(event_type) over (order by event_id) = event_type
      and lag(user_id % 3) over (order by event_id) = user_id % 3 then 0 else 1 end new from events)
    select event_id, event_type, part, sum(new) over (order by event_id)::bigint group_no from f""",
)
def _(t):
    src = t.events.select("event_id", "event_type", (F.col("user_id") % 3).alias("part"))
    return wn.boundary_groups(src, ["event_type", "part"], ["event_id"])


@query("h8_global_sort", "select path, row_number() over (order by path) position from manifest_path")
def _(t):
    return row_index(t.manifest_path.select("path"), ["path"], name="position").orderBy("path")


# --- I: set operations ------------------------------------------------------------------------------------


@query("i1_union_rows", "select c_custkey id, 'customer' kind from customer union all select s_suppkey, 'supplier' from supplier")
def _(t):
    return st.union_rows(
        [
            t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")),
            t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")),
        ]
    )


@query("i2_mask_or", "select image_id, y, x from fg_px union select image_id, y, x from mask_px where mask_id = 3")
def _(t):
    return st.mask_or(t.fg_px, t.mask_px.where("mask_id = 3"))


@query("i2_mask_and", "select image_id, y, x from fg_px intersect select image_id, y, x from mask_px where mask_id = 3")
def _(t):
    return st.mask_and(t.fg_px, t.mask_px.where("mask_id = 3"))


@query(
    "i3_except_rows",
    "select defect, class from manifest_item where split = 'test' except all select defect, class from manifest_item where defect = 'good'",
)
def _(t):
    m = t.manifest_item
    return st.except_rows(m.where("split = 'test'").select("defect", "class"), m.where("defect = 'good'").select("defect", "class"))


@query(
    "i4_merge_maps",
    """select o_orderkey, case when o_custkey % 10 = 0 then 7 else o_custkey end a, o_orderkey b, 7 c,
      3::bigint n from orders""",
)
def _(t):
    from strayfield.functions.scalar import merge_maps

    left = F.create_map(F.lit("a"), F.col("o_custkey"), F.lit("b"), F.col("o_orderkey"))
    right = F.when(F.col("o_custkey") % 10 == 0, F.create_map(F.lit("a"), F.lit(7).cast("long"), F.lit("c"), F.lit(7).cast("long"))).otherwise(
        F.create_map(F.lit("c"), F.lit(7).cast("long"))
    )
    m = merge_maps(left, right)
    return t.orders.select(
        "o_orderkey", m["a"].alias("a"), m["b"].alias("b"), m["c"].cast("int").alias("c"), F.map_keys(m).alias("k")
    ).select("o_orderkey", "a", "b", "c", F.size("k").cast("long").alias("n"))


@query("i5_distinct_values", "select distinct label from label_map_px")
def _(t):
    return st.distinct_values(t.label_map_px, "label")


@query("i5_distinct_elements", "select l_orderkey, list_sort(list_distinct(list(l_linenumber))) nums from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(st.distinct_elements(F.collect_set("l_linenumber")).alias("nums"))


@query(
    "e15_zip_rows",
    """with a as (select row_number() over (order by p_partkey) position, p_partkey from part),
    b as (select row_number() over (order by c_custkey) position, c_custkey from customer)
    select a.position, p_partkey, c_custkey from a join b on a.position = b.position""",
)
def _(t):
    return st.zip_rows(t.part.select("p_partkey"), t.customer.select("c_custkey"), ["p_partkey"], ["c_custkey"])
