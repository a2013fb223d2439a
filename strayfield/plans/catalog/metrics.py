"""Queries of the score and ranking-metric group."""

from pyspark.sql import functions as F

from strayfield.functions.scalar import signed_round
from strayfield.operators import metrics as m
from strayfield.operators import neighbours as nn
from strayfield.plans.catalog.neighbours import L2SQ, _hits_sql
from strayfield.plans.registry import query


def rounded(df, digits=6, skip=()):
    kinds = dict(df.dtypes)
    return df.select(*[signed_round(c, digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns])


# one curve as SQL: {src} has columns score, y and optionally grp
_CURVE = """
cnt as (select {grp} grp, cast(score as double) threshold, sum(y)::bigint pos, sum(1 - y)::bigint neg from src group by 1, 2),
crv as (
  select *, sum(pos) over (partition by grp order by threshold desc)::double tp,
    sum(neg) over (partition by grp order by threshold desc)::double fp,
    sum(pos) over (partition by grp)::double p, sum(neg) over (partition by grp)::double n from cnt)"""

_AREA = "sum(neg * (tp - pos / 2)) / nullif(max(p) * max(n), 0)"
_AP = "sum(pos * tp / (tp + fp)) / nullif(max(p), 0)"
_F1 = "2.0::double * tp / (tp + fp + p)"


def curve_sql(src: str, tail: str, grp: str = "1") -> str:
    return f"with src as ({src}), {_CURVE.format(grp=grp).strip()} {tail}"


_IMAGES = "select score, is_anomaly y, dataset from image_score"
_COARSE = "select coarse score, gt y, image_id from score_px"

_AUROC_TAIL = f"select round({_AREA}, 6) auroc from crv"


@query(
    "e7_knn_image_auroc",
    _hits_sql(
        L2SQ,
        4,
        f""", v as (select query_id, avg(distance) score from hits group by 1),
        src as (select q.image_id, max(v.score) score, max(q.is_anomaly) y from v join query_vec q on v.query_id = q.vec_id group by 1),
        {_CURVE.format(grp='1').strip()} select round({_AREA}, 6) auroc, count(*) thresholds from crv""",
    ),
)
def _(t):
    scored = nn.knn_score(t.query_vec, t.bank_vec, 4).withColumnRenamed("query_id", "vec_id")
    images = m.rollup_instances(scored.join(t.query_vec.drop("vec"), "vec_id"))
    return rounded(m.curve(images).agg(m._area().alias("auroc"), F.count(F.lit(1)).alias("thresholds")))


@query("f1_image_score", "select image_id, max(score) score from score_px group by 1")
def _(t):
    return m.image_score(t.score_px)


@query(
    "f2_image_score_topk",
    """select image_id, round(avg(score), 6) score from (
      select image_id, score, row_number() over (partition by image_id order by score desc, y, x) rn from score_px)
    where rn <= 5 group by 1""",
)
def _(t):
    return rounded(m.image_score_topk(t.score_px, 5, tie=["y", "x"]))


@query(
    "f3_rollup_instances",
    "select l_orderkey image_id, max(l_extendedprice) score, max(case when l_returnflag = 'R' then 1 else 0 end) is_anomaly "
    "from lineitem group by 1",
)
def _(t):
    inst = t.lineitem.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_anomaly"),
    )
    return m.rollup_instances(inst)


@query(
    "f4_ensemble",
    """with s as (
      select doc_id, 'chars' model, cast(n_chars as double) score from documents
      union all select doc_id, 'words' model, cast(length(text) - length(replace(text, ' ', '')) as double) from documents),
    sp as (select model, min(score) lo, max(score) hi from s group by 1)
    select doc_id, round(avg((score - lo) / nullif(hi - lo, 0)), 6) score from s join sp on s.model = sp.model group by 1""",
)
def _(t):
    chars = t.documents.select("doc_id", F.lit("chars").alias("model"), F.col("n_chars").cast("double").alias("score"))
    words = t.documents.select(
        "doc_id",
        F.lit("words").alias("model"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("score"),
    )
    return rounded(m.ensemble(chars.unionByName(words), ["doc_id"]))


@query("f5_roc_curve", curve_sql(_COARSE, "select threshold, round(fp / n, 6) fpr, round(tp / p, 6) tpr from crv"))
def _(t):
    return rounded(m.roc_curve(t.score_px, "coarse", "gt"))


@query("f6_auroc", curve_sql(_IMAGES, f"select grp dataset, round({_AREA}, 6) auroc from crv group by 1", "dataset"))
def _(t):
    return rounded(m.auroc(t.image_score, by=["dataset"]))


@query("f6_auroc_ties", curve_sql(_COARSE, _AUROC_TAIL))
def _(t):
    return rounded(m.auroc(t.score_px, "coarse", "gt"))


@query(
    "f7_pr_curve",
    curve_sql(_IMAGES, "select threshold, round(tp / (tp + fp), 6) \"precision\", round(tp / p, 6) recall from crv"),
)
def _(t):
    return rounded(m.pr_curve(t.image_score))


@query("f8_average_precision", curve_sql(_IMAGES, f"select grp dataset, round({_AP}, 6) ap from crv group by 1", "dataset"))
def _(t):
    return rounded(m.average_precision(t.image_score, by=["dataset"]))


@query(
    "f9_auc_pr",
    curve_sql(
        _IMAGES,
        """, pts as (select *, tp / (tp + fp) pr, lag(tp / (tp + fp), 1, 1.0) over (order by threshold desc) before from crv)
        select round(sum(pos * (pr + before) / 2) / max(p), 6) auc_pr from pts""",
    ),
)
def _(t):
    return rounded(m.auc_pr(t.image_score))


@query(
    "f10_best_f1",
    curve_sql(
        _IMAGES,
        f"select grp dataset, round(max({_F1}), 6) f1, -max(struct_pack(f := {_F1}, t := -threshold)).t threshold from crv group by 1",
        "dataset",
    ),
)
def _(t):
    return rounded(m.best_f1(t.image_score, by=["dataset"]))


@query(
    "f11_error_shares",
    curve_sql(
        _IMAGES,
        f""", th as (select grp, -max(struct_pack(f := {_F1}, t := -threshold)).t threshold from crv group by 1)
        select dataset, round(avg(case when score >= threshold and y = 0 then 1.0::double else 0 end), 6) fp_share,
          round(avg(case when score < threshold and y = 1 then 1.0::double else 0 end), 6) fn_share
        from src join th on dataset = grp group by 1""",
        "dataset",
    ),
)
def _(t):
    best = m.best_f1(t.image_score, by=["dataset"])
    return rounded(m.error_shares(t.image_score, best, by=["dataset"]))


_SCOPES = """select 'all' sc, score, gt y from score_px union all
  select 'anomalous' sc, score, gt y from score_px
  where image_id in (select image_id from score_px where gt > 0)"""


@query(
    "f12_pixel_metrics",
    curve_sql(
        _SCOPES,
        f""", best as (select grp, {_AREA} auroc, {_AP} ap,
          max(struct_pack(f := {_F1}, t := -threshold, tp := tp, fp := fp, p := p, n := n)) b from crv group by 1)
        select grp as scope, round(auroc, 6) auroc, round(ap, 6) ap, round(b.f, 6) f1, -b.t threshold,
          round(b.fp / (b.p + b.n), 6) fp_share, round((b.p - b.tp) / (b.p + b.n), 6) fn_share from best""",
        "sc",
    ),
)
def _(t):
    return rounded(m.pixel_metrics(t.score_px))


_FAMILY = """select score, case when is_anomaly = 0 then 'good' when quality = 0 then 'logical' else 'structural' end family
  from image_score"""


@query(
    "f14_auroc_by_family",
    curve_sql(
        f"""select score, f.family, 0 y from ({_FAMILY}) s cross join (values ('logical'), ('structural')) f(family)
          where s.family = 'good' union all select score, family, 1 y from ({_FAMILY}) where family <> 'good'""",
        f"select grp family, round({_AREA}, 6) auroc from crv group by 1",
        "family",
    ),
)
def _(t):
    family = (
        F.when(F.col("is_anomaly") == 0, "good").when(F.col("quality") == 0, "logical").otherwise("structural")
    )
    return rounded(m.auroc_by_family(t.image_score.withColumn("family", family), ["logical", "structural"]))


@query(
    "f30_latency",
    """with gaps as (select epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) gap from events)
    select round(avg(gap / 1e6), 4) mean, round(stddev_pop(gap / 1e6), 4) std from gaps""",
)
def _(t):
    from strayfield.operators.windows import gap_seconds

    return rounded(m.latency(gap_seconds(t.events, "ts", ["user_id"], ["event_id"]), "gap"), 4)
