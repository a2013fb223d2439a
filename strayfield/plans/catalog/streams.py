"""Queries of the streaming group: each drains a table as a stream and returns what was written."""

import uuid

from pyspark.sql import functions as F

from strayfield.plans.catalog.metrics import rounded
from strayfield.plans.catalog.neighbours import L2SQ, _hits_sql
from strayfield.plans.registry import query
from strayfield.session import shared_folder
from strayfield.streaming import ops as so


@query(
    "l1_stream_rollup",
    """with f as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end new from events),
    s as (select *, sum(new) over (partition by user_id order by ts) session from f)
    select user_id image_id, epoch_us(min(ts)) start_us, max(value) score, max(case when event_type = 'error' then 1 else 0 end) is_anomaly,
      count(*) instances from s group by user_id, session""",
)
def _(t):
    events = so.read_stream(t.spark, t.folder, "events").select(
        F.col("user_id").alias("image_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("score"),
        (F.col("event_type") == "error").cast("int").alias("is_anomaly"),
    )
    rolled = so.stream_rollup(events, "ts", "6 hours", "1 day")
    out = so.run_available(rolled.withColumn("start_us", F.unix_micros("start")).drop("start"), mode="complete")
    return out.select("image_id", "start_us", "score", "is_anomaly", "instances")


@query("l2_stream_score", _hits_sql(L2SQ, 4, "select query_id, round(avg(distance), 6) score from hits group by 1"))
def _(t):
    vectors = so.read_stream(t.spark, t.folder, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    out = f"{shared_folder(t.spark)}/scores-{uuid.uuid4().hex}"
    so.run_available(vectors, so.score_batch(t.bank_vec, 4, out))
    return rounded(t.spark.read.parquet(out).select("query_id", "score"))


_CELLS = "select unnest(range(64))::int dim, unnest(embedding)::double v from embeddings"


@query("l3_stream_profile", f"select dim, round(least(999, min(v)), 6) lo, round(greatest(-999, max(v)), 6) hi from ({_CELLS}) group by 1")
def _(t):
    return rounded(so.run_available(so.stream_profile(so.read_stream(t.spark, t.folder, "embeddings"), "embedding"), mode="complete"))


@query(
    "l3_stream_histogram",
    f"select dim, least(floor((v + 0.5) / 1.0 * 8), 7)::int bin, count(*) n from ({_CELLS}) where v between -0.5 and 0.5 group by 1, 2",
)
def _(t):
    counts = so.stream_profile(so.read_stream(t.spark, t.folder, "embeddings"), "embedding", -0.5, 0.5, 8)
    return so.run_available(counts, mode="complete")


@query(
    "l4_stream_meter",
    """with b as (select user_id, event_id, ts, ln(1 + value) v, max(value) over (partition by user_id order by ts, event_id) top, value from events)
    select user_id, event_id, round(avg(v) over (partition by user_id order by ts, event_id rows between 19 preceding and current row), 6) moving_avg,
      round(ln(1 + top), 6) best, first_value(event_id) over (partition by user_id, top order by case when value = top then 0 else 1 end, ts, event_id) best_at from b""",
)
def _(t):
    events = so.read_stream(t.spark, t.folder, "events").withColumn("v", F.log1p("value"))
    out = so.run_available(so.stream_meter(events, "user_id", "v", "ts", "event_id"))
    return rounded(out.select(F.col("key").alias("user_id"), F.col("position").alias("event_id"), "moving_avg", "best", "best_at"))
