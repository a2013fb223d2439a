"""Access to the given parquet tables, and canonical anomaly tables derived from them.

``VIEWS`` are plain SELECTs over whole base tables. The same text is run by Spark here and inlined as a
CTE by the SQL check, so both sides start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

SIDE = 32  # rasters are SIDE x SIDE

VIEWS: dict[str, str] = {
    "label_map_px": (
        "select l_suppkey image_id, cast(l_partkey % 32 as int) y, cast(l_quantity as int) % 32 x, "
        "max(1 + l_linenumber % 5) label from lineitem group by 1, 2, 3"
    ),
    # label map in which the images of some suppliers show component 4 in place of component 3
    "component_px": (
        "select l_suppkey image_id, cast(l_partkey % 32 as int) y, cast(l_quantity as int) % 32 x, "
        "max(1 + case when s_acctbal < 1000 and l_linenumber % 5 = 2 then 3 else l_linenumber % 5 end) label "
        "from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3"
    ),
    "normal_image": "select s_suppkey image_id from supplier where s_acctbal >= 1000",
    "mask_px": (
        "select distinct l_suppkey image_id, l_linenumber mask_id, cast(l_partkey % 32 as int) y, "
        "cast(l_quantity as int) % 32 x from lineitem"
    ),
    "fg_px": (
        "select distinct l_suppkey image_id, cast(l_partkey % 32 as int) y, cast(l_quantity as int) % 32 x "
        "from lineitem where l_returnflag <> 'N'"
    ),
    "score_px": (
        "select l_suppkey image_id, cast(l_partkey % 32 as int) y, cast(l_quantity as int) % 32 x, "
        "max(l_extendedprice) score, max(l_discount) coarse, "
        "max(case when l_returnflag = 'R' then 1 else 0 end) gt from lineitem group by 1, 2, 3"
    ),
    "image_score": (
        "select d.doc_id image_id, cast(d.n_chars as double) score, l.toxic is_anomaly, l.quality quality, "
        "d.lang dataset from documents d join labels l on d.doc_id = l.doc_id"
    ),
    "bank_vec": "select vec_id, embedding vec, label from embeddings where label < 8",
    "query_vec": (
        "select vec_id, embedding vec, label, vec_id - vec_id % 4 image_id, "
        "case when label >= 8 then 1 else 0 end is_anomaly from embeddings"
    ),
    "instance_rec": (
        "select l_suppkey image_id, l_orderkey instance_id, max(l_quantity) area, 1.0 + max(l_tax) scale, "
        "max(l_discount) * 10 cx, max(l_tax) * 12 cy from lineitem group by 1, 2"
    ),
    "manifest_path": (
        "select p_partkey image_key, concat('/data/', replace(lower(p_brand), '#', ''), '/', "
        "case when p_partkey % 3 = 0 then 'train' else 'test' end, '/', "
        "case when p_partkey % 3 = 0 or p_size < 20 then 'good' else 'defect' end, '/', "
        "lpad(cast(p_partkey as varchar(20)), 7, '0'), '_', cast(p_size % 4 as varchar(5)), '.png') path from part"
    ),
    "manifest_item": (
        "select p_partkey image_id, replace(lower(p_brand), '#', '') class, "
        "case when p_partkey % 3 = 0 then 'train' else 'test' end split, "
        "case when p_partkey % 3 = 0 or p_size < 20 then 'good' else 'defect' end defect from part"
    ),
    "prob_px": (
        "select vec_id - vec_id % 16 image_id, cast((vec_id % 16 - vec_id % 4) / 4 as int) y, "
        "cast(vec_id % 4 as int) x, embedding vec, label gt from embeddings"
    ),
    "grid_vec": (
        "select vec_id - vec_id % 16 image_id, cast((vec_id % 16 - vec_id % 4) / 4 as int) y, "
        "cast(vec_id % 4 as int) x, embedding vec from embeddings"
    ),
}


class Tables:
    """Base tables and views of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        used = [t for t in BASE_TABLES if re.search(rf"\b{t}\b", text)]
        bound = re.sub(rf"\b(from|join)\s+({'|'.join(used)})\b", r"\1 {\2}", text)
        return self.spark.sql(bound, **{t: getattr(self, t) for t in used if "{" + t + "}" in bound})



def with_views(sql: str) -> str:
    """Prefix an oracle statement with the CTEs of the views it mentions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    body = sql.strip()
    if not used:
        return body
    ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in used)
    lowered = body.lower()
    if lowered.startswith("with recursive"):
        return f"with recursive {ctes}, {body[len('with recursive'):].strip()}"
    if lowered.startswith("with"):
        return f"with {ctes}, {body[len('with'):].strip()}"
    return f"with {ctes} {body}"
