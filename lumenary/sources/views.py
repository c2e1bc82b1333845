"""The media library as views over the driver tables, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


VIEWS = {
    "v_volume": """
select cast(r_regionkey as bigint)+1 as id, md5(r_name) as uuid, r_name as label,
       case when r_regionkey = 3 then 0 else 1 end as online from region
""",
    "v_root": """
select cast(n_nationkey as bigint)+1 as id, cast(n_regionkey as bigint)+1 as volume_id, lower(n_name) as rel_path, n_name as label from nation
""",
    "v_file": """
select doc_id as id, md5(text) as blake3, doc_id % 25 + 1 as root_id,
  'IMG_' || cast(doc_id - doc_id % 2 as string) || case doc_id % 4 when 0 then '.NEF' when 1 then '.jpg' when 2 then '.png' else '.JPG' end as filename,
  lang || '/' || source || '/IMG_' || cast(doc_id - doc_id % 2 as string) || case doc_id % 4 when 0 then '.NEF' when 1 then '.jpg' when 2 then '.png' else '.JPG' end as rel_path,
  1704067200 + doc_id * 600 as mtime, n_chars as size,
  case when doc_id % 17 = 0 then 'missing' when doc_id % 11 = 0 then 'offline' else 'present' end as state
from documents
""",
    "v_ident": """
select blake3, min(id) as photo_id, min(size) as bytes from v_file group by blake3
""",
    "v_photo": """
select i.photo_id as id, i.blake3, i.bytes,
  case when i.photo_id % 13 = 0 then null else 1704067200 + i.photo_id * 43200 end as taken_at,
  p.p_brand as camera_make, p.p_type as camera_model,
  case when i.photo_id % 3 = 0 then cast(i.photo_id % 90 as double) end as gps_lat,
  case when i.photo_id % 3 = 0 then cast(i.photo_id % 180 as double) end as gps_lon,
  n.n_name as place_name, case when i.photo_id % 7 = 0 then 1 else 0 end as favorite,
  coalesce(l.toxic, 0) as hidden, 1704067200 + i.photo_id as created_at
from v_ident i left join part p on p.p_partkey = i.photo_id % 200
left join nation n on n.n_nationkey = i.photo_id % 25 left join labels l on l.doc_id = i.photo_id
""",
    "v_annotation": """
select d.doc_id as photo_id, substr(d.text, 1, 120) as caption, d.lang as scene, substr(d.text, 121) as ocr_text,
  'm1' as model, 1704067200 + d.doc_id as created_at from documents d join v_ident i on i.photo_id = d.doc_id
union all
select i.photo_id, 'edited ' || cast(i.photo_id as string), 'edited', '', 'manual', 1704000000 + i.photo_id
from v_ident i join labels l on l.doc_id = i.photo_id where l.quality = 0
""",
    "v_photo_tag": """
select d.doc_id as photo_id, d.lang as name, 'ai' as source from documents d join v_ident i on i.photo_id = d.doc_id
union all
select d.doc_id, lower(d.source), 'ai' from documents d join v_ident i on i.photo_id = d.doc_id
union all
select d.doc_id, d.lang, 'manual' from documents d join v_ident i on i.photo_id = d.doc_id where d.doc_id % 5 = 0
""",
    "v_person": """
select cast(r_regionkey as bigint)+1 as id, r_name as name from region where r_regionkey < 4
""",
    "v_face": """
select vec_id + 1 as id, cast((vec_id - vec_id % 600) / 4 as bigint) + vec_id % 150 as photo_id,
  case when label < 4 and vec_id % 3 = 0 then cast(label as bigint) + 1 end as person_id,
  case when label >= 4 and vec_id % 4 = 0 and vec_id % 29 <> 0 then cast(label as bigint) end as cluster_id,
  case when label < 4 and vec_id % 3 = 0 then 1 else 0 end as confirmed,
  case when vec_id % 29 = 0 then 1 else 0 end as rejected,
  case when vec_id % 29 = 0 and vec_id % 2 = 0 then cast(label as bigint) end as ignored_as,
  100 + (vec_id % 150) * 3 + cast((vec_id % 600 - vec_id % 150) / 150 as bigint) * 7 + (cast((vec_id % 600 - vec_id % 150) / 150 as bigint) % 2) * 400 as bbox_x,
  100 + vec_id % 7 as bbox_y, 200 - cast((vec_id % 600 - vec_id % 150) / 150 as bigint) * 5 as bbox_w, 200 as bbox_h,
  cast(vec_id % 50 as double) as det_score,
  case when vec_id % 31 = 0 then null else 1600 end as src_w, case when vec_id % 31 = 0 then null else 1200 end as src_h
from embeddings
""",
    "v_job": """
select event_id as id, event_id as photo_id,
  case event_type when 'view' then 'thumbs' when 'click' then 'embed' when 'purchase' then 'faces' else 'caption' end as stage,
  case event_id % 5 when 0 then 'done' when 1 then 'running' when 2 then 'failed' else 'pending' end as state,
  100 - user_id % 3 as priority, event_id % 7 as attempts from events
""",
}


def with_views(body: str) -> str:
    """`body` with the views that it needs before it, in order of dependency."""
    body = body.strip()
    need, text = [], body
    for name in reversed(list(VIEWS)):
        if name in text:
            need.insert(0, name)
            text += VIEWS[name]
    if not need:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes},\n{body[len(start):]}"
    return f"WITH {ctes}\n{body}"


BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A query over the views; only the driver tables that it names are opened."""
    sql = with_views(body)
    for name in BASE:
        if re.search(rf"\b{name}\b", sql):
            base(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)
