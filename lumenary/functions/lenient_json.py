"""Annotations out of a model's JSON, also where it broke off or holds a bad escape. SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "struct<caption: string, tags: array<string>, scene: string, setting: string, people_count: long, ocr_text: string>"


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def salvaged(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with the column replaced: the text where it parses; else without broken unicode escapes; else with its open string, arrays and objects closed; else null.

    Each step is a column of its own, so that it is computed once a row.
    """
    text, out = F.col(column), rows
    for name, step in (
        ("_plain", F.regexp_replace(text, r"\\u(?![0-9a-fA-F]{4})", "")),
        ("_cut", F.regexp_replace(F.rtrim(F.col("_plain")), r"\\$", "")),
        ("_closed", F.concat("_cut", F.when(F.regexp_count("_cut", F.lit(r'(?<!\\)"')) % 2 == 1, '"').otherwise(""))),
    ):
        out = out.withColumn(name, step)
    closed = F.col("_closed")
    arrays, objects = (F.greatest(_count(closed, a) - _count(closed, b), F.lit(0)) for a, b in ("[]", "{}"))
    out = out.withColumn("_closed", F.concat(closed, F.repeat(F.lit("]"), arrays), F.repeat(F.lit("}"), objects)))
    return out.withColumn(column, F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), F.col(t)) for t in (column, "_plain", "_closed")))).drop("_plain", "_cut", "_closed")


def annotated(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with the column's JSON as a struct of caption, tags, scene, setting, people_count, ocr_text: trimmed, tags lower-case without blanks, setting `unknown` and count 0 where absent; null if beyond repair."""
    raw = F.col(column)
    plain = {c: F.trim(F.coalesce(raw[c], F.lit(""))) for c in ("caption", "scene", "ocr_text")}
    tags = F.filter(F.transform(F.coalesce(raw["tags"], F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    setting = F.trim(F.when(F.coalesce(raw["setting"], F.lit("")) != "", raw["setting"]).otherwise("unknown"))
    out = F.struct(plain["caption"].alias("caption"), tags.alias("tags"), plain["scene"].alias("scene"), setting.alias("setting"), F.coalesce(raw["people_count"], F.lit(0)).alias("people_count"), plain["ocr_text"].alias("ocr_text"))
    return salvaged(rows, column).withColumn(column, F.from_json(column, FIELDS)).withColumn(column, F.when(raw.isNotNull(), out))


def annotation_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's annotation as a model would send it; every third is cut off within its last string, every fifth in its tags."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sent = F.concat(F.lit('{"caption": " of '), "source", F.lit('", "people_count": 2, "tags": [" '), F.upper("lang"), F.lit('", "", "x"'))
    rest = F.concat(F.lit('], "scene": "a\\uZZb", "ocr_text": "'), F.md5(F.col("doc_id").cast("string")))
    text = F.when(F.col("doc_id") % 5 == 0, sent).when(F.col("doc_id") % 3 == 0, F.concat(sent, rest)).otherwise(F.concat(sent, rest, F.lit('"}')))
    got = annotated(docs.select("doc_id", text.alias("a")), "a")
    return got.select("doc_id", "a.caption", F.array_join("a.tags", ",").alias("tags"), "a.scene", "a.setting", "a.people_count", "a.ocr_text")


SALVAGE_SQL = """
select doc_id, 'of ' || source as caption, lower(lang) || ',x' as tags, case when doc_id % 5 = 0 then '' else 'aZZb' end as scene,
  'unknown' as setting, 2::bigint as people_count, case when doc_id % 5 = 0 then '' else md5(doc_id::varchar) end as ocr_text from documents
"""


def annotation_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that hold the documents' own texts, as JSON writes them, broken off at a place by id: within the caption, after a backslash, within an escape, within a tag, within the read text, before a colon."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (1 + F.col("doc_id") * 37 % 400).alias("k"), (F.col("doc_id") % 7).alias("c"))
    text = F.substring("text", F.lit(1), F.col("k"))
    whole = F.to_json(F.struct(text.alias("caption")))
    open_ = F.substring(whole, F.lit(1), F.length(whole) - 2)  # within the caption
    read = F.to_json(F.struct(text.alias("ocr_text")))
    sent = (
        F.when(F.col("c") == 0, open_)
        .when(F.col("c") == 1, F.concat(open_, F.lit("\\")))
        .when(F.col("c") == 2, F.concat(open_, F.lit("\\u00")))
        .when(F.col("c") == 3, F.concat(open_, F.lit('", "tags": ["One", " Two')))
        .when(F.col("c") == 4, F.concat(open_, F.lit('", "tags": [], '), F.substring(read, F.lit(2), F.length(read) - 3)))
        .when(F.col("c") == 5, F.concat(open_, F.lit('", "scene"')))
        .otherwise(whole)
    )
    got = annotated(docs.select("doc_id", sent.alias("a")), "a")
    return got.select("doc_id", "a.caption", F.array_join("a.tags", ",").alias("tags"), "a.ocr_text")


DAMAGE_SQL = """
select doc_id, case when doc_id % 7 <> 5 then trim(t || if(doc_id % 7 = 2, '00', '')) end as caption, case doc_id % 7 when 5 then null when 3 then 'one,two' else '' end as tags, case doc_id % 7 when 5 then null when 4 then trim(t) else '' end as ocr_text
from (select doc_id, ltrim(substr(text, 1, 1 + doc_id * 37 % 400)) as t from documents) d
"""
