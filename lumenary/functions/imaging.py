"""What is read out of a picture: perceptual hash of grey pixels, capture time, camera and position from its raw tags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, KEPT = 32, 8

# Dates in file names, tried in order.
NAME_DATES = (
    r"(20\d{2})[-_.]?(\d{2})[-_.]?(\d{2})[ _T-]+(\d{2})[-:.]?(\d{2})[-:.]?(\d{2})",
    r"(20\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})",
    r"(20\d{2})[-_.]?(\d{2})[-_.]?(\d{2})",
)


def _cosines() -> np.ndarray:
    """The first rows of the orthonormal DCT-II; scaling by row does not depend on the pixels."""
    rows, at = np.mgrid[0:KEPT, 0:SIDE]
    out = np.cos((at + 0.5) * rows * np.pi / SIDE) * np.sqrt(2 / SIDE)
    out[0] /= np.sqrt(2)
    return out


def hashes(grey) -> list:
    """Of 32 x 32 grey values in rows: a bit for each of 8 x 8 low frequencies above the median of all but the first; None if there are not 1,024."""
    basis, out = _cosines(), [None] * len(grey)
    right = [i for i, g in enumerate(grey) if g is not None and len(g) == SIDE * SIDE]
    if right:
        pixels = np.stack([np.asarray(grey[i], float) for i in right]).reshape(-1, SIDE, SIDE)
        low = np.einsum("ur,nrc,vc->nuv", basis, pixels, basis, optimize=True).reshape(len(right), -1)
        bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
        for i, h in zip(right, np.packbits(bits, axis=1).view(">i8")[:, 0].tolist()):
            out[i] = h
    return out


def perceptual_hashes(pictures: DataFrame) -> DataFrame:
    """(id, phash) of pictures (id, grey), by Arrow batches."""

    def work(parts):
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "phash": pd.Series(hashes(part["grey"].tolist()), dtype="Int64", index=part.index)})

    return pictures.select(F.col("id").cast("long").alias("id"), "grey").mapInPandas(work, "id long, phash long")


def name_date(name: Column, last_year: Column) -> Column:
    """The time that a file name holds: the first pattern whose first match is a real date from 2000 to `last_year`; else null."""
    tries = []
    for pattern in NAME_DATES:
        groups = range(1, pattern.count("(") + 1)
        digits = F.rpad(F.concat(*(F.regexp_extract(name, pattern, i) for i in groups)), 14, "0")
        at = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))
        tries.append(F.when(F.regexp_like(name, F.lit(pattern)) & F.year(at).between(2000, last_year), at))
    return F.coalesce(*tries)


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Signed decimal degrees; south and west are negative."""
    size = d + m / 60 + s / 3600
    return F.round(F.when(F.upper(ref).isin("S", "W"), -size).otherwise(size), 7)


def photo_meta(tags: DataFrame) -> DataFrame:
    """Metadata from rows of (id, name, mtime in seconds, tags map<string, string>, width, height).

    Blank make and model are null; iso only where it is a whole number; the time is the first of three tags that holds one,
    else the file name's, else mtime, and taken_at_source says which; width and height swap for turned pictures; a
    position at 0, 0 is none.
    """

    def tag(name):
        return F.col("tags")[name]

    def time(name):
        text = F.substring(F.trim(tag(name)), 1, 19)
        return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))

    def text(name):
        return F.nullif(F.trim(tag(name)), F.lit(""))

    def number(name):
        return tag(name).try_cast("double")

    exif = F.coalesce(*(time(t) for t in ("DateTimeOriginal", "DateTimeDigitized", "DateTime")))
    named = name_date(F.col("name"), F.year(F.current_date()) + 1)
    lat, lon = (degrees(number(f"{c}Deg"), number(f"{c}Min"), number(f"{c}Sec"), tag(f"{c}Ref")) for c in ("Latitude", "Longitude"))
    turned = F.coalesce(tag("Orientation").try_cast("int") >= 5, F.lit(False))
    placed = lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    return tags.select(
        "id",
        text("Make").alias("camera_make"),
        text("Model").alias("camera_model"),
        text("LensModel").alias("lens"),
        F.when(F.regexp_like(tag("ISOSpeedRatings"), F.lit(r"^\d+$")), tag("ISOSpeedRatings").try_cast("long")).alias("iso"),
        *(number(t).alias(n) for t, n in (("FNumber", "f_number"), ("ExposureTime", "exposure"), ("FocalLength", "focal_length"))),
        F.coalesce(F.unix_seconds(exif), F.unix_seconds(named), F.col("mtime")).alias("taken_at"),
        F.when(exif.isNotNull(), "exif").when(named.isNotNull(), "filename").otherwise("mtime").alias("taken_at_source"),
        F.when(turned, F.col("height")).otherwise(F.col("width")).alias("width"),
        F.when(turned, F.col("width")).otherwise(F.col("height")).alias("height"),
        F.when(placed, lat).alias("gps_lat"),
        F.when(placed, lon).alias("gps_lon"),
    )


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.expr("""concat(case doc_id % 4 when 0 then 'IMG' when 1 then 'Screenshot ' when 2 then 'x' else '' end, '20', lpad(cast(doc_id % 27 as string), 2, '0'),
          case when doc_id % 3 = 0 then '-' else '' end, lpad(cast(doc_id % 14 as string), 2, '0'), case when doc_id % 3 = 0 then '-' else '' end, lpad(cast(doc_id % 33 as string), 2, '0'),
          case doc_id % 5 when 0 then '' when 1 then '_' when 2 then ' ' when 3 then 'T' else 'z' end, lpad(cast(doc_id % 25 as string), 2, '0'), lpad(cast(doc_id % 61 as string), 2, '0'), lpad(cast(doc_id % 60 as string), 2, '0'), '.jpg')""").alias("name"),
    )


def name_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made from document ids, some of them holding no date, and the time in each."""
    return _names(spark, sf_dir).select("id", "name", F.unix_seconds(name_date(F.col("name"), F.lit(2027))).alias("taken_at"))


_AT = "try_strptime(rpad(concat({}), 14, '0'), '%Y%m%d%H%M%S')"
NAME_DATES_SQL = (
    """select id, name, epoch(coalesce({}))::bigint as taken_at from (select doc_id as id, concat(case doc_id % 4 when 0 then 'IMG' when 1 then 'Screenshot ' when 2 then 'x' else '' end, '20', lpad(cast(doc_id % 27 as varchar), 2, '0'),
          case when doc_id % 3 = 0 then '-' else '' end, lpad(cast(doc_id % 14 as varchar), 2, '0'), case when doc_id % 3 = 0 then '-' else '' end, lpad(cast(doc_id % 33 as varchar), 2, '0'),
          case doc_id % 5 when 0 then '' when 1 then '_' when 2 then ' ' when 3 then 'T' else 'z' end, lpad(cast(doc_id % 25 as varchar), 2, '0'), lpad(cast(doc_id % 61 as varchar), 2, '0'), lpad(cast(doc_id % 60 as varchar), 2, '0'), '.jpg') as name from documents) t"""
).format(", ".join("case when regexp_matches(name, '%s') then %s end" % (p, _AT.format(", ".join(f"regexp_extract(name, '{p}', {i})" for i in range(1, p.count("(") + 1)))) for p in NAME_DATES))


def phash_of_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a picture made from each vector: the products of its two halves."""
    grey = F.expr("flatten(transform(slice(embedding, 1, 32), x -> transform(slice(embedding, 33, 32), y -> cast(x as double) * y)))")
    pictures = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), grey.alias("grey"))
    return perceptual_hashes(pictures).withColumnRenamed("id", "vec_id")


PHASH_SQL = """
with c as (select u, r, cos((r + 0.5) * u * pi() / 32) * sqrt(2.0 / 32) / if(u = 0, sqrt(2), 1) as w from (select unnest(range(8)) as u) a, (select unnest(range(32)) as r) b),
h as (select vec_id, u, sum(w * embedding[r + 1]::double) as a, sum(w * embedding[r + 33]::double) as b from embeddings, c group by vec_id, u),
low as (select x.vec_id, x.u * 8 + y.u as n, x.a * y.b as low from h x join h y on x.vec_id = y.vec_id),
m as (select vec_id, median(low) as mid from low where n > 0 group by vec_id),
s as (select vec_id, sum(if(low > mid, 1::hugeint << (63 - n)::int, 0::hugeint)) as s from low join m using (vec_id) group by vec_id)
select vec_id, (if(s >= 9223372036854775808::hugeint, s - 18446744073709551616::hugeint, s))::bigint as phash from s
"""
