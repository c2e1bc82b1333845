"""Encoded pictures made of the fixture's photos: the bytes that `pictures` reads back, some of them broken."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions import imaging
from lumenary.sources import pictures

SIDE = pictures.SIDE


def tiff(main: dict, exif: dict, place: dict, order: str = "<") -> bytes:
    """Tag numbers to values: text, a whole number, or a list of quotients as pairs."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8))

    def directory(entries: dict) -> None:
        at = len(out)
        rest = at + 2 + 12 * len(entries) + 4
        head, tail = bytearray(struct.pack(order + "H", len(entries))), bytearray()
        for tag, value in sorted(entries.items()):
            if isinstance(value, str):
                kind, count, data = 2, len(value.encode()) + 1, value.encode() + b"\0"
            elif isinstance(value, list):
                kind, count, data = 5, len(value), b"".join(struct.pack(order + "II", *v) for v in value)
            else:
                kind, count, data = 4, 1, struct.pack(order + "I", value)
            head += struct.pack(order + "HHI", tag, kind, count)
            if len(data) <= 4:
                head += data.ljust(4, b"\0")
            else:
                head += struct.pack(order + "I", rest + len(tail))
                tail += data
        out.extend(head + struct.pack(order + "I", 0) + tail)

    # where the others begin is known once the first one is measured
    links = {pictures.EXIF_AT: 0, pictures.PLACE_AT: 0}
    first = len(out)
    directory(main | links)
    at = {pictures.EXIF_AT: len(out)}
    directory(exif)
    at[pictures.PLACE_AT] = len(out)
    directory(place)
    for k, tag in enumerate(sorted(main | links)):
        if tag in at:
            struct.pack_into(order + "I", out, first + 2 + 12 * k + 8, at[tag])
    return bytes(out)


def png(rows: list[bytes], width: int, colour: int = 0, depth: int = 8, tags: bytes | None = None, palette: bytes | None = None) -> bytes:
    """Rows of raw bytes; each row takes the next of the five filters."""
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    body, before = bytearray(), bytes(len(rows[0]))
    for y, row in enumerate(rows):
        how = y % 5
        body.append(how)
        for x, v in enumerate(row):
            a, b, c = row[x - step] if x >= step else 0, before[x], before[x - step] if x >= step else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            body.append(v - (0, a, b, (a + b) // 2, paeth)[how] & 255)
        before = row

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0))
    data = zlib.compress(bytes(body))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"eXIf", tags) if tags else b"") + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


def bmp(pixels: list[list[tuple]], down: bool = False) -> bytes:
    """Pixels as (red, green, blue), from the top; stored from the bottom unless `down`."""
    width, height = len(pixels[0]), len(pixels)
    rows = [b"".join(bytes(p[::-1]) for p in row).ljust(-(-width * 24 // 32) * 4, b"\0") for row in (pixels if down else pixels[::-1])]
    body = b"".join(rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, -height if down else height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def jpeg(width: int, height: int, tags: bytes) -> bytes:
    """The segments up to the coded data, which is left out."""
    part = lambda code, data: b"\xff" + bytes([code]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xE1, b"Exif\0\0" + tags) + b"\xff" + part(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0") + part(0xDA, b"\1\1\0\0\x3f\0") + b"\0\xff\xd9"


def encoded(id_: int, make: str | None, model: str | None, taken: int | None, place: bool) -> bytes:
    """A photo's file: PNG (grey, colour), BMP, JPEG or TIFF by its id; some cut off, damaged, or no picture at all."""
    main = {274: id_ % 8 + 1} | ({271: make} if make else {}) | ({272: f" {model} "} if model else {})
    exif = {33437: [(28, 10)], 34855: 100 * (id_ % 4 + 1)}
    if taken is not None:
        exif[36867] = datetime.fromtimestamp(taken, timezone.utc).strftime("%Y:%m:%d %H:%M:%S")
    where = {1: "S" if id_ % 2 else "N", 2: [(id_ % 90, 1), (id_ % 60, 1), (id_ % 37 * 10, 10)], 3: "E", 4: [(id_ % 180, 1), (0, 1), (0, 1)]} if place else {}
    value = lambda x, y: (7 * x + 3 * y + id_) % 256
    kind = id_ % 5
    if kind == 4:
        main |= {256: 400 + id_ % 50, 257: 300}
    tags = tiff(main, exif, where, ">" if id_ % 3 else "<")
    if kind == 0:
        data = png([bytes(value(x, y) for x in range(SIDE)) for y in range(SIDE)], SIDE, tags=tags)
    elif kind == 1:
        data = png([bytes(v for x in range(SIDE) for v in (value(x, y),) * 3) for y in range(SIDE)], SIDE, 2, tags=tags)
    elif kind == 2:
        data = bmp([[(value(x, y),) * 3 for x in range(SIDE)] for y in range(SIDE)], id_ % 4 == 0)
    else:
        data = jpeg(400 + id_ % 50, 300, tags) if kind == 3 else tags
    if id_ % 23 == 0:
        return b"no picture"
    return data[: len(data) // 3] if id_ % 19 == 0 else data


def files(lib) -> DataFrame:
    """(id, name, mtime, content) of the fixture's photos."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [encoded(*row) for row in zip(*(c.to_pylist() for c in batch.columns[:5]))]
            yield pa.record_batch([batch.column(0), pa.array([f"IMG_{i}.bin" for i in batch.column(0).to_pylist()]), batch.column(5), pa.array(made, pa.binary())], names=["id", "name", "mtime", "content"])

    return lib.photo.select("id", "camera_make", "camera_model", "taken_at", F.col("gps_lat").isNotNull().alias("place"), F.col("created_at").alias("mtime")).mapInArrow(run, "id long, name string, mtime long, content binary")


def read_back(lib) -> DataFrame:
    """What is read of these files: kind, fault, size as shown, camera, time, place, and the sum of grey values.

    Of a cut file kind and fault alone: how much else is found depends on where its parts lie.
    """
    from lumenary.sources.shared import checkpoint

    made = checkpoint(files(lib))
    found = checkpoint(pictures.decoded(made.select("id", "content")))
    meta = imaging.photo_meta(found.join(made.select("id", "name", "mtime"), "id").select("id", "name", "mtime", "tags", "width", "height"))
    total = F.aggregate("grey", F.lit(0.0), lambda a, x: a + x).cast("long")
    cut = F.col("fault") == "truncated"
    meta = meta.join(found.select("id", F.coalesce(cut, F.lit(False)).alias("cut")), "id").select("id", *(F.when(~F.col("cut"), F.col(c)).alias(c) for c in meta.columns if c != "id"))
    return found.select("id", "kind", "fault", total.alias("grey_total")).join(meta, "id").select("id", "kind", "fault", "grey_total", "width", "height", "camera_make", "camera_model", "iso", "f_number", "taken_at", "taken_at_source", "gps_lat", "gps_lon")


READ_BACK_SQL = """
with p as (select *, id % 5 as k, id % 5 <> 2 as tagged, id % 8 + 1 >= 5 and id % 5 <> 2 as turned from v_photo),
g as (select i as r, sum((7 * x + 3 * y + i) % 256) as total from (select unnest(range(256)) as i) a, (select unnest(range(32)) as x) b, (select unnest(range(32)) as y) c group by i)
select p.id, case k when 0 then 'png' when 1 then 'png' when 2 then 'bmp' when 3 then 'jpeg' else 'tiff' end as kind, null::varchar as fault,
  case when k < 3 then g.total end::bigint as grey_total, if(turned, if(k < 3, 32, 300), if(k < 3, 32, 400 + p.id % 50))::int as width, if(turned, if(k < 3, 32, 400 + p.id % 50), if(k < 3, 32, 300))::int as height,
  case when tagged then camera_make end as camera_make, case when tagged then camera_model end as camera_model, case when tagged then 100 * (p.id % 4 + 1) end::bigint as iso, case when tagged then 2.8::double end as f_number,
  case when tagged then coalesce(taken_at, created_at) else created_at end::bigint as taken_at, case when tagged and taken_at is not null then 'exif' else 'mtime' end as taken_at_source,
  case when tagged and gps_lat is not null and (p.id % 90 + p.id % 60 + p.id % 37 + p.id % 180 > 0) then round((p.id % 90 + (p.id % 60) / 60 + (p.id % 37) / 3600) * if(p.id % 2 = 1, -1, 1), 7) end as gps_lat,
  case when tagged and gps_lat is not null and (p.id % 90 + p.id % 60 + p.id % 37 + p.id % 180 > 0) then (p.id % 180)::double end as gps_lon
from p join g on g.r = p.id % 256 where p.id % 19 <> 0 and p.id % 23 <> 0
union all
select id, null, 'unknown', null, null, null, null, null, null, null, created_at, 'mtime', null, null from p where id % 23 = 0
union all
select id, case k when 0 then 'png' when 1 then 'png' when 2 then 'bmp' when 3 then 'jpeg' else 'tiff' end, 'truncated', null, null, null, null, null, null, null, null, null, null, null from p where id % 19 = 0 and id % 23 <> 0
"""
