"""What picture files hold, out of their bytes: size, tags, and grey pixels where they aren't behind a lossy code.

JPEG is read by its segments and TIFF, which raw files of cameras are, by its directories: for size and tags. PNG and BMP
are read whole, to grey values. Each file gets a row; one that is broken gets the class of its fault, and what was read
before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 32
DECODED = "id long, kind string, width int, height int, tags map<string, string>, grey array<double>, fault string"

# Fixed values of the formats: tag numbers by directory, and bytes of each type of value.
MAIN = {271: "Make", 272: "Model", 274: "Orientation", 306: "DateTime", 256: "ImageWidth", 257: "ImageLength"}
EXIF = {33434: "ExposureTime", 33437: "FNumber", 34855: "ISOSpeedRatings", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37386: "FocalLength", 42036: "LensModel"}
PLACE = {1: "LatitudeRef", 2: "Latitude", 3: "LongitudeRef", 4: "Longitude"}
EXIF_AT, PLACE_AT = 34665, 34853
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii"}
PASSES = 1 << 28  # pixels of a picture that are decoded, at most


class Fault(Exception):
    """Why a file can't be read: unknown, truncated, damaged, unsupported, too-large."""


def _unpack(form: str, data: bytes, at: int):
    try:
        return struct.unpack_from(form, data, at)
    except struct.error:
        raise Fault("truncated") from None


def _text(kind: int, values) -> str | None:
    """A value as tags are written: text, a whole number, a quotient; several by commas."""
    if kind in (2, 7):
        return values[0].split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        values = [a / b if b else None for a, b in zip(values[::2], values[1::2])]
    return None if None in values else ",".join(map(str, values))


def tiff_tags(data: bytes, start: int = 0) -> dict[str, str]:
    """The tags of a TIFF structure that begins at `start`: of its first directory and of those for the picture and the place."""
    order = {b"II": "<", b"MM": ">"}.get(data[start : start + 2])
    if order is None:
        raise Fault("damaged")
    magic, first = _unpack(order + "HI", data, start + 2)
    if magic != 42:
        raise Fault("unsupported")
    out, todo, seen = {}, [(first, MAIN)], set()
    while todo:
        at, names = todo.pop()
        if at in seen:  # a directory that leads back
            raise Fault("damaged")
        seen.add(at)
        (number,) = _unpack(order + "H", data, start + at)
        for k in range(number):
            entry = start + at + 2 + 12 * k
            tag, kind, count = _unpack(order + "HHI", data, entry)
            form = TYPES.get(kind)
            if form is None or tag not in names and not (names is MAIN and tag in (EXIF_AT, PLACE_AT)):
                continue
            size = struct.calcsize(order + form) * count
            place = entry + 8 if size <= 4 else start + _unpack(order + "I", data, entry + 8)[0]
            if place + size > len(data):
                raise Fault("truncated")
            values = _unpack(f"{order}{count * len(form)}{form[0]}", data, place)
            if tag in (EXIF_AT, PLACE_AT) and names is MAIN:
                todo.append((values[0], EXIF if tag == EXIF_AT else PLACE))
            elif names is PLACE and tag in (2, 4):
                parts = (_text(kind, values) or "").split(",")
                out |= {f"{names[tag]}{unit}": part for unit, part in zip(("Deg", "Min", "Sec"), parts) if len(parts) == 3}
            elif (text := _text(kind, values)) is not None:
                out[names[tag]] = text
    return out


def _jpeg(data: bytes, out: dict) -> None:
    at = 2
    while True:
        mark, code = _unpack("BB", data, at)
        if mark != 0xFF:
            raise Fault("damaged")
        if code == 0xFF:  # filling
            at += 1
            continue
        if code == 0xD9 or code == 0xDA:
            if "width" not in out:
                raise Fault("damaged")
            return
        (size,) = _unpack(">H", data, at + 2)
        if at + 2 + size > len(data):
            raise Fault("truncated")
        if code == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            out["tags"] |= tiff_tags(data[at + 10 : at + 2 + size])
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = _unpack(">HH", data, at + 5)
        at += 2 + size


def _grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue, rounded as usual for eight bits."""
    r, g, b = (pixels[..., k].astype(np.int64) for k in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 32768 >> 16).astype(np.float64)


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """PNG rows (each with its filter first) as bytes; three of the five filters go through a row byte by byte."""
    rows, before = np.zeros((len(raw), raw.shape[1] - 1), np.uint8), np.zeros(raw.shape[1] - 1, np.uint8)
    for y, line in enumerate(raw):
        how, line = line[0], line[1:]
        if how == 0:
            row = line
        elif how == 2:
            row = line + before
        elif how == 1:  # sums along every step-th byte
            row = line.copy()
            for k in range(step):
                row[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif how in (3, 4):
            row, up, new = line.tolist(), before.tolist(), [0] * len(line)
            for x, value in enumerate(row):
                a, b = new[x - step] if x >= step else 0, up[x]
                if how == 3:
                    guess = a + b >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                new[x] = value + guess & 255
            row = np.array(new, np.uint8)
        else:
            raise Fault("damaged")
        rows[y] = before = row
    return rows


def _png(data: bytes, out: dict) -> None:
    at, packed, palette, head = 8, [], None, None
    while True:
        size, name = _unpack(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise Fault("truncated")
        if zlib.crc32(name + body) != _unpack(">I", data, at + 8 + size)[0]:
            raise Fault("damaged")
        if name == b"IHDR":
            head = _unpack(">IIBBBBB", body, 0)
            out["width"], out["height"] = head[:2]
        elif name == b"PLTE" and size % 3 == 0:
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"eXIf":
            out["tags"] |= tiff_tags(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise Fault("damaged")
    width, height, depth, colour, _, _, laced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (1, 2, 4, 8, 16) or colour == 3 and palette is None or not width * height:
        raise Fault("damaged")
    if laced:
        raise Fault("unsupported")
    if width * height > PASSES:
        raise Fault("too-large")
    line = -(-width * channels * depth // 8)
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), (line + 1) * height)
    except zlib.error:
        raise Fault("damaged") from None
    if len(raw) < (line + 1) * height:
        raise Fault("truncated")
    rows = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, line + 1), max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        rows = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)
        rows = rows if colour == 3 else (rows.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    pixels = rows.reshape(height, width, channels)
    if colour == 3:
        if pixels.max(initial=0) >= len(palette):
            raise Fault("damaged")
        pixels = palette[pixels[..., 0]]
    out["pixels"] = _grey(pixels) if pixels.shape[2] >= 3 else pixels[..., 0].astype(np.float64)


def _bmp(data: bytes, out: dict) -> None:
    (start,) = _unpack("<I", data, 10)
    size, width, height, _, depth, how = _unpack("<IiiHHI", data, 14)
    out["width"], out["height"] = width, abs(height)
    if size < 40 or width <= 0 or not height:
        raise Fault("damaged")
    if how != 0 or depth not in (8, 24, 32):
        raise Fault("unsupported")
    if width * abs(height) > PASSES:
        raise Fault("too-large")
    line = -(-width * depth // 32) * 4
    if start + line * abs(height) > len(data):
        raise Fault("truncated")
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    if depth == 8:
        if start < 14 + size:
            raise Fault("damaged")
        palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size)
        palette = palette[: len(palette) // 4 * 4].reshape(-1, 4)
        if rows.max(initial=0) >= len(palette):
            raise Fault("damaged")
        rows = palette[rows[..., 0]]
    out["pixels"] = _grey(rows[::-1 if height > 0 else 1, :, 2::-1])


def _tiff(data: bytes, out: dict) -> None:
    out["tags"] |= tiff_tags(data)
    if not {"ImageWidth", "ImageLength"} <= out["tags"].keys():
        raise Fault("damaged")
    out["width"], out["height"] = (int(out["tags"].pop(t)) for t in ("ImageWidth", "ImageLength"))


KINDS = ((b"\xff\xd8\xff", "jpeg", _jpeg), (b"\x89PNG\r\n\x1a\n", "png", _png), (b"BM", "bmp", _bmp), (b"II*\0", "tiff", _tiff), (b"MM\0*", "tiff", _tiff))


def _weights(size: int) -> np.ndarray:
    """SIDE x size: windowed sinc of three lobes, as wide as the reduction asks for; each row sums to one."""
    scale = max(1.0, size / SIDE)
    away = (np.arange(size) + 0.5 - ((np.arange(SIDE) + 0.5) * size / SIDE)[:, None]) / scale
    w = np.where(np.abs(away) < 3, np.sinc(away) * np.sinc(away / 3), 0)
    return w / w.sum(1, keepdims=True)


def small(pixels: np.ndarray) -> np.ndarray:
    """32 x 32 grey values of a picture, in whole numbers of 0 to 255 after each direction."""
    across = np.clip(np.rint(pixels @ _weights(pixels.shape[1]).T), 0, 255)
    return np.clip(np.rint(_weights(pixels.shape[0]) @ across), 0, 255)


def read(data: bytes | None) -> dict:
    """kind, width, height, tags, grey and fault of a file's bytes."""
    out = {"kind": None, "width": None, "height": None, "tags": {}, "grey": None, "fault": None}
    found = {"tags": out["tags"]}
    try:
        for start, kind, parse in KINDS:
            if data is not None and data.startswith(start):
                out["kind"] = kind
                parse(data, found)
                break
        else:
            raise Fault("unknown" if data else "empty")
        if "pixels" in found and found["pixels"].size:
            out["grey"] = small(found["pixels"]).ravel().tolist()
    except Fault as e:
        out["fault"] = str(e)
    return out | {k: found[k] for k in ("width", "height") if k in found}


def decoded(files: DataFrame) -> DataFrame:
    """(id, kind, width, height, tags, grey, fault) of `files` (id, content): one row for each; null and empty content are a fault, `empty`.

    grey: 1,024 values for `imaging.perceptual_hashes`; tags: for `imaging.photo_meta`.
    """

    def run(batches):
        import pyarrow as pa

        kinds = {"kind": pa.string(), "width": pa.int32(), "height": pa.int32(), "tags": pa.map_(pa.string(), pa.string()), "grey": pa.list_(pa.float64()), "fault": pa.string()}
        for batch in batches:
            for at in range(batch.num_rows):  # a picture at a time: its pixels are all that is held
                row = read(batch.column(1)[at].as_py())
                row["tags"] = list(row["tags"].items())
                yield pa.record_batch([batch.column(0).slice(at, 1), *(pa.array([row[n]], k) for n, k in kinds.items())], names=["id", *kinds])

    return files.select(F.col("id").cast("long").alias("id"), "content").mapInArrow(run, DECODED)
