"""XMP sidecars: written by expressions from captions, tags, ratings and face regions, and read back by Arrow batches."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# The public namespaces of such files.
SPACES = {
    "x": "adobe:ns:meta/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "mwg-rs": "http://www.metadataworkinggroup.com/schemas/regions/",
    "stArea": "http://ns.adobe.com/xmp/sType/Area#",
    "stDim": "http://ns.adobe.com/xap/1.0/sType/Dimensions#",
    "xml": "http://www.w3.org/XML/1998/namespace",
}
HEAD, TAIL = '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n', '\n<?xpacket end="w"?>\n'
READ = StructType().add("caption", StringType()).add("tags", ArrayType(StringType())).add("rating", IntegerType()).add("people", ArrayType(StringType()))


def _name(short: str) -> str:
    space, _, local = short.partition(":")
    return f"{{{SPACES[space]}}}{local}"


def _grow(parent: ET.Element, *path: str, text: str | None = None, resource: bool = False, **marks: str) -> ET.Element:
    for step in path:
        parent = ET.SubElement(parent, _name(step))
    parent.text = text
    if resource:
        parent.set(_name("rdf:parseType"), "Resource")
    for key, value in marks.items():
        parent.set(_name(key.replace("_", ":")), value)
    return parent


def packet(caption, tags, rating, regions) -> str | None:
    """One sidecar; null when there is no caption, tag or region. Regions are (name, x, y, w, h) around their centre, as shares."""
    tags, regions = [t for t in (tags if tags is not None else ())], list(regions if regions is not None else ())
    if not (caption or tags or regions):
        return None
    for prefix, space in SPACES.items():
        if prefix != "xml":
            ET.register_namespace(prefix, space)
    top = ET.Element(_name("x:xmpmeta"))
    about = _grow(top, "rdf:RDF", "rdf:Description", rdf_about="")
    if caption:
        _grow(about, "dc:description", "rdf:Alt", "rdf:li", text=caption, xml_lang="x-default")
    if tags:
        bag = _grow(about, "dc:subject", "rdf:Bag")
        for t in tags:
            _grow(bag, "rdf:li", text=t)
    if rating is not None and rating == rating:
        _grow(about, "xmp:Rating", text=str(int(rating)))
    if regions:
        faces = _grow(about, "mwg-rs:Regions", resource=True)
        size = _grow(faces, "mwg-rs:AppliedToDimensions", resource=True)
        for key, value in (("w", "1"), ("h", "1"), ("unit", "normalized")):
            _grow(size, f"stDim:{key}", text=value)
        bag = _grow(faces, "mwg-rs:RegionList", "rdf:Bag")
        for face in regions:
            item = _grow(bag, "rdf:li", resource=True)
            _grow(item, "mwg-rs:Name", text=face["name"])
            _grow(item, "mwg-rs:Type", text="Face")
            area = _grow(item, "mwg-rs:Area", resource=True)
            for key in "xywh":
                _grow(area, f"stArea:{key}", text=format(face[key], ".6f"))
            _grow(area, "stArea:unit", text="normalized")
    ET.indent(top)
    return HEAD + ET.tostring(top, encoding="unicode") + TAIL


def contents(text: str | bytes | None) -> tuple:
    """(caption, tags, rating, people) of a sidecar; nothing found where it is null or not well-formed."""
    try:
        top = ET.fromstring(text.encode() if isinstance(text, str) else bytes(text or b""))
    except ET.ParseError:
        return None, [], None, []

    def texts(short, inner=None):
        for node in top.iter(_name(short)):
            found = [(n.text or "") for n in (node.iter(_name(inner)) if inner else [node])]
            yield [t.strip() for t in found if t.strip()]

    captions = [next((li.text.strip() for li in node.iter(_name("rdf:li")) if li.text), None) for node in top.iter(_name("dc:description"))]
    caption = next((c for c in reversed(captions) if c is not None), None)
    ratings = [int(t) for found in texts("xmp:Rating") for t in found if t.isdigit()]
    return caption, [t for found in texts("dc:subject", "rdf:li") for t in found], ratings[-1] if ratings else None, [t for found in texts("mwg-rs:Name") for t in found]


def _safe(text: Column) -> Column:
    """Text as it stands in an element."""
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        text = F.replace(text, F.lit(mark), F.lit(f"&{name};"))
    return text


def _six(x: Column) -> Column:
    """A number with six decimals, rounded by its exact value; a tie goes to the even one."""
    size = F.abs(x.cast("double"))
    scaled, big = size * F.lit(1e6), size * F.lit(134217729.0)  # the product splits `size` into halves that multiply exactly
    high = big - (big - size)
    lost = (high * F.lit(1e6) - scaled) + (size - high) * F.lit(1e6)
    tie = scaled - F.floor(scaled) == 0.5
    whole = F.when(tie & (lost > 0), F.ceil(scaled)).when(tie & (lost < 0), F.floor(scaled)).otherwise(F.rint(scaled)).cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(whole / 1_000_000).cast("string"), F.lit("."), F.lpad((whole % 1_000_000).cast("string"), 6, "0"))


def _element(depth: int, name: str, inner: Column | str, marks: str = "") -> Column:
    """A line with an element that holds text alone; an empty or null text closes it at once."""
    open_, inner = "\n" + "  " * depth + f"<{name}{marks}", F.lit(inner) if isinstance(inner, str) else inner
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(f"{open_} />")).otherwise(F.concat(F.lit(f"{open_}>"), inner, F.lit(f"</{name}>")))


def _around(depth: int, path: list[str], *inner: Column) -> Column:
    """Lines with elements in each other, and `inner` in the last."""
    opens = "".join("\n" + "  " * (depth + i) + f"<{step}>" for i, step in enumerate(path))
    closes = "".join("\n" + "  " * (depth + i) + f"</{step.split(' ')[0]}>" for i, step in reversed(list(enumerate(path))))
    return F.concat(F.lit(opens), *inner, F.lit(closes))


def written(row: Column) -> Column:
    """A sidecar for a struct of caption, tags, rating and regions, by expressions; what `packet` makes of the same values."""
    caption, tags, rating, regions = (row[x] for x in ("caption", "tags", "rating", "regions"))
    resource = ' rdf:parseType="Resource"'

    def listed(items: Column, one) -> Column:
        return F.array_join(F.transform(items, one), "")

    def face(r: Column) -> Column:
        place = [_element(8, f"stArea:{key}", _six(r[key])) for key in "xywh"]
        area = _around(7, [f"mwg-rs:Area{resource}"], *place, _element(8, "stArea:unit", "normalized"))
        return _around(6, [f"rdf:li{resource}"], _element(7, "mwg-rs:Name", _safe(r["name"])), _element(7, "mwg-rs:Type", "Face"), area)

    size = _around(4, [f"mwg-rs:AppliedToDimensions{resource}"], *(_element(5, f"stDim:{k}", v) for k, v in (("w", "1"), ("h", "1"), ("unit", "normalized"))))
    has_caption, has_tags, has_faces = F.coalesce(caption, F.lit("")) != "", F.size(tags) > 0, F.size(regions) > 0
    parts = {
        "description": F.when(has_caption, _around(3, ["dc:description", "rdf:Alt"], _element(5, "rdf:li", _safe(caption), ' xml:lang="x-default"'))),
        "subject": F.when(has_tags, _around(3, ["dc:subject", "rdf:Bag"], listed(tags, lambda t: _element(5, "rdf:li", _safe(t))))),
        "rating": F.when(rating.isNotNull(), _element(3, "xmp:Rating", rating.cast("int").cast("string"))),
        "faces": F.when(has_faces, _around(3, [f"mwg-rs:Regions{resource}"], size, _around(4, ["mwg-rs:RegionList", "rdf:Bag"], listed(regions, face)))),
    }
    # The namespaces that are used stand in the order of their prefixes.
    used = {"dc": has_caption | has_tags, "mwg-rs": has_faces, "rdf": F.lit(True), "stArea": has_faces, "stDim": has_faces, "x": F.lit(True), "xmp": rating.isNotNull()}
    spaces = F.concat(*(F.when(F.coalesce(on, F.lit(False)), F.lit(f' xmlns:{p}="{SPACES[p]}"')).otherwise("") for p, on in used.items()))
    body = F.concat(*(F.coalesce(p, F.lit("")) for p in parts.values()))
    inner = _around(1, ["rdf:RDF", 'rdf:Description rdf:about=""'], body)
    text = F.concat(F.lit(f"{HEAD}<x:xmpmeta"), spaces, F.lit(">"), inner, F.lit(f"\n</x:xmpmeta>{TAIL}"))
    return F.when(F.coalesce(has_caption, F.lit(False)) | F.coalesce(has_tags, F.lit(False)) | F.coalesce(has_faces, F.lit(False)), text)


@F.pandas_udf(READ)
def read(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([contents(t) for t in texts], columns=["caption", "tags", "rating", "people"])
    return out.astype({"rating": "Int32"})


def collected(lib) -> DataFrame:
    """Per photo: the caption that counts, tags (manual first, then by name), rating 5 for favourites, and named faces as regions."""
    from lumenary.operators import filters

    tags = lib.photo_tag.select("photo_id", F.struct(F.when(F.col("source") == "manual", 0).otherwise(1).alias("o"), "name").alias("t"))
    tags = tags.groupBy("photo_id").agg(F.transform(F.array_sort(F.collect_set("t")), lambda t: t["name"]).alias("tags"))
    named = lib.person.select(F.col("id").alias("person_id"), "name")
    faces = lib.face.where("rejected = 0 and src_w > 0 and src_h > 0").join(named, "person_id")
    region = F.struct("name", *(c.alias(n) for c, n in zip(centred(), "xywh")))
    regions = faces.groupBy("photo_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    out = lib.photo.select(F.col("id").alias("photo_id"), F.when(F.col("favorite") == 1, 5).alias("rating"))
    for part in (filters.winner(lib).select("photo_id", "caption"), tags, regions):
        out = out.join(part, "photo_id", "left")
    return out.select(F.col("photo_id").alias("id"), "caption", "tags", "rating", "regions")


def centred():
    """A face's box around its centre, as shares of its picture."""
    return [(F.col("bbox_x") + F.col("bbox_w") / 2) / F.col("src_w"), (F.col("bbox_y") + F.col("bbox_h") / 2) / F.col("src_h"), F.col("bbox_w") / F.col("src_w"), F.col("bbox_h") / F.col("src_h")]


def packets(lib) -> DataFrame:
    """(id, packet): the sidecar of each photo; null where there is nothing to say."""
    return collected(lib).select("id", written(F.struct("caption", "tags", "rating", "regions")).alias("packet"))


def save(rows: DataFrame, overwrite: bool = True) -> DataFrame:
    """Write sidecars (path, packet) where all executors see the paths: (path, state written, skipped or empty).

    A file appears whole, or not at all: it is written under another name first. Null packets write nothing.
    """

    def work(parts):
        import os

        for part in parts:
            states = []
            for path, text in zip(part["path"], part["packet"]):
                if text is None:
                    states.append("empty")
                elif not overwrite and os.path.exists(path):
                    states.append("skipped")
                else:
                    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
                        f.write(text)
                    os.replace(f"{path}.tmp", path)
                    states.append("written")
            yield pd.DataFrame({"path": part["path"], "state": states})

    return rows.select("path", "packet").mapInPandas(work, "path string, state string")


def round_trip(lib) -> DataFrame:
    """What is read back from the sidecar written for each photo."""
    rows = packets(lib).select("id", read("packet").alias("s"))
    return rows.select("id", F.trim(F.regexp_replace("s.caption", r"\s+", " ")).alias("caption"), F.array_join("s.tags", ",").alias("tags"), "s.rating", F.array_join("s.people", ",").alias("people"))


ROUND_TRIP_SQL = """
select p.id, trim(regexp_replace(w.caption, '\\s+', ' ', 'g')) as caption, coalesce(t.tags, '') as tags, case when p.favorite = 1 then 5 end as rating, coalesce(f.people, '') as people from v_photo p
left join (select photo_id, max_by(caption, (case when model = 'manual' then 1e12 else 0 end) + created_at) as caption from v_annotation group by photo_id) w on w.photo_id = p.id
left join (select photo_id, string_agg(name, ',' order by o, name) as tags from (select distinct photo_id, name, case when source = 'manual' then 0 else 1 end as o from v_photo_tag) d group by photo_id) t on t.photo_id = p.id
left join (select photo_id, string_agg(n.name, ',' order by n.name) as people from v_face f join v_person n on n.id = f.person_id where f.rejected = 0 and src_w > 0 and src_h > 0 group by photo_id) f on f.photo_id = p.id
"""
