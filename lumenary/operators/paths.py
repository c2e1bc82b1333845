"""Names, folders, drives and places of files: pure functions of columns, and the tables made with them."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("readable_paths", "sidecar_targets", "crops")

# Extensions of pictures and raw pictures, what a walk leaves out.
PICTURES = "jpg jpeg png webp heic heif gif bmp tif tiff avif".split()
RAW = "cr2 cr3 nef arw dng orf rw2 raf pef".split()
LEFT_OUT = ["*/.*", "*/@eaDir/*", "*/Thumbs.db", "*/.thumbnails/*", "*/node_modules/*", "*/$RECYCLE.BIN/*", "*/System Volume Information/*", "*/lost+found/*"]


def stem_and_extension(name: Column) -> tuple[Column, Column]:
    """In lower case; both empty for a name without a dot."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    return F.regexp_extract(lower, r"^(.*)\.[^.]*$", 1), F.regexp_extract(lower, r"\.([^.]*)$", 1)


def format_groups(files: DataFrame, group: str) -> DataFrame:
    """Groups of files (`group`, filename) that are one picture in several formats: one stem, no extension twice, one raw or HEIC."""
    stem, ext = stem_and_extension(F.col("filename"))
    rows = files.select(group, stem.alias("stem"), ext.alias("ext")).groupBy(group)
    out = rows.agg(F.count("*").alias("n"), F.count_distinct("stem").alias("stems"), F.count_distinct("ext").alias("exts"), F.count_if(F.col("stem") == "").alias("blank"), F.count_if(F.col("ext").isin([*RAW, "heic", "heif"])).alias("raw"))
    return out.where("n >= 2 and blank = 0 and stems = 1 and exts = n and raw > 0").select(group, "n")


def human_bytes(n: Column) -> Column:
    """1.5 KB, 3.0 MB, halves to the even digit; whole bytes below 1,024; a dash for none."""
    def shown(unit: str, size: int) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(n / size, 1))

    out = shown("GB", 1024**3)
    for unit, size in (("MB", 1024**2), ("KB", 1024)):
        out = F.when(n < 1024 * size, shown(unit, size)).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "-").when(n < 1024, F.format_string("%.0f B", n.cast("double"))).otherwise(out)


def parent_folder(path: Column) -> Column:
    """The folder that a relative path is in; a dot at the top."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(folder == "", ".").otherwise(folder)


def thumb_path(digest: Column, kind: str, ext: str = "webp") -> Column:
    """Two levels of folders by the first four letters of the hash."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(f"_{kind}.{ext}"))


def beside(path: Column) -> Column:
    """A sidecar next to its picture; the whole name stays."""
    return F.concat(path, F.lit(".xmp"))


def in_app_folder(base: str, drive: Column, path: Column) -> Column:
    """A sidecar in the app's own folder, which mirrors the drive's; of the drive's name letters, digits, -, _ and blanks stay."""
    safe = F.trim(F.regexp_replace(F.coalesce(drive, F.lit("unknown")), r"[^\p{L}\p{N}_ -]", "_"))
    return F.concat(F.lit(base.rstrip("/") + "/"), F.when(safe == "", "drive").otherwise(safe), F.lit("/"), beside(path))


def sidecar_targets(lib, mode: str = "app", base: str = "app") -> DataFrame:
    """(id, path): where each photo's sidecar goes, by its first file; beside the picture, or in the app's folder."""
    volumes = lib.volume.select(F.col("id").alias("volume_id"), F.col("label").alias("drive"))
    roots = F.broadcast(lib.root.select(F.col("id").alias("root_id"), "volume_id").join(volumes, "volume_id"))
    first = lib.file.groupBy("blake3").agg(F.min_by(F.struct("root_id", "rel_path"), "id").alias("f")).select("blake3", "f.*")
    rows = lib.photo.select("id", "blake3").join(first, "blake3").join(roots, "root_id", "left")
    return rows.select("id", (beside(F.col("rel_path")) if mode == "beside" else in_app_folder(base, F.col("drive"), F.col("rel_path"))).alias("path"))


def readable_paths(lib, there: DataFrame) -> DataFrame:
    """(id, rel_path): a file of each photo on a mounted drive that is `there` (root_id, rel_path); present ones first, then by id."""
    mounted = lib.volume.where("online = 1").select(F.col("id").alias("volume_id"))
    roots = F.broadcast(lib.root.join(mounted, "volume_id", "left_semi").select(F.col("id").alias("root_id")))
    files = lib.file.join(roots, "root_id", "left_semi").join(there, ["root_id", "rel_path"], "left_semi")
    best = files.groupBy("blake3").agg(F.min_by("rel_path", F.struct((F.col("state") != "present").alias("o"), "id")).alias("rel_path"))
    return lib.photo.select("id", "blake3").join(best, "blake3").select("id", "rel_path")


def crops(lib, width: int, height: int, pad: float = 0.35) -> DataFrame:
    """(id, x1, y1, x2, y2): whole pixels to cut each face out of its picture at another size, with a margin, inside it and 1 wide at least."""
    w, h = F.lit(float(width)), F.lit(float(height))
    known = F.expr("coalesce(src_w, 0) > 0 and coalesce(src_h, 0) > 0")
    sx, sy = F.when(known, w / F.col("src_w")).otherwise(1.0), F.when(known, h / F.col("src_h")).otherwise(1.0)
    x, y, bw, bh = (F.col("bbox_x") * sx, F.col("bbox_y") * sy, F.col("bbox_w") * sx, F.col("bbox_h") * sy)
    left, top = (F.least(F.greatest(a - b * pad, F.lit(0.0)), side - 1) for a, b, side in ((x, bw, w), (y, bh, h)))
    rows = lib.face.select("id", left.alias("x1"), top.alias("y1"), (x + bw * (1 + pad)).alias("r"), (y + bh * (1 + pad)).alias("b"))
    right, bottom = F.greatest(F.least(F.col("r"), w), F.col("x1") + 1), F.greatest(F.least(F.col("b"), h), F.col("y1") + 1)
    return rows.select("id", *(c.cast("int").alias(n) for c, n in ((F.col("x1"), "x1"), (F.col("y1"), "y1"), (right, "x2"), (bottom, "y2"))))


def pictures(listing: DataFrame, base: str, excludes: list[str] = (), recursive: bool = True) -> DataFrame:
    """The rows of a listing (path, ...) that a walk of `base` finds: pictures of known kinds, by path relative to it.

    A file or folder whose whole path fits a pattern is left out, with all that it holds; * crosses slashes. A null path
    is none.
    """
    base = base.rstrip("/")
    out = listing.where(F.col("path").startswith(base + "/")).withColumn("rel_path", F.substring("path", len(base) + 2, 1 << 30))
    out = out.where(stem_and_extension(F.col("rel_path"))[1].isin(PICTURES + RAW))
    if not recursive:
        out = out.where(~F.col("rel_path").contains("/"))
    steps = F.split("rel_path", "/")
    over = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit(base + "/"), F.array_join(F.slice(steps, 1, i), "/")))
    pattern = "|".join(f"(?:{fnmatch.translate(p).replace(chr(92) + 'Z', chr(92) + 'z')})" for p in [*LEFT_OUT, *excludes])
    return out.where(~F.exists(over, lambda p: p.rlike(f"^(?:{pattern})")))


def walk(spark: SparkSession, base: str, excludes: list[str] = ()) -> DataFrame:
    """(path, rel_path, mtime, size, content) of the pictures below a folder that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    listing = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return pictures(listing, base, excludes)


def content_hash(content: Column) -> Column:
    """The name of a file's bytes: SHA-256, as hexadecimal digits."""
    return F.sha2(content, 256)


def above(path: Column, itself: bool = True) -> Column:
    """The path's folders from the top on ('' is that of a path from /), and the path itself."""
    steps = F.split(path, "/")
    last = F.size(steps) if itself else F.size(steps) - 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def _named(mounts: DataFrame) -> DataFrame:
    return mounts.select("mountpoint", F.coalesce("serial", "uuid", F.concat(F.lit("mark-"), "marker"), F.concat(F.lit("path-"), "mountpoint")).alias("volume"), "label")


def mounted_on(places: DataFrame, mounts: DataFrame) -> DataFrame:
    """Each row of `places` (path) with its mount: the longest mountpoint that is the path or a folder above it.

    `mounts`: (mountpoint, serial, uuid, marker, label), each mountpoint once. Adds mountpoint, volume (serial, else uuid,
    else mark- and the marker, else path- and the mountpoint), label and rel_path, empty for the mountpoint itself. Each
    path meets its own folders only, by equality, so mounts may be many; paths on none are left out.
    """
    named = _named(mounts).withColumn("folder", F.regexp_replace("mountpoint", "/$", ""))
    known = named.join(places.select(F.explode(F.array_distinct(above(F.col("path")))).alias("folder")).distinct(), "folder", "left_semi")
    found = places.select("path").distinct().withColumn("folder", F.explode(above(F.col("path")))).join(known, "folder")
    best = found.groupBy("path").agg(F.max_by(F.struct("mountpoint", "volume", "label"), F.length("folder")).alias("m")).select("path", "m.*")
    return places.join(best, "path").withColumn("rel_path", F.expr("ltrim('/', substring(path, length(regexp_replace(mountpoint, '/$', '')) + 1))"))


def current_mountpoints(volumes: DataFrame, mounts: DataFrame) -> DataFrame:
    """Where each volume (uuid) is mounted now, by identity and not by letter; null if it isn't."""
    return volumes.join(_named(mounts).groupBy(F.col("volume").alias("uuid")).agg(F.min("mountpoint").alias("mountpoint")), "uuid", "left")


def library_state(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """Folders (path) and how they relate to the roots (path) there are: root, inside, contains, or null.

    Folders meet the roots by equality: a folder, the folders above it, and the folders above roots.
    """
    known, paths = roots.select("path").distinct(), folders.select("path").distinct()
    inside = paths.select("path", F.explode(above(F.col("path"), False)).alias("over")).join(known.select(F.col("path").alias("over")), "over", "left_semi").select("path").distinct()
    contains = known.select(F.explode(above(F.col("path"), False)).alias("path")).distinct()
    out = folders
    for name, rows in (("root", known), ("inside", inside), ("contains", contains)):
        out = out.join(rows.select("path", F.lit(name).alias(f"is_{name}")), "path", "left")
    return out.select(*folders.columns, F.coalesce("is_root", "is_inside", "is_contains").alias("library"))


def browse_folder(listing: DataFrame, folder: str, roots: DataFrame) -> DataFrame:
    """The folders in a folder of a listing of files (path), by name: (name, path, images, library); hidden ones are left out."""
    below = listing.where(F.col("path").startswith(folder + "/")).withColumn("rest", F.substring("path", len(folder) + 2, 1 << 30)).where(F.col("rest").contains("/"))
    direct = F.size(F.split("rest", "/")) == 2
    picture = stem_and_extension(F.col("rest"))[1].isin(PICTURES + RAW)
    groups = below.groupBy(F.split("rest", "/")[0].alias("name")).agg(F.count_if(direct & picture).alias("images")).where(~F.col("name").startswith("."))
    return library_state(groups.withColumn("path", F.concat(F.lit(folder + "/"), "name")), roots).orderBy(F.lower("name"), "name")
