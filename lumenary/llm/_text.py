"""Vectorised text kernels and small Spark helpers shared by the corpus operators.

The kernels work on the bytes of an Arrow string column: a batch is cut into runs of whole documents of bounded
size, so a worker holds a few megabytes (or one document, if that is longer) whatever the batch size is.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

import numpy as np

RUN_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_own: dict = {}
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The six white-space bytes 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words of ASCII letters, digits and anything outside ASCII.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = True
NOT_WORD[48:58] = NOT_WORD[97:123] = NOT_WORD[65:91] = False
_BYTE_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers["up"]) < n:
        m = max(n, RUN_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(m, base, _U)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs(column):
    """Cut an Arrow string column into (first row, bytes, offsets) of whole documents, about RUN_BYTES each; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + RUN_BYTES, "right")) - 1)
        yield row, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def trimmed(run):
    """A function over batches whose worker gives freed memory back when a task ends: workers live on between stages."""

    def inner(*batches):
        yield from run(*batches)
        trim()

    return inner


def trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray):
    """Hashes of the words of each document, and the number of words of each; A-Z count as a-z.

    Words are the longest stretches without separator bytes; none crosses the end of a document.
    """
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(bounds) - 1, np.int64)
    gap = np.ones(n + 1, bool)
    gap[:n] = separator[data]
    inner = bounds[1:-1]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[: n - 1]
    before[inner[inner < n]] = True
    after = gap[1:].copy()
    after[inner[(inner > 0) & (inner <= n)] - 1] = True
    here = ~gap[:n]
    starts = np.flatnonzero(here & before)
    ends = np.flatnonzero(here & after) + 1
    up, down = _power_table(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE_CODE[LOWER[data]] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    at = np.searchsorted(starts, bounds)
    return hashes, np.diff(at)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words of one document; the whole sequence as one if it is shorter."""
    k = min(width, len(hashes))
    if not k:
        return hashes
    out = np.zeros(len(hashes) - k + 1, _U)
    for i in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - k + 1 + i]
    return mix(out + _U(k))


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, or that of SparkContext.setCheckpointDir; one of our own only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault("folder", None) or tempfile.mkdtemp(prefix="checkpoint-")
        if _own["folder"] is None:
            _own["folder"] = folder
            atexit.register(shutil.rmtree, folder, True)
    return folder.rstrip("/")


#: Rows of whole texts that are handed to a worker at a time, at most, while a table of ours is written.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark) -> str:
    """Hand workers BATCH_ROWS rows at a time at most; returns the session's setting so far."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return before


def checkpoint(df):
    """`df` as a table written in the shared folder, which cuts its lineage: lost executors lose nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    before = small_batches(df.sparkSession)
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(_BATCH, before)
    trim()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables) -> None:
    """Delete tables that checkpoint() wrote and nothing will read again."""
    for df in tables:
        path = _paths.pop(df, None) if df is not None else None
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(names) -> list:
    """Columns of whatever names, of a list or a table."""
    from pyspark.sql import functions as F

    return [F.col("`" + c.replace("`", "``") + "`") for c in getattr(names, "columns", names)]


def map_arrow(df, run, keep: list[str], added: str):
    """mapInArrow over columns of any names, which `run` gets by place; it returns those of `keep`, the first, and one more.

    `added` is the name and type of that one.
    """
    from pyspark.sql.types import StructField, StructType

    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields[: len(keep)])]
    name, kind = added.rsplit(" ", 1)
    return plain.mapInArrow(trimmed(run), StructType(fields).add(f"c{len(df.columns)}", kind)).toDF(*keep, name)


def packed(df):
    """`df` as one column `row`, a struct: no name can clash with those that are added."""
    from pyspark.sql import functions as F

    return df.select(F.struct(*columns(df)).alias("row"))


BITS = 1 << 27


def id_bits(ids) -> np.ndarray:
    """A bit for each slot, of 2**27, that an id (long, null as 0) of the only column falls on.

    As long as the highest slot needs, and a zero byte: 16 MB at most, at every size of the input.
    """
    from pyspark.sql import functions as F

    slot = ids.select(F.coalesce(F.col(ids.columns[0]).cast("long"), F.lit(0)).bitwiseAND(BITS - 1).alias("s"))
    rows = slot.groupBy(F.expr("s div 32768").cast("int").alias("k")).agg(F.expr("bitmap_construct_agg(s % 32768)").alias("b")).collect()
    out = np.zeros(4096 * max((r["k"] + 1 for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(bytes(r["b"]), np.uint8)
    return out


def has_bit(bits: np.ndarray, ids) -> np.ndarray:
    """Whether the bit of each id of an Arrow column is set; where it isn't, the id is none of those."""
    slot = ids.fill_null(0).to_numpy(zero_copy_only=False) & (BITS - 1)
    return (bits[np.minimum(slot >> 3, len(bits) - 1)] >> (slot & 7) & 1).astype(bool)


SLOTS = 1 << 24


def marked(rows, key: str, among, name: str):
    """`rows` with a boolean column `name`: false only where the long `key` is none of those in the only column of `among`.

    A bitmap of the keys' slots is broadcast: 512 pages of 4 kB at every size. It tells less the more keys there are.
    """
    from pyspark.sql import functions as F

    slot = F.pmod(F.col(among.columns[0]), F.lit(SLOTS))
    pages = among.select(slot.alias("s")).groupBy(F.expr("s div 32768").alias("bits_page")).agg(F.expr("bitmap_construct_agg(s % 32768)").alias("bits_held"))
    at = f"pmod({key}, {SLOTS})"
    bit = f"shiftright(cast(conv(hex(substring(bits_held, cast({at} % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) & 1 = 1"
    return rows.join(F.broadcast(pages), F.expr(f"{at} div 32768 = bits_page"), "left").withColumn(name, F.coalesce(F.expr(bit), F.lit(False))).drop("bits_page", "bits_held")


def table(spark, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(ids, modulus: int, remainder: int):
    """Column: whether crc32 of the id's decimal text leaves the remainder; false for a null id."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
