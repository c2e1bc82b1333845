"""Scans of drives as a stream with state: each found file is new, changed or unchanged, and at the end of a scan the rest is missing.

The stream brings rows (root_id, scan, rel_path, mtime, size): what scans found, scans of a root numbered upwards, and
after the last file of a scan one row without a path. State is kept for each file, under its root and one of BUCKETS
shares of its paths, so a root of any size is spread over tasks; a task holds what is known of one share. The row that ends a scan goes to all shares of its root,
and each goes through its own files. RocksDB keeps them on disk, and a restart goes on where the stream stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lumenary.sources.shared import fresh

BUCKETS = 64
#: Tables that a share's state is in, at most.
PARTS = 32
FOUND = "root_id long, scan long, rel_path string, mtime long, size long"
EVENT = "root_id long, scan long, rel_path string, status string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(known: dict) -> bytes:
    """Files by path, (mtime, size, scan) each, as the bytes of an Arrow stream."""
    import pyarrow as pa

    columns = [pa.array(list(known), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*known.values()))]
    table, sink = pa.table(columns, ["rel_path", "mtime", "size", "scan"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Files(StatefulProcessor):
    """What is known of the files of a share: mtime, size and the last scan that found them.

    It is kept as packed tables. A batch reads those of a share at once and adds one with what it found, of which the later
    entry of a file counts; they become one when most entries are written over, or there are PARTS of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tables = handle.getListState("tables", "packed binary")

    def _known(self) -> tuple[dict, int, int]:
        """What is known by path, and how many entries and tables hold it."""
        import pyarrow as pa

        known, entries, parts = {}, 0, 0
        for (packed,) in self.tables.get() if self.tables.exists() else ():
            table = pa.ipc.open_stream(packed).read_all()
            path, *values = (c.to_pylist() for c in table.columns)
            known.update(zip(path, zip(*values)))
            entries, parts = entries + len(path), parts + 1
        return known, entries, parts

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        found = pd.concat(list(rows))
        root, out, new = int(key[0]), [], {}
        known, entries, parts = self._known()
        for scan, part in found.sort_values("scan").groupby("scan"):  # of a batch that holds several scans, one after the other
            scan = int(scan)
            here = part[part["rel_path"].notna()].drop_duplicates("rel_path", keep="last")
            for path, mtime, size in zip(here["rel_path"], here["mtime"].astype("int64").tolist(), here["size"].astype("int64").tolist()):
                before = known.get(path)
                if before is None or before[2] < scan:  # a repeated listing says nothing new
                    out.append((root, scan, path, "new" if before is None else "unchanged" if before[:2] == (mtime, size) else "changed"))
                    known[path] = new[path] = (mtime, size, scan)
            if part["rel_path"].isna().any():
                out += [(root, scan, path, "missing") for path, value in known.items() if value[2] < scan]
        if new and (parts + 1 > PARTS or entries + len(new) > 2 * len(known)):
            self.tables.put([(_packed(known),)])
        elif new:
            self.tables.appendValue((_packed(new),))
        yield pd.DataFrame(out, columns=["root_id", "scan", "rel_path", "status"])

    def close(self) -> None:
        pass


def events(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The stream of (root_id, scan, rel_path, status) that a stream of found files makes; files missing from a scan are reported at each.

    mtime counts by whole seconds. `buckets` can't change while a stream's state is kept. Rows without root or scan are ignored.
    """
    share = F.when(F.col("rel_path").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.hash("rel_path"), F.lit(buckets))))
    dealt = found.where("root_id is not null and scan is not null").withColumn("share", F.explode(share))
    return dealt.groupBy("root_id", "share").transformWithStateInPandas(statefulProcessor=Files(), outputStructType=EVENT, outputMode="Append", timeMode="None")


class Progress(StreamingQueryListener):
    """How far streams have come, while they run: rows and batches by the query's id; `told` is called with each step."""

    def __init__(self, told=lambda identity, rows, batches: None):
        self.rows, self.batches, self.ended, self.told = {}, {}, set(), told

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)
        self.batches.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        at = str(event.progress.id)
        self.rows[at] = self.rows.get(at, 0) + event.progress.numInputRows
        self.batches[at] = self.batches.get(at, 0) + 1
        self.told(at, self.rows[at], self.batches[at])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.id))


def start(found: DataFrame, target: str, state: str) -> StreamingQuery:
    """Writes the events of what is there to `target` and stops. Started again with the same folders, it goes on."""
    spark = found.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    try:
        return events(found).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the listings (Parquet files of FOUND) that come into a folder, one file at a time."""
    return spark.readStream.schema(FOUND).option("maxFilesPerTrigger", 1).parquet(folder)


def three_scans(lib) -> DataFrame:
    """Events of three scans of all roots of the fixture: some files change, go, come back, come late; the stream stops and starts again after the second."""
    spark, folder, target, state = lib.spark, fresh(lib.spark, "found"), fresh(lib.spark, "events"), fresh(lib.spark, "scans")
    scans = F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))
    listing = lib.file.withColumn("scan", F.explode(scans))
    later, grown = F.when(F.expr("scan >= 2 and id % 5 = 0"), 60).otherwise(0), F.when(F.expr("scan = 3 and id % 11 = 0"), 1).otherwise(0)
    listing = listing.select("root_id", "scan", "rel_path", (F.col("mtime") + later).alias("mtime"), (F.col("size") + grown).alias("size"), "id")
    there = listing.where("not (id % 7 = 0 and scan = 2) and not (id % 13 = 0 and scan < 3) and not (id % 17 = 0 and scan = 3)").drop("id")
    ends = lib.root.select(F.col("id").alias("root_id"), F.explode(scans).alias("scan"), F.lit(None).cast("string").alias("rel_path"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("long").alias("size"))
    ends = ends.where("not (root_id % 6 = 0 and scan = 2)")
    for numbers in ((1, 2), (3,)):
        for scan in numbers:
            for rows in (there, ends):  # files come in order of time
                rows.where(F.col("scan") == scan).coalesce(1 if scan == 2 else 2).write.mode("append").parquet(folder)
        start(watched(spark, folder), target, state).awaitTermination()
    return spark.read.schema(EVENT).option("recursiveFileLookup", True).parquet(target)


THREE_SCANS_SQL = """
with f as (select root_id, rel_path, min(id) as id, min(mtime) as mtime, min(size) as size from v_file group by root_id, rel_path),
n as (select unnest([1, 2, 3])::bigint as scan),
s as (select f.root_id, n.scan, f.rel_path, f.mtime + if(n.scan >= 2 and f.id % 5 = 0, 60, 0) as mtime, f.size + if(n.scan = 3 and f.id % 11 = 0, 1, 0) as size,
  not (f.id % 7 = 0 and n.scan = 2) and not (f.id % 13 = 0 and n.scan < 3) and not (f.id % 17 = 0 and n.scan = 3) as there from f, n),
b as (select s.*, (select max_by({'m': p.mtime, 's': p.size}, p.scan) from s p where p.root_id = s.root_id and p.rel_path = s.rel_path and p.there and p.scan < s.scan) as old from s)
select root_id, scan, rel_path, case when not there then 'missing' when old is null then 'new' when old.m = mtime and old.s = size then 'unchanged' else 'changed' end as status
from b where there or (old is not null and not (root_id % 6 = 0 and scan = 2))
"""
