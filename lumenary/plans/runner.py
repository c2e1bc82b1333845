"""Runs stages over the job table: batches are claimed, run, and finished, until nothing new is left."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions import providers
from lumenary.operators import changes
from lumenary.sources.shared import checkpoint, fresh, numbered

#: The order of stages; groups of faces follow faces.
ORDER = ("thumbs", "embed", "faces", "caption", "cluster")


def batches(lib, stage: str, size: int, limit: int, work):
    """Work through the pending jobs of a stage, `size` at a time, until `limit` of them ended; the library with the jobs' new states.

    `work` gets claimed jobs and returns (id, state, error). Jobs are claimed by priority, then id, each once in a run:
    one that is put back to pending isn't claimed again, and the run ends when there is nothing else. All pending jobs
    are numbered, and get what `work.prepare` (if there is one) adds to them, once; a batch reads its own folder of these.
    """
    spark, queue, prepared, ended = lib.spark, fresh(lib.spark, "queue"), fresh(lib.spark, "jobs"), fresh(lib.spark, "ended")
    counts = {"done": 0, "failed": 0, "skipped": 0}
    pending = numbered(lib.job.where((F.col("stage") == stage) & (F.col("state") == "pending")), "priority", "id")
    pending.withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1}).write.parquet(queue)
    jobs = spark.read.schema(pending.schema).parquet(queue)
    total, at = jobs.count(), 0
    if not total:
        return lib, counts
    rows = getattr(work, "prepare", lambda jobs: jobs)(jobs).withColumn("batch", F.expr(f"(place - 1) div {size}"))
    rows.repartitionByRange("place").write.partitionBy("batch").parquet(prepared)
    rows = spark.read.schema(rows.schema).parquet(prepared)
    while at < total and counts["done"] + counts["failed"] < limit:
        upto = at + min(size, limit - counts["done"] - counts["failed"])
        part = rows.where(F.col("batch").between(at // size, (upto - 1) // size) & (F.col("place") > at) & (F.col("place") <= upto))
        results = work(part.drop("batch", "place")).select("id", "state", "error")
        results.write.parquet(f"{ended}/upto={upto}")
        for r in spark.read.schema(results.schema).parquet(f"{ended}/upto={upto}").groupBy("state").count().collect():
            counts["skipped" if r["state"] == "pending" else r["state"]] += r["count"]
        at = upto
    claimed = lib.with_tables(job=changes.upsert(lib.job, jobs.where(F.col("place") <= at).select(*lib.job.columns), ["id"], ["state", "attempts"]))
    return lib.with_tables(job=checkpoint(changes.finish(claimed, spark.read.schema(results.schema).parquet(ended)))), counts


def provider_work(lib, payloads: DataFrame, kind: str, name: str):
    """Work for `batches`: a provider runs over the payloads (photo_id, payload) of the jobs' photos; offline ones stay pending."""

    def work(jobs: DataFrame) -> DataFrame:
        return providers.run_stage(jobs, kind, name, "id", "payload").select("id", "state", "error")

    work.prepare = lambda jobs: jobs.join(payloads.select("photo_id", "payload"), "photo_id", "left")
    return work


class Busy(RuntimeError):
    """A run is going on already."""


class Runner:
    """One run at a time, stage by stage. `work` has a function of the library for each stage, which returns it changed, and counts."""

    def __init__(self, work: dict):
        self.work, self._one, self._stop = work, threading.Lock(), threading.Event()
        self.state: dict = {"running": False, "stage": None, "results": {}, "cancelled": False, "error": None}

    def plan(self, stages) -> list[str]:
        wanted = list(stages)
        odd = [s for s in wanted if s not in ORDER]
        if odd or not wanted:
            raise ValueError(f"unknown stages {odd}; there are {', '.join(ORDER)}" if odd else "no stages")
        if "faces" in wanted and "cluster" not in wanted:
            wanted.append("cluster")
        return sorted(wanted, key=ORDER.index)

    def cancel(self) -> bool:
        """Stop before the next stage; false if nothing runs."""
        if self.state["running"]:
            self._stop.set()
        return self.state["running"]

    def run(self, lib, stages=ORDER):
        """The library after the stages; jobs that a killed run left are pending again first."""
        wanted = self.plan(stages)
        if not self._one.acquire(blocking=False):
            raise Busy("a run is going on")
        self._stop.clear()
        self.state = {"running": True, "stage": None, "results": {}, "cancelled": False, "error": None}
        try:
            lib = lib.with_tables(job=checkpoint(changes.requeue_stale(lib)))
            for stage in wanted:
                if self._stop.is_set():
                    self.state["cancelled"] = True
                    break
                self.state["stage"] = stage
                if stage in self.work:
                    lib, self.state["results"][stage] = self.work[stage](lib)
        except Exception as e:
            self.state["error"] = f"{type(e).__name__}: {e}"[:400]
            raise
        finally:
            self.state |= {"running": False, "stage": None}
            self._one.release()
        return lib


def offline_payloads(lib, texts: DataFrame) -> DataFrame:
    """(photo_id, payload): the text of each photo that has a present file; null for the others, which are offline."""
    here = lib.file.where("state = 'present'").select("blake3").distinct().withColumn("here", F.lit(True))
    photos = lib.photo.select(F.col("id").alias("photo_id"), "blake3").join(here, "blake3", "left").join(texts, "photo_id", "left")
    return photos.select("photo_id", F.when(F.col("here"), F.col("payload")).alias("payload"))
