"""Model providers as plug-ins, and stages that run one over a table without failing on single rows."""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from collections.abc import Iterable
from importlib import import_module, metadata
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Provider(ABC):
    """Made once in each worker and kept while that lives; `run` gets a batch of payloads and returns a value for each, or raises."""

    #: The Spark type of a value.
    result = "string"

    @abstractmethod
    def run(self, batch: list) -> list: ...


class CaptionProvider(Provider):
    result = "struct<caption: string, tags: array<string>>"


class ImageEmbedder(Provider):
    result = "array<float>"


class TextEmbedder(Provider):
    result = "array<float>"


class FaceAnalyzer(Provider):
    result = "array<struct<x: double, y: double, w: double, h: double, score: double, embedding: array<float>>>"


KINDS = {"caption": CaptionProvider, "image": ImageEmbedder, "text": TextEmbedder, "faces": FaceAnalyzer}
_known: dict[tuple[str, str], type[Provider]] = {}


class SystemicError(Exception):
    """The provider itself is out of order: rows of the batch stay pending."""


def register(kind: str, name: str):
    """Class decorator; the last registration of a name counts."""

    def add(cls):
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; there are {', '.join(sorted(KINDS))}")
        if not (isinstance(cls, type) and issubclass(cls, KINDS[kind])):
            raise TypeError(f"{cls!r} is no {KINDS[kind].__name__}")
        _known[kind, name] = cls
        return cls

    return add


def load_entry_points(group: str) -> None:
    """Imports plug-ins that installed packages announce; a broken one only warns."""
    for point in metadata.entry_points(group=group):
        try:
            point.load()
        except Exception as e:  # a plug-in may raise anything
            warnings.warn(f"plug-in {point.name}: {e}")


_loaded: set[str] = set()


def load_file(path: str) -> None:
    """Imports a loose file of plug-ins, once; one that is missing or broken only warns."""
    from importlib.util import module_from_spec, spec_from_file_location

    if path in _loaded:
        return
    _loaded.add(path)
    spec = spec_from_file_location(f"plugin_{Path(path).stem}", path)
    try:
        spec.loader.exec_module(module_from_spec(spec))
    except Exception as e:  # a plug-in may raise anything
        warnings.warn(f"plug-in {path}: {e}")


#: Providers of this package that are imported when first asked for: kind and name to a module.
LAZY: dict[tuple[str, str], str] = {}


def text_provider(embed) -> type[Provider]:
    """The text embedder of settings: the picture embedder's, whose space it shares, unless they name another."""
    for path in embed.plugins:
        load_file(path)
    return provider("text", embed.text_provider or embed.provider)


def provider(kind: str, name: str) -> type[Provider]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(sorted(KINDS))}")
    if (kind, name) not in _known and (kind, name) in LAZY:
        import_module(LAZY[kind, name])
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} provider {name!r}; there are {', '.join(sorted(n for k, n in _known if k == kind)) or 'none'}")
    return _known[kind, name]


@register("caption", "first_words")
class FirstWords(CaptionProvider):
    """Caption and tags out of the payload's own first words; refuses payloads of fewer than five words."""

    def run(self, batch):
        out = []
        for payload in batch:
            words = payload.split()
            if len(words) < 5:
                raise ValueError("too few words")
            out.append((" ".join(words[:5]), sorted(set(w.lower() for w in words[:2]))))
        return out


@register("text", "hashed")
class HashedWords(TextEmbedder):
    """Unit vectors of signed word counts."""

    size = 64

    def run(self, batch):
        from zlib import crc32

        out = []
        for payload in batch:
            v = np.zeros(self.size, np.float32)
            for w in payload.lower().split():
                h = crc32(w.encode())
                v[h % self.size] += 1 if h >> 31 else -1
            out.append((v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
        return out


@register("image", "low_frequencies")
class LowFrequencies(ImageEmbedder):
    """Unit vectors of the lowest frequencies of 32 x 32 grey values, but for the mean; refuses payloads of other sizes."""

    def __init__(self):
        from lumenary.functions.imaging import _cosines

        self.basis = _cosines()

    def run(self, batch):
        if any(len(p) != 1024 for p in batch):
            raise ValueError("not 32 x 32 grey values")
        grey = np.array([list(p) for p in batch], np.float64).reshape(-1, 32, 32)
        low = np.einsum("ur,nrc,vc->nuv", self.basis, grey, self.basis, optimize=True).reshape(len(batch), -1)[:, 1:]
        return (low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)).astype(np.float32).tolist()


@register("faces", "bright_boxes")
class BrightBoxes(FaceAnalyzer):
    """The box around all values of half the largest or more, where that is over 0, with the means of its quarters; refuses payloads of other sizes."""

    def run(self, batch):
        out = []
        for payload in batch:
            if len(payload) != 1024:
                raise ValueError("not 32 x 32 grey values")
            grey = np.array(list(payload), np.float64).reshape(32, 32)
            top, found = float(grey.max()), []
            if top > 0:
                y, x = np.nonzero(grey >= top / 2)
                inside = grey[y.min() : y.max() + 1, x.min() : x.max() + 1]
                parts = [q.mean() if q.size else 0.0 for half in np.array_split(inside, 2) for q in np.array_split(half, 2, axis=1)]
                found = [(float(x.min()), float(y.min()), float(np.ptp(x) + 1), float(np.ptp(y) + 1), top, [float(p) for p in parts])]
            out.append(found)
        return out


_models: dict[tuple[str, str], Provider] = {}


def kept(cls: type[Provider]) -> Provider:
    """The worker's one model of a class: made when first needed, kept while the worker lives, over all its tasks."""
    name = (cls.__module__, cls.__qualname__)
    if name not in _models:
        _models[name] = cls()
    return _models[name]


def _bytes(payload) -> int:
    return 0 if payload is None else payload.nbytes if isinstance(payload, np.ndarray) else len(payload)


def _batches(parts: Iterable[pd.DataFrame], key: str, payload: str, rows: int, size: int):
    """Lists of (key, payload) of `rows` rows and `size` bytes at most (one row, if that alone is larger), whatever the parts' bounds are."""
    held, total = [], 0
    for part in parts:
        for row in zip(part[key], part[payload]):
            n = _bytes(row[1])
            if held and (len(held) >= rows or total + n > size):
                yield held
                held, total = [], 0
            held.append(row)
            total += n
    if held:
        yield held


def _results(model: Provider, batch: list) -> list[tuple]:
    """(state, value, error) of each row of a batch."""

    def one(p):
        try:
            return "done", model.run([p])[0], None
        except SystemicError as e:
            return "pending", None, str(e)[:500]
        except Exception as e:  # the provider's own errors are results
            return "failed", None, str(e)[:500]

    there = [p for _, p in batch if p is not None]
    try:
        values = list(model.run(there)) if there else []
        if len(values) != len(there):
            raise ValueError(f"{len(values)} values for {len(there)} payloads")
        values = iter(values)
        return [("pending", None, None) if p is None else ("done", next(values), None) for _, p in batch]
    except SystemicError as e:
        return [("pending", None, str(e)[:500])] * len(batch)
    except Exception:
        return [("pending", None, None) if p is None else one(p) for _, p in batch]


def profile(cpus: int = 1, gpus: float = 0, memory: str | None = None):
    """What a task of a stage needs of an executor: for clusters that schedule by stage (`run_stage`'s `needs`)."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    task, executor = TaskResourceRequests().cpus(cpus), ExecutorResourceRequests().cores(max(1, cpus))
    if gpus:
        task, executor = task.resource("gpu", gpus), executor.resource("gpu", max(1, round(gpus)))
    if memory:
        executor = executor.memoryOverhead(memory)
    return ResourceProfileBuilder().require(task).require(executor).build


def run_stage(rows: DataFrame, kind: str, name: str, key: str, payload: str, batch: int = 32, batch_bytes: int = 64 << 20, needs=None) -> DataFrame:
    """(key, state, value, error) of every row: done, failed with an error of at most 500 letters, or pending.

    The model gets up to `batch` payloads of `batch_bytes` together at a time. A batch that fails is tried again row by row;
    after a SystemicError its rows are pending. Null payloads are pending, as their file is offline. `needs` is a profile
    of resources for the stage's tasks.
    """
    cls = provider(kind, name)
    types = rows.select(key).schema[0].dataType.simpleString()

    def work(parts: Iterable[pd.DataFrame]):
        model = kept(cls)
        for block in _batches(parts, key, payload, batch, batch_bytes):
            found = _results(model, block)
            yield pd.DataFrame([(k, *f) for (k, _), f in zip(block, found)], columns=[key, "state", "value", "error"])

    return rows.select(key, payload).mapInPandas(work, f"{key} {types}, state string, value {cls.result}, error string", profile=needs)


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, grey): a picture made from each vector, the products of its two halves; every 29th is cut off, every 31st offline."""
    grey = F.expr("flatten(transform(slice(embedding, 1, 32), y -> transform(slice(embedding, 33, 32), x -> cast(x as double) * y)))")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.when(F.col("vec_id") % 31 == 0, None).when(F.col("vec_id") % 29 == 0, F.slice(grey, 1, 1000)).otherwise(grey).alias("grey"))


def face_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces found in the pictures of vectors: state, number, box and score of each."""
    out = run_stage(_products(spark, sf_dir), "faces", "bright_boxes", "vec_id", "grey")
    face = F.col("value")[0]
    return out.select("vec_id", "state", F.when(F.col("state") == "done", F.size("value")).alias("n"), *(face[c].cast("int").alias(c) for c in "xywh"), F.round(face["score"], 6).alias("score"), "error")


def image_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the pictures of vectors: state, size and length of each."""
    out = run_stage(_products(spark, sf_dir), "image", "low_frequencies", "vec_id", "grey")
    length = F.sqrt(F.aggregate("value", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return out.select("vec_id", "state", F.when(F.col("state") == "done", F.size("value")).alias("n"), F.round(length, 3).alias("length"), "error")


_STATE = "case when vec_id % 31 = 0 then 'pending' when vec_id % 29 = 0 then 'failed' else 'done' end"
FACE_SQL = f"""
with g as (select vec_id, y, x, embedding[y + 1]::double * embedding[33 + x]::double as v from embeddings, (select unnest(range(32)) as y) a, (select unnest(range(32)) as x) b where vec_id % 31 <> 0 and vec_id % 29 <> 0),
t as (select vec_id, max(v) as top from g group by vec_id),
b as (select vec_id, min(x)::int as x, min(y)::int as y, (max(x) - min(x) + 1)::int as w, (max(y) - min(y) + 1)::int as h, round(any_value(top), 6) as score from g join t using (vec_id) where top > 0 and v >= top / 2 group by vec_id)
select vec_id, {_STATE} as state, case when {_STATE} = 'done' then (b.x is not null)::int end as n, b.x, b.y, b.w, b.h, b.score, case when {_STATE} = 'failed' then 'not 32 x 32 grey values' end as error
from (select vec_id from embeddings) e left join b using (vec_id)
"""
IMAGE_SQL = f"select vec_id, {_STATE} as state, case when {_STATE} = 'done' then 63 end as n, case when {_STATE} = 'done' then 1.0::double end as length, case when {_STATE} = 'failed' then 'not 32 x 32 grey values' end as error from embeddings"


def caption_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = run_stage(docs, "caption", "first_words", "doc_id", "text")
    return out.select("doc_id", "state", "value.caption", F.array_join("value.tags", ",").alias("tags"), "error")
