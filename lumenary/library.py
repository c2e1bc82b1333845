"""A media library as DataFrames, and one method for each thing that can be asked of it or done to it.

Questions return a DataFrame. Changes return the new state of the tables that they change, as a DataFrame or a tuple of
them; `sources.snapshots` publishes states. Nothing is read until a result is used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lumenary.operators import changes, filters, paths, people, reports, search
from lumenary.sources import views

TABLES = ("volume", "root", "file", "photo", "annotation", "photo_tag", "person", "face", "job", "embeddings")


class Library:
    """Tables by name: volume, root, file, photo, annotation, photo_tag, person, face, job, embeddings (DataFrames, or
    functions that make one when it is first needed). Photos and files are linked by the hash of their content.
    `text_folder` and `vector_folder` name kept indexes (`operators.text_index`, `operators.vector_index`) that searches use."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], text_folder: str | None = None, vector_folder: str | None = None):
        self.spark, self._tables, self.text_folder, self.vector_folder = spark, dict(tables), text_folder, vector_folder

    @classmethod
    def of_driver_tables(cls, spark: SparkSession, sf_dir: str) -> Library:
        """The library that `sources.views` makes of the driver's tables."""
        made = {t: partial(views.table, spark, sf_dir, f"select * from v_{t}") for t in TABLES[:-1]}
        return cls(spark, made | {t: partial(views.base, spark, sf_dir, t) for t in ("embeddings", "documents", "events")})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        if callable(self._tables[name]):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    def with_tables(self, **tables: DataFrame) -> Library:
        """The library with other states of some tables."""
        return Library(self.spark, self._tables | tables, self.text_folder, self.vector_folder)

    def with_indexes(self, text_folder: str | None = None, vector_folder: str | None = None) -> Library:
        """The library with other kept indexes."""
        return Library(self.spark, self._tables, text_folder or self.text_folder, vector_folder or self.vector_folder)


def _methods():
    for module in (filters, search, reports, people, changes, paths):
        for name in module.METHODS:
            setattr(Library, name, getattr(module, name))


_methods()
