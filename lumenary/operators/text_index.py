"""A kept full-text index: postings as Parquet tables, searched without reading any text.

A segment has three tables. `postings`, in order of term: for each term and block of 2**BLOCK ids the ids, weighted
counts, sizes of the documents and places of the words, and the block's largest count and smallest size. `docs`: each
document's size and terms. `terms`: how many documents a term has gained or lost. The first segment holds all documents;
an update adds one with the changed and removed ones only, and newer rows of an id hide older ones. `state`, a row for
each version, names the segments and counts what lives; a version is there once its row is, so readers see whole ones.
One writer at a time is assumed. Filters on terms and prefixes reach the Parquet files, which hold ranges of terms.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.functions import stem
from lumenary.operators.fulltext import B, IDF_FLOOR, K1, WEIGHTS, phrases
from lumenary.sources.shared import checkpoint, release

BLOCK = 10
#: A place is the number of the column, shifted by so many bits, and the number of the word in it.
COLUMN = 40
#: Blocks of the highest bounds that are scored first, to learn what the best hits have at least.
FIRST = 64
POSTINGS = "term string, block long, ids array<long>, counts array<double>, sizes array<int>, places array<array<long>>, most double, least int"
CUT = "id long, size int, terms array<string>, counts array<double>, places array<array<long>>"
DOCS = "id long, size int, terms array<string>"
STATE = "version int, segments array<string>, n long, total long, columns array<string>, weights array<double>"
SMALL = ("parquet.block.size", str(1 << 22))


@dataclass
class Index:
    """A version of an index: its folder, segments (oldest first), number and total size of its documents, weights of columns."""

    spark: SparkSession
    folder: str
    version: int
    segments: list[str]
    n: int
    total: int
    weights: dict[str, float]

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of all segments, with the number of the segment."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{s}/{name}").withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionByName, parts)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, segment) that no later segment has hidden."""
        if len(self.segments) == 1:
            return rows
        later = self.table("docs", DOCS).where("segment > 0").groupBy("id").agg(F.max("segment").alias("last"))
        return rows.join(later, "id", "left").where("last is null or segment = last").drop("last")


def opened(spark: SparkSession, folder: str) -> Index | None:
    """The newest version; None if the folder has no index."""
    try:
        row = spark.read.schema(STATE).parquet(f"{folder}/state").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return row and Index(spark, folder, row["version"], row["segments"], row["n"], row["total"], dict(zip(row["columns"], row["weights"])))


def _publish(index: Index) -> Index:
    row = (index.version, index.segments, index.n, index.total, list(index.weights), list(index.weights.values()))
    index.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(f"{index.folder}/state")
    return index


def _held(weights: list[float]):
    """Rows (id, a text for each weight) to CUT."""

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64())))
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part, rows = batch.slice(k, 200), []
                for texts in zip(*(c.to_pylist() for c in part.columns[1:])):
                    found, size = {}, 0
                    for i, text in enumerate(texts):
                        cut = stem.words(text)
                        size += len(cut)
                        for place, w in enumerate(cut, i << COLUMN):
                            found.setdefault(w, []).append(place)
                    terms = sorted(found)
                    rows.append((size, terms, [sum(weights[x >> COLUMN] for x in found[w]) for w in terms], [found[w] for w in terms]))
                yield pa.record_batch([part.column(0), *(pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds))], names=["id", "size", "terms", "counts", "places"])

    return run


def _cut(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """CUT of each document, its terms in order, with weighted counts and places: the one step that reads text and runs Python."""
    parts = docs.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(weights)))
    return parts.mapInArrow(_held([float(w) for w in weights.values()]), CUT)


def _weight(place: Column, weights: dict[str, float]) -> Column:
    return F.element_at(F.array(*(F.lit(float(w)) for w in weights.values())), F.shiftright(place, COLUMN).cast("int") + 1)


def _blocks(rows: DataFrame) -> DataFrame:
    """(id, size, term, count, places) to POSTINGS, in ranges of terms; a block has 2**BLOCK rows at most."""
    rows = rows.select("id", "size", "term", "count", "places", F.shiftright("id", BLOCK).alias("block"))
    # dealt before blocks are made, so that rows travel once and nothing costly runs twice for the bounds of ranges
    rows = rows.repartitionByRange("term", "block").groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "count", "size", "places"))).alias("p"))
    return rows.select("term", "block", F.col("p.id").alias("ids"), F.col("p.count").alias("counts"), F.col("p.size").alias("sizes"), F.col("p.places").alias("places"), F.array_max("p.count").alias("most"), F.array_min("p.size").alias("least"))


def _write(folder: str, postings: DataFrame, docs: DataFrame) -> None:
    postings.sortWithinPartitions("term", "block").write.option(*SMALL).parquet(f"{folder}/postings")
    docs.repartitionByRange("id").write.parquet(f"{folder}/docs")


def _segment(docs: DataFrame, folder: str, weights: dict[str, float], gone: DataFrame | None = None) -> None:
    """Write the postings and documents of a segment; removed ones have no size."""
    cut = checkpoint(_cut(docs, weights))
    rows = cut.select("id", "size", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("count"), "places")))
    held = cut.select("id", "size", "terms")
    if gone is not None:
        held = held.unionByName(gone.select(F.col("id").cast("long").alias("id")).join(held, "id", "left_anti").select("id", F.lit(None).cast("int").alias("size"), F.array().cast("array<string>").alias("terms")).distinct())
    _write(folder, _blocks(rows), held)
    release(cut)


def build(docs: DataFrame, folder: str, weights: dict[str, float] = WEIGHTS) -> Index:
    """Index all documents (id, unique and not null, and text columns as in `weights`); null columns are empty, an empty table gives an empty index."""
    spark, name = docs.sparkSession, f"segment-{uuid.uuid4().hex}"
    before = opened(spark, folder)
    _segment(docs, f"{folder}/{name}", weights)
    held = spark.read.schema(DOCS).parquet(f"{folder}/{name}/docs")
    held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).repartitionByRange("term").write.parquet(f"{folder}/{name}/terms")
    facts = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    return _publish(Index(spark, folder, before.version + 1 if before else 0, [name], facts["n"], facts["total"], dict(weights)))


def update(spark: SparkSession, folder: str, changed: DataFrame, gone: DataFrame | None = None) -> Index:
    """A new version in which documents of `changed` are new or replaced and those of `gone` (id) are removed.

    Texts of `changed` are read, and of what was indexed the rows of these ids; an id in both counts as changed; removing
    what isn't there is no fault.
    """
    index, name = opened(spark, folder), f"segment-{uuid.uuid4().hex}"
    if index is None:
        raise ValueError(f"no index in {folder}")
    _segment(changed, f"{folder}/{name}", index.weights, gone)
    new = spark.read.schema(DOCS).parquet(f"{folder}/{name}/docs")
    old = index.live(index.table("docs", DOCS).join(new.select("id"), "id", "left_semi")).where("size is not null")
    both = new.where("size is not null").select("size", "terms", F.lit(1).alias("by")).unionByName(old.select("size", "terms", F.lit(-1).alias("by")))
    terms = both.select("by", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("by").alias("n")).where("n <> 0")
    terms.repartitionByRange("term").write.parquet(f"{folder}/{name}/terms")
    facts = both.agg(F.coalesce(F.sum("by"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("by") * F.col("size")), F.lit(0)).alias("total")).first()
    return _publish(Index(spark, folder, index.version + 1, [*index.segments, name], index.n + facts["n"], index.total + facts["total"], index.weights))


def merge(spark: SparkSession, folder: str) -> Index:
    """A new version of one segment without what is hidden; no text is read."""
    index, name = opened(spark, folder), f"segment-{uuid.uuid4().hex}"
    rows = index.live(index.table("postings", POSTINGS).select("segment", "term", F.inline(_zipped())).withColumnRenamed("counts", "count").withColumnRenamed("sizes", "size"))
    docs = index.live(index.table("docs", DOCS)).where("size is not null").drop("segment")
    _write(f"{folder}/{name}", _blocks(rows), docs)
    terms = index.table("terms", "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")
    terms.repartitionByRange("term").write.parquet(f"{folder}/{name}/terms")
    return _publish(Index(spark, folder, index.version + 1, [name], index.n, index.total, index.weights))


def _zipped() -> Column:
    return F.arrays_zip(F.col("ids").alias("id"), "counts", "sizes", "places")


def terms(index: Index) -> DataFrame:
    """(term, n): the terms that some document has, and how many."""
    return index.table("terms", "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")


def _fits(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


class _Query:
    """A query's phrases against an index: each a list of words, of which the last one of all may be a prefix."""

    def __init__(self, index: Index, query: str, last_is_prefix: bool):
        self.index = index
        want = phrases(query)
        self.tests = [[_fits(w, last_is_prefix and i == len(want) - 1 and j == len(p) - 1) for j, w in enumerate(p)] for i, p in enumerate(want)]
        self.plain = [p[0] if len(p) == 1 and not (last_is_prefix and i == len(want) - 1) else None for i, p in enumerate(want)]

    def postings(self) -> DataFrame:
        """The rows of the query's terms; whatever else is held isn't read."""
        return self.index.table("postings", POSTINGS).where(reduce(Column.__or__, (t for p in self.tests for t in p)))

    def rows(self, postings: DataFrame) -> DataFrame:
        """(id, size, f0, f1, ...): how often each phrase occurs in a document, by weight."""
        each = self.index.live(postings.select("segment", "term", F.inline(_zipped())))
        found = [F.sum(F.when(p[0], F.col("counts")).otherwise(0.0)).alias(f"f{i}") if len(p) == 1 else F.struct(*(F.flatten(F.collect_list(F.when(t, F.col("places")))).alias(f"p{j}") for j, t in enumerate(p))).alias(f"f{i}") for i, p in enumerate(self.tests)]
        each = each.groupBy("id").agg(F.max("sizes").alias("size"), *found)
        return each.withColumns({f"f{i}": self._together(i) for i, p in enumerate(self.tests) if len(p) > 1})

    def _together(self, i: int) -> Column:
        """The weight of the places where all words of a phrase stand in a row."""
        starts = F.col(f"f{i}.p0")
        for j in range(1, len(self.tests[i])):
            starts = F.array_intersect(starts, F.transform(F.col(f"f{i}.p{j}"), lambda x: x - j))  # noqa: B023
        return F.aggregate(starts, F.lit(0.0), lambda a, x: a + _weight(x, self.index.weights))

    def documents(self) -> list[int]:
        """In how many documents each phrase occurs: by the table of terms, or else by the postings of its words."""
        asked = [w for w in self.plain if w is not None]
        known = {r["term"]: r["n"] for r in terms(self.index).where(F.col("term").isin(asked)).collect()} if asked else {}
        out = [known.get(w, 0) for w in self.plain]
        odd = [i for i, w in enumerate(self.plain) if w is None]
        if odd:
            counts = self.rows(self.postings()).agg(*(F.count_if(F.col(f"f{i}") > 0) for i in odd)).first()
            for i, n in zip(odd, counts):
                out[i] = n
        return out

    def score(self, documents: list[int], f=lambda i: F.col(f"f{i}"), size=lambda i: F.col("size")) -> Column:
        mean, out = self.index.total / self.index.n, F.lit(0.0)
        for i, df in enumerate(documents):
            idf = F.greatest(F.lit(IDF_FLOOR), F.log(F.lit((self.index.n - df + 0.5) / (df + 0.5))))
            out += idf * f(i) * (K1 + 1) / (f(i) + K1 * (1 - B + B * size(i) / mean))
        return out

    def hits(self, postings: DataFrame, documents: list[int]) -> DataFrame:
        held = reduce(Column.__and__, (F.col(f"f{i}") > 0 for i in range(len(self.tests))))
        return self.rows(postings).where(held).select("id", self.score(documents).alias("score"))

    def bounds(self, documents: list[int]) -> DataFrame:
        """(block, bound): the highest score that a document of a block can have; blocks without one of the phrases are left out."""
        most, least = [], []
        for i, p in enumerate(self.tests):
            each = [F.sum(F.when(t, F.col("most"))) for t in p]
            most.append((each[0] if len(each) == 1 else F.least(*each)).alias(f"m{i}"))  # a phrase is no more frequent than its words
            least.append(F.min(F.when(p[0], F.col("least"))).alias(f"l{i}"))
        rows = self.postings().groupBy("block").agg(*most, *least)
        held = reduce(Column.__and__, (F.col(f"m{i}").isNotNull() & F.col(f"l{i}").isNotNull() for i in range(len(self.tests))))
        return rows.where(held).select("block", self.score(documents, lambda i: F.col(f"m{i}"), lambda i: F.col(f"l{i}")).alias("bound"))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, score double")


def search(index: Index, query: str, last_is_prefix: bool = True) -> DataFrame:
    """(id, score) of all documents that hold all phrases, as `fulltext.search` gives them; none for no phrase."""
    q = _Query(index, query, last_is_prefix)
    if not q.tests or not index.n:
        return _none(index.spark)
    return q.hits(q.postings(), q.documents())


def top(index: Index, query: str, k: int, last_is_prefix: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """(id, score to six digits) of the `k` best documents (of those in `allowed`, id), best first, ties to the smaller id.

    The blocks of the highest bounds are scored first; only blocks whose bound reaches the k-th best score found there
    can hold a better one, and of these alone counts and places are read.
    """
    q = _Query(index, query, last_is_prefix)
    if not q.tests or not index.n or k < 1:
        return _none(index.spark)
    documents, order = q.documents(), (F.desc("score"), "id")
    bounds = q.bounds(documents)

    def best(postings):
        found = q.hits(postings, documents).select("id", F.round("score", 6).alias("score"))
        return (found if allowed is None else found.join(allowed.select("id"), "id", "left_semi")).orderBy(*order).limit(k)

    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
    known = [r["score"] for r in best(q.postings().where(F.col("block").isin(first))).collect()] if first else []
    least = known[-1] - 1e-6 if len(known) == k else float("-inf")
    chance = bounds.where(F.col("bound") >= least).select("block")
    return best(q.postings().join(chance, "block", "left_semi"))
