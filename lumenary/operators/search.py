"""Full text, vector and hybrid search: BM25 over words, cosine with cutoffs, reciprocal rank fusion, engine choice, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenary.sources.shared import checkpoint

METHODS = ("filter_ranking", "search", "page")
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
POOL = 200
#: Vectors count from this score on, and from this share of the best one's.
LEAST, SHARE = 0.07, 0.6


def _is(word: str):
    return lambda w: w == word


def bm25(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, score) of the documents that hold all of `words`, scored over all documents; texts are cut into words once."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    rows = docs.select("doc_id", ws.alias("ws")).select("doc_id", F.size("ws").alias("dl"), *(F.size(F.filter("ws", _is(w))).alias(f"f{i}") for i, w in enumerate(words)))
    rows = checkpoint(rows)
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words))))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)))
        score += idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avg")))
    held = rows.where(" and ".join(f"f{i} > 0" for i in range(len(words))))
    return held.crossJoin(F.broadcast(stats)).select("doc_id", F.round(score, 6).alias("score"))  # one row


def vector_top(vectors: DataFrame, query: DataFrame, limit: int, least: float, share: float) -> DataFrame:
    """The `limit` most similar vectors, cut off below `least` and below `share` of the best."""
    dot = F.expr("aggregate(zip_with(cast(embedding as array<double>), cast(q as array<double>), (x, y) -> x * y), 0d, (s, x) -> s + x)")
    top = vectors.crossJoin(F.broadcast(query.limit(1))).select(F.col("vec_id").alias("id"), F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    best = F.max("score").over(W.partitionBy())  # over `limit` rows
    return top.withColumn("best", best).where(F.col("score") >= F.greatest(F.lit(least), F.col("best") * share)).select("id", "score")


def ranked(df: DataFrame, *by) -> DataFrame:
    """Ranks from 1 for at most a pool of rows."""
    return df.withColumn("r", F.row_number().over(W.orderBy(*by))).select("id", "r")


ENGINES = ("fts", "vec", "filter")


def fuse(lists: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, r) by engine: sum of 1 / (60 + rank); ties by engine, then by its rank.

    (id, score, sources, rank); each list is a pool of bounded size.
    """
    every = None
    for name, rows in lists.items():
        rows = rows.withColumn("e", F.lit(ENGINES.index(name)))
        every = rows if every is None else every.unionByName(rows)
    out = every.groupBy("id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("r"))), 9).alias("score"), F.array_sort(F.collect_set("e")).alias("es"), F.min_by("r", "e").alias("first_rank"))
    names = F.array_join(F.transform("es", lambda e: F.element_at(F.lit(list(ENGINES)), e + 1)), ",")
    order = W.orderBy(F.desc("score"), F.col("es")[0], "first_rank")
    out = out.select("id", "score", names.alias("sources"), F.row_number().over(order).alias("rank"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def filter_ranking(lib, photos: DataFrame, limit: int) -> DataFrame:
    """(id, r): the newest of some photos; those without a time come last."""
    return ranked(photos.orderBy(F.desc_nulls_last("taken_at"), "id").limit(limit).select("id", "taken_at"), F.desc_nulls_last("taken_at"), "id")


def search(lib, request, limit: int = 60, texts: DataFrame | None = None, vectors: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:
    """Photos for a request, ranked: (id, score, sources, rank).

    Without words the conditions are the answer, newest first. With words, the full-text engine ranks what meets the
    conditions (`texts`, id and score, of the visible photos; by default the best of the library's text index, or without
    one the weighted search of `fts_document`), and the vector engine's best (`vectors`, id and score: a pool of the best
    of all; by default those of the library's vector index for the vector `query`) what is left of it after the conditions.
    Only where there are no vectors, and no text fits, the conditions answer alone.
    """
    from lumenary.operators import filters, fulltext, text_index, vector_index

    pool, allowed = max(4 * limit, 200), filters.matching(lib, request)
    newest = {"filter": filter_ranking(lib, allowed, pool)}
    if not request.text:
        return fuse(newest, limit)
    if texts is None:
        index = lib.text_folder and text_index.opened(lib.spark, lib.text_folder)
        texts = text_index.top(index, request.text, pool, allowed=allowed) if index else fulltext.search(lib.fts_document(), request.text)
    if vectors is None and query is not None and lib.vector_folder:
        vectors = vector_index.top(lib.spark, lib.vector_folder, query, pool, LEAST, SHARE)
    texts = texts.join(allowed.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(pool)
    lists = {"fts": ranked(texts, F.desc("score"), "id")}
    if vectors is not None:
        lists["vec"] = ranked(vectors.orderBy(F.desc("score"), "id").limit(pool).join(allowed.select("id"), "id", "left_semi"), F.desc("score"), "id")
    else:
        lists["filter"] = newest["filter"].join(texts.limit(1).select(F.lit(1).alias("found")), F.lit(True), "left_anti")  # one row
    return fuse(lists, limit)


def page(lib, hits: DataFrame, limit: int = 80, offset: int = 0, most: int = 2000) -> DataFrame:
    """A page of ranked hits with what it shows: id, rank, score to 5 digits, sources, caption, filename, and on each row
    how many hits there are and whether that is all that was counted."""
    from lumenary.operators import filters

    hits = checkpoint(hits.where(F.col("rank") <= max(most, limit + offset)))
    total = hits.agg(F.count("*").alias("total"))
    rows = hits.where((F.col("rank") > offset) & (F.col("rank") <= offset + min(limit, 500)))
    photos = lib.photo.select("id", "blake3", "taken_at").join(F.broadcast(rows), "id").join(filters.first_file(lib), "blake3", "left")
    captions = filters.winner(lib).select(F.col("photo_id").alias("id"), "caption")
    out = photos.join(captions, "id", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("id", "rank", F.round("score", 5).alias("score"), "sources", "caption", "filename", "taken_at", "total", (F.col("total") >= most).alias("capped"))


#: The fixture's query: two words, and the vector of row 0.
WORDS = ["by", "whst"]


def engines(lib) -> tuple[DataFrame, DataFrame]:
    """Full text and vector hits of the fixture's query: (id, score) each."""
    fts = bm25(lib.documents, WORDS).select(F.col("doc_id").alias("id"), "score")
    return fts, vector_top(lib.embeddings, lib.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")), POOL, 0.07, 0.2)


def rrf_fusion(lib) -> DataFrame:
    fts, vec = engines(lib)
    top = fts.orderBy(F.desc("score"), "id").limit(POOL)
    return fuse({"fts": ranked(top, F.desc("score"), "id"), "vec": ranked(vec, F.desc("score"), "id")})


def hybrid_search(lib) -> DataFrame:
    """Text filtered first, vectors after their global top; both fused."""
    from lumenary.plans.request import Request

    texts, vectors = engines(lib)
    return search(lib, Request(text=" ".join(WORDS)), 2000, texts, vectors).where("rank <= 400")
