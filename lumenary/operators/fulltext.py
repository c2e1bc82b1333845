"""Full-text search over several weighted columns: all phrases must occur, the last one as a prefix; scored by BM25."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.functions import stem
from lumenary.sources.shared import checkpoint

#: How much an occurrence in a column counts.
WEIGHTS = {"caption": 8.0, "tags": 6.0, "ocr": 3.0, "people": 10.0, "filename": 2.0, "folder": 1.0, "place": 4.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Rows of whole texts that a worker stems at a time: it holds their words as objects, many times the bytes of the texts.
TEXTS = 500


def phrases(query: str) -> list[list[str]]:
    """The query's words, each as the index would split it (an underscore makes a phrase of two words)."""
    return [p for p in (stem.words(w) for w in re.findall(r"\w+", query)) if p]


def _occurrences(words: Column, phrase: list[str], prefix: bool) -> Column:
    k = len(phrase)
    want = [F.lit(w) for w in phrase]

    def fits(i):
        at = [F.get(words, i + j) for j in range(k)]
        tests = [a == w for a, w in zip(at[:-1], want[:-1])] + [at[-1].startswith(want[-1]) if prefix else at[-1] == want[-1]]
        return reduce(Column.__and__, tests)

    if k == 1:
        return F.size(F.filter(words, lambda w: w.startswith(want[0]) if prefix else w == want[0]))
    return F.when(F.size(words) >= k, F.size(F.filter(F.sequence(F.lit(0), F.size(words) - k), fits))).otherwise(0)


def search(docs: DataFrame, query: str, weights: dict[str, float] = WEIGHTS, last_is_prefix: bool = True) -> DataFrame:
    """(id, score) of the rows of `docs` (id and text columns as in `weights`) that hold all phrases; none for no phrase.

    Null columns are empty. Words are stemmed once; what is left of a row are its length and weighted counts.
    """
    want = phrases(query)
    if not want:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    cut = docs.select("id", *(stem.stemmed(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in weights))
    size = sum((F.size(c) for c in weights), F.lit(0))
    found = [sum((_occurrences(F.col(c), p, last_is_prefix and i == len(want) - 1) * F.lit(w) for c, w in weights.items()), F.lit(0.0)).alias(f"f{i}") for i, p in enumerate(want)]
    rows = checkpoint(cut.select("id", size.alias("size"), *found), TEXTS)
    stats = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(want))))
    held = reduce(Column.__and__, (F.col(f"f{i}") > 0 for i in range(len(want))))
    score = F.lit(0.0)
    for i in range(len(want)):
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)))
        score += idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return rows.where(held).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # stats: one row
