"""Language identification by bit-sliced Bloom filters of byte n-grams.

Each language's n-grams go into a Bloom filter; the filters are stored bit-sliced, so slot i is one integer with a bit
for each language, and ANDing the few slots of an n-gram returns all languages that contain it. A text's n-grams are
counted by language (a popcount of each bit). A count c of n n-grams with a filter's false-positive rate f is corrected
to (c - f * n) / (1 - f); the language with most hits wins.

An n-gram is a language's from MIN_SHARE of the language's n-grams on, at every size of the corpus, so that a filter
holds 50,000 at most; rarer ones, of which a large corpus has every one in every language, tell languages apart no
better than chance. A text of such n-grams only has no hit, and gets the most frequent language.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

GRAM = 4
#: An n-gram belongs to a language from this share of the language's n-grams on, so a filter holds 1 / MIN_SHARE at most.
MIN_SHARE = 2e-5
SLOTS = 1 << 21
PROBES = 3
_U = np.uint64
#: Bytes of letters, lower-cased; every other ASCII byte counts as a space.
_FOLD = np.where(T.NOT_WORD, 32, T.LOWER).astype(np.uint8)
_FOLD[48:58] = 32


def _grams(data: np.ndarray, bounds: np.ndarray):
    """N-grams of each document of a run as integers, with the document of each; each text has a space on both sides.

    N-grams that don't begin with part of a letter after a space or letter are kept; those of spaces only are not.
    """
    lengths = np.diff(bounds)
    size = int(bounds[-1]) + (GRAM - 1) * len(lengths)
    padded = np.full(size, 32, np.uint8)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    padded[np.arange(len(data)) + 1 + doc * (GRAM - 1)] = _FOLD[data]
    wide = padded.astype(np.uint32)
    key = np.zeros(max(0, size - GRAM + 1), np.uint32)
    for i in range(GRAM):
        key = (key << np.uint32(8)) | wide[i : i + len(key)]
    owner = np.repeat(np.arange(len(lengths)), lengths + GRAM - 1)[: len(key)]
    # A window that reaches into the next text starts in the last GRAM - 1 places of its own.
    last = (bounds[1:] + (GRAM - 1) * np.arange(1, len(lengths) + 1)) - (GRAM - 1)
    inside = np.arange(len(key)) <= last[owner] if len(key) else np.zeros(0, bool)
    keep = inside & (key != 0x20202020)
    return key[keep], owner[keep]


def _count(batches):
    """Rows (text, lang) to (lang, gram, n), added up in the task as far as memory for a few million entries goes."""
    import pyarrow as pa

    held: dict[str, list] = {}
    size = 0

    def merged(parts):
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

    def flush():
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for row, data, bounds in T.runs(batch.column("text")):
            key, owner = _grams(data, bounds)
            own = langs[row : row + len(bounds) - 1]
            for lang in set(own):
                mine = key[(own == lang)[owner]]
                k, n = np.unique(mine, return_counts=True)
                if len(k):
                    held.setdefault(lang, []).append((k, n))
                    size += len(k)
        if size > 3_000_000:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > 2_000_000:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _places(key: np.ndarray):
    """The slots of n-grams: two halves of one scrambled value, combined."""
    x = T.mix(key.astype(_U) + _U(0x51ED270B))
    a, b = x & _U(0xFFFFFFFF), (x >> _U(32)) | _U(1)
    return [((a + _U(i) * b) & _U(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def train(rows: DataFrame, min_share: float = MIN_SHARE) -> dict:
    """Filters from all rows (text, lang); rows with null lang are ignored. Returns languages, filters and false-positive rates."""
    rows = rows.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = T.checkpoint(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    least = F.greatest(F.lit(2.0), F.col("total") * min_share)
    kept = counts.join(totals, "lang").where(F.col("n") >= least).select("lang", "gram").toPandas()
    size = {r["lang"]: r["total"] for r in totals.collect()}
    langs = sorted(size)
    slices = -(-len(langs) // 64) or 1
    table = np.zeros((slices, SLOTS), _U if len(langs) > 8 else np.uint8)
    rates = []
    for i, lang in enumerate(langs):
        bit = table.dtype.type(1 << (i % 64))
        for at in _places(kept["gram"][kept["lang"] == lang].to_numpy(np.int64).astype(np.uint32)):
            table[i // 64][at] |= bit
        rates.append(float((table[i // 64] & bit != 0).mean()) ** PROBES)
    return {"langs": langs, "table": table, "rates": np.array(rates), "common": max(langs, key=lambda x: (size[x], x), default="und")}


def _predict(model, names):
    def run(batches):
        import pyarrow as pa

        m = model.value
        langs, table, rates = m["langs"], m["table"], m["rates"]
        one = table.dtype.type(1)
        for batch in batches:
            hits = np.zeros((batch.num_rows, len(langs)))
            total = np.zeros(batch.num_rows, np.int64)
            for row, data, bounds in T.runs(batch.column("text")):
                key, owner = _grams(data, bounds)
                docs = len(bounds) - 1
                total[row : row + docs] = np.bincount(owner, minlength=docs)
                at = _places(key)
                for s in range(len(table)):
                    mask = table[s][at[0]]
                    for p in at[1:]:
                        mask &= table[s][p]
                    for i in range(64 * s, min(len(langs), 64 * s + 64)):
                        bit = table.dtype.type(i % 64)
                        hits[row : row + docs, i] = np.bincount(owner, (mask >> bit) & one, minlength=docs)
            n = np.maximum(total, 1)[:, None]
            share = np.clip((hits / n - rates) / (1 - rates), 0, 1)
            best = share.argmax(1) if langs else np.zeros(batch.num_rows, int)
            score = share.max(1) if langs else np.zeros(batch.num_rows)
            lang = [langs[b] if langs and s > 0 else m["common"] for b, s in zip(best, score)]
            yield pa.record_batch([*(batch.column(x) for x in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` (doc_id, text; others are ignored) to (doc_id, lang_pred, score), a row for each row.

    Whole texts are read, very long ones too; repeated rows are kept and equal texts judged alike. A text that is null or has no letter is `und` with score 0. A text without a known n-gram, or
    with as many in two languages, gets the most frequent, or the first by name. The score is the corrected share of
    n-grams in the language. Without training rows all is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text"))
    out = rows.mapInArrow(_predict(shared, ["doc_id", "letters"]), "doc_id long, letters boolean, lang_pred string, score double")
    return out.select("doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~T.held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", T.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
