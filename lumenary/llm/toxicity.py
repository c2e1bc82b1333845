"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class (toxic, ordinary) has a bigram model with absolute discounts that backs off to the class's words, and these
back off to shared counts: in how many different contexts a word stands in either class. A rare expression that a class
hasn't seen thus costs the same in both. A document's evidence is the difference of its length-normalised
log-likelihoods, over the whole text and in its most toxic window, turned into a probability by a logistic curve.

Counts cover all training rows; a document counts a pair of words once, so that a text that repeats one word a thousand
times doesn't make it an expression of its class. They are exact, in DataFrames. Words of which no class has more than
its discount are one word, the unknown one: they cost no less than the back-off alone. The model that tasks get holds
the other words and the pairs of which a class has more than its discount, 12 to 28 bytes each, and grows with the
labelled rows up to MODEL_WORDS and MODEL_PAIRS. Those of the lowest counts beyond these stay in tables: each text asks for
its words and pairs that the broadcast model doesn't hold, a join finds those that the tables do, and they go along with the
text. So all of them count, alike in either place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

_U = np.uint64
#: Taken off every count of the smaller class; of the larger one in proportion to its pairs.
DISCOUNT = 0.75
#: Back-off counts of a word, added to each class in proportion to its words: so many for each context that the word has
#: in either class, and so many for any word. An expression that no class has seen thus costs the same in both.
BACK_OFF = 0.01
ANY_WORD = 3
#: So many occurrences of the back-off distribution are added after each word, and so many of each pair, to both classes
#: in proportion. A pair's count says the more the higher it is above that, without bound.
PAIR_BACK_OFF = 60
ANY_PAIR = 30
WINDOW = 4
TOP = 4
#: Most words and pairs of the model that is broadcast: 112 and 96 MB; the rest are found by joins.
MODEL_WORDS = 4_000_000
MODEL_PAIRS = 8_000_000
#: Most labelled training rows whose evidence fits the logistic curve (4 numbers each). The counts have no such bound.
CALIBRATION_ROWS = 20_000
EVIDENCE = ("mean_ratio", "top_ratio", "n_words", "top_words")
_KINDS = ", ".join(f"{x} double" for x in EVIDENCE)
#: Stands before the first word of a document, and for all words that the model doesn't know.
START, UNKNOWN = _U(0x5EED), _U(0x0DD)
#: Distinct keys that a task holds at a time, about.
HELD = 1 << 19


def _merged(parts: list) -> list[np.ndarray]:
    """The sums of n0 and n1 over equal keys."""
    key, n0, n1 = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return [key[at], *(np.add.reduceat(n[order], at, dtype=np.int32) if len(at) else n for n in (n0, n1))]


#: What a batch brings along of the words and pairs that aren't in the broadcast model: none.
NONE = {"words": np.zeros(0, _U), "at": np.zeros(0, np.int64), "word": np.zeros(0), "context": np.zeros(0), "pairs": np.zeros(0, _U), "pair": np.zeros(0)}


def _pairs(words: np.ndarray, h: np.ndarray, counts: np.ndarray, more: np.ndarray = NONE["words"]) -> tuple[np.ndarray, np.ndarray]:
    """Places in `words`, and after them in `more`, of each word and of the one before it; the first of a document has the start mark before it."""
    start, unknown = np.searchsorted(words, np.array([START, UNKNOWN]))
    some, back = np.unique(h, return_inverse=True)
    at, known = _find(words, some)
    at = np.where(known, at, unknown)
    if len(more):
        far, there = _find(more, some)
        at = np.where(there, len(words) + far, at)
    w = at[back]
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[(np.cumsum(counts) - counts)[counts > 0]] = start
    return v, w


def _of(kept: np.ndarray, more: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at places in `kept` and, after them, in `more`."""
    if not len(more):
        return kept[at]
    far = at >= len(kept)
    out = kept[np.where(far, 0, at)]
    out[far] = more[at[far] - len(kept)]
    return out


def _keys(n: int, more_at: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of pairs: the numbers of both words. A word of the model has its place, below n, one of the tables its own number."""
    if len(more_at):
        v, w = (np.where(x < n, x, more_at[np.maximum(x - n, 0)]) for x in (v, w))
    return v.astype(_U) << _U(32) | w.astype(_U)


def _brought(batch) -> dict:
    """What the rows of a batch bring along: see _asking. Sorted by key, each once."""
    out = dict(NONE)
    for column, key, values in (("more_words", "words", ("at", "word", "context")), ("more_pairs", "pairs", ("pair",))):
        if column in batch.schema.names:
            held = batch.column(column).flatten()
            got = {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(held.type, held.flatten())}
            out[key], first = np.unique(got["key"].astype(np.int64).view(_U), return_index=True)
            out |= {c: got[c][first] for c in values if c in got}
    return out


def _asking(rows: DataFrame, model, column: str, table: DataFrame) -> DataFrame:
    """`rows` (row, a number of its own, text and more) with what each has of `table` (key and values), in an array.

    `model` is a broadcast of the sorted hashes of words, as "words", and for pairs of their keys, as "pairs": only what these
    don't hold is asked for, once for each row.
    """

    def run(batches):
        import pyarrow as pa

        m = model.value
        for batch in batches:
            more, number = _brought(batch), batch.column("row").to_numpy()
            for row, data, bounds in T.runs(batch.column("text")):
                key, counts = T.words(data, bounds, T.NOT_WORD)
                if not len(key):
                    continue
                if column == "more_pairs":
                    key = _keys(len(m["words"]), more["at"], *_pairs(m["words"], key, counts, more["words"]))
                doc, held = np.repeat(np.arange(len(counts)), counts), m["pairs" if column == "more_pairs" else "words"]
                some = ~_find(held, key)[1]
                key, doc = key[some], doc[some]
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[new], number[row + doc[new]]
                for s in range(0, len(key), 100_000):
                    yield pa.record_batch([pa.array(doc[s : s + 100_000]), pa.array(key[s : s + 100_000].view(np.int64))], names=["row", "key"])

    kept = ["row", "text", *(c for c in ("more_words",) if c in rows.columns)]
    asked = rows.select(*kept).mapInArrow(T.trimmed(run), "row long, key long")
    found = asked.join(table, "key").groupBy("row").agg(F.collect_list(F.struct(*table.columns)).alias(column))
    return rows.join(found, "row", "left")


def _count(words=None):
    """Rows (text, toxic) to (key, n0, n1): in how many documents of each class.

    Without `words`, a broadcast with the sorted hashes of the words kept, keys are hashes of words; with them the numbers
    of two words that follow each other.
    """

    def run(batches):
        import pyarrow as pa

        def out(parts):
            key, n0, n1 = _merged(parts)
            for s in range(0, len(key), 100_000):
                part = slice(s, s + 100_000)
                yield pa.record_batch([pa.array(x[part]) for x in (key.view(np.int64), n0, n1)], names=["key", "n0", "n1"])

        held, size = [], 0
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            more = _brought(batch)
            for row, data, bounds in T.runs(batch.column("text")):
                key, counts = T.words(data, bounds, T.NOT_WORD)
                if not len(key):
                    continue
                if words is not None:
                    kept = words.value["words"]
                    key = _keys(len(kept), more["at"], *_pairs(kept, key, counts, more["words"]))
                doc = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                n1 = toxic[row : row + len(counts)][doc[new]].astype(np.int32)
                held.append(_merged([[key[new], 1 - n1, n1]]))
                size += len(held[-1][0])
                if size > 2 * HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield from out(held)
                        held, size = [], 0
        if held:
            yield from out(held)

    return T.trimmed(run)


_KEYS = "key long, n0 int, n1 int"


def _collect(df: DataFrame, kinds: dict) -> list[np.ndarray]:
    """The columns of `df`, of bounded size, as arrays, brought to the driver packed, a partition at a time."""
    names = list(kinds)

    def pack(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            raw = b"".join(batch.column(x).to_numpy(zero_copy_only=False).astype(kinds[x]).tobytes() for x in names)
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([zstandard.ZstdCompressor(1).compress(raw)], pa.binary())], names=["n", "cells"])

    import zstandard

    parts = [[np.zeros(0, kinds[x])] for x in names]
    for r in df.select(*names).coalesce(16).mapInArrow(pack, "n long, cells binary").toLocalIterator():
        raw, at = zstandard.ZstdDecompressor().decompress(bytes(r["cells"])), 0
        for x, part in zip(names, parts):
            part.append(np.frombuffer(raw, kinds[x], r["n"], at))
            at += part[-1].nbytes
    return [np.concatenate(p) for p in parts]


def _share(rows: DataFrame) -> np.ndarray:
    """How much larger each class is than the smaller one, by its counts."""
    total = np.maximum(np.array([x or 0 for x in rows.agg(F.sum("n0"), F.sum("n1")).first()], float), 1)
    return total / total.min()


def _over(rows: DataFrame, share: np.ndarray, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of which a class has more than its discount: where they are over `most`, those of the largest counts, and the rest."""
    count = F.greatest(*(F.col(f"n{c}") / F.lit(float(share[c])) for c in (0, 1)))
    rows = rows.where(count > DISCOUNT)
    left = most
    for r in rows.groupBy(F.least(F.ceil(count), F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect():
        left -= r["count"]
        if left < 0:
            return rows.where(count > float(r["n"])), rows.where(count <= float(r["n"]))
    return rows, None


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """`rows` (key) with a column `at`: numbers from `first` on."""
    at = F.monotonically_increasing_id()
    rows = T.checkpoint(rows.select("key", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")))
    starts = []
    for r in rows.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts.append((r["part"], first))
        first += r["count"]
    if first >= 1 << 31:
        raise ValueError("over 2**31 words")
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, start long"))
    return rows.join(starts, "part").select("key", (F.col("start") + F.col("place")).alias("at"))


def _counts(rows: DataFrame) -> dict:
    """Exact counts of what has more than its discount in some class; see _model.

    `rest` are what is beyond the model's bounds: all words by number with their counts, the words (key, at) and the pairs
    (key, n0, n1) that aren't among the arrays; None where there are none.
    """
    words = T.checkpoint(rows.mapInArrow(_count(), _KEYS).groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    kept, more_words = _over(words, _share(words), MODEL_WORDS - 2)
    (key,) = _collect(kept, {"key": "u8"})
    key = np.unique(np.concatenate([key, [START, UNKNOWN]]))
    n = len(key)
    kept = rows.sparkSession.sparkContext.broadcast({"words": key})
    if more_words is not None:
        more_words = T.checkpoint(_numbered(more_words.select("key"), n))
        numbered = T.checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
        rows = _asking(numbered, kept, "more_words", more_words)
    T.release(words)
    pairs = T.checkpoint(rows.mapInArrow(_count(kept), _KEYS).groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    if more_words is not None:
        T.release(numbered)
    share = _share(pairs)
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    given = [F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(float(DISCOUNT * share[c])))).alias(f"g{c}") for c in (0, 1)]
    second = pairs.groupBy(F.col("key").bitwiseAND(0xFFFFFFFF).alias("w")).agg(F.count("*").alias("contexts"), *sums)
    first = pairs.groupBy(F.shiftright("key", 32).alias("v")).agg(*sums, *given)
    at, *x = _collect(second.where(F.col("w") < n), {"w": "i8", "contexts": "f8", "n0": "f8", "n1": "f8"})
    word = np.zeros((3, n))
    word[:, at] = x
    at, *x = _collect(first.where(F.col("v") < n), {"v": "i8", "n0": "f8", "n1": "f8", "g0": "f8", "g1": "f8"})
    follow = np.zeros((4, n))
    follow[:, at] = x
    inside = (F.shiftright("key", 32) < n) & (F.col("key").bitwiseAND(0xFFFFFFFF) < n)
    kept, more_pairs = _over(pairs if more_words is None else pairs.where(inside), share, MODEL_PAIRS)
    at, *x = _collect(kept, {"key": "u8", "n0": "f4", "n1": "f4"})
    order = np.argsort(at)
    if more_words is not None:  # pairs with a word of the tables are there too
        outside, _ = _over(pairs.where(~inside), share, 1 << 62)
        more_pairs = outside if more_pairs is None else more_pairs.unionByName(outside)
    rest = None
    if more_words is not None or more_pairs is not None:
        both = second.join(first.toDF("v", "f0", "f1", "g0", "g1"), F.col("w") == F.col("v"), "full").select(F.coalesce("w", "v").alias("at"), "contexts", "n0", "n1", "f0", "f1", "g0", "g1")
        rest = {"all": T.checkpoint(both.fillna(0)), "words": more_words, "pairs": T.checkpoint(more_pairs)}
    T.release(pairs)
    return {"share": share, "words": key, "n": word[1:], "backed": word[0], "follow": follow, "pairs": at[order], "pair_n": np.stack(x)[:, order], "rest": rest}


def _rest(raw: dict) -> tuple[np.ndarray, dict]:
    """Of the words and pairs beyond the model's bounds: what the words weigh in each class, and tables as _model's arrays.

    The words are (key, at, word, context), the pairs (key, pair).
    """
    share, rest, n = [float(x) for x in raw["share"]], raw["rest"], len(raw["words"])
    own = [F.greatest(F.col(f"n{c}") - F.lit(DISCOUNT * share[c]), F.lit(0.0)) + share[c] * (BACK_OFF * F.col("contexts") + ANY_WORD) for c in (0, 1)]
    left = [F.col(f"g{c}") + PAIR_BACK_OFF * share[c] for c in (0, 1)]
    alone = [F.log(left[c] / (F.col(f"f{c}") + PAIR_BACK_OFF * share[c])) for c in (0, 1)]
    some = rest["all"].where(F.col("at") >= n).agg(*(F.sum(x) for x in own)).first()
    weights = np.array([x or 0.0 for x in some])
    total = [float(x) for x in _own(raw).sum(1) + weights]
    known = rest["all"].select("at", *((own[c] / total[c]).alias(f"own{c}") for c in (0, 1)), *(left[c].alias(f"left{c}") for c in (0, 1)), (alone[1] - alone[0]).alias("context"))
    known = known.withColumn("word", F.log(F.col("own1") / F.col("own0")))
    words, pairs = rest["words"], rest["pairs"]
    if words is not None:
        words = T.checkpoint(words.join(known, "at").select("key", "at", F.col("word").cast("float").alias("word"), F.col("context").cast("float").alias("context")))
    if pairs is not None:
        a = known.select(F.col("at").alias("v"), "left0", "left1", "context")
        b = known.select(F.col("at").alias("w"), "own0", "own1", "word")
        pairs = pairs.withColumns({"v": F.shiftright("key", 32), "w": F.col("key").bitwiseAND(0xFFFFFFFF)}).join(a, "v").join(b, "w")
        base = [F.col(f"left{c}") * F.col(f"own{c}") + share[c] * ANY_PAIR for c in (0, 1)]
        logs = [F.log((F.greatest(F.col(f"n{c}") - F.lit(DISCOUNT * share[c]), F.lit(0.0)) + base[c]) / base[c]) for c in (0, 1)]
        pairs = T.checkpoint(pairs.select("key", (logs[1] - logs[0] + F.col("context") + F.col("word")).cast("float").alias("pair")))
    return weights, {"words": words, "pairs": pairs}


def _own(raw: dict) -> np.ndarray:
    """What each word of the arrays weighs in each class."""
    share = raw["share"]
    return np.maximum(raw["n"] - DISCOUNT * share[:, None], 0) + share[:, None] * (BACK_OFF * raw["backed"] + ANY_WORD)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return at, (keys[at] == x if len(keys) else np.zeros(len(x), bool))


def _model(raw: dict, weights: np.ndarray | float = 0.0) -> dict[str, np.ndarray]:
    """What scoring looks up: log ratios of words, of contexts that back off, and of pairs; `weights` are those of other words, see _rest.

    A class's word probability is its discounted count and its part of the back-off counts; a pair's is its discounted
    count and what the pairs after its first word gave up, spread by the word probabilities, and counts how many times
    more often than by back-off alone it is seen. A pair without an entry has the ratio of its word and its context.
    """
    share, pairs = raw["share"], raw["pairs"]
    own = _own(raw)
    own /= (own.sum(1) + weights)[:, None]
    left = raw["follow"][2:] + PAIR_BACK_OFF * share[:, None]
    alone = np.log(left / (raw["follow"][:2] + PAIR_BACK_OFF * share[:, None]))
    word, context = np.log(own[1] / own[0]), alone[1] - alone[0]
    ratio = np.zeros(len(pairs), np.float32)
    for s in range(0, len(pairs), 1 << 18):  # a part at a time, for memory
        v, w = (pairs[s : s + (1 << 18)] >> _U(32)).astype(np.int64), (pairs[s : s + (1 << 18)] & _U(0xFFFFFFFF)).astype(np.int64)
        logs = []
        for c in (0, 1):
            base = left[c][v] * own[c][w] + share[c] * ANY_PAIR
            logs.append(np.log((np.maximum(raw["pair_n"][c][s : s + (1 << 18)] - DISCOUNT * share[c], 0) + base) / base))
        ratio[s : s + (1 << 18)] = logs[1] - logs[0] + context[v] + word[w]
    return {"words": raw["words"], "word": word.astype(np.float32), "context": context.astype(np.float32), "pairs": pairs, "pair": ratio}


def _evidence(model, data, bounds, more: dict = NONE):
    """Mean log ratio, that of the most toxic window, the number of words and the mean of the top words, for each document of a run."""
    h, counts = T.words(data, bounds, T.NOT_WORD)
    out = np.zeros((len(counts), 4))
    if not len(h):
        return out
    v, w = _pairs(model["words"], h, counts, more["words"])
    ratio = _of(model["word"], more["word"], w).astype(float) + _of(model["context"], more["context"], v)
    key = _keys(len(model["words"]), more["at"], v, w)
    for pairs, values in ((model["pairs"], model["pair"]), (more["pairs"], more["pair"])):
        if len(pairs):
            at, ok = _find(pairs, key)
            ratio[ok] = values[at[ok]]
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    ends = np.cumsum(counts)
    starts = ends - counts
    out[:, 2] = counts
    out[:, 0] = (total[ends] - total[starts]) / np.maximum(counts, 1)
    # Windows of WINDOW words (a shorter text is one window), each normalised by its length.
    full = np.minimum(np.arange(len(h)) + WINDOW, np.repeat(ends, counts))
    first = np.maximum(np.repeat(starts, counts), full - WINDOW)
    windows = (total[full] - total[first]) / (full - first)
    some = counts > 0
    out[some, 1] = np.maximum.reduceat(windows, starts[some])
    # The mean of the TOP largest single words' ratios, each text's own.
    order = np.lexsort((-ratio, np.repeat(np.arange(len(counts)), counts)))
    best = np.concatenate([[0.0], np.cumsum(ratio[order])])
    upto = np.minimum(starts + TOP, ends)
    out[:, 3] = (best[upto] - best[starts]) / np.maximum(upto - starts, 1)
    return out


def _features(x: np.ndarray) -> np.ndarray:
    n = np.log1p(x[:, 2])
    return np.column_stack([np.ones(len(x)), x[:, 0], x[:, 1], n / 8, x[:, 3], x[:, 3] * n / 8])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.05 * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scorer(model, names):
    def run(batches):
        import pyarrow as pa

        m = model.value
        for batch in batches:
            out, more = np.zeros((batch.num_rows, 4)), _brought(batch)
            for row, data, bounds in T.runs(batch.column("text")):
                out[row : row + len(bounds) - 1] = _evidence(m, data, bounds, more)
            kept = [batch.column(n) for n in names]
            yield pa.record_batch([*kept, pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2]), pa.array(out[:, 3])], names=[*names, *EVIDENCE])

    return T.trimmed(run)


def _judged(rows: DataFrame, shared, rest: dict | None, names: list[str]) -> DataFrame:
    """`rows` (`names` and text) to `names` and evidence; words and pairs of the tables in `rest` count as those of the model do."""
    kinds = dict(rows.dtypes)
    if rest is not None:
        rows = T.checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
        for column, table in (("more_words", rest["words"]), ("more_pairs", rest["pairs"])):
            if table is not None:
                rows = T.checkpoint(_asking(rows, shared, column, table))
    return rows.mapInArrow(_scorer(shared, names), ", ".join(f"{x} {kinds[x]}" for x in names) + f", {_KINDS}")


def train(labelled: DataFrame) -> dict:
    """A model from rows (doc_id, text, toxic 0/1); rows with null labels are ignored.

    A fifth of the rows, by a hash of doc_id, only fits the logistic curve; the rest is counted. Without rows of both
    classes the score is the share of toxic rows (0.5 without any row).
    """
    rows = labelled.where("toxic in (0, 1)").select("text", F.col("toxic").cast("long").alias("toxic"), F.xxhash64("doc_id", F.lit(1)).alias("by"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold"))
    rows = T.checkpoint(rows)  # read three times
    raw = _counts(rows.where("fold <> 0").select("text", "toxic"))
    weights, rest = (0.0, None) if raw["rest"] is None else _rest(raw)
    shared = rows.sparkSession.sparkContext.broadcast(_model(raw, weights))
    held = _judged(rows.where("fold = 0").select("by", "toxic", F.col("text").cast("string").alias("text")), shared, rest, ["by", "toxic"])
    got = held.orderBy("by", *EVIDENCE).limit(CALIBRATION_ROWS).toPandas()
    T.release(rows)
    x, y = got[[*EVIDENCE]].to_numpy(float), got["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        curve = np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0])
    else:
        curve = _logistic(_features(x), y)
    return {"tables": shared, "rest": rest, "curve": curve}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` (doc_id, text; others are ignored) to (doc_id, score and its evidence), a row for each row.

    Whole texts count, lower-cased (A-Z), in words of letters and digits. A null or empty text has no evidence, and the
    score that the curve gives to none. Repeated rows and null doc_ids are kept, equal texts score alike, very long ones
    are read whole in bounded memory, and an empty table gives an empty result.
    """
    rows = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model["tables"], model["rest"], ["doc_id"])
    n = F.log1p("n_words") / 8
    terms = [F.lit(1.0), F.col("mean_ratio"), F.col("top_ratio"), n, F.col("top_words"), F.col("top_words") * n]
    z = sum((F.lit(float(c)) * t for c, t in zip(model["curve"], terms)), F.lit(0.0))
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """The labelled documents: (doc_id, text, label column). Of several labels of a doc_id the largest counts.

    Documents without a label are mostly dropped before the join by a bitmap of the labelled ids (16 MB at most),
    so that their texts aren't shuffled.
    """
    labels = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias(column))
    bits = docs.sparkSession.sparkContext.broadcast(T.id_bits(labels.select("doc_id")))

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(T.has_bit(bits.value, batch.column("doc_id"))))

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(keep, "doc_id long, text string")
    return some.join(labels.hint("merge"), "doc_id")  # alike at every size of the labels


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = T.table(spark, sf_dir, "labels").where(~T.held_out(F.col("doc_id"), 4, 2))
    scored = score(docs, train(labelled_rows(docs, labels, "toxic")))
    return scored.select("doc_id", T.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "mean_ratio", "top_ratio", "top_words")
