"""Document quality by a small convolutional network over bytes, in numpy.

A text becomes one symbol per byte: the byte, and whether the eight bytes before this place also end some 2 to 40 bytes
earlier (a text that repeats itself; made by hand, as filters over a few bytes can't see repetition). The symbols cover
the whole document in overlapping chunks of CHUNK bytes, every half chunk one. Learned filters run over each chunk, are
rectified and max-pooled; the pooled chunks are averaged and a last layer combines them into one probability. Training
takes whole texts, as scoring does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

HALF = 128
CHUNK = 2 * HALF
WIDTH = 6
STRIDE = 2
EMBED = 4
FILTERS = 16
LAGS = range(2, 41)
#: The labelled rows that the network is fitted on, at most so many of each class, the first by a hash of doc_id; whole
#: texts. All rows are scored.
TRAIN_ROWS = 1500
EPOCHS = 8
BATCH = 32
_WINDOWS = HALF // STRIDE
#: The last windows of a half chunk that reach beyond it.
_BEYOND = -(-(WIDTH - 1) // STRIDE)


def _symbols(data: np.ndarray, bounds: np.ndarray, repeats: bool = True):
    """Symbols of a run of documents, each padded to whole half chunks (two at least), and the number of half chunks."""
    n = len(data)
    again = np.zeros(n, bool)
    if n > 8 and repeats:
        eight = np.zeros(n - 7, np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | data[i : i + n - 7].astype(np.uint64)
        for lag in LAGS:
            if lag < len(eight):
                again[7 + lag :] |= eight[lag:] == eight[:-lag]
        first = np.repeat(bounds[:-1], np.diff(bounds))
        again &= np.arange(n) - first >= LAGS[-1] + 8  # nothing from the text before
    lengths = np.diff(bounds)
    halves = np.maximum(2, -(-lengths // HALF))
    out = np.zeros(int(halves.sum()) * HALF + WIDTH, np.int16)
    starts = (np.cumsum(halves) - halves) * HALF
    out[np.arange(n) + np.repeat(starts - bounds[:-1], lengths)] = 1 + data.astype(np.int16) + 256 * again
    return out, halves


def _tops(net, symbols: np.ndarray, halves: np.ndarray):
    """For each half chunk the filters' largest sums and the windows that have them.

    A window may reach into the next half chunk of its own text, but not into another text.
    """
    total = int(halves.sum())
    last = np.zeros(total, bool)
    last[np.cumsum(halves) - 1] = True
    top, arg = np.empty((total, FILTERS), net["filters"].dtype), np.empty((total, FILTERS), np.int16)
    step = 512
    for k in range(0, total, step):
        m = min(step, total - k)
        x = net["embed"][symbols[k * HALF : (k + m) * HALF + WIDTH]]
        # A window at every STRIDE-th place: a view of WIDTH embedded symbols, then one matrix product.
        windows = np.lib.stride_tricks.as_strided(x, (m * _WINDOWS, WIDTH * EMBED), (STRIDE * EMBED * x.itemsize, x.itemsize))
        y = (windows @ net["filters"] + net["bias"]).reshape(m, _WINDOWS, FILTERS)
        y[last[k : k + m], _WINDOWS - _BEYOND :] = -np.inf
        arg[k : k + m] = y.argmax(1)
        top[k : k + m] = np.take_along_axis(y, arg[k : k + m, None].astype(np.int64), 1)[:, 0]
    return top, arg


def _chunks(top: np.ndarray, halves: np.ndarray):
    """Pooled chunks, one for each half chunk and the next (0 for the last of a text), and whether the next one has the maximum."""
    right = np.zeros_like(top, bool)
    right[:-1] = top[1:] > top[:-1]
    pair = np.maximum(top, 0)
    pair[:-1] = np.maximum(pair[:-1], pair[1:])
    ends = np.cumsum(halves)
    pair[ends - 1] = 0
    return pair, right, np.add.reduceat(pair, ends - halves, axis=0) / (halves - 1)[:, None]


def _probability(net, pooled):
    z = np.full(len(pooled), net["last"], np.float64)
    for i, w in enumerate(net["out"]):  # a matrix product may add up in another order at another place
        z += pooled[:, i] * w
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _exact(net: dict) -> dict:
    """`net` in doubles, rounded so that all sums of a window are exact: they are the same in any order, at any place."""
    embed, filters, bias = (net[k].astype(np.float64) for k in ("embed", "filters", "bias"))
    most = WIDTH * EMBED * np.abs(embed).max() * np.abs(filters).max() + np.abs(bias).max() + 1
    scale = 2.0 ** int((51 - np.ceil(np.log2(most))) // 2)
    return net | {"embed": np.round(embed * scale) / scale, "filters": np.round(filters * scale) / scale, "bias": np.round(bias * scale) / scale}


def _gradient(net, symbols, halves, labels, weight):
    """The gradient of the weighted log-loss of some texts; it reaches the best window of each filter and chunk only."""
    top, arg = _tops(net, symbols, halves)
    pair, right, pooled = _chunks(top, halves)
    dz = ((_probability(net, pooled) - labels) * weight / len(labels)).astype(np.float32)
    # Each chunk's share goes to the half with the maximum, if that is above 0.
    share = np.repeat(dz / (halves - 1), halves)[:, None] * net["out"] * (pair > 0)
    share[np.cumsum(halves) - 1] = 0
    dtop = np.where(right, 0, share)
    dtop[1:] += np.where(right, share, 0)[:-1]
    place = (np.arange(len(arg))[:, None] * HALF + arg.astype(np.int64) * STRIDE)[:, :, None] + np.arange(WIDTH)
    hit = symbols[place]  # half chunk, filter, symbol of its best window
    best = net["embed"][hit].reshape(len(arg), FILTERS, -1)
    dx = (dtop[:, :, None] * net["filters"].T).reshape(-1, EMBED)
    embed = np.stack([np.bincount(hit.reshape(-1), dx[:, i], 513) for i in range(EMBED)], axis=1)
    return {"out": pooled.T @ dz + 1e-4 * net["out"], "last": dz.sum(), "filters": np.einsum("cfi,cf->if", best, dtop), "bias": dtop.sum(0), "embed": embed}


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 0, repeats: bool = True) -> dict:
    """Train on whole texts and labels (0/1); classes weigh the same. Adam over small batches; the same seed gives the same net."""
    rng = np.random.default_rng(seed)
    net = {"embed": rng.normal(0, 0.5, (513, EMBED)), "filters": rng.normal(0, 0.3, (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, FILTERS), "last": np.zeros(())}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    share = float(np.mean(labels)) if len(labels) else 0.5
    if not 0 < share < 1:
        net["out"][:] = 0
        net["last"] = np.float32(4 * share - 2 if len(labels) else 0)
        return net
    made = []
    for t in texts:
        s, halves = _symbols(np.frombuffer(t, np.uint8), np.array([0, len(t)]), repeats)
        made.append((s[: int(halves[0]) * HALF], int(halves[0])))
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    steps, tail = 0, np.zeros(WIDTH, np.int16)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            symbols = np.concatenate([*(made[i][0] for i in rows), tail])
            g = _gradient(net, symbols, np.array([made[i][1] for i in rows]), labels[rows], weight[rows])
            steps += 1
            for k, v in net.items():
                m, w = moments[k]
                m = 0.9 * m + 0.1 * g[k]
                w = 0.99 * w + 0.01 * np.square(g[k])
                moments[k] = m, w
                net[k] = (v - 0.01 * (1 - epoch / EPOCHS) * (m / (1 - 0.9**steps)) / (np.sqrt(w / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: dict, column) -> np.ndarray:
    """The probability of each text of an Arrow column; none depends on another text, or on its place in the column."""
    net, out = _exact(net), np.zeros(len(column))
    for row, data, bounds in T.runs(column):
        symbols, halves = _symbols(data, bounds)
        out[row : row + len(bounds) - 1] = _probability(net, _chunks(_tops(net, symbols, halves)[0], halves)[2])
    return out


def _score(net, kept: int, text: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score = pa.array(probabilities(net.value, batch.column(text)))
            yield pa.record_batch([*batch.columns[:kept], score], names=[*batch.schema.names[:kept], f"c{batch.num_columns}"])

    return run


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, repeats: bool = True) -> dict:
    """A network from documents (doc_id, text) and labels (doc_id, quality 0/1), fitted on `train_rows` of each class at most.

    Labels that are null or other, and those of no document, are ignored; of several labels of a doc_id the largest
    counts, of several texts the first in order. Rows are chosen by their ids alone; only the chosen ones' texts are
    read to the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    there = labels.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("by", F.xxhash64("doc_id"))
    few = [r for q in (0, 1) for r in there.where(F.col("quality") == q).orderBy("by", "doc_id").limit(train_rows).collect()]
    if not few:
        return fit([], np.zeros(0, np.float32))
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in few], "doc_id long")
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = {r["doc_id"]: bytes(r["text"]) for r in found.select("doc_id", F.col("text").cast("binary").alias("text")).coalesce(8).toLocalIterator()}
    rows = [r for r in few if r["doc_id"] in texts]
    return fit([texts[r["doc_id"]] for r in rows], np.array([r["quality"] for r in rows], np.float32), repeats=repeats)


def score(docs: DataFrame, net: dict, keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """`docs` with a column named `column`, the probability of good quality; `keep` names the columns to return (doc_id).

    Whole texts are read, in overlapping chunks; null and empty texts are one chunk of padding, and very long ones are
    cut into many. A row for each row, whatever its neighbours are. Columns may have any names; one named `column` is
    replaced.
    """
    names = [n for n in (keep or ["doc_id"]) if n.lower() != column.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    own = "text" in names and dict(docs.dtypes)["text"] == "string"
    rows = docs.select(*T.columns(names), *([] if own else [F.col("text").cast("string").alias(T.fresh("text_", names))]))
    return T.map_arrow(rows, _score(shared, len(names), names.index("text") if own else len(names)), names, f"{column} double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = T.table(spark, sf_dir, "labels").where(~T.held_out(F.col("doc_id"), 3, 1))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", T.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
