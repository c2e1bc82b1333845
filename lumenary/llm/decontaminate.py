"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact weighted-shingle similarity.

Every benchmark item and every window of an item's size in a document gets a 64-bit SimHash of its weighted word
shingles (a shingle weighs as many units as it has characters). The fingerprints are cut into BLOCKS blocks; two
fingerprints within RADIUS bits differ in some block by at most RADIUS // BLOCKS bits, so the items are entered under all
values so near to their own in each block, and equal blocks give every pair within the radius. Candidates are verified
by the exact weighted Jaccard similarity of their shingle multisets.

Windows are only built where they can match. A window as similar as asked shares shingles with the item, and each
shingle holds its longest word: a first pass over all texts looks up those words, checks the shingles around them, and
keeps the documents that hold enough weight of an item's shingles. Nothing similar enough is lost by that.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Three bits in each block. No bound on similarity follows from it, but brute force finds no pair beyond it among edited copies.
RADIUS = 23
BLOCKS = 6
#: Benchmark shingles that are looked up at a time (some 100 bytes each are broadcast); more need more passes over the texts.
LOOKED_UP = 300_000
SPLIT = r"[\x20\x09-\x0D]+"
#: Windows that are fingerprinted, and shingles of candidates that are counted, by one task, about: so that a task's tables don't grow with the input.
TASK_WINDOWS = 50_000
TASK_SHINGLES = 500_000


def _words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), SPLIT), lambda w: w != "")


def _weight(shingle: Column) -> Column:
    return F.char_length(F.array_join(shingle, "")).cast("long")


def _fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, h, w) to one (keys, fingerprint, weight) each: bit j is set if shingles with bit j weigh more than half.

    Two bits share one sum of 64 bits, 32 each, so a window may weigh up to 2**32 units.
    """
    lanes = 0x0000000100000001
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(lanes)) * F.col("w")).alias(f"s{j}") for j in range(32)]
    out = rows.groupBy(*keys).agg(F.sum("w").alias("weight"), *sums)
    bits = []
    for j in range(32):
        bits.append(F.when(2 * F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("weight"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        high = (1 << (j + 32)) if j < 31 else -(1 << 63)
        bits.append(F.when(2 * F.shiftrightunsigned(F.col(f"s{j}"), 32) > F.col("weight"), F.lit(high).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return out.select(*keys, "weight", bits[0].alias("fingerprint"))


def _blocks() -> list[tuple[int, int]]:
    """Shift and width of each block; the widths add up to 64."""
    out, at = [], 0
    for b in range(BLOCKS):
        width = 64 // BLOCKS + (b < 64 % BLOCKS)
        out.append((at, width))
        at += width
    return out


def _near(width: str, distance: int) -> Column:
    """All masks of `width` bits with at most `distance` bits set; made where they are used, as lists of them are long in a plan."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {width})") - 1), lambda m: F.bit_count(m) <= distance)


def _places(fingerprint: str) -> Column:
    """Of a fingerprint: block, width and value of each of its blocks."""
    value = lambda shift, width: F.shiftrightunsigned(fingerprint, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("long")
    return F.array(*(F.struct(F.lit(b).alias("block"), F.lit(n).alias("width"), value(s, n).alias("value")) for b, (s, n) in enumerate(_blocks())))


def _tasks(rows: int | None, each: int) -> int:
    """Partitions of about `each` rows; their number is fixed, so that Spark doesn't put them together by their bytes."""
    return max(1, -(-(rows or 0) // each))


def _slot(size: str, block: str, value) -> Column:
    """Size of a window, block and value of it as one number, by which rows meet."""
    value = F.col(value) if isinstance(value, str) else value
    return ((F.col(size).cast("long") * BLOCKS + F.col(block)) * F.lit(1 << (-(-64 // BLOCKS))) + value).alias("slot")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 75, radius: int = RADIUS, keep_key: bool = False) -> DataFrame:
    """The documents that hold a benchmark item: doc_id, item_id, start_word, n_words, similarity, hamming.

    One row for each document and item, for its most similar window (the first, of several): `n_words` words from
    `start_word` on, counted from 0. A window has the item's number of words, or is the whole of a shorter document. It
    counts if its fingerprint is within `radius` bits of the item's and its weighted Jaccard similarity, over shingles
    of `width` words (of all words, for shorter items), is at least `percent` hundredths. Words are lower-cased (A-Z)
    and parted by ASCII white space. Null and empty texts or items match nothing; a repeated row gives one row; rows
    with a null doc_id are reported with it; of equal items each is reported. Very long texts are compared whole, an empty
    table of either kind gives no rows, and further columns are ignored, whatever their names. `keep_key` adds the rows' hash, `rid`.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    items = items.distinct().withColumn("size", F.size("iw")).withColumn("k", F.least("size", F.lit(width)))
    items = items.select("item_id", "size", "k", F.xxhash64("iw").alias("same"), F.posexplode(F.expr("transform(sequence(1, size - k + 1), i -> slice(iw, i, k))")).alias("i", "g"))
    items = T.checkpoint(items.select("item_id", "same", "size", "k", "i", F.xxhash64("g").alias("h"), _weight(F.col("g")).alias("w"), "g"))
    # Each shingle is found by its longest word (the first of several).
    best = F.array_max(F.transform("g", lambda w, i: F.struct(F.char_length(w).alias("n"), (-i).alias("i"), w.alias("word"))))
    anchors = items.withColumn("a", best).select(F.col("a.word").alias("word"), (-F.col("a.i")).cast("int").alias("off"), "h", "k").distinct()
    words = docs.select("rid", _words(F.col("text")).alias("ws"))
    placed = words.select("rid", "ws", F.posexplode("ws").alias("p", "word"))
    anchors = T.checkpoint(anchors)
    passes, hits = max(1, -(-anchors.count() // LOOKED_UP)), None
    for i in range(passes):
        some = anchors.where(F.pmod("h", F.lit(passes)) == i)
        hit = placed.join(F.broadcast(some), "word").where("p >= off and p - off + k <= size(ws) and xxhash64(slice(ws, greatest(p - off, 0) + 1, k)) = h")
        hit = hit.select("rid", (F.col("p") - F.col("off")).alias("p"), "h")
        hits = hit if hits is None else hits.unionByName(hit)
    hits = T.checkpoint(hits.distinct())

    # An item's shingles that a document holds must weigh `percent` of the item at least, repeated ones as often as there.
    own = items.groupBy("item_id", "size", "k", "h", "w").agg(F.count("*").alias("c"))
    total = items.groupBy("item_id").agg(F.sum("w").alias("item_weight"))
    held = hits.groupBy("rid", "h").agg(F.count("*").alias("n")).join(own, "h")
    held = held.groupBy("rid", "item_id", "size", "k").agg(F.sum(F.col("w") * F.least("c", "n")).alias("got")).join(total, "item_id")
    likely = T.checkpoint(held.where(100 * F.col("got") >= percent * F.col("item_weight")).select("rid", "item_id", "size", "k"))

    # Windows of the items' sizes around the hits, in the few documents that are left: a bitmap drops the others.
    some = T.marked(docs, "rid", likely.select("rid"), "likely").where("likely")
    texts = T.checkpoint(some.select("rid", "doc_id", _words(F.col("text")).alias("ws")).dropDuplicates(["rid"]))
    sizes = likely.select("rid", "item_id", "size", "k").join(own.select("item_id", "h").distinct(), "item_id").join(hits, ["rid", "h"])
    spots = T.checkpoint(sizes.groupBy("rid", "size", "k").agg(F.array_sort(F.collect_set("p")).alias("ps")))
    # Each hit but the first adds the starts between it and the one before, as many as a window has places for it at most.
    new = F.expr("size - k + 1 + aggregate(transform(slice(ps, 2, size(ps)), (p, i) -> least(p - ps[i], size - k + 1)), 0L, (a, x) -> a + x)")
    n_tasks = _tasks(spots.agg(F.sum(new)).first()[0], TASK_WINDOWS)
    window = texts.repartition(n_tasks, "rid").join(spots.repartition(n_tasks, "rid").hint("merge"), "rid").withColumn("n", F.least("size", F.size("ws")))
    # Shingles are hashed and weighed once a document, and cut into windows by their places.
    hashed = "transform(if(size(ws) >= k, sequence(1, size(ws) - k + 1), array()), i -> {})"
    grams = F.expr(hashed.format("named_struct('h', xxhash64(slice(ws, i, k)), 'w', cast(char_length(array_join(slice(ws, i, k), '')) as bigint))"))
    # All starts of windows that hold one of the hits, each once.
    starts = F.expr("array_distinct(flatten(transform(ps, p -> sequence(greatest(0, p + k - n), least(p, n_words - n)))))")
    window = window.where("n >= k").select("rid", "doc_id", "size", "n", "k", "ps", F.size("ws").alias("n_words"), grams.alias("gs"))
    window = window.select("rid", "doc_id", "size", "n", "k", "gs", F.explode(starts).alias("s"))
    grams = window.select("rid", "doc_id", "size", "n", "s", F.explode(F.expr("slice(gs, s + 1, n - k + 1)")).alias("g")).select("rid", "doc_id", "size", "n", "s", "g.h", "g.w")
    # Both kinds of fingerprints are written: 64 conditions each would otherwise stand in the plan again for every block.
    prints = T.checkpoint(_fingerprint(grams, ["rid", "doc_id", "size", "n", "s"]))
    item_prints = T.checkpoint(_fingerprint(items.select("item_id", "size", "h", "w"), ["item_id", "size"]).select("item_id", "size", F.col("fingerprint").alias("item_print"), F.col("weight").alias("item_weight")))

    # Multi-index: the items under every value near to theirs in each block.
    entries = item_prints.select("item_id", "size", "item_print", "item_weight", F.explode(_places("item_print")).alias("x"))
    entries = entries.withColumn("mask", F.explode(_near("x.width", radius // BLOCKS)))
    entries = entries.select(_slot("size", "x.block", F.col("x.value").bitwiseXOR(F.col("mask"))), "item_id", "item_print", "item_weight")
    wide = prints.select("rid", "doc_id", "size", "n", "s", "fingerprint", "weight", F.explode(_places("fingerprint")).alias("x")).withColumn("slot", _slot("size", "x.block", "x.value")).drop("x")
    pairs = wide.join(entries, "slot").withColumn("hamming", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))))
    pairs = pairs.where(F.col("hamming") <= radius).select("rid", "doc_id", "size", "n", "s", "weight", "item_id", "item_weight", "hamming").distinct()
    pairs = T.checkpoint(pairs)
    T.release(prints)

    # Exact: shingle multisets of the candidates.
    some = pairs.groupBy("rid", "size", "n").agg(F.collect_set("s").alias("ss")).withColumn("k", F.least("size", F.lit(width)))
    n_tasks = _tasks(some.agg(F.sum(F.expr("size(ss) * cast(n - k + 1 as bigint)"))).first()[0], TASK_SHINGLES)
    again = texts.repartition(n_tasks, "rid").join(some.repartition(n_tasks, "rid").hint("merge"), "rid")
    again = again.select("rid", "size", "n", "k", "ss", F.expr(hashed.format("xxhash64(slice(ws, i, k))")).alias("hs")).select("rid", "size", "n", "k", "hs", F.explode("ss").alias("s"))
    again = again.select("rid", "size", "s", F.explode(F.expr("slice(hs, s + 1, n - k + 1)")).alias("h"))
    if passes == 1:  # only shingles of the benchmark can be common; so few are broadcast
        again = again.join(F.broadcast(own.select("h").distinct()), "h", "left_semi")
    again = again.groupBy("rid", "size", "s", "h").agg(F.count("*").alias("n1"))
    common = pairs.join(again, ["rid", "size", "s"]).join(own.select("item_id", "h", "w", "c"), ["item_id", "h"])
    common = common.groupBy("rid", "doc_id", "item_id", "s", "n", "weight", "item_weight", "hamming").agg(F.sum(F.col("w") * F.least("n1", "c")).alias("both"))
    found = common.withColumn("any", F.col("weight") + F.col("item_weight") - F.col("both")).where(100 * F.col("both") >= percent * F.col("any"))
    found = found.withColumn("similarity", F.col("both") / F.col("any"))
    first = F.max_by(F.struct("s", "n", "similarity", "hamming"), F.struct(F.col("similarity").alias("a"), (-F.col("s")).alias("b")))
    out = found.groupBy("rid", "item_id").agg(F.first("doc_id").alias("doc_id"), first.alias("x"))
    return out.select(*(["rid"] if keep_key else []), "doc_id", "item_id", F.col("x.s").cast("long").alias("start_word"), F.col("x.n").cast("long").alias("n_words"), F.col("x.similarity").alias("similarity"), F.col("x.hamming").cast("long").alias("hamming"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that hold a benchmark item; all other rows stay, null and empty texts too.

    All columns stay, whatever their names; repeated rows stay or go together; very long texts are compared whole; an
    empty `docs` stays empty, and an empty `benchmark` leaves all rows. Only rows that a bitmap of 2 MB can't rule out are joined.
    """
    bad = T.checkpoint(contaminated(docs, benchmark, keep_key=True, **options).select("rid").distinct())
    key = F.xxhash64(F.col("row.doc_id").cast("long"), F.col("row.text").cast("string"))
    rows = T.marked(T.packed(docs).withColumn("rid", key), "rid", bad, "likely")
    good = rows.where("not likely").select("row").unionByName(rows.where("likely").join(bad, "rid", "left_anti").select("row"))
    return good.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "benchmark"))
