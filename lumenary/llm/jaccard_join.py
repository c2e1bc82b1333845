"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents become sets of hashed word shingles; rows with one set are one node. All shingles have one global order,
rarer first. Two sets with Jaccard similarity of at least t share at least m shingles in their prefixes, if the prefix
of a set of n has n - ceil(t * n) + m shingles. Each document picks its own m: it lengthens its prefix while that lowers
the estimated cost of its candidates, so a document of common shingles must match several times before it is verified.
A pair has to share min(m of one, m of the other).

Links between different sets are found in two steps, so that a group of thousands of near copies costs a star and not
all its pairs. First each prefix shingle's rows are verified against one leader of that shingle, and what links is
merged. Then only pairs of sets in different components remain to be matched, counted and verified, all of them.
Candidates are verified where their texts meet: texts travel, compressed, and their sets are built again there, as a
set of 64-bit hashes is larger than its text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _text as T
from .components import connected_components

_U = np.uint64
SLOTS = 1 << 22  # counters of the frequency table; 4 MB broadcast at every size of the input
CHUNK = 1 << 18
#: Fewest and most matches that a document asks for (fewer where its set is too small for that).
LEAST_MATCHES = 4
MATCHES = 16
STAR_ROUNDS = 2
#: A shingle that stands in about so many documents or more is dealt out in parts, each with a leader of its own.
HOT = 50_000
#: A shingle with more rows than that is crowded; its rows are compared in blocks.
CROWD = 64
#: Shingles that a block, or a task of verification, holds, about.
HELD = 1_000_000


def _sets(column, width):
    """For each text of a column: its distinct shingle hashes, sorted."""
    for row, data, bounds in T.runs(column):
        hashes, counts = T.words(data, bounds, T.SPACE)
        at = 0
        for i, c in enumerate(counts):
            yield row + i, np.unique(T.shingles(hashes[at : at + c], width))
            at += c


def _node(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        return int(T.mix(np.array([T.mix(shingles).sum(dtype=_U) + _U(len(shingles))], _U)).view(np.int64)[0])


def _fingerprints(width):
    def run(batches):
        import pyarrow as pa
        import zstandard

        counts, since = np.zeros(SLOTS, np.uint16), 0
        pack = zstandard.ZstdCompressor(1)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

        def parts():
            for k in range(0, SLOTS, CHUNK):
                part = counts[k : k + CHUNK]
                if part.any():
                    raw = part.astype(np.uint8) if part.max() < 256 else part.astype(np.uint32)
                    none = pa.nulls(1)
                    yield pa.record_batch([none.cast(pa.int64())] * 3 + [pa.array([k // CHUNK], pa.int32()), pa.array([pack.compress(raw.tobytes())], pa.binary())], schema=schema)

        for batch in (b.slice(k, 5000) for b in batches for k in range(0, max(1, b.num_rows), 5000)):
            since += batch.num_rows
            if since > 65_000:  # a counter holds as many
                yield from parts()
                counts[:], since = 0, batch.num_rows
            n = np.zeros(batch.num_rows, np.int64)
            node = np.zeros(batch.num_rows, np.int64)
            for i, s in _sets(batch.column("text"), width):
                n[i] = len(s)
                if len(s):
                    node[i] = _node(s)
                    counts[(s & _U(SLOTS - 1)).astype(np.int64)] += 1  # a slot hit twice in one document counts once
            none = pa.nulls(len(n))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(node), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        yield from parts()

    return run


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, np.uint8).astype(np.uint64) if len(raw) == CHUNK else np.frombuffer(raw, np.uint32 if len(raw) == 4 * CHUNK else np.uint64).astype(np.uint64)


def _sum_counts(pdf):
    import pandas as pd
    import zstandard

    total = np.zeros(CHUNK, np.uint64)
    for blob in pdf["counts"]:
        total += _unpack(blob)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "salt": [-1], "counts": [zstandard.ZstdCompressor(1).compress(total.tobytes())]})


def _frequency_table(parts: DataFrame) -> np.ndarray:
    """Counters of all tasks, added up; 8 steps for each doubling, so one byte each. Its size is that of SLOTS."""
    kind = "chunk int, salt int, counts binary"
    first = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("chunk", "salt").applyInPandas(_sum_counts, kind)
    out = np.zeros(SLOTS, np.uint8)
    for row in first.groupBy("chunk").applyInPandas(_sum_counts, kind).select("chunk", "counts").collect():
        steps = 8 * np.log2(1 + _unpack(bytes(row["counts"])).astype(np.float64))
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.minimum(255, np.ceil(steps))
    return out


def prefix(shingles: np.ndarray, steps: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of one set, in the global order, and the number of matches it asks for."""
    n = len(shingles)
    if n == 0:
        return shingles, 1
    q = steps[(shingles & _U(SLOTS - 1)).astype(np.int64)]
    overlap = -(-percent * n // 100)
    most = min(MATCHES, overlap)
    key = (q.astype(_U) << _U(56)) | (shingles >> _U(8))
    order = np.argsort(key, kind="stable")[: n - overlap + most]
    partners = np.cumsum(np.maximum(np.exp2(q[order] / 8.0) - 1 - noise, 0))
    m = np.arange(1, most + 1)
    size = n - overlap + m
    cost = size + partners[size - 1] * (1 + 20 / m)
    least = min(LEAST_MATCHES, most) - 1
    m = int(np.argmin(cost[least:])) + least + 1
    return shingles[order[: n - overlap + m]], m


def _postings(width, percent, table, noise):
    def run(batches):
        import pyarrow as pa

        steps, seen = table.value, set()
        for batch in batches:
            out = []
            for _, s in _sets(batch.column("text"), width):
                if not len(s) or (name := _node(s)) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(name)
                p, m = prefix(s, steps, noise, percent)
                # A hot shingle is dealt out in parts, told apart by its last 16 bits; none where the table is too full to tell.
                rows = np.maximum(np.exp2(steps[(p & _U(SLOTS - 1)).astype(np.int64)] / 8.0) - noise, 0)
                hot = rows > HOT + noise
                p = np.where(hot, p >> _U(16) << _U(16) | (name % np.minimum(rows // HOT + 1, 65536)).astype(_U), p)
                out.append((p, name, (len(s) * 16 + m - 1) * 2 + hot))
                if len(out) >= 2000:
                    yield _posting_batch(pa, out)
                    out = []
            if out:
                yield _posting_batch(pa, out)

    return run


def _posting_batch(pa, out):
    k = [len(x[0]) for x in out]
    cols = [np.concatenate([x[0] for x in out]).view(np.int64), np.repeat([x[1] for x in out], k), np.concatenate([x[2] for x in out])]
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["token", "node", "meta"])


#: What a posting's meta holds: the size of the set, the matches it asks for, and whether the shingle is dealt out in parts.
_N, _M, _HOT = "({} div 32)", "({} div 2 % 16 + 1)", "({} % 2 = 1)"


def _texts(width, wanted):
    """The texts of the rows whose doc_id has its bit set; what comes along too is dropped by the join that follows."""

    def run(batches):
        import pyarrow as pa

        bits, seen = wanted.value, set()
        for batch in batches:
            batch = batch.filter(pa.array(T.has_bit(bits, batch.column("doc_id"))))
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                names, rows = [], []
                for i, s in _sets(part.column("text"), width):
                    if len(s) and (name := _node(s)) not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(name)
                        names.append(name)
                        rows.append(i)
                yield pa.record_batch([pa.array(names, pa.int64()), part.column("text").take(pa.array(rows, pa.int64()))], names=["node", "text"])

    return run


def _sets_of(table, width) -> dict:
    """Node to sorted set for the rows (node, text) of an Arrow table."""
    column = table.column("text")
    return dict(zip(table.column("node").to_pylist(), (s for _, s in _sets(column, width))))


def _compare_pairs(width: int, percent: int):
    """Some pairs (u, v) and the texts of their nodes: the pairs that link."""

    def run(pairs, texts):
        import pyarrow as pa

        sets = _sets_of(texts, width) if pairs.num_rows else {}
        us, vs = [], []
        for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist()):
            a, b = sets[u], sets[v]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                us.append(u)
                vs.append(v)
        del sets
        T.trim()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _compare_blocks(width: int, percent: int):
    """Some sets of a crowd against others: the pairs that link, of different components."""

    def run(few, many):
        import pyarrow as pa

        us, vs = [], []
        if few.num_rows and many.num_rows:
            sets = _sets_of(many, width)
            node, part = many.column("node").to_numpy(), many.column("component").to_numpy()
            sets = [sets[x] for x in node.tolist()]
            size = np.array([len(x) for x in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            own = _sets_of(few, width)
            for u, c in zip(few.column("node").to_pylist(), few.column("component").to_pylist()):
                x = own[u]
                low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = high - low
                at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                both = np.bincount(owner[at], minlength=len(sets))
                link = (100 * both >= percent * (len(x) + size - both)) & (part != c)
                us += [u] * int(link.sum())
                vs += node[link].tolist()
            del sets, flat, owner, own
            T.trim()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


class _Join:
    """The links of one table of documents, found step by step; see similar_components."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        prints = T.checkpoint(self.docs.mapInArrow(T.trimmed(_fingerprints(width)), "doc_id long, n long, node long, chunk int, counts binary"))
        self.rows = prints.where("chunk is null").select("doc_id", "n", "node")
        self.nodes = self.rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
        self.steps = _frequency_table(prints.where("chunk is not null").select("chunk", "counts"))
        self.noise = float(self.rows.agg(F.sum("n")).first()[0] or 0) / SLOTS
        self.edges: list[DataFrame] = []
        self.parts: DataFrame | None = None  # (node, component) of the nodes that have a link

    def shared(self) -> DataFrame:
        """The postings (token, node, meta) of shingles that stand in prefixes of several sets."""
        table = self.spark.sparkContext.broadcast(self.steps)
        found = self.docs.select("text").mapInArrow(T.trimmed(_postings(self.width, self.percent, table, self.noise)), "token long, node long, meta long")
        return self.led(found, "node")

    def led(self, rows: DataFrame, component: str) -> DataFrame:
        """Rows (token, node, meta, component) of shingles that hold several components: distinct, with a leader and their number.

        Each part of a hot shingle has a leader of its own.
        """
        token = W.partitionBy("token")
        by = F.struct(F.xxhash64("node", F.lit(len(self.edges))).alias("by"), "node", "meta", F.col(component).alias("component"))
        rows = rows.repartition("token")  # before the struct is made, so that it doesn't travel
        rows = rows.select("*", F.min(by).over(token).alias("lead"), F.min(component).over(token).alias("low"), F.max(component).over(token).alias("high"))
        rows = rows.where("low <> high or meta % 2 = 1").select("token", "node", "meta", F.col(component).alias("component"), "lead", "low", "high").distinct()
        out = T.checkpoint(rows.select("*", F.count("*").over(token).alias("crowd")))
        hot = out.where("meta % 2 = 1")
        if hot.isEmpty():
            return out
        # The parts of a hot shingle together: whether they hold several components.
        part = F.shiftright("token", 16).alias("part")
        several = hot.groupBy(part).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("part")
        kept, old = T.checkpoint(out.where("meta % 2 = 0").unionByName(hot.withColumn("part", part).join(several, "part", "left_semi").drop("part"))), out
        T.release(old)
        return kept

    def texts(self, some: DataFrame) -> DataFrame:
        """(node, text) of some nodes, and a few more; the texts that are wanted are read again."""
        bits = T.id_bits(self.nodes.join(some, "node", "left_semi").select("first_id"))
        return self.docs.mapInArrow(T.trimmed(_texts(self.width, self.spark.sparkContext.broadcast(bits))), "node long, text string")

    def similar_size(self, a: str, b: str):
        return F.expr(f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})")

    def need(self, n: str, m: str, o: str, p: str):
        """How many prefix shingles sets of n and o have to share, if they ask for m and p matches.

        What they share beyond the end of the prefix that ends first lies in the rest of that set, which is ceil(t * n) - m
        long; so the prefixes share what linked sets share less the longer rest, and min(m, p) at least.
        """
        t = self.percent
        rest = f"greatest(({t} * {n} + 99) div 100 - {m}, ({t} * {o} + 99) div 100 - {p})"
        return F.expr(f"greatest(least({m}, {p}), ({t} * ({n} + {o}) + {99 + t}) div {100 + t} - {rest})")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """What links of the distinct pairs (u, v, nu, nv); a u of many pairs meets them in several tasks."""
        total = pairs.agg(F.sum(F.col("nu") + F.col("nv"))).first()[0] or 0
        buckets = max(1, -(-total // HELD))
        salts = pairs.groupBy("u").agg(F.ceil(F.sum("nv") / HELD).cast("int").alias("salts"))
        dealt = pairs.join(salts, "u").withColumn("bucket", F.pmod(F.xxhash64("u", F.pmod(F.xxhash64("v"), "salts")), F.lit(buckets)).cast("int"))
        dealt = T.checkpoint(dealt.select("bucket", "u", "v"))
        sides = dealt.select("bucket", F.col("u").alias("node")).unionByName(dealt.select("bucket", F.col("v").alias("node"))).distinct()
        held = self.texts(sides.select("node").distinct()).join(sides, "node").select(F.col("bucket").alias("b"), "node", "text")
        return dealt.groupBy("bucket").cogroup(held.groupBy("b")).applyInArrow(_compare_pairs(self.width, self.percent), "u long, v long")

    def merge(self, links: DataFrame) -> bool:
        """Add links (u, v) to the components; whether there are any."""
        links = T.checkpoint(links)
        if links.isEmpty():
            return False
        self.edges.append(links)
        every = links if self.parts is None else links.unionByName(self.parts.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
        self.parts = T.checkpoint(connected_components(every))
        return True

    def live(self, rows: DataFrame) -> DataFrame:
        """The postings of shingles that still hold rows of two components."""
        rows = rows.select("token", "node", "meta")
        if self.parts is None:
            return self.led(rows, "node")
        return self.led(rows.join(self.parts, "node", "left").select("token", "node", "meta", F.coalesce("component", "node").alias("component")), "component")

    def stars(self, rows: DataFrame) -> bool:
        """Each set against the leader that it shares most shingles with, of those that it shares enough with."""
        n, m, o, p = _N.format("meta"), _M.format("meta"), _N.format("lead.meta"), _M.format("lead.meta")
        pairs = rows.where("component <> lead.component").where(self.similar_size(n, o))
        pairs = pairs.groupBy("node", F.col("lead.node").alias("lead")).agg(F.count("*").alias("k"), F.first(F.expr(n)).alias("n"), F.first(F.expr(o)).alias("lead_n"), F.first(self.need(n, m, o, p)).alias("need"))
        best = pairs.where("k >= need").groupBy("node").agg(F.max(F.struct("k", "lead", "n", "lead_n")).alias("x"))
        return self.merge(self.verified(T.checkpoint(best.select(F.col("x.lead").alias("u"), F.col("node").alias("v"), F.col("x.lead_n").alias("nu"), F.col("x.n").alias("nv")))))

    def crowds(self, rows: DataFrame) -> DataFrame | None:
        """Links within crowded shingles, and the home of each row that has one.

        Rows that share a crowded shingle mostly share many; each such row is at home with the leader of most of them.
        Rows of one home meet, and so do those of two homes that a crowded shingle joins. A meeting is compared in
        blocks, the sets outside its largest component with all others: no pair is made before it links.
        """
        crowded = rows.where(f"crowd > {CROWD} or meta % 2 = 1").select("token", "node", "component", F.expr(_N.format("meta")).alias("n"), F.col("lead.node").alias("lead"), F.expr(_HOT.format("meta")).alias("hot"))
        home = T.checkpoint(crowded.groupBy("node", "lead").agg(F.count("*").alias("k")).groupBy("node").agg(F.max(F.struct("k", "lead"))["lead"].alias("home")))
        if home.isEmpty():
            return None
        # The parts of a hot shingle count as one shingle here. One row for each crowded posting, kept as it is read three times.
        at = T.checkpoint(crowded.select(F.when(F.col("hot"), F.shiftright("token", 16)).otherwise(F.col("token")).alias("token"), "node", "component", "n").join(home, "node"))
        homes = at.select("token", "home").distinct()
        other = homes.toDF("token", "other")
        joined = homes.join(other, "token").where("home < other")
        both = joined.unionByName(joined.select("token", F.col("other").alias("home"), F.col("home").alias("other")))
        meets = at.select("home", F.col("home").alias("other"), "node", "component", "n").unionByName(at.join(both, ["token", "home"]).select(F.least("home", "other").alias("home"), F.greatest("home", "other").alias("other"), "node", "component", "n")).distinct()
        sizes = meets.groupBy("home", "other", "component").agg(F.sum("n").alias("k")).groupBy("home", "other").agg(F.max(F.struct("k", "component")).alias("x"), F.sum("k").alias("all"))
        sizes = sizes.where("all > x.k").select("home", "other", F.col("x.component").alias("main"), F.ceil((F.col("all") - F.col("x.k")) / HELD).cast("int").alias("rows_"), F.ceil(F.col("all") / HELD).cast("int").alias("cols_"))
        meets = T.checkpoint(meets.join(sizes, ["home", "other"]).withColumn("meet", F.xxhash64("home", "other")))
        T.release(at, home)
        block = F.xxhash64("node", F.lit(11))
        few = meets.where("component <> main").select("meet", F.pmod(block, "rows_").alias("row"), F.explode(F.expr("sequence(0L, cols_ - 1L)")).alias("col"), "node", "component")
        many = meets.select("meet", F.explode(F.expr("sequence(0L, rows_ - 1L)")).alias("row"), F.pmod(block, "cols_").alias("col"), "node", "component")
        texts = self.texts(meets.select("node").distinct())
        few, many = few.join(texts, "node"), many.join(texts, "node")
        few = few.toDF("node", "f_meet", "f_row", "f_col", "component", "text")
        return few.groupBy("f_meet", "f_row", "f_col").cogroup(many.groupBy("meet", "row", "col")).applyInArrow(_compare_blocks(self.width, self.percent), "u long, v long").distinct()

    def rest(self, rows: DataFrame) -> DataFrame:
        """Links of all other pairs that share shingles and are in different components."""
        rows = rows.where(f"crowd <= {CROWD} and meta % 2 = 0").select("token", "node", "meta", "component")
        pairs = rows.toDF("token", "u", "mu", "cu").join(rows.toDF("token", "v", "mv", "cv"), "token").where("cu < cv")
        n, m, o, p = _N.format("mu"), _M.format("mu"), _N.format("mv"), _M.format("mv")
        pairs = pairs.where(self.similar_size(n, o)).groupBy("u", "v").agg(F.count("*").alias("k"), F.first(F.expr(n)).alias("nu"), F.first(F.expr(o)).alias("nv"), F.first(self.need(n, m, o, p)).alias("need"))
        return self.verified(T.checkpoint(pairs.where("k >= need").select("u", "v", "nu", "nv")))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """The rows (doc_id, n, node), and for each set (node, first_id, component, component_id)."""
        rows = self.shared()
        for _ in range(STAR_ROUNDS):
            if not self.stars(rows):
                break
            rows, old = self.live(rows), rows
            T.release(old)
        # A pair that shares a crowded shingle meets there; all shingles that another pair shares are counted.
        links, found = self.crowds(rows), self.rest(rows)
        self.merge(found if links is None else found.unionByName(links))
        T.release(rows)
        lowest = self.nodes if self.parts is None else self.nodes.join(self.parts, "node", "left")
        lowest = lowest.withColumn("component", F.coalesce("component", "node") if self.parts is not None else F.col("node"))
        group = lowest.groupBy("component").agg(F.min("first_id").alias("component_id"))
        return self.rows, lowest.join(group, "component").select("node", "first_id", "component", "component_id")


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    return _Join(docs, width, percent).run()


def similar_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text; further columns are ignored).

    Two documents link when 100 * intersection >= percent * union of their sets of `width`-word shingles; words are
    lower-cased (A-Z) and parted by ASCII white space; a text of fewer words is one shingle. component_id is the
    smallest doc_id that links lead to, the document's own included. Null, empty and blank texts have an empty set and
    link with nothing. Repeated rows and equal texts link; each keeps its row. A null doc_id is kept, and is the
    smallest only where a component has no other. An empty table gives an empty result.
    """
    rows, nodes = _components(docs, width, percent)
    named = nodes.select("node", "component_id")
    out = rows.join(named, (rows.node == named.node) & (rows.n > 0), "left")
    return out.select(rows.doc_id, rows.n.alias("n_shingles"), F.when(rows.n > 0, F.col("component_id")).otherwise(rows.doc_id).alias("component_id"))


def _with_node(width, names, suspects, staying):
    """Rows of `names`, in their order, and a node: null for a row that stays, else that of its set; rows that can't stay are left out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            doubt = T.has_bit(suspects.value, batch.column(names.index("doc_id")).cast(pa.int64()))
            stay = ~doubt
            node = np.zeros(batch.num_rows, np.int64)
            rows = np.flatnonzero(doubt)
            may = T.has_bit(staying.value, batch.column(names.index("doc_id")).cast(pa.int64()))
            text = batch.column(names.index("text")).cast(pa.string())
            for k in range(0, len(rows), 500):
                part = rows[k : k + 500]
                for i, s in _sets(text.take(pa.array(part)), width):
                    if len(s):
                        node[part[i]] = _node(s)
                    else:
                        stay[part[i]] = True
            keep = pa.array(stay | may)
            yield pa.record_batch([*batch.columns, pa.array(node, mask=stay)], names=[*batch.schema.names, f"c{batch.num_columns}"]).filter(keep)

    return run


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """`docs` with one row of each component of similar documents, the one with its smallest doc_id; all columns stay.

    Rows with empty sets all stay. Of several rows that are equal in text and doc_id one stays. Columns may have any
    names. Rows whose doc_id belongs to no other row, and whose set stays, are passed through where they are read; only
    the others' texts travel.
    """
    names = docs.columns
    rows, nodes = _components(docs, width, percent)
    # The set of the smallest id; where ids repeat, of the smallest set of those.
    stay = nodes.where("first_id <=> component_id").groupBy("component").agg(F.min(F.struct("node", "first_id")).alias("x"))
    stay = T.checkpoint(stay.select(F.col("x.node").alias("s_node"), F.col("x.first_id").alias("s_id")))
    fits = rows.join(stay, F.expr("node = s_node and doc_id <=> s_id"), "left")
    each = fits.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.expr("n = 0 or s_node is not null")).alias("stays"))
    context = docs.sparkSession.sparkContext
    suspects = context.broadcast(T.id_bits(each.where("rows > 1 or not stays").select("doc_id")))
    staying = context.broadcast(T.id_bits(stay.select("s_id")))
    node, s_node, s_id = (T.fresh(x, names) for x in ("node_", "s_node", "s_id"))
    found = T.map_arrow(docs, _with_node(width, names, suspects, staying), names, f"{node} long")
    doubt = found.where(F.col(node).isNotNull()).join(stay.toDF(s_node, s_id), F.expr(f"{node} = {s_node} and doc_id <=> {s_id}"), "left_semi")
    return found.where(F.col(node).isNull()).unionByName(doubt.dropDuplicates([node])).select(*T.columns(names))


def op4_jaccard_components(spark, sf_dir: str) -> DataFrame:
    return similar_components(T.table(spark, sf_dir, "documents"))


#: The same by brute force: all pairs that share a shingle, and components by recursion.
SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, 2 + greatest(len(w) - 5, 0))) AS i FROM w WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM o JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN c USING (doc_id) JOIN m ON m.x = w.doc_id
"""
