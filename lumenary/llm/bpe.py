"""Byte-level BPE by a global shuffle of distinct words.

Texts are packed into blocks of bounded size where they are read. Each block explodes its texts into pre-tokens with
positions and sends its distinct pre-tokens, packed, to the shard that their hash names; a task encodes each distinct
word of its shards once, whatever the number of blocks it came from, and answers each block. The block joins the ids back
and reassembles its texts by position. Occurrences never cross the network, so a word that makes up a third of the text
costs one entry a block. Decoding joins ids with the table of token bytes.

There are as many shards as the square root of the number of blocks, times four: rows grow as blocks to the power 1.5,
and a shard is a stream, so that no task holds one. At 100 TB, blocks of 64 MB keep that to some 10**9 rows.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

BLOCK_BYTES = 8 << 20
_cache: dict = {}


def _vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    if ("ranks", path) not in _cache:
        with open(path, "rb") as f:
            _cache["ranks", path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    return _cache["ranks", path]


#: Texts of these characters only are split by the standard library's engine, several times as fast: ASCII, letters of
#: Latin-1 and Latin Extended-A and -B, and general punctuation. The classes are spelled out for it, with equal meaning.
_PLAIN = r"\t\n\r -~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u2010-\u2027"
_LETTERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"


def _splitter(pattern: str):
    """A function from a text to its pre-tokens. \\s is Unicode's White_Space, as in the library that fixes the ids."""
    import re

    import regex

    if ("split", pattern) not in _cache:
        any_text = regex.compile(pattern).findall
        _cache["split", pattern] = any_text
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}0-9]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
        if "\\p" not in inside and "\\P" not in inside and "\\w" not in inside.lower() and "\\d" not in inside.lower():
            other, plain = re.compile(f"[^{_PLAIN}]").search, re.compile(inside).findall
            _cache["split", pattern] = lambda text: any_text(text) if other(text) else plain(text)
    return _cache["split", pattern]


class _Index(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _encoder(path: str):
    """A function from a pre-token to its ids: the pattern takes it whole, as it is split already."""
    import tiktoken

    if ("bpe", path) not in _cache:
        _cache["bpe", path] = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks=_vocabulary(path), special_tokens={})
    return _cache["bpe", path].encode_ordinary


def _pack(words: list[bytes]) -> bytes:
    """Byte strings with their lengths, compressed."""
    import zstandard

    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(3).compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    out, at = [], 4 + 4 * n
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


def _pack_texts(block_bytes: int):
    """Rows (doc_id, text) to blocks in the order of reading: `block_bytes` of text each, or one longer text."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            return pa.record_batch([pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([_pack(texts)], pa.binary())], names=["block", "ids", "texts"])

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").cast("binary").to_pylist()):
                    t = t or b""
                    if ids and size + len(t) > block_bytes or len(ids) >= 100_000:
                        yield flush()
                        name, ids, texts, size = name + 1, [], [], 0
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
        if ids:
            yield flush()

    return run


def _shards(words, shards: int) -> list[list[bytes]]:
    """Distinct words of a block by shard, sorted, so that a shard's answer needs no copy of the words."""
    out = [[] for _ in range(shards)]
    for w in words:
        b = w.encode()
        out[zlib.crc32(b) % shards].append(b)
    for x in out:
        x.sort()
    return out


def _words_of_block(pattern: str, shards: int):
    def run(table):
        import pyarrow as pa

        split, words = _splitter(pattern), set()
        for blob in table.column("texts"):
            for t in _unpack(blob.as_py()):
                words.update(split(t.decode(errors="replace")))
        parts = [(s, _pack(x)) for s, x in enumerate(_shards(words, shards)) if x]
        words.clear()
        T.trim()
        block = table.column("block")[0].as_py()
        return pa.table({"shard": pa.array([s for s, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int64()), "words": pa.array([x for _, x in parts], pa.binary())})

    return run


#: Words whose ids a task remembers; beyond, it forgets them and goes on.
_KNOWN = 1_000_000


def _encode_words(path: str):
    """Rows (shard, block, words) to the answers, one by one."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        encode, known = _encoder(path), {}
        for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            answers = []
            for blob in batch.column("words"):
                ids, counts = [], []
                for w in _unpack(blob.as_py()):
                    x = known.get(w)
                    if x is None:
                        if len(known) >= _KNOWN:
                            known.clear()
                        x = known[w] = encode(w.decode())
                    ids += x
                    counts.append(len(x))
                answers.append(zstandard.ZstdCompressor(3).compress(np.uint32(len(counts)).tobytes() + np.array(counts, np.uint32).tobytes() + np.array(ids, np.uint32).tobytes()))
            yield pa.record_batch([batch.column("block"), batch.column("shard"), pa.array(answers, pa.binary())], names=["block", "shard", "answer"])

    return run


def _assemble(path: str, pattern: str, shards: int, decoded: bool):
    def run(texts, answers):
        import pyarrow as pa
        import zstandard

        split, index, doc_ids, places, words = _splitter(pattern), _Index(), [], [], None
        for k in range(texts.num_rows):
            doc_ids += texts.column("ids")[k].as_py()
            for t in _unpack(texts.column("texts")[k].as_py()):
                words = split(t.decode(errors="replace"))
                places.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        flat, count = {}, {}
        for s, blob in zip(answers.column("shard").to_pylist(), answers.column("answer")):
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint32)
            count[s], flat[s] = raw[1 : 1 + raw[0]].astype(np.int64), raw[1 + raw[0] :]
        # The words of all shards in the order in which the answers list them.
        order, counts, ids = [], [], []
        for s, words in enumerate(_shards(index, shards)):
            if words:
                if len(count[s]) != len(words):
                    raise RuntimeError("a shard's answer doesn't fit the words of its block")
                order += [index[w.decode()] for w in words]
                counts.append(count[s])
                ids.append(flat[s])
        index.clear()
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ids = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        start, many = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        start[order], many[order] = np.cumsum(counts) - counts, counts
        out, bounds = [], np.zeros(len(places) + 1, np.int32)
        for i, at in enumerate(places):
            m = many[at]
            ends = np.cumsum(m)
            total = int(ends[-1]) if len(ends) else 0
            out.append(ids[np.arange(total) + np.repeat(start[at] - ends + m, m)])
            bounds[i + 1] = bounds[i] + total
        columns = {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(out) if out else ids[:0], pa.int32()))}
        if decoded:
            token = _token_bytes(path)
            columns["decoded"] = pa.array([b"".join(token[x].tolist()) for x in out], pa.binary())
        del out, places, texts, answers, index, words, flat, count, order, counts, ids, start, many
        T.trim()
        return pa.table(columns)

    return run


def _token_bytes(path: str) -> np.ndarray:
    """The token-byte table: the bytes of each id."""
    if ("bytes", path) not in _cache:
        ranks = _vocabulary(path)
        _cache["bytes", path] = np.full(max(ranks.values(), default=0) + 1, None, object)
        for t, i in ranks.items():
            _cache["bytes", path][i] = t
    return _cache["bytes", path]


def encode(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """Rows (doc_id long, ids array<int>), one for each row of `docs` (doc_id, text; other columns are ignored).

    Each match of `pattern` is encoded separately by the ranks of the vocabulary file `path`, without special tokens.
    Null and empty texts have no ids; repeated rows, null and repeated doc_ids keep a row each; an empty table gives an
    empty result. Bytes that aren't UTF-8 count as U+FFFD. `decoded` adds the bytes that the ids decode to, by a join of
    each id with the token-byte table, while the block holds them. A text is whole in one block, so a worker holds
    `block_bytes` of text or its longest text. `docs` must give the same rows in the same order when it is read again,
    as files do: a table that a shuffle made belongs in a checkpoint before.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = int(4 * max(1, -(-size // block_bytes)) ** 0.5)
    packed = docs.mapInArrow(T.trimmed(_pack_texts(block_bytes)), "block long, ids array<long>, texts binary").groupBy("block")
    words = packed.applyInArrow(_words_of_block(pattern, shards), "shard int, block long, words binary")
    answers = words.repartition("shard").mapInArrow(T.trimmed(_encode_words(path)), "block long, shard int, answer binary")
    kind = "doc_id long, ids array<int>" + ", decoded binary" * decoded
    return packed.cogroup(answers.groupBy("block")).applyInArrow(_assemble(path, pattern, shards, decoded), kind)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Replace the column `ids` of a table by `decoded` (binary), the tokens' bytes one after the other.

    Null ids give null; an id that the vocabulary lacks is an error. Other columns and all rows stay.
    """
    kept = [f for f in encoded.schema.fields if f.name not in ("ids", "decoded")]

    def run(batches):
        import pyarrow as pa

        token = _token_bytes(path)
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 200):
                part = batch.slice(k, 200)
                out = [None if x.values is None else b"".join(token[x.values.to_numpy(zero_copy_only=False)].tolist()) for x in part.column("ids")]
                yield pa.record_batch([*(part.column(f.name) for f in kept), pa.array(out, pa.binary())], names=[*(f.name for f in kept), "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.select(*(f.name for f in kept), "ids").mapInArrow(run, StructType([*kept, StructField("decoded", BinaryType())]))


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = encode(docs, path, pattern, decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip_digest(T.table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
