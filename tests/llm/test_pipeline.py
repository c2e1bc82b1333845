"""The pipeline against plain Python: one document at a time, all pairs, all windows, and the tokenizer library."""

import base64
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lumenary.llm import quality_cnn
from lumenary.llm import _text as T
from tests.llm.test_brute import matches
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~T.held_out(F.col("doc_id"), 3, 1))
    net = quality_cnn.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = [(i, t) for i, t in rows if quality_cnn.probabilities(net, pa.array([t], pa.string()))[0] >= 0.5]
    assert 0.7 * len(rows) < len(good) < len(rows)
    stay = {c for _, _, c in brute(good, 5, 75)}
    single = [(i, t) for i, t in good if i in stay]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in matches(single, items)}
    left = [i for i, _ in single if i not in bad]
    assert len(rows) > len(good) > len(single) > len(left) > 0
    private = corpus_pipeline.surrogates(spark, docs.where(F.col("doc_id").isin(left)), SF)
    assert private.columns == docs.columns and private.where("n_chars <> char_length(text)").count() == 0
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = []
    for r in private.collect():
        ids = encode(r.text)
        want.append((r.doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(r.text.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)
    assert np.all(np.diff(sorted(i for i, *_ in got)) > 0)
