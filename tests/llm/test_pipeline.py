import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from riskfabric.llm import bpe, mixing, quality, queries
from tests.llm.test_chat_mixing import _count
from tests.llm.test_similar import brute_jaccard

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_names():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "source_mixture", "byte_level_bpe"]
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op") and n[2].isdigit()] == [n for n in queries.QUERIES if n != "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


def test_pipeline_equals_plain_python(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = quality.grades(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rated = quality.rate(documents, quality.fit(documents, labels)).collect()
    docs = {r.doc_id: r for r in rated if r.tail >= corpus_pipeline.LEAST_TAIL}
    assert 0 < len(docs) < len(rated)
    kept = {k: docs[k] for k, (_, c) in brute_jaccard({k: r.text for k, r in docs.items()}, 5, 80, 100).items() if c == k}
    assert len(kept) < len(docs)
    sizes = {}
    for r in kept.values():
        sizes[r.source] = sizes.get(r.source, 0) + 1
    roots = sum(n**0.5 for n in sizes.values())
    encoder, _ = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {}
    for k, r in kept.items():
        n = _count(17, k, sizes[r.source] ** 0.5 / roots * len(kept) / sizes[r.source])
        if n:
            want[k] = (n, r.text, np.array(encoder.encode_ordinary(r.text or ""), "<u4").tobytes())
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = (got.get(r.doc_id, (0,))[0] + 1, r.text, bytes(r.ids))
    assert got == want


def test_stages_accept_empty_and_missing(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "word " * 20000, "en", "a", 100000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert out.columns[: len(schema)] == schema.names
            out.count()
