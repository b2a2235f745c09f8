"""Corpus pipeline: documents of good quality, one of each near-duplicate group, mixed to source shares, as token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.llm import bpe, jaccard, mixing, quality
from riskfabric.llm.shared import written

#: A document stays if the top grade is at least this likely.
LEAST_TAIL = 0.6


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches LEAST_TAIL, by a model of the labelled ones."""
    labels = quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = quality.rate(docs, quality.fit(docs, labels))
    return rated.where(F.col("tail") >= LEAST_TAIL).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked at a similarity of 0.8 of 5-word shingles; rows of one id are one document. Rows without an id stay."""
    found = jaccard.ngram_groups(docs, width=5, share=(80, 100), rows=4)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have shares proportional to the square root of their size, in random order."""
    return mixing.mix(docs).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; the decoded bytes must be the text's."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("decoded bytes differ from the text")).cast("binary"))
    return rows.select(*docs.columns, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), whole.alias("ids"))


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", ngram_jaccard_join), ("mixing sources to target weights", source_mixture),
          ("byte-level BPE encoding and decoding", byte_level_bpe)]

#: SQL can express neither the classifier nor the encoding; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
