"""Token counts by a two-tier look-up on the map side.

First tier: a compact hash table of frequent pre-tokens and their numbers of tokens, broadcast to all executors. Second tier: what the table does not hold is
encoded by the library, once per worker, and remembered there. Texts stay where they are: nothing is shuffled by pre-token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm import pieces

#: Texts (about) whose pre-tokens the broadcast table is learned from; its entries: 1.5 MB at most.
SAMPLE, ENTRIES = 2_000, 1 << 16
LIMIT = 512


class Frequent(pieces.Table):
    """Frequent short pieces with their numbers of tokens."""

    def __init__(self, found: list[bytes], counts: np.ndarray):
        super().__init__(max(8, (4 * len(found)).bit_length()))
        self.counts = counts.astype(np.int32)
        if found:
            self.add(*pieces.packed(found))


def frequent_pieces(documents: DataFrame, tokenizer: str, text: str = "text", sample: int = SAMPLE, entries: int = ENTRIES) -> Frequent:
    """The `entries` most frequent pieces of about `sample` texts chosen at random, whole, with their numbers of tokens.

    The table decides how fast counts are found and never what they are. Only the pieces of the sample are counted together.
    """
    total = documents.count()
    if not total:
        return Frequent([], np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces.coder(tokenizer)
        for batch in batches:
            for _, data, offsets in pieces.blocks(batch.column(0)):
                found = pieces.Pieces(coder, data, offsets)
                names, often = np.unique(np.array(found.texts(np.flatnonzero(found.short)), object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.binary()), pa.array(often, pa.int64())], names=["piece", "n"])

    chosen = documents.select(F.col(text).cast("string").alias("text")).sample(min(1.0, sample / total), seed=13)
    counted = chosen.mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    found = [bytes(r.piece) for r in counted.orderBy(F.desc("n"), "piece").limit(entries).collect()]
    if not found:
        return Frequent([], np.zeros(0))
    found, _, counts = pieces.coder(tokenizer).library(found)
    return Frequent(found, counts)


class Counter:
    """Numbers of tokens of texts: the broadcast table first, then the worker's own memory, then the library."""

    def __init__(self, tokenizer: str, frequent: Frequent):
        self.coder, self.frequent = pieces.coder(tokenizer), frequent

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for rows, data, offsets in pieces.blocks(texts):
            found = pieces.Pieces(self.coder, data, offsets)
            counts = np.zeros(len(found), np.int64)
            short = np.flatnonzero(found.short)
            entry = self.frequent.find(found.low[short], found.high[short], found.size[short])
            hit = entry >= 0
            counts[short[hit]] = self.frequent.counts[entry[hit]]
            rest = np.union1d(short[~hit], np.flatnonzero(~found.short))
            if len(rest):
                counts[rest] = self.coder.counts(found, rest)
            out[rows] += np.diff(np.concatenate([[0], np.cumsum(counts)])[found.bounds])  # a row stands once in a block
        return out


class Whole:
    """Numbers of tokens by the library's call for whole texts: for files that cut texts otherwise."""

    def __init__(self, tokenizer: str):
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            self.count = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer)
            model.no_truncation()
            model.no_padding()
            self.count = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[self.count([t or ""]) for t in texts.to_pylist()]]).astype(np.int64)


@lru_cache(maxsize=2)
def _whole(tokenizer: str) -> Whole:
    return Whole(tokenizer)


def is_byte_level(tokenizer: str) -> bool:
    try:
        return not tokenizer.endswith(".model") and bool(pieces.coder(tokenizer))
    except ValueError:
        return False


def count(documents: DataFrame, tokenizer: str, limit: int = LIMIT, text: str = "text", sample: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """All columns plus `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens).

    Equal to the library's count of every whole text, without begin, end or other added special tokens; strings of special tokens inside a text count as
    the library counts them by default. A missing or empty text has 0 bytes and tokens and is not over the limit. Columns of these three names are
    replaced; other columns, repeated rows and missing keys stay as they are, row by row, and an empty table gives an empty result.
    Files other than plain byte-level BPE (`.model` files of sentencepiece, other `.json` files) are counted by the library's call for whole texts.
    """
    rows = documents.drop("n_bytes", "n_tokens", "over_limit")
    if is_byte_level(tokenizer):
        shared = documents.sparkSession.sparkContext.broadcast(frequent_pieces(documents, tokenizer, text, sample, entries))
        counter = lambda: Counter(tokenizer, shared.value)
    else:
        counter = lambda: _whole(tokenizer)

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(counter()(texts), pa.int64())

    value = F.col(text).cast("string")
    return rows.select("*", F.coalesce(F.octet_length(value), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(tokens(value), F.lit(0)).cast("long").alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)
