"""Target-distribution importance resampling over hashed word n-grams.

Texts are bags of runs of one to three words, hashed into buckets by CRC-32 (`llm/crc.py`, a position table). A bucket's gain is the logarithm of how much more frequent
it is in the target texts than in all documents; a document's weight is the sum over its features; with Gumbel noise of its key, the highest scores are a draw
without replacement in proportion to the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfabric.llm import crc, pieces
from riskfabric.llm.shared import written

#: Buckets, longest run of words, seed of the noise, fewest words of a document that can be drawn, and percentage that is drawn.
BUCKETS, WIDTH, SEED, LEAST, PERCENT = 10_000, 3, 42, 20, 5
# All ASCII characters but digits and letters separate words.
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _words(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of all words in lower case with one blank between neighbours, where words start and end in it, and the range of words of each text."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _INSIDE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    begins = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    size = np.flatnonzero(inside[:-1] & (~inside[1:] | cut)) - begins
    starts = np.cumsum(size + 1) - size - 1
    buffer = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    at = np.flatnonzero(inside[1:-1])
    buffer[np.arange(len(at)) + np.repeat(np.arange(len(size)), size)] = _LOWER[raw[at]]
    return buffer, starts, starts + size, np.searchsorted(begins, offsets)


def grams(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(rows, numbers of words, per length of run its checksums and their offsets per row) of consecutive blocks.

    A long text comes in several blocks of the same row: the last words of one begin the next as context, so no run is lost or counted twice.
    """
    last, carried = -1, []
    for rows, data, offsets in pieces.blocks(texts, cut=_SEPARATOR):
        before = carried if len(rows) == 1 and rows[0] == last else []
        if before:
            data = b" ".join([*before, data])
            offsets = np.array([0, len(data)])
        buffer, starts, ends, bounds = _words(data, offsets)
        counts = np.diff(bounds)
        place = np.arange(len(starts)) - np.repeat(bounds[:-1], counts)
        out = []
        for n in range(1, width + 1):
            final = place >= max(n - 1, len(before))  # the run's last word
            at = np.flatnonzero(final)
            out.append((crc.crc32(buffer, starts[at - n + 1], ends[at]), np.concatenate([[0], np.cumsum(final)])[bounds]))
        yield rows, counts - len(before), out
        last = int(rows[-1]) if len(rows) == 1 else -1
        carried = [buffer[a:b].tobytes() for a, b in zip(starts[max(0, len(starts) - width + 1) :], ends[max(0, len(starts) - width + 1) :])]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """`bucket` and `n`, the features of all texts that fall into it. Every task adds up before anything is shuffled: a row per bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in grams(batch.column(0), width):
                for sums, _ in found:
                    total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of a bucket's smoothed share in the target over its share in all documents, rounded down."""
    buckets, s, t = len(all_counts), all_counts.astype(float), target_counts.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # a row per bucket
        out[r.bucket] = r.n
    return out


def weighed(documents: DataFrame, gain: np.ndarray, text: str = "text", width: int = WIDTH) -> DataFrame:
    """All columns plus `n_words`, `n_features` and `weight` (the sum of the gains of a text's features). Columns of these names are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("struct<n_words: long, n_features: long, weight: long>")
    def run(texts: pa.Array) -> pa.Array:
        words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
        table = shared.value
        for rows, counts, found in grams(texts, width):
            words[rows] += counts
            for sums, bounds in found:
                features[rows] += np.diff(bounds)
                weight[rows] += np.diff(np.concatenate([[0], np.cumsum(table[sums % np.uint32(len(table))])])[bounds])
        return pa.StructArray.from_arrays([pa.array(words), pa.array(features), pa.array(weight)], ["n_words", "n_features", "weight"])

    rows = documents.drop("n_words", "n_features", "weight")
    return rows.withColumn("_bag", run(F.col(text).cast("string"))).select(*rows.columns, "_bag.n_words", "_bag.n_features", "_bag.weight")


def with_score(rows: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Adds `score`: the weight plus Gumbel noise in thousandths from the SHA-256 of seed and key (a missing key is empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def importance(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, width: int = WIDTH,
               seed: int = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """Every document's key, `n_words`, `n_features`, `weight`, `score` and `rank`.

    Of the N documents with at least `least` words the floor(percent * N / 100) highest scores are drawn; `rank` is 1, 2, 3… in that order and missing elsewhere. Ties go to
    the smaller key, missing keys last; rows of equal key and score are ranked in any order. Repeated rows count every time. A missing or empty text has no words, features
    or weight. Other columns are not read. Without target texts all gains come from the documents alone; an empty table gives no rows.

    Buckets are added up in the tasks and gains are one number a bucket; drawing sorts (score, key) in ranges and numbers them range by range.
    """
    gain = gains(_dense(bucket_counts(documents, text, buckets, width), buckets), _dense(bucket_counts(target, target_text, buckets, width), buckets))
    rows = documents.select(F.col(key), F.col(text).cast("string").alias("_text"))
    scored = written(with_score(weighed(rows, gain, "_text", width), key, seed).drop("_text"), "scores")
    able = F.col("n_words") >= least
    drawn = percent * scored.where(able).count() // 100
    # Repeated rows may be many: their place in the table ends ties, so that no range has to hold them all.
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("n_features"), F.asc("_row")]
    ordered = scored.where(able).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # range, then place in it
    ordered = written(ordered.select(*scored.columns, F.shiftright(number, 33).alias("_part"), number.bitwiseAND((1 << 33) - 1).alias("_place")), "ordered")
    sizes = ordered.groupBy("_part").agg(F.max("_place").alias("last"))
    base = sizes.select("_part", F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rank = F.col("_base") + F.col("_place") + 1
    ranked = ordered.join(F.broadcast(base), "_part").select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))  # base: a row per range
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
