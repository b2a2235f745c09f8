"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is the sum of the weights of its hashed features; ordered thresholds turn it into probabilities of the grades: P(grade <= k) = logistic(threshold[k] - score).
All grades share the weights. Features are the distinct words of the whole text, the beginnings of its words with their share of them, and the shares of word shapes
(letter case, symbols, digits) and of repeated words in it. Rare features are tamed by the ridge and by how clearly grades differ in holding them, not by a least count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm import words
from riskfabric.llm.shared import release

#: Labelled rows that a model is fitted on at most (those of the smallest hashes), and hashed features.
SAMPLE, FEATURES = 20_000, 1 << 18
#: Steps and ridge of the fit; weight of a share among the features; standard errors between grades at which a feature counts half.
STEPS, RIDGE, SCALE, CLEAR = 150, 3e-4, 4.0, 12.0
#: Feature values that are added up at once.
SLICE = 1 << 21
SHAPES = 64
#: Bytes of the word beginnings that are features, and the weight of the root of their share of a text's words.
BEGINNINGS, PART = (4, 5, 6, 7, 8), 40.0

_KIND = np.zeros((4, 256), dtype=np.int64)  # capitals, small letters (and all bytes of other scripts), digits, symbols
_KIND[0, 0x41:0x5B] = 1
_KIND[1, 0x61:0x7B] = _KIND[1, 0x80:] = 1
_KIND[2, 0x30:0x3A] = 1
_KIND[3, 0x21:0x7F] = 1 - _KIND[:3, 0x21:0x7F].sum(axis=0)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(offsets per text, feature numbers, values) of consecutive blocks of texts."""
    for _, data, offsets in words.blocks(texts):
        found = words.Words(data, offsets)
        counts = np.diff(found.offsets)
        owner = np.repeat(np.arange(len(counts)), counts)
        plain = words.Words(data, offsets, space=words.NO_WORD)
        number = (plain.hashes % np.uint64(FEATURES - SHAPES - 1)).astype(np.int64)
        distinct = np.unique(np.repeat(np.arange(len(counts)), np.diff(plain.offsets)) * FEATURES + number)
        holder = np.repeat(np.arange(len(counts)), np.diff(plain.offsets))
        starts = []
        for size in BEGINNINGS:
            at, hashes = plain.beginnings(size)
            starts.append(holder[at] * FEATURES + (hashes % np.uint64(FEATURES - SHAPES - 1)).astype(np.int64))
        starts, often = np.unique(np.concatenate(starts), return_counts=True)
        often = PART * np.sqrt(often / np.maximum(np.diff(plain.offsets), 1)[starts // FEATURES])
        kinds = []
        for table in _KIND:
            sums = np.concatenate([[0], np.cumsum(table[data])])
            kinds.append(sums[found.ends] - sums[found.starts])
        capitals, small, digits, symbols = kinds
        case = np.where(capitals == 0, 0, np.where((small == 0) & (capitals > 1), 3, np.where(capitals == 1, 1, 2)))
        shape = case * 16 + np.minimum(symbols, 3) * 4 + (digits > 0) * 2 + (capitals + small == 0)
        shares = np.bincount(owner * SHAPES + shape, minlength=len(counts) * SHAPES).reshape(-1, SHAPES) / np.maximum(counts, 1)[:, None]
        again = 1 - np.minimum(np.bincount(distinct // FEATURES, minlength=len(counts)) / np.maximum(counts, 1), 1)
        row, column = np.nonzero(shares)
        full = np.flatnonzero(counts)
        keys = np.concatenate([distinct, starts, row * FEATURES + FEATURES - SHAPES - 1 + column, full * FEATURES + FEATURES - 1])
        values = np.concatenate([np.ones(len(distinct)), often, SCALE * shares[row, column], SCALE * again[full]])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        yield np.searchsorted(keys, np.arange(len(counts) + 1) * FEATURES), keys % FEATURES, values.astype(np.float32)


def _sums(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def descend(loss, state: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """The state after at most `steps` steps of L-BFGS down a loss that gives its value and gradient."""
    value, gradient = loss(state)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, held = -gradient, []
        for move, change, inverse in reversed(moves):
            held.append(inverse * float(move @ way))
            way = way - held[-1] * change
        way *= 1 / (moves[-1][2] * float(moves[-1][1] @ moves[-1][1])) if moves else 1 / max(1.0, float(np.sqrt(gradient @ gradient)))
        for (move, change, inverse), part in zip(moves, reversed(held)):
            way = way + (part - inverse * float(change @ way)) * move
        slope, size = float(gradient @ way), 1.0
        while size > 1e-10:
            after, turned = loss(state + size * way)
            if after <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        move, change = size * way, turned - gradient
        if (bend := float(move @ change)) > 1e-12:
            moves = [*moves[1 - memory :], (move, change, 1 / bend)]
        state, value, gradient = state + move, after, turned
        if np.abs(gradient).max() < 1e-6:
            break
    return state


def evidence(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """0 to 1 per feature: how clearly the rows of some neighbouring grades differ in holding it (shares, which all texts hold, count whole)."""
    z = np.zeros(held.shape[1])
    for low, high, n, m in zip(held, held[1:], rows, rows[1:]):
        both = (low + high) / (n + m)
        z = np.maximum(z, np.abs(low / n - high / m) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n + 1 / m)))
    z[FEATURES - SHAPES - 1 :] = np.inf
    return 1 / (1 + (CLEAR / np.maximum(z, 1e-9)) ** 2)


def fit_arrays(offsets: np.ndarray, numbers: np.ndarray, values: np.ndarray, grades: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model with grades 0 to `top` that fit best, on all rows at once."""
    n, width = len(grades), FEATURES
    # Row ranges of about SLICE values: only these are ever expanded.
    ends = np.unique(np.searchsorted(offsets, np.arange(0, offsets[-1] + SLICE, SLICE), side="left").clip(0, n))
    parts = [(low, high, slice(offsets[low], offsets[high])) for low, high in zip([0, *ends], [*ends, n]) if high > low]
    rows = np.bincount(grades, minlength=top + 1)
    held = np.zeros((top + 1, width))
    for low, high, at in parts:
        grade = np.repeat(grades[low:high], np.diff(offsets[low : high + 1]))
        for g in range(top + 1):
            held[g] += np.bincount(numbers[at][grade == g], minlength=width)
    scale = evidence(held, np.maximum(rows, 1))
    below = np.clip(np.cumsum(rows)[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    cuts = np.log(below / (1 - below))
    cuts = cuts[0] + np.concatenate([[0], np.cumsum(np.maximum(np.diff(cuts), 1e-2))])
    state = np.concatenate([np.zeros(width), cuts[:1], np.log(np.diff(cuts))])

    def loss(state: np.ndarray) -> tuple[float, np.ndarray]:
        weights, first, gaps = state[:width], state[width : width + 1], np.exp(state[width + 1 :])
        cuts = np.concatenate([first, first + np.cumsum(gaps)])
        scaled, slopes = weights * scale, np.zeros(width)
        score = np.concatenate([_sums(offsets[low : high + 1] - offsets[low], scaled[numbers[at]] * values[at]) for low, high, at in parts])
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = _logistic(bounds[grades + 1] - score), _logistic(bounds[grades] - score)
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = (slope_high - slope_low) / n
        gradient = np.empty_like(state)
        for low, high, at in parts:
            slopes += np.bincount(numbers[at], np.repeat(by_score[low:high], np.diff(offsets[low : high + 1])) * values[at], minlength=width)
        gradient[:width] = slopes * scale + RIDGE * weights
        by_cut = np.bincount(grades, -slope_high, top + 1)[:-1] / n + np.bincount(grades, slope_low, top + 1)[1:] / n
        after = np.cumsum(by_cut[::-1])[::-1]
        gradient[width] = after[0]
        gradient[width + 1 :] = after[1:] * gaps
        return RIDGE / 2 * float(weights @ weights) - float(np.log(chance).mean()), gradient

    state = descend(loss, state, STEPS)
    state[:width] *= scale
    first, gaps = state[width : width + 1], np.exp(state[width + 1 :])
    return state[:width].astype(np.float32), np.concatenate([first, first + np.cumsum(gaps)])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts behind each other; each is let go as soon as it is copied."""
    out, at = np.empty(sum(map(len, parts)), parts[0].dtype), 0
    for k, part in enumerate(parts):
        out[at : at + len(part)] = part
        at += len(part)
        parts[k] = None
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to the top grade."""
        return 1 - _logistic(self.thresholds[None, :] - score[:, None])

    def score(self, texts: pa.Array) -> np.ndarray:
        with np.errstate(over="ignore"):
            parts = [_sums(offsets, self.weights[numbers] * values) for offsets, numbers, values in features(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(documents: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", top: int = 2, sample: int = SAMPLE) -> Model:
    """The model of at most `sample` rated documents.

    `ratings` has key and grade (0 to `top`); rows without either are left out. The rated keys of the smallest hashes are taken, so the sample does not depend on
    partitions; its keys, and no others, are broadcast to meet the texts. Features are formed where the texts are; one task fits them. A key rated or stored twice counts twice.
    Without any rated document every weight is zero and the grades are equally likely.
    """
    taken = ratings.where(F.col(key).isNotNull() & F.col(grade).isNotNull()).select(F.col(key).alias("_key"), F.col(grade).cast("int").alias("grade"))
    taken = taken.orderBy(F.xxhash64("_key", F.lit("rated")), "_key", "grade").limit(sample)
    rows = documents.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(taken), "_key").select("grade", "text")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                low = 0
                for offsets, numbers, values in features(batch.column(1)):
                    cut = offsets.astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(cut) - 1), pa.ListArray.from_arrays(cut, pa.array(numbers.astype(np.int32))),
                                                      pa.ListArray.from_arrays(cut, pa.array(values))], names=["grade", "numbers", "parts"])
                    low += len(cut) - 1
        release()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copied out of every batch, so that one copy of the sample is held while fitting and none afterwards.
        held = [(b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy()), b.column(1).flatten().to_numpy().copy(), b.column(2).flatten().to_numpy().copy()) for b in batches if b.num_rows]
        if not held:
            weights, thresholds = np.zeros(FEATURES, np.float32), -np.log(np.arange(top, 0, -1) / np.arange(1, top + 1))
        else:
            rated, sizes, numbers, values = (list(column) for column in zip(*held))
            del held
            numbers, values = _joined(numbers), _joined(values)
            weights, thresholds = fit_arrays(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), numbers, values, np.clip(np.concatenate(rated), 0, top), top)
            del numbers, values
        release()
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype("<f4").tobytes()], "thresholds": [thresholds.tolist()]})

    # All rows of the sample, ordered so that repeated runs add up in one order.
    formed = rows.mapInArrow(form, "grade int, numbers array<int>, parts array<float>")
    row = formed.repartition(1).sortWithinPartitions("grade", F.xxhash64("numbers")).mapInArrow(solve, "weights binary, thresholds array<double>").first()
    if row is None:
        return Model(np.zeros(FEATURES, np.float32), -np.log(np.arange(top, 0, -1) / np.arange(1, top + 1)))
    return Model(np.frombuffer(bytes(row.weights), "<f4"), np.array(row.thresholds))


def rate(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns plus `expected_grade` and `tail` (probability of the top grade). A missing or empty text has no features: its score is zero.

    The model (one number per hashed feature, a megabyte) is broadcast; rows are neither moved nor joined. Columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @F.arrow_udf("struct<expected_grade: double, tail: double>")
    def run(texts: pa.Array) -> pa.Array:
        chances = Model(*shared.value).probabilities(Model(*shared.value).score(texts))
        release()
        return pa.StructArray.from_arrays([pa.array(chances.sum(axis=1)), pa.array(chances[:, -1])], ["expected_grade", "tail"])

    rated = documents.drop("expected_grade", "tail").withColumn("_rated", run(F.col(text).cast("string")))
    return rated.select(*documents.drop("expected_grade", "tail").columns, "_rated.expected_grade", "_rated.tail")


def grades(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 for low quality, 1 for good but toxic text, 2 for good text; rows without a quality have none."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) > 0
    return labels.select("doc_id", F.when(F.col("quality") <= 0, 0).when(F.col("quality") > 0, F.when(toxic, 1).otherwise(2)).alias("grade"))
