"""License scans by patience alignment.

A template and a stretch of text are aligned at the words that each of them holds exactly once: the longest increasing run of these anchors is kept, and the gaps between
them are aligned the same way, where other words have become unique; a gap without any falls back to the longest common subsequence. The share of the template's words
that are aligned is its coverage. Where to align is told by the length of the longest common subsequence, kept as the bits of one number per template.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm import words

#: Least share of the template's words that must be aligned, and least share of the words from the first to the last aligned one.
COVERAGE, DENSITY = 0.8, 0.6


def _longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs, which ascend in the first number, that ascends in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [b], [i]
    run, i = [], ends[-1] if ends else -1
    while i >= 0:
        run.append(pairs[i])
        i = back[i]
    return run[::-1]


def _bits(a: Sequence[int]) -> dict[int, int]:
    """The places of each word as bits."""
    bits: dict[int, int] = {}
    for i, word in enumerate(a):
        bits[word] = bits.get(word, 0) | 1 << i
    return bits


def _steps(bits: dict[int, int], size: int, b: Iterable[int]) -> Iterator[int]:
    """For each beginning of b a number whose bit i is 0 where word i of a makes the longest common subsequence of a's beginning longer."""
    full = (1 << size) - 1
    now = full
    for word in b:
        both = now & bits.get(word, 0)
        if both:
            now = (now + both | now - both) & full
        yield now


def _common(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Longest common subsequence as pairs of places."""
    steps = list(_steps(_bits(a), len(a), b))
    i, j, found = len(a), len(b), []
    while i and j:
        if steps[j - 1] >> i - 1 & 1:
            i -= 1
            continue
        j -= 1
        if not j or steps[j - 1] >> i - 1 & 1:
            i -= 1
            found.append((i, j))
    return found[::-1]


def _first_end(bits: dict[int, int], size: int, b: Iterable[int], need: int) -> int:
    """How many words of b it takes to have `need` in common, 0 if all of them do not."""
    for j, now in enumerate(_steps(bits, size, b), 1):
        if size - now.bit_count() >= need:
            return j
    return 0


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned places of two word sequences, ascending in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        places: list[dict[int, int]] = []
        for seq, low, high in ((a, a0, a1), (b, b0, b1)):
            once: dict[int, int] = {}
            for at in range(low, high):
                once[seq[at]] = -1 if seq[at] in once else at
            places.append(once)
        anchors = _longest_run([(at, places[1][w]) for w, at in sorted(places[0].items(), key=lambda x: x[1]) if at >= 0 and places[1].get(w, -1) >= 0])
        if not anchors:
            found += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        found += anchors
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(found)


def _hashes(text: str) -> list[int]:
    with np.errstate(over="ignore"):
        for _, data, offsets in words.blocks(pa.array([text])):
            return words.Words(data, offsets, space=words.NO_WORD).hashes.tolist()
    return []


def _densest(places: list[tuple[int, int]], need: int, density: float) -> tuple[int, int, int] | None:
    """(first word, word after the last, aligned words) of the longest dense enough part of an alignment with at least `need` words, the earliest of equal ones."""
    for count in range(len(places), need - 1, -1):
        for i in range(len(places) - count + 1):
            first, last = places[i][1], places[i + count - 1][1]
            if count >= density * (last - first + 1):
                return first, last + 1, count
    return None


def matches(template: list[int], text: np.ndarray, coverage: float = COVERAGE, density: float = DENSITY) -> list[tuple[float, int, int, int]]:
    """(coverage, first word, word after the last, aligned words) of all places of a template in a text; places do not overlap and ascend.

    A match holds some of those template words that are rarest in the text, as many kinds as a match may miss and one, and is at most the template's length stretched by
    what the density allows. From word to word the tightest stretch is taken that has enough words in common with the template, and aligned with its surroundings; behind a
    place that is dense enough the search goes on.
    """
    size, need = len(template), max(int(np.ceil(coverage * len(template) - 1e-9)), 1)
    reach = int(size / density) + 1
    kinds, counts = np.unique(text[np.isin(text, np.array(template, np.uint64))], return_counts=True)
    have = dict(zip(kinds.tolist(), counts.tolist()))
    amounts = Counter(template)
    missed, tried = 0, []
    for w in sorted(amounts, key=lambda w: (have.get(w, 0), w)):
        tried.append(w)
        missed += amounts[w]
        if missed > size - need:
            break
    starts = np.flatnonzero(np.isin(text, np.array(tried, np.uint64)))
    bits, mirrored = _bits(template), _bits(template[::-1])
    found: list[tuple[float, int, int, int]] = []
    low = floor = 0
    while True:
        at = int(np.searchsorted(starts, low))
        if at == len(starts):
            return found
        low = max(low, int(starts[at]) - reach)
        window = text[low : low + 2 * reach].tolist()
        end = _first_end(bits, size, window, need)
        if not end:
            low += reach
            continue
        start = end - _first_end(mirrored, size, window[end - 1 :: -1], need)
        if end - start <= reach:
            origin = max(floor, low + end - reach)
            around = text[origin : low + start + reach].tolist()
            for how, first, stretch in ((align, origin, around), (_common, origin, around), (_common, low + start, window[start:end])):
                place = _densest(how(template, stretch), need, density)
                if place and first + place[0] < low + end and first + place[1] > low + start:  # not a later place
                    break
                place = None
            if place:
                found.append((place[2] / size, first + place[0], first + place[1], place[2]))
                low = floor = first + place[1]
                continue
        low += start + 1


def scan(documents: DataFrame, licenses: dict[str, str], key: str = "doc_id", text: str = "text", coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """One row per document and place of a template: key, license, coverage, first_word, end_word, aligned, template_words.

    Words are runs of letters, digits and other than ASCII characters, with A-Z in lower case. A template is found if at least `coverage` of its words are aligned and they
    make up `density` of the words they span; every such place is given, and places of one template do not overlap. A template is aligned only with texts that hold enough
    of its words at all. A missing or empty text holds none. Repeated rows repeat their findings; other columns are not read. An empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast([(name, _hashes(body)) for name, body in sorted(licenses.items())])
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [(name, body, np.unique(np.array(body, np.uint64))) for name, body in shared.value if body]
        vocabulary = np.unique(np.concatenate([v for _, _, v in templates])) if templates else np.zeros(0, np.uint64)
        member = np.array([np.isin(vocabulary, v) for _, _, v in templates])
        amount = np.array([[body.count(w) for w in vocabulary.tolist()] for _, body, _ in templates])
        for batch in batches:
            rows, low = [], 0
            with np.errstate(over="ignore"):
                for _, data, offsets in words.blocks(batch.column(1)):
                    found = words.Words(data, offsets, space=words.NO_WORD)
                    if len(vocabulary):
                        at = np.minimum(np.searchsorted(vocabulary, found.hashes), len(vocabulary) - 1)
                        hit = np.flatnonzero(vocabulary[at] == found.hashes)
                        owner = np.searchsorted(found.offsets, hit, side="right") - 1
                        held, number = np.unique(owner, return_inverse=True)
                        counts = np.bincount(number * len(vocabulary) + at[hit], minlength=len(held) * len(vocabulary)).reshape(len(held), len(vocabulary))
                        for t, (name, body, _) in enumerate(templates):
                            enough = np.minimum(counts[:, member[t]], amount[t, member[t]]).sum(axis=1) >= coverage * len(body)
                            for doc in held[enough].tolist():
                                own = found.hashes[found.offsets[doc] : found.offsets[doc + 1]]
                                rows += [(low + doc, name, *match, len(body)) for match in matches(body, own, coverage, density)]
                    low += len(offsets) - 1
            if rows:
                place, name, share, first, end, count, size = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(name), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64()),
                                                  pa.array(count, pa.int64()), pa.array(size, pa.int64())],
                                                 names=["key", "license", "coverage", "first_word", "end_word", "aligned", "template_words"])

    found = documents.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        run, f"key {kind}, license string, coverage double, first_word long, end_word long, aligned long, template_words long")
    return found.withColumnRenamed("key", key)
