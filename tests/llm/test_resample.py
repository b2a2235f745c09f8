import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from riskfabric.llm import crc, pieces, queries, resample

FOLDER = "/root/testdata/sf0.001"


def _plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _plain_features(text):
    words = _plain_words(text)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _plain(documents, target, buckets=10_000, least=20, percent=5):
    """doc_id -> rows of (n_features, weight, score, rank), by the definition."""
    bags = [(key, len(_plain_words(text)), [zlib.crc32(f.encode()) % buckets for f in _plain_features(text)]) for key, text in documents]
    everything, wanted = Counter(b for _, _, bag in bags for b in bag), Counter(zlib.crc32(f.encode()) % buckets for _, text in target for f in _plain_features(text))
    s, t = sum(everything.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((everything[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for key, words, bag in bags:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bag)
        rows.append([key, words, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    return sorted((tuple(r) for r in rows), key=str)


def test_checksums_equal_zlib():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 30_000, dtype=np.uint8)
    for sizes in (rng.integers(1, 60, 2000), np.concatenate([rng.integers(0, 40, 500), rng.integers(500, 530, 300), rng.integers(1000, 9000, 200), [512, 513, 1024, 20_000]])):
        starts = rng.integers(0, 10_000, len(sizes))
        assert crc.crc32(data, starts, starts + sizes).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]


def test_grams_of_blocks_and_cut_texts(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "B", "1", " ", "  ", "-", "é", "\n", "word", "x" * 300]) for _ in range(rnd.randrange(80))) for _ in range(60)] + [None, "", "a b " * 400, "y" * 4000]
    for limit in (40, 500, 1 << 20):
        monkeypatch.setattr(pieces.blocks, "__defaults__", (limit, pieces._CUT))
        got, words = [Counter() for _ in texts], [0] * len(texts)
        for rows, counts, found in resample.grams(pa.array(texts)):
            for i, row in enumerate(rows):
                words[row] += int(counts[i])
                for sums, bounds in found:
                    got[row].update(sums[bounds[i] : bounds[i + 1]].tolist())
        assert words == [len(_plain_words(t)) for t in texts]
        assert got == [Counter(zlib.crc32(f.encode()) for f in _plain_features(t)) for t in texts]


def test_op11_equals_the_definition(spark):
    table = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()]
    want = [(r[0], *r[2:]) for r in _plain(table("documents", "doc_id"), table("benchmark", "item_id"))]
    got = queries.op11_importance_resampling(spark, FOLDER)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[4] for r in want)


def test_edges(spark):
    rows = [(1, "one two three " * 9, 5), (2, None, 5), (2, "", 5), (None, "four five " * 12, 5), (7, "rare 'words' " * 20, 5), (7, "rare 'words' " * 20, 5), (9, "a " * 19, 5)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, score int")
    target = spark.createDataFrame([(1, "rare words"), (None, None)], "item_id long, text string")
    got = resample.importance(documents, target, percent=60)
    want = _plain([r[:2] for r in rows], [(1, "rare words"), (None, None)], percent=60)
    assert sorted(map(tuple, got.collect()), key=str) == want and sorted(r.rank for r in got.collect() if r.rank) == [1, 2]
    assert resample.importance(documents.limit(0), target).count() == 0
    assert resample.importance(documents, target.limit(0)).count() == len(rows)
